"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(ids: DataFrame, label: str, values: list, most: int) -> DataFrame:
    """At most ``most`` (doc_id, label) rows of each value, the first in the order of a hash of the id."""
    parts = [ids.where(F.col(label) == v).select("doc_id", label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in values]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def texts_of(docs: DataFrame, sample: DataFrame, label: str) -> list[tuple[str, object]]:
    """(text, label) of the sampled documents, on the driver, in a fixed order. The sample is bounded, so it is sent."""
    ids = sample.select(F.col("doc_id").alias("sample_id"), F.col(label).alias("sample_label"))
    joined = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id"))
    found = joined.select("doc_id", "text", "sample_label").where(F.col("text").isNotNull()).toArrow()
    rows = sorted(zip(found["doc_id"].to_pylist(), found["text"].to_pylist(), found["sample_label"].to_pylist()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return [(text, value) for _, text, value in rows]


def binary_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, most: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts with label 0 or 1 for fitting, ``most`` of each at most, and how many labelled rows each class has.

    Rows whose label or id is null, or whose label is neither, are left out; of several labels of one id the largest counts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(training)
    of = usable.groupBy("doc_id").agg(F.max(label).alias(label))
    counts = {r[label]: r["count"] for r in of.groupBy(label).count().collect()}
    return texts_of(docs, pick(of, label, [0, 1], most), label), counts
