"""Shards along a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS, BITS = 24, 5


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cell numbers (each below 2**bits) along the Hilbert curve through that grid.

    From the highest bit down, every level mirrors or exchanges the lower bits of the axes as the orientation of the
    visited sub-cube asks; the Gray decoding of the interleaved bits is the position.
    """
    axes = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    for level in reversed(range(1, bits)):
        bit, lower = 1 << level, (1 << level) - 1
        for d, axis in enumerate(axes):
            high = (axis & bit) != 0
            swap = np.where(high, 0, (axes[0] ^ axis) & lower)
            axes[0] = np.where(high, axes[0] ^ lower, axes[0] ^ swap)
            if d:
                axes[d] = axes[d] ^ swap
    code = np.zeros(len(points), np.int64)
    for level in reversed(range(bits)):
        for axis in axes:
            code = code << 1 | axis >> level & 1
    shift = 1
    while shift < bits * len(axes):  # Gray code to number
        code ^= code >> shift
        shift *= 2
    return code


def curve(*cells: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), BITS))


def equal_depth(df: DataFrame, column: str) -> DataFrame:
    """column's values and the cell each falls in when the values, by code point with null first, are cut to equal rows.

    The windows run over one row per value.
    """
    counts = df.groupBy(column).count()
    order = Window.orderBy(F.asc_nulls_first(column)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(order), F.lit(0))
    cell = F.floor(before * (1 << BITS) / F.sum("count").over(Window.partitionBy()))
    return cut(counts.select(F.col(column).alias(f"{column}_value"), cell.cast("int").alias(f"{column}_cell")))


def with_cell(df: DataFrame, column: str) -> DataFrame:
    of = equal_depth(df, column)
    of = F.broadcast(of) if of.count() <= 50_000 else of
    return df.join(of, F.col(column).eqNullSafe(F.col(f"{column}_value")), "left").drop(f"{column}_value")


def order_on_curve(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, lang, source, size, text_crc32, curve and the gapless global ``place`` of each row along the curve; and their number.

    Dimensions: language and source (equal depth), size (binary logarithm). Rows of one cell follow by text checksum, then
    id, so equal texts of one language and source stand together. The rows are dealt by range over the whole key, which
    also splits a cell with very many rows; places are partition offsets plus the number within the partition.
    """
    rows = docs.select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = cut(rows)
    rows = with_cell(with_cell(rows, "lang"), "source")
    cells = (F.col("lang_cell"), F.col("source_cell"), F.floor(F.log2("size")))
    cells = [F.least(c.cast("int"), F.lit((1 << BITS) - 1)) for c in cells]
    rows = rows.select("doc_id", "lang", "source", "size", "text_crc32", F.pandas_udf(curve, "long")(*cells).alias("curve"))
    keys = ("curve", "text_crc32", "doc_id")
    rows = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = rows.groupBy(part.alias("part")).count()
    offset = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(parts.select("part", offset.alias("offset")))  # one row per partition
    total = rows.count()
    place = F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("part", part).join(offsets, "part").select("doc_id", "lang", "source", "size", "text_crc32", "curve", place.alias("place")), total


def dealt(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, curve, shard, slot: runs of the curve, cut so that row counts differ by one
    at most."""
    placed, total = order_on_curve(docs)
    first = F.expr(f"(shard * {total} + {n - 1}) div {n}")
    placed = placed.withColumn("shard", F.expr(f"place * {n} div {max(total, 1)}").cast("int"))
    return placed.withColumn("slot", F.col("place") - first).drop("place")


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve: runs of the curve, cut by rows.

    Row counts of the n shards differ by one at most; slots are gapless in each. A null text has no bytes and checksum 0,
    null languages and sources fall in the first cell; repeated rows each get a slot of their own; an empty table
    gives an empty result. docs needs doc_id, text, lang and source; other columns are ignored.
    """
    return dealt(docs, n).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def ranges(rows: DataFrame) -> DataFrame:
    """Of the rows of ``dealt``: the least and greatest language, source and size of each shard, and whether nulls are in
    it. A filter on any of them needs the shards whose range it meets only."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("lang", "source", "size") for name, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), *ends, *(F.bool_or(F.col(c).isNull()).alias(f"null_{c}") for c in ("lang", "source")))


def write(rows: DataFrame, path: str) -> None:
    """Rows of ``dealt`` as Parquet, one folder a shard and the rows of each in order of their slots; a run that is
    repeated overwrites what it left."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
