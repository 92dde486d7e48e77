"""64-bit SimHash over character 3-grams with multiplicity."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the overlapping 3-grams of a text; a shorter text is one gram."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    points = np.concatenate([points, np.zeros(max(0, 3 - len(points)), np.uint64)])
    h = points[:-2] * ODD[0] + points[1:-1] * ODD[1] + points[2:] * ODD[2]
    for shift in (30, 27, 31):
        h = (h ^ (h >> np.uint64(shift))) * ODD[0]
    return h ^ (h >> np.uint64(32))


def of_text(text: str | None) -> int | None:
    """Signed bit pattern: bit b is set if more of the gram hashes have it than not (a tie leaves it unset)."""
    if text is None:
        return None
    h = gram_hashes(text)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h)).view(">u8").astype(np.uint64).view(np.int64)[0])


def of_array(texts: pa.Array) -> pa.Array:
    """One text at a time becomes Python's, so that a task holds no second copy of a batch."""
    return pa.array([of_text(t.as_py()) for t in texts], pa.int64())


def simhash(text: Column) -> Column:
    """Fast form: one function over Arrow batches; Spark has no function that folds bits over an array."""
    return F.arrow_udf(of_array, "bigint")(text)


#: Grams whose bits a task remembers before it begins anew.
KNOWN_GRAMS = 1 << 17
#: Stands for no character where a text is shorter than a gram.
PAD = (1 << 21) - 1


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct overlapping 3-grams of a text, 21 bits a character, and how often each stands there; a shorter text is
    one gram."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.concatenate([points, np.full(max(0, 3 - len(points)), PAD)])
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)


def md5_bits(code: int) -> np.ndarray:
    """Of the first 64 bits of a gram's md5, lowest first, 1 for each that is set and -1 for each that is not."""
    gram = "".join(chr(p) for p in (code >> 42, code >> 21 & PAD, code & PAD) if p != PAD)
    bits = np.unpackbits(np.frombuffer(md5(gram.encode(), usedforsecurity=False).digest()[:8], np.uint8))
    return bits[::-1].astype(np.int8) * 2 - 1


def md5_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, votes) of (id, text): for each bit, by how many of the text's grams more have it than not; nothing for null.
    A gram's bits are found once and remembered."""
    place, bits = {}, np.zeros((1024, 64), np.int8)
    for batch in batches:
        votes = np.zeros((batch.num_rows, 64), np.int64)
        for i, text in enumerate(batch["text"]):
            if not text.is_valid:
                continue
            codes, counts = gram_counts(text.as_py())
            if len(place) > KNOWN_GRAMS:
                place, bits = {}, np.zeros((1024, 64), np.int8)
            at = [place.get(c, -1) for c in codes.tolist()]
            if -1 in at:
                for k, c in enumerate(codes.tolist()):
                    if at[k] < 0:
                        if len(place) == len(bits):
                            bits = np.concatenate([bits, np.zeros_like(bits)])
                        at[k] = place[c] = len(place)
                        bits[at[k]] = md5_bits(c)
            votes[i] = counts.astype(float) @ bits[at]
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 64)
        lists = pa.ListArray.from_arrays(offsets, pa.array(votes.reshape(-1)))
        yield pa.record_batch([batch["id"], lists], ["id", "votes"]).filter(batch["text"].is_valid())


def simhash_md5(texts: DataFrame) -> DataFrame:
    """(id, simhash): 64 bits by md5 and plain aggregation, which any SQL engine can repeat; a signed bit pattern.

    A task counts the grams of each text where it stands, so no gram is ever a row; texts of one id vote together.
    """
    schema = StructType([texts.schema["id"], StructField("votes", ArrayType(LongType()))])
    votes = texts.select("id", "text").mapInArrow(md5_votes, schema)
    of = votes.groupBy("id").agg(*[F.sum(F.get("votes", F.lit(b))).alias(f"b{b}") for b in range(64)])
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return of.select("id", value.alias("simhash"))


def simhash_sql(table: str, id: str, text: str = "text") -> str:
    """The same as common tables ``values_<table>`` (id, value) for the oracle."""
    bits = lambda name, k: " + ".join(f"CASE WHEN b{32 * k + b} > 0 THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(32))
    sums = ", ".join(f"sum(CASE WHEN ({name} >> {b}) & 1 = 1 THEN n ELSE -n END) AS b{32 * k + b}" for k, name in enumerate(("low", "high")) for b in range(32))
    return f"""g_{table} AS (SELECT {id} AS id, unnest(CASE WHEN length({text}) <= 3 THEN [{text}] ELSE list_transform(range(1, length({text}) - 1), lambda i: substr({text}, i, 3)) END) AS g FROM {table}),
c_{table} AS (SELECT id, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) AS high, CAST('0x' || substr(md5(g), 9, 8) AS BIGINT) AS low, count(*) AS n FROM g_{table} GROUP BY id, g),
s_{table} AS (SELECT id, {sums} FROM c_{table} GROUP BY id),
v_{table} AS (SELECT id, {bits("low", 0)} AS low, {bits("high", 1)} AS high FROM s_{table}),
values_{table} AS (SELECT id, CAST(CASE WHEN high >= 2147483648 THEN high - 4294967296 ELSE high END * 4294967296 + low AS BIGINT) AS value FROM v_{table})"""
