"""Shared helpers of the training-data operators: lineage cuts, words, link components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage defines it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, so that later reads survive lost executors.

    The folder is the session's ``spark.checkpoint.dir``; only in local mode, where that is unset, a folder is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return df.checkpoint(eager=True)


def tasks(df: DataFrame) -> int:
    """As many tasks as the session's shuffles have, where work is not in proportion to bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def quoted(column: str) -> str:
    """A column's name as select() takes it, whatever signs it has."""
    return "`" + column.replace("`", "``") + "`"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() parts at exactly the six white spaces of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def give_back() -> None:
    """What this process has freed goes back to the machine: a task's worker waits for other work, and the driver goes on to
    other stages after it has fitted a model."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def tidy(run):
    """An Arrow function after whose last batch ``give_back`` follows, when what it held is free."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


class Memo(dict):
    """A dict that computes missing values. ``trim`` keeps the newest ``most`` entries or so, and what was used lately."""

    def __init__(self, make, most: int = 100_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.old = {}


def crc_mod(doc_id, n: int):
    """Column: crc32 of the id as text, modulo n. A null id has remainder null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def fold(doc_id, n: int) -> int | None:
    """The same for one Python value."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable from it.

    Alternates the large-star and small-star steps over edges until nothing changes; each step is an aggregation
    with map-side combine and a join on the same key, so a node with very many neighbours is split by AQE, and no
    component is ever gathered in one task. Nulls and self-links are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, seen = cut(e), None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = now
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # every node keeps its smallest neighbour; its other smaller neighbours move there
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(down).where("u > v").distinct())


def block_forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """At most len(rows) + len(cols) of the True cells of ``linked`` that connect the same nodes as all of them.

    rows and cols are node ids. Nodes are reached breadth first, a whole frontier of matrix rows at a time.
    """
    out: list[tuple[int, int]] = []
    left, right = linked.any(axis=1), linked.any(axis=0)
    while left.any():
        start = int(np.flatnonzero(left)[0])
        left[start] = False
        frontier = np.array([start])
        while len(frontier):
            new = np.flatnonzero(linked[frontier].any(axis=0) & right)
            if not len(new):
                break
            right[new] = False
            by = frontier[linked[np.ix_(frontier, new)].argmax(axis=0)]
            out += zip(rows[by].tolist(), cols[new].tolist())
            back = np.flatnonzero(linked[:, new].any(axis=1) & left)
            if not len(back):
                break
            left[back] = False
            by = new[linked[np.ix_(back, new)].argmax(axis=1)]
            out += zip(rows[back].tolist(), cols[by].tolist())
            frontier = back
    return out
