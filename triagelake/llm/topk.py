"""Exact top-k search by term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BLOCK = 8192
#: Components of all the queries that are sent around at once (64 MB); more queries take more rounds.
CELLS = 8_000_000


def postings(ids: pa.ChunkedArray, terms: pa.ChunkedArray, n_terms: int):
    """Sorted ids and, per term, (positions, weights) of the non-zero components; shorter vectors count as padded by 0."""
    ids = ids.to_numpy()
    order = np.argsort(ids, kind="stable")
    lists = terms.combine_chunks()
    ends = lists.offsets.to_numpy()
    flat, lengths = lists.values.to_numpy(), np.diff(ends)
    dense = np.zeros((len(ids), n_terms), np.int64)
    dense[np.repeat(np.arange(len(ids)), lengths), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)] = flat[ends[0] : ends[-1]]
    dense = dense[order]
    out = []
    for column in dense.T:
        at = np.flatnonzero(column)
        out.append((slice(None) if len(at) == len(column) else at, column[at]))
    return ids[order], out, dense


def blocks_of(batches, size: int):
    """The rows of Arrow batches in tables of ``size`` rows or a few more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def best_of(k: int, block: int, queries):
    """Arrow function over candidates: of each task the k best ones for every query that was sent."""

    def search(batches):
        q_ids, q_dense = queries.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(q_ids)
        for table in blocks_of(batches, block):
            width = int(np.diff(table["terms"].combine_chunks().offsets.to_numpy()).max())
            c_ids, lists, _ = postings(table["id"], table["terms"], width)
            for q, (q_id, row) in enumerate(zip(q_ids, q_dense)):
                scores = np.zeros(len(c_ids), np.int64)
                for term in np.flatnonzero(row[:width]):
                    at, weights = lists[term]
                    scores[at] += row[term] * weights  # positions are distinct within a posting list
                other = c_ids != q_id
                ids, scores = np.concatenate([best[q][0], c_ids[other]]), np.concatenate([best[q][1], scores[other]])
                if len(ids) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    above, ties = scores > least, scores == least
                    tied = np.sort(ids[ties])[: k - int(above.sum())]
                    ids, scores = np.concatenate([ids[above], tied]), np.concatenate([scores[above], np.full(len(tied), least)])
                best[q] = ids, scores
        columns = [np.repeat(q_ids, [len(i) for i, _ in best]), *(np.concatenate([none, *x]) for x in zip(*best))] if len(q_ids) else [none] * 3
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k candidates with the largest inner product for each query: query_id, rank, vec_id, score.

    Both inputs have ``id`` (long) and ``terms`` (array<long>, position = term); other columns are ignored. Queries are
    sent around in rounds of CELLS components at most. Candidates stay where they are: a task goes over its own in
    blocks, each term of a query row scatters its weighted posting list into a dense score array, and a partition
    selection keeps k of the block and of those before it. A ranked window (with Spark's group limit before the shuffle)
    merges the tasks. Ties go to the smaller id. A candidate with the query's own id is the query itself. Rows with null
    id or terms, or a null term, take no part; of repeated ids one vector is used, the smallest as an array. Arrays of
    different length count as padded by zeros; products are 64-bit and wrap beyond. Empty inputs give an empty result.
    """
    valid = F.col("id").isNotNull() & F.col("terms").isNotNull() & ~F.exists("terms", lambda x: x.isNull())
    one = lambda df: df.where(valid).groupBy("id").agg(F.min("terms").alias("terms"))
    q, c = cut(one(queries)), cut(one(candidates))
    n, width = q.agg(F.count("*"), F.max(F.size("terms"))).first()
    rounds = -(-n // max(1, CELLS // max(width or 0, 1)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for r in range(rounds):
        rows = q.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toArrow()
        if not rows.num_rows:
            continue
        ids, _, dense = postings(rows["id"], rows["terms"], width)
        sent = q.sparkSession.sparkContext.broadcast((ids, dense))
        found = c.mapInArrow(best_of(k, block, sent), "query_id long, vec_id long, score long")
        merged = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if rounds == 1:
            return merged
        merged = cut(merged)
        sent.unpersist()
        out = merged if out is None else out.unionByName(merged)
    return q.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def fixed_point(embedding, scale: int = 1024):
    """floor(scale * x) of every component as long; null where the vector holds a null or a non-finite component."""
    terms = F.transform(embedding, lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.floor(F.lit(scale) * x.cast("double"))))
    return F.when(~F.exists(terms, lambda x: x.isNull()), terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), fixed_point(F.col("embedding")).alias("terms"))
    return top_k(vectors.where(F.col("id") % 100 == 0), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.t) + 1), lambda i: q.t[i] * c.t[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
