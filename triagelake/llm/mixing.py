"""Mixing sources to target weights, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, quoted, table

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
#: Above so many sources, the plan is joined by a shuffle instead of being sent to every executor (about 6 MB).
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column) -> Column:
    """A uniform integer below 2**32 from the hash of the seed and a value."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    Sources take the weights in turn, by code point with null last, and share the whole by weight; a target stops at MOST
    times its source's size, and the excess is shared again. That is the level at which a tank of such vessels stands:
    with sources by cap over weight, the first one that the level of the rest does not overflow gives the level of all.
    The windows run over one row per source.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(WEIGHTS)
    of = of.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1)).withColumn("cap", MOST * F.col("source_size"))
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - before).cast("double") / rest
    of = of.select("*", F.row_number().over(order).alias("place"), level.alias("level"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("place"))
    of = of.select("*", F.min_by("level", fits).over(Window.partitionBy()).alias("shared"))
    return of.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("shared") * F.col("weight")), F.lit(0.0)).alias("target"))


def cuts(sizes: DataFrame, points: DataFrame) -> DataFrame:
    """source, low, high: for both points (source, start, stop) of each source the least draw before which, in the order
    of the draws, the source has so many words or more.

    The words of at most 2**16 ranges of draws are summed up, then those of the draws in the one range that has the
    point; so no window runs over all documents of a source.
    """
    of = lambda df, *names: df.select(F.col("source").alias("of_source"), *names)
    same = F.col("source").eqNullSafe(F.col("of_source"))
    ranges = sizes.groupBy("source", F.shiftright("draw", 16).alias("range")).agg(F.sum("size").alias("words"))
    preceding = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(preceding("source").orderBy("range")), F.lit(0)))
    both = points.select("source", F.posexplode(F.array("start", "stop")).alias("end", "point"))
    last = ranges.join(of(both, "end", "point"), same).where("before < point").groupBy("source", "end", "point").agg(F.max("range").alias("range"), F.max("before").alias("before"))
    last = cut(last)
    inside = sizes.withColumn("range", F.shiftright("draw", 16)).join(sized(of(last, "end", "point", "before", F.col("range").alias("of_range"))), same & (F.col("range") == F.col("of_range")))
    inside = inside.groupBy("source", "end", "point", "before", "draw").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("place", F.col("before") + F.coalesce(F.sum("words").over(preceding("source", "end").orderBy("draw")), F.lit(0)))
    found = inside.where("place >= point").groupBy("source", "end").agg(F.min("draw").alias("draw"))
    found = last.join(of(found, F.col("end").alias("of_end"), "draw"), same & (F.col("end") == F.col("of_end")), "left")
    found = found.select("source", "end", F.coalesce("draw", F.shiftleft(F.col("range") + 1, 16)).alias("draw"))
    least = found.groupBy("source").agg(F.min(F.when(F.col("end") == 0, F.col("draw"))).alias("low"), F.min(F.when(F.col("end") == 1, F.col("draw"))).alias("high"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return points.select("source").join(of(least, "low", "high"), same, "left").select("source", zero("low"), zero("high"))


def plan(docs: DataFrame) -> DataFrame:
    """source, source_size, target, copies_whole, low, high, around: how often documents of each source are repeated.

    Every document is taken floor(target / source_size) times, plus one copy by a draw hashed from the seed and its id,
    whose probability is the fraction. The draws of a source are systematic: its documents stand in the order of their
    draws around a circle as long as their words, and those that begin in an arc of the length of the missing words,
    which starts where a draw of the source says, get the copy. So a source misses its target by a document or so. If the
    arc goes ``around`` the circle's start, draws from ``low`` on and below ``high`` are in it, else those between.
    """
    sizes = cut(docs.select(draw(F.col("doc_id")).alias("draw"), "source", words(F.col("text")).alias("size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of = targets(sizes).withColumn("copies_whole", F.floor(rate))
    rest = F.round(F.col("target") - F.col("copies_whole") * F.col("source_size")).cast("long")
    start = F.floor(draw(F.col("source")) / 2.0**32 * F.col("source_size"))
    of = of.withColumn("start", start).withColumn("end", start + rest).withColumn("around", F.col("end") > F.col("source_size"))
    of = cut(of.withColumn("stop", F.col("end") - F.when(F.col("around"), F.col("source_size")).otherwise(0)).drop("end"))
    found = cuts(sizes, of).withColumnRenamed("source", "of_source")
    of = of.join(found, F.col("source").eqNullSafe(F.col("of_source")))
    return cut(of.select("source", "source_size", "target", "copies_whole", "low", "high", "around"))


def sized(of: DataFrame) -> DataFrame:
    """The plan, marked for broadcast if its rows are few enough; call on a cut table."""
    return F.broadcast(of) if of.count() <= BROADCAST_SOURCES else of


def mix(docs: DataFrame) -> DataFrame:
    """``doc`` (struct of all the columns of docs), size, source_size, target, copies: the decision for every row.

    A null text has size 0; a null source is a source of its own, the last. A source without words has target 0 and its
    documents are taken 0 times. Rows that repeat an id share its draw. An empty table gives an empty result. Whatever
    other columns docs has stay inside ``doc``, so their names cannot clash.
    """
    of = sized(plan(docs)).withColumnRenamed("source", "of_source")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), words(F.col("text")).alias("size"))
    own, low, high = draw(F.col("doc.doc_id")), F.col("low"), F.col("high")
    copy = F.when(F.col("around"), (own >= low) | (own < high)).otherwise((own >= low) & (own < high)).cast("int")
    joined = rows.join(of, F.col("doc.source").eqNullSafe(F.col("of_source")))
    return joined.select("doc", "size", "source_size", "target", (F.col("copies_whole") + copy).alias("copies"))


def repeat(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: every row of docs, with its own columns, as often as ``mix`` takes it."""
    return mix(docs).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


DRAW = "CAST('0x' || substr(md5('{seed}:' || coalesce(CAST({key} AS VARCHAR), 'null')), 1, 8) AS BIGINT)"
SQL = f"""
WITH d AS (SELECT doc_id, source, {DRAW.format(seed=SEED, key="doc_id")} AS draw,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
  CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS place,
  CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source)),
t AS (SELECT *, coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM l WHERE level * weight <= cap ORDER BY place LIMIT 1) * weight), 0) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
  floor({DRAW.format(seed=SEED, key="source")} / 4294967296.0::DOUBLE * source_size) AS start FROM t),
e AS (SELECT *, start + round(target - whole * source_size) AS stop FROM r),
g AS (SELECT source, draw, sum(size) AS words FROM d GROUP BY source, draw),
c AS (SELECT source, draw, coalesce(sum(words) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM g)
SELECT d.doc_id, d.size, e.source_size, CAST(e.target AS DOUBLE) AS target, CAST(d.size * (e.whole +
  CASE WHEN c.place >= e.start AND c.place < e.stop OR c.place < e.stop - e.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.draw = c.draw
"""
