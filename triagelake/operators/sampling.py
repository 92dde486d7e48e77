"""Draws, splits and segments: repeatable by hash, sequential only where order decides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators.similarity import IMAGE_LIMIT, cut, first_independent, hamming_pairs


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def quota_draw(rows: DataFrame, key: str, stratum: str, quota: int, excluded: Column, seed: str) -> DataFrame:
    """(key, stratum, state): the first ``quota`` rows per stratum in hash order that are not excluded.

    Exclusions count only up to the row that filled the quota. ``state`` is kept or excluded.
    """
    order = Window.partitionBy(stratum).orderBy(hash_order(key, seed), key)
    ranked = rows.withColumn("excluded", excluded).withColumn("kept_so_far", F.count_if(~F.col("excluded")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.when(F.col("excluded"), F.col("kept_so_far") < quota).otherwise(F.col("kept_so_far") <= quota)
    return ranked.where(inside).select(key, stratum, F.when(F.col("excluded"), "excluded").otherwise("kept").alias("state"))


#: Hexadecimal digits of a hash by which rows are counted before the border of a draw is looked for: 65,536 counts at most.
DIGITS = 4


def first_of_each(rows: DataFrame, key: str, stratum: str, wanted: DataFrame, seed: str) -> DataFrame:
    """rows with ``first``: whether a row is among the first n of its stratum in hash order; wanted is (stratum, n).

    Rows are counted by the beginning of their hash, which finds where each stratum's border lies. Only rows with the same
    beginning as the border are put in order, a 65,536th of a stratum, so no stratum is ever sorted.
    """
    h = rows.withColumn("_h", hash_order(key, seed)).withColumn("_p", F.left("_h", F.lit(DIGITS)))
    counts = h.groupBy(F.col(stratum).alias("_s"), "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_p")
    upto = counts.withColumn("_upto", F.sum("_n").over(before)).join(wanted.select(F.col(stratum).alias("_w"), F.col("n").cast("long").alias("_most")), F.col("_s").eqNullSafe(F.col("_w"))).drop("_w")
    border = upto.where("_upto >= _most").groupBy("_s", "_most").agg(F.min("_p").alias("_border"), F.min_by(F.col("_upto") - F.col("_n"), "_p").alias("_before"))
    # a stratum that has fewer rows than wanted has no border
    known = wanted.select(F.col(stratum).alias("_s")).join(border.withColumnRenamed("_s", "_b"), F.col("_s").eqNullSafe(F.col("_b")), "left").drop("_b")
    h = h.join(F.broadcast(known), F.col(stratum).eqNullSafe(F.col("_s")), "left")  # one row for each stratum
    at = F.coalesce(F.col("_p") == F.col("_border"), F.lit(False))
    clear = h.where(~at).withColumn("first", F.coalesce(F.col("_p") < F.col("_border"), F.lit(True)))
    order = Window.partitionBy(stratum).orderBy("_h", key)
    tied = h.where(at).withColumn("first", F.row_number().over(order) <= F.col("_most") - F.col("_before"))
    return clear.unionByName(tied).select(*rows.columns, "first")


def split(rows: DataFrame, key: str, stratum: str, share: float, seed: str) -> DataFrame:
    """(key, stratum, part): dev is the first round(share * n) of each stratum in hash order, halves to even."""
    wanted = rows.groupBy(stratum).agg(F.bround(F.lit(share) * F.count("*")).cast("long").alias("n"))
    drawn = first_of_each(rows.select(key, stratum), key, stratum, wanted, seed)
    return drawn.select(key, stratum, F.when(F.col("first"), "dev").otherwise("train").alias("part"))


def draw_without_copies(rows: DataFrame, quotas: dict[str, int], seed: str, limit: int = IMAGE_LIMIT) -> DataFrame:
    """(id, stratum, state) of rows (id, stratum, value, reason): of each stratum, in the order of ``quotas``, rows in hash
    order until its quota is kept. ``state`` is kept, the row's own ``reason`` to leave it out, or near_copy: within
    ``limit`` bits of a row that was kept before, in any stratum. Rows after the one that filled the quota are not looked at.

    Near copies of rows that were left out are no reason. A stratum is read in runs of its next rows by hash, a little more
    than are missing, so no stratum is sorted; inside a run the kept rows are an independent set, first in order.
    """
    every = rows.where(F.col("stratum").isin(*quotas)).withColumn("h", hash_order("id", seed))
    kept, out = None, None
    for stratum, quota in quotas.items():
        rest, missing = every.where(F.col("stratum") == stratum), quota
        while missing > 0:
            run = cut(rest.orderBy("h", "id").limit(2 * missing + 16))
            if run.isEmpty():
                break
            free = run.where("reason IS NULL")
            if kept is not None:
                near = hamming_pairs(free.select("value").distinct(), kept.select("value").distinct(), limit).select(F.col("a").alias("value")).distinct()
                free = free.join(near, "value", "left_anti")
            # of equal values only the first can be kept
            order = F.struct("h", "id")
            numbered = cut(free.groupBy("value").agg(F.min(order).alias("at")).select("value", "at.h", "at.id", F.row_number().over(Window.orderBy("at.h", "at.id")).alias("o")))
            new = cut(numbered.join(first_independent(numbered.select("value", "o"), limit).select("o"), "o", "left_semi").orderBy("o").limit(missing))
            n, last = new.count(), new.agg(F.max(order)).first()[0]
            missing -= n
            looked_at = run if missing else run.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("id") <= last["id"]))
            state = looked_at.join(new.select("id", F.lit("kept").alias("state")), "id", "left").select("id", "stratum", F.coalesce("state", "reason", F.lit("near_copy")).alias("state"))
            out = state if out is None else out.unionByName(state)
            kept = new.select("value") if kept is None else cut(kept.union(new.select("value")))
            end = run.agg(F.max(order)).first()[0]
            rest = rest.where((F.col("h") > end["h"]) | (F.col("h") == end["h"]) & (F.col("id") > end["id"]))
    return rows.select("id", "stratum", F.lit("").alias("state")).limit(0) if out is None else out


def round_robin(rows: DataFrame, key: str, category: str, most: int, seed: str) -> DataFrame:
    """Turns over the categories, the rarest first in each turn, until ``most`` rows are drawn: (key, category, place)."""
    ranked = rows.select(key, category).withColumn("turn", F.row_number().over(Window.partitionBy(category).orderBy(hash_order(key, seed), key)))
    ranked = ranked.withColumn("size", F.count("*").over(Window.partitionBy(category)))
    drawn = ranked.orderBy("turn", "size", category).limit(most)
    return drawn.select(key, category, F.row_number().over(Window.orderBy("turn", "size", category)).alias("place"))


def balanced(rows: DataFrame, key: str, positive: Column, seed: str) -> DataFrame:
    """All positives, and as many negatives, the first in hash order."""
    marked = rows.select(key, positive.alias("positive"))
    n = marked.agg(F.count_if("positive").alias("n"))
    drawn = first_of_each(marked.where(~F.col("positive")), key, "positive", n.select(F.lit(False).alias("positive"), "n"), seed)
    return marked.where("positive").unionByName(drawn.where("first").drop("first"))


#: Seconds: shorter scenes are merged, longer ones cut, and windows of this length are taken where nothing is cut.
SHORTEST, LONGEST, WINDOW = 5.0, 20.0, 15.0


def segments_of(cuts: pd.DataFrame) -> pd.DataFrame:
    """Segments of one video from its cut points: short scenes go with the next, a short tail with the one before, long
    ones are cut evenly; without cuts there are windows, of which a tail shorter than a third joins the last."""
    video, duration = cuts["video"].iloc[0], float(cuts["duration"].iloc[0])
    points = sorted(x for x in cuts["cut"].dropna() if 0 < x < duration)
    if points:
        bounds = [0.0]
        for p in points:
            if p - bounds[-1] >= SHORTEST:
                bounds.append(p)
        if duration - bounds[-1] < SHORTEST and len(bounds) > 1:
            bounds.pop()
        bounds.append(duration)
    else:
        bounds = [i * WINDOW for i in range(int(duration // WINDOW) + 1)]
        if len(bounds) > 1 and duration - bounds[-1] < WINDOW / 3:
            bounds.pop()
        bounds.append(duration)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        n = max(1, -int(-(b - a) // LONGEST))
        out += [(video, a + (b - a) * i / n, a + (b - a) * (i + 1) / n) for i in range(n)]
    return pd.DataFrame([(v, i, s, e) for i, (v, s, e) in enumerate(out) if e > s], columns=["video", "idx", "start_s", "end_s"])


def segments(cuts: DataFrame) -> DataFrame:
    """(video, idx, start_s, end_s) from (video, duration, cut) rows; a video's cuts are few and fit one task."""
    return cuts.groupBy("video").applyInPandas(segments_of, "video long, idx int, start_s double, end_s double")
