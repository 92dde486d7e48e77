"""Joins and aggregates over time intervals of a parent (a video and its segments, phrases, passages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 600.0


def overlapping(left: DataFrame, right: DataFrame, parent: str, bucket: float = BUCKET) -> DataFrame:
    """All pairs of rows of the same parent whose half-open intervals overlap; columns of ``right`` get the prefix r_.

    Equal keys are (parent, time bucket), so a very long parent is spread over its buckets; a pair is taken only in the
    bucket where the later of the two begins, so it comes once.
    """
    cover = lambda s, e: F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))
    a = left.withColumn("_b", F.explode(cover("start_s", "end_s")))
    b = right.select(*[F.col(c).alias(c if c == parent else f"r_{c}") for c in right.columns]).withColumn("_b", F.explode(cover("r_start_s", "r_end_s")))
    pairs = a.join(b, [parent, "_b"]).where("start_s < r_end_s AND end_s > r_start_s")
    return pairs.where(F.col("_b") == F.floor(F.greatest("start_s", "r_start_s") / bucket)).drop("_b")


def texts_of_segments(segments: DataFrame, phrases: DataFrame) -> DataFrame:
    """(video, idx, text): the phrases that overlap each segment, in order, joined by spaces."""
    pairs = overlapping(segments.select("video", "idx", "start_s", "end_s"), phrases.select("video", "start_s", "end_s", "text"), "video")
    texts = pairs.groupBy("video", "idx").agg(F.array_sort(F.collect_list(F.struct("r_start_s", "r_end_s", "r_text"))).alias("l"))
    return texts.select("video", "idx", F.array_join(F.transform("l", lambda x: x.r_text), " ").alias("text"))


def video_scores(segments: DataFrame) -> DataFrame:
    """video, score, any_positive, top (the three most likely positive segments), errors: one row per video.

    Only the three best of each video are gathered, whatever its length.
    """
    best = Window.partitionBy("video").orderBy(F.desc("p"), "idx")
    top = segments.where("positive").withColumn("n", F.row_number().over(best)).where("n <= 3").groupBy("video").agg(F.array_sort(F.collect_list(F.struct("n", "idx"))).alias("l"))
    total = segments.groupBy("video").agg(F.max("p").alias("score"), F.bool_or("positive").alias("any_positive"), F.count_if(F.col("role") == "tool").alias("errors"))
    return total.join(top, "video", "left").select("video", "score", "any_positive", F.array_join(F.transform("l", lambda x: x.idx.cast("string")), ",").alias("top"), "errors")


def covered(intervals: DataFrame, parent: str) -> DataFrame:
    """(parent, covered): length of the union of a parent's intervals."""
    order = Window.partitionBy(parent).orderBy("start_s", "end_s")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    length = F.greatest(F.lit(0.0), F.col("end_s") - F.greatest(F.col("start_s"), F.coalesce(reach, F.col("start_s"))))
    return intervals.withColumn("new", length).groupBy(parent).agg(F.sum("new").alias("covered"))


def timeline(segments: DataFrame, passages: DataFrame) -> DataFrame:
    """segments with ``flagged``, the most likely positive segment of its video (the first of equals), and ``in_passage``,
    whether one of the annotated passages (video, start_s, end_s) overlaps it. Null p is never flagged."""
    best = segments.where("positive AND p IS NOT NULL").groupBy("video").agg(F.min_by("idx", F.struct(-F.col("p"), "idx")).alias("_top"))
    met = overlapping(segments.select("video", "idx", "start_s", "end_s"), passages.select("video", "start_s", "end_s"), "video").select("video", "idx").distinct().withColumn("_met", F.lit(True))
    rows = segments.join(best, "video", "left").join(met, ["video", "idx"], "left")
    return rows.select(*segments.columns, F.coalesce(F.col("idx") == F.col("_top"), F.lit(False)).alias("flagged"), F.coalesce("_met", F.lit(False)).alias("in_passage"))
