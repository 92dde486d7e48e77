"""Classifier evaluation: thresholds, curves, calibration, rankings, agreement, resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.metrics import confusion, rates, ratio
from triagelake.operators.ranges import running_sums


def by_score(rows: DataFrame) -> DataFrame:
    """(score, pos, neg): one row per distinct score, so that later windows run over scores, not over rows."""
    return rows.groupBy("score").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve with tied scores averaged: pairs won plus half the pairs tied, over all pairs."""
    below = running_sums(by_score(rows), [F.col("score")], "neg")
    won = below.agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return won.select(ratio(F.col("won").cast("double"), F.col("p") * F.col("n")).alias("auroc"), "p", "n")


def roc(rows: DataFrame) -> DataFrame:
    """(score, tpr, fpr, sent): a point for each distinct score, where rows at that score or above are positive."""
    scores = by_score(rows)
    above = running_sums(scores, [-F.col("score")], "pos", "neg")
    total = F.broadcast(scores.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")))  # one row
    points = above.join(total).select("score", (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_neg") + F.col("neg")).alias("fp"), "p", "n")
    return points.select("score", ratio(F.col("tp"), F.col("p")).alias("tpr"), ratio(F.col("fp"), F.col("n")).alias("fpr"), ((F.col("tp") + F.col("fp")) / (F.col("p") + F.col("n"))).alias("sent"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The score with the largest TPR - FPR, the highest of equals."""
    return roc(rows).agg(F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("gain"), F.col("score"))).alias("m")).select("m.score", "m.gain")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share): the last bin takes 1.0."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("share"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    ece = calibration(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("share"))) / F.sum("n")).alias("ece"))
    brier = rows.agg(F.avg(F.pow(F.col("score") - F.col("y").cast("double"), 2)).alias("brier"))
    return ece.join(F.broadcast(brier))  # one row each


def metrics(rows: DataFrame, predicted: Column, *by: str) -> DataFrame:
    counts = rows.groupBy(*by).agg(*confusion(F.col("y"), predicted)) if by else rows.agg(*confusion(F.col("y"), predicted))
    return counts.withColumns(rates())


def threshold_for_recall(rows: DataFrame, target: float) -> DataFrame:
    """The highest threshold that keeps ``target`` of the positives: floor((1 - target) * n) may be lost; none: 0.0."""
    at = by_score(rows).where("pos > 0")
    total = F.broadcast(at.agg(F.sum("pos").alias("n")))  # one row
    placed = running_sums(at, [F.col("score")], "pos").withColumn("upto", F.col("before_pos") + F.col("pos")).join(total)
    return placed.where(F.col("upto") > F.floor(F.lit(1 - target) * F.col("n"))).agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("threshold"))


def recall_at_budget(rows: DataFrame, budget: float) -> DataFrame:
    """Recall if at most ``budget`` of the rows are sent: the threshold is the linear quantile of the scores."""
    at = rows.agg(F.percentile("score", F.lit(1 - budget)).alias("threshold"))
    sent = rows.join(F.broadcast(at))
    return sent.groupBy("threshold").agg((F.count_if((F.col("score") >= F.col("threshold")) & F.col("y")) / F.greatest(F.count_if("y"), F.lit(1))).alias("recall"))


def cascade(rows: DataFrame, threshold: Column, filter_s: float, judge_s: float) -> DataFrame:
    """A cheap filter before the judge: what it sends, positives it loses, and the estimated seconds and speed-up."""
    sent = F.col("score") >= threshold
    out = rows.agg(*confusion(F.col("y"), F.when(sent, F.col("judge")).otherwise(False)), F.count_if(sent).alias("sent"), F.count_if(~sent & F.col("y")).alias("lost"))
    per = F.lit(filter_s) + ratio(F.col("sent"), F.col("n")) * judge_s
    return out.withColumns(rates()).withColumns({"share_sent": ratio(F.col("sent"), F.col("n")), "seconds": per, "speed_up": F.lit(judge_s) / per})


def resampled(pos: int, neg: int, score: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a score's positives and negatives, how often each replica draws them: Poisson counts, from a generator of the
    score's own, so that neither the order of rows nor how they are dealt matters."""
    rng = np.random.Generator(np.random.Philox(key=int(np.float64(score).view(np.uint64))))
    return rng.poisson(pos, replicas), rng.poisson(neg, replicas)


def bootstrap_auroc(rows: DataFrame, replicas: int = 2000) -> DataFrame:
    """95% interval of AUROC by Poisson resampling: every row is drawn Poisson(1) times in each replica.

    Rows are counted by score first. Scores are dealt by range, and a range gives each replica's positives, negatives and
    pairs won inside it; replicas are put together from one row a range.
    """
    schema = "range int, replica int, pos long, neg long, won double"

    def run(batches):
        at, total, won = 0, np.zeros((2, replicas), np.int64), np.zeros(replicas)
        for batch in batches:
            for score, p, n in zip(batch["score"], batch["pos"], batch["neg"]):
                pos, neg = resampled(p, n, score, replicas)
                won += pos * (total[1] + neg / 2)
                total += (pos, neg)
            at = batch["range"].iloc[0] if len(batch) else at
        if total.any():
            yield pd.DataFrame({"range": at, "replica": np.arange(replicas), "pos": total[0], "neg": total[1], "won": won})

    dealt = by_score(rows).repartitionByRange("score").sortWithinPartitions("score").withColumn("range", F.spark_partition_id())
    parts = dealt.mapInPandas(run, schema)
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("replica").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = parts.withColumn("below", below).groupBy("replica").agg((F.sum(F.col("won") + F.col("pos") * F.col("below")) / (F.sum("pos") * F.sum("neg"))).alias("a"))
    return per.agg(F.percentile("a", F.lit(0.025)).alias("low"), F.percentile("a", F.lit(0.975)).alias("high"), F.count("*").alias("replicas"))


def two_sided(b: int, c: int) -> float:
    """Twice the binomial tail up to the smaller of two discordant counts, at most 1. Terms are taken from the largest
    down while they matter, some multiples of the root of b + c at most."""
    n, k = b + c, min(b, c)
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    total = term = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < total * 1e-18:
            break
    return min(1.0, 2 * math.exp(top) * total)


def mcnemar(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """Exact two-sided McNemar test of two systems' correctness: b and c are the discordant counts, p is 1 without any."""
    counts = rows.agg(F.count_if(first & ~second).alias("b"), F.count_if(~first & second).alias("c"))
    p = F.pandas_udf(lambda b, c: pd.Series([two_sided(int(x), int(y)) for x, y in zip(b, c)]), "double")
    return counts.withColumn("p", p("b", "c"))


def missed_items(rows: DataFrame, key: str, right: dict[str, Column]) -> DataFrame:
    """(key, missed_by, systems): which systems miss each item that one misses, by name; unknown verdicts are no misses."""
    systems = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in sorted(right.items())]))
    return rows.select(key, F.size(systems).alias("missed_by"), systems.alias("systems")).where("missed_by > 0")


def speed_up(rows: DataFrame, sent: Column, front_s: float, judge_s: float, replicas: int = 2000, seed: int = 11) -> DataFrame:
    """n, sent, speed_up, low, high: how many times faster a filter before the judge makes it, with the 95 % bootstrap
    interval. Nulls without rows.

    A resample of n rows sends a binomial number of them on, so replicas are drawn from two counts, never from rows.
    """
    counts = rows.agg(F.count("*").alias("n"), F.count_if(sent).alias("sent"))
    gain = lambda share: judge_s / (front_s + share * judge_s)

    def run(batches):
        for batch in batches:
            for n, k in zip(batch["n"], batch["sent"]):
                if n:
                    shares = np.random.default_rng(seed).binomial(n, k / n, replicas) / n
                    yield pd.DataFrame({"n": n, "sent": k, "speed_up": gain(k / n), "replica": gain(shares)})
                else:
                    yield pd.DataFrame({"n": [0], "sent": [0], "speed_up": [None], "replica": [None]})

    drawn = counts.mapInPandas(run, "n long, sent long, speed_up double, replica double")
    return drawn.groupBy("n", "sent", "speed_up").agg(F.percentile("replica", F.lit(0.025)).alias("low"), F.percentile("replica", F.lit(0.975)).alias("high"))


def throughput(rows: DataFrame, seconds: Column, run_seconds: float, tokens: dict[str, Column]) -> DataFrame:
    """One row on a run: n, per_minute, per_10_min, mean_latency, max_latency, and the mean of each count of tokens, a null
    one counted as 0. Means are null without rows."""
    latency = [F.avg(seconds).alias("mean_latency"), F.max(seconds).alias("max_latency")]
    per = lambda s: (F.count("*") * (s / run_seconds)) if run_seconds > 0 else F.lit(None).cast("double")
    return rows.agg(F.count("*").alias("n"), per(60.0).alias("per_minute"), per(600.0).alias("per_10_min"), *latency, *(F.avg(F.coalesce(c, F.lit(0))).alias(f"{name}_mean") for name, c in tokens.items()))


def histogram(rows: DataFrame, score: Column, edges: list[float], *by: str) -> DataFrame:
    """(by, bin, low, n): how many scores lie in each bin from an edge to the next, its end left out, but that of the last
    bin; bins without a score have 0. Null scores and those outside count nowhere."""
    last = len(edges) - 2
    of = F.lit(None).cast("int")
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        of = F.when((score >= low) & ((score < high) | (F.lit(k == last) & (score == high))), k).otherwise(of)
    counts = rows.select(*by, of.alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    bins = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(float(low)).alias("low")) for k, low in enumerate(edges[:-1])])
    every = (rows.select(*by).distinct() if by else rows.limit(1).select()).select(*by, F.explode(bins).alias("b")).select(*by, "b.bin", "b.low")
    same = F.lit(True)
    for c in ("bin", *by):
        same = same & every[c].eqNullSafe(counts[c])
    return every.join(counts, same, "left").select(*(every[c] for c in by), every["bin"], "low", F.coalesce("n", F.lit(0)).alias("n"))


def run_health(rows: DataFrame) -> DataFrame:
    """One row of counts over (error, reason, possible_minor, p_true): n, valid, invalid_json, timeouts, server_errors,
    refusals (valid, without a reason, not restricted), restricted, without_probability."""
    valid, minor = F.col("error").isNull(), F.coalesce("possible_minor", F.lit(False))
    failed = {"invalid_json": "invalid_json", "timeouts": "timeout", "server_errors": "server_error"}
    return rows.agg(
        F.count("*").alias("n"), F.count_if(valid).alias("valid"), *(F.count_if(F.col("error").startswith(start)).alias(name) for name, start in failed.items()),
        F.count_if(valid & ~minor & (F.coalesce("reason", F.lit("")) == "")).alias("refusals"), F.count_if(valid & minor).alias("restricted"), F.count_if(valid & ~minor & F.col("p_true").isNull()).alias("without_probability"),
    )
