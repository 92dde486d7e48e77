"""Sinks: validated detections, idempotent appends, publish payloads, reports and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.rules import apply_restriction, lookup, violations
from triagelake.operators.similarity import cut


def write_detections(rows: DataFrame, path: str, known: set[str]) -> None:
    """Restricts, checks and appends detections by day; unknown columns and broken constraints are errors."""
    if extra := set(rows.columns) - known:
        raise ValueError(f"unknown columns {sorted(extra)}")
    rows = apply_restriction(rows)
    if not violations(rows).isEmpty():
        raise ValueError("rows break the table's constraints")
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def absent(new: DataFrame, target: DataFrame | None, key: str, order: str) -> DataFrame:
    """The first new row of each key that the target doesn't have; rows without a key are all taken."""
    first = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    first = first if target is None else first.join(target.select(key), key, "left_anti").select(new.columns)
    return first.unionByName(new.where(F.col(key).isNull()))


def payloads(sightings: DataFrame) -> DataFrame:
    """What is published of a sighting: external id, link, clamped priority, source class, shortened context. Restricted
    rows and links that aren't web links are left out."""
    rows = sightings.where(F.col("url").rlike("^https?://") & ~F.col("restricted"))
    source = lookup(F.col("lane"), {"view": "PUBLIC", "click": "PUBLIC"}, "SCRAP")
    priority = F.when(F.coalesce("priority", F.lit("none")) == "none", "standard").otherwise(F.col("priority"))
    return rows.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("external_id"), "url", priority.alias("priority"), source.alias("source"), F.left(F.concat(F.lit("Review ("), "lane", F.lit(")")), F.lit(2000)).alias("context"))


def unified_metrics(frames: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Metric frames under one schema, with ``experiment``; a column that a frame lacks is null."""
    parts = [f.select(F.lit(name).alias("experiment"), *[(F.col(c) if c in f.columns else F.lit(None)).cast("string").alias(c) for c in columns]) for name, f in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def candidate_rows(corpus: DataFrame, strength: Column, patterns: Column, minor: Column) -> DataFrame:
    """The candidates of a corpus (seq, dup_key, channel, side, lang, month, text), a row each: strength, ids of the patterns
    hit, age indicator, and how many posts and channels of the whole corpus have the same text. Where an age indicator is,
    the text is null, so a file of them shows none.

    Rows are made once and kept, with the text of candidates alone; both the candidates and the counts are read from there.
    """
    names = ["seq", "dup_key", "channel", "side", "lang", "month", "strength", "patterns", "minor"]
    rows = corpus.withColumns({"strength": strength, "patterns": patterns, "minor": minor})
    rows = cut(rows.select(*names, F.when(F.col("strength").isNotNull() & ~F.col("minor"), F.col("text")).alias("text")))
    spread = rows.groupBy("dup_key").agg(F.count("*").alias("copies"), F.countDistinct("channel").alias("channels"))
    return rows.where("strength IS NOT NULL").join(spread, "dup_key").select(*names, "copies", "channels", "text")


def candidate_report(corpus: DataFrame, candidates: DataFrame, channels: int = 25, wide: int = 3) -> DataFrame:
    """(section, name, n, total, rate): counts of candidates, never a text, beside those of the corpus where it has them.

    Sections: all, side, lang, month (with totals), strength, pattern, minor, texts (distinct, and ``wide``: in so many
    channels or more), channel (the ``channels`` with most candidates, by name if equal). Unknown values are "unknown".
    """
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    ways = ("side", "lang", "month")
    both = corpus.select(*(known(c).alias(c) for c in ways), F.lit(0).alias("hit"), F.lit(1).alias("post")).unionByName(candidates.select(*(known(c).alias(c) for c in ways), F.lit(1).alias("hit"), F.lit(0).alias("post")))
    names = F.explode(F.array(F.struct(F.lit("all").alias("section"), F.lit("all").alias("name")), *(F.struct(F.lit(c).alias("section"), F.col(c).alias("name")) for c in ways)))
    totals = both.select(names.alias("s"), "hit", "post").groupBy("s.section", "s.name").agg(F.sum("hit").alias("n"), F.sum("post").alias("total")).where("n > 0 OR section = 'all'")
    no_total = F.lit(None).cast("long").alias("total")
    signs = F.explode(F.concat(F.array(F.struct(F.lit("strength").alias("section"), F.col("strength").alias("name"))), F.when(F.col("minor"), F.array(F.struct(F.lit("minor").alias("section"), F.lit("anywhere").alias("name")))).otherwise(F.array()), F.transform("patterns", lambda p: F.struct(F.lit("pattern").alias("section"), p.alias("name")))))
    parts = candidates.select(signs.alias("s")).groupBy("s.section", "s.name").agg(F.count("*").alias("n")).select("section", "name", "n", no_total)
    texts = candidates.groupBy("dup_key").agg(F.max("channels").alias("c")).agg(F.count("*").alias("distinct"), F.count_if(F.col("c") >= wide).alias("wide"))
    texts = texts.select(F.lit("texts").alias("section"), F.stack(F.lit(2), F.lit("distinct"), "distinct", F.lit("wide"), "wide").alias("name", "n")).select("section", "name", "n", no_total)
    most = candidates.groupBy(known("channel").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(channels)
    out = totals.unionByName(parts).unionByName(texts).unionByName(most.select(F.lit("channel").alias("section"), "name", "n", no_total))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("n") / F.col("total")))


def confusion_list(frames: dict[str, DataFrame], by: str, labels: tuple[str, str] = ("positive", "negative")) -> DataFrame:
    """(id, experiment, task, labels, n_pos, n_neg, values): a 2 x 2 matrix for each row of the metric frames, rows by
    reference, columns by prediction. A frame without the column ``by`` is about the task "all"."""
    parts = []
    for name, frame in frames.items():
        task = F.coalesce(F.col(by).cast("string"), F.lit("all")) if by in frame.columns else F.lit("all")
        values = F.array(F.array("tp", "fn"), F.array("fp", "tn"))
        names = F.struct(F.lit(labels[0]).alias("positive"), F.lit(labels[1]).alias("negative"))
        parts.append(frame.select(F.concat_ws("|", F.lit(name), task).alias("id"), F.lit(name).alias("experiment"), task.alias("task"), names.alias("labels"), (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"), values.alias("values")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
