"""Structured Streaming jobs: what is seen once, limited, released, replayed, published and counted as rows arrive.

Every job takes a streaming frame; what must be remembered is in Spark's state, and each micro-batch is written to a folder
of its number, so that neither a restart nor a batch that is run again repeats anything. ``drain`` runs a query over what
is there and returns the finished table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from triagelake.operators import similarity as S
from triagelake.operators.queue import runs
from triagelake.operators.similarity import shared_folder
from triagelake.sources.snapshots import KeyedTable

LIMIT, WINDOW_S, TIMEOUT_S = 5, 600.0, 1800.0
#: In how many states senders are kept; each has its rows of a micro-batch in memory at once.
SENDER_GROUPS = 512


def folder(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder; a local one only in local mode where that is unset."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The events of a parquet file, or of a folder of files, as a stream in UTC event time."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a plain path would have to be a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(pattern)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    """A micro-batch in a folder of its own number, so that a batch which is run again replaces what it left."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def drain(stream: DataFrame, schema: str, at: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, and returns what it has written: the whole output, in complete mode the last batch.

    ``at`` is the job's folder for its checkpoint and output, a new one by default. A job that is started again there goes
    on where it stopped; a batch that was written but not committed is written again in its place.
    """
    spark = stream.sparkSession
    at = at or folder(spark)
    write = lambda batch, number: write_batch(batch, number, f"{at}/out")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    columns = StructType.fromDDL(schema).names
    out = read_batches(spark, f"{at}/out", f"{schema}, batch long")
    if mode == "complete":
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    return out.select(columns)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_batch`` has written, with its column ``batch``; nothing where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def with_first(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, event_id) in update mode: of each key that arrives for the first time, the least id of its micro-batch; nulls
    are a key of their own. Spark's own aggregation keeps one id a key, so no batch reads what earlier ones wrote.

    Batches are told apart by their time, which the checkpoint keeps, so a batch that runs again has the same one.
    """
    first = rows.withColumn("at", F.current_timestamp()).groupBy(*keys).agg(F.min(F.struct("at", "event_id")).alias("first"))
    return first.where(F.col("first.at") == F.current_timestamp()).select(*keys, "first.event_id")


def first_sightings(rows: DataFrame, at: str | None = None) -> DataFrame:
    """(user_id, event_type, event_id): the first event of each pair over the whole history."""
    return drain(with_first(rows, "user_id", "event_type"), "user_id long, event_type string, event_id long", at, "update")


def bounded_first_sightings(rows: DataFrame) -> DataFrame:
    """The bounded form: repeats within a day are dropped by Spark's own state, which the watermark clears."""
    return rows.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type", "event_id")


def accept(times: list[float], held: list[float], limit: int = LIMIT, window: float = WINDOW_S) -> tuple[list[bool], list[float]]:
    """Which of a sender's rows are taken: at most ``limit`` accepted ones in a sliding window, whose start expires when it
    is strictly older; refused ones don't count; a limit of 0 is off."""
    out = []
    for t in times:
        held = [h for h in held if t - h <= window]
        taken = limit <= 0 or len(held) < limit
        if taken:
            held.append(t)
        out.append(taken)
    return out, held


def limited_sorted(batches):
    held: list[float] = []
    for new, rows in runs(batches, "user_id"):
        taken, held = accept(rows["t"], [] if new else held)
        yield pa.record_batch([pa.array(rows["user_id"], pa.int64()), pa.array(rows["event_id"], pa.int64()), pa.array(taken, pa.bool_())], ["user_id", "event_id", "accepted"])


def rate_limited(events: DataFrame) -> DataFrame:
    """The batch form: every sender's rows stream by in time order; the accepted times in the window are all that is kept."""
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t")).withColumn("t", F.col("t") / 1e6)
    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInArrow(limited_sorted, "user_id long, event_id long, accepted boolean")


def limited_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A group of senders. Their rows of a micro-batch come in several chunks in no order, so all are put in order of time
    before any is judged."""
    held = dict(zip(*state.get)) if state.exists else {}
    rows = pd.concat([b[["user_id", "t", "event_id"]] for b in batches]).sort_values(["t", "event_id"])
    taken = []
    for sender, t in zip(rows["user_id"].tolist(), rows["t"].tolist()):
        (ok,), held[sender] = accept([t], held.get(sender, []))
        taken.append(ok)
    yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "accepted": taken})
    state.update((list(held), list(held.values())))


def rate_limited_stream(rows: DataFrame, groups: int = SENDER_GROUPS) -> DataFrame:
    """The streaming form: the accepted times of a sender are state, at most LIMIT of them. Senders share a state by hash, in
    a number of ``groups`` that a checkpoint keeps, so that a micro-batch takes a call of Python a group, not a sender."""
    sender = F.coalesce(F.col("user_id").cast("string"), F.lit(""))
    rows = rows.select(F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("group"), sender.alias("user_id"), "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    out, kept = "user_id string, event_id long, accepted boolean", "senders array<string>, held array<array<double>>"
    found = rows.groupBy("group").applyInPandasWithState(limited_state, out, kept, "append", GroupStateTimeout.NoTimeout)
    return found.select(F.when(F.col("user_id") != "", F.col("user_id").cast("long")).alias("user_id"), "event_id", "accepted")


def overdue(reports: DataFrame, screened: DataFrame, now: str, timeout: float = TIMEOUT_S) -> DataFrame:
    """(event_id, context): reports older than the timeout that nobody has screened; they go on with a remark."""
    old = reports.where(F.col("ts").cast("timestamp") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(timeout)))
    return old.join(screened.select("event_id"), "event_id", "left_anti").select("event_id", F.lit("not screened in time").alias("context"))


def release_stream(rows: DataFrame) -> DataFrame:
    """The streaming form of ``overdue``: a report opens an event-time session that a screening within the timeout joins; a
    session that closes without one is released. Sessions are in Spark's own state, and the watermark clears them."""
    gap = f"{TIMEOUT_S:.0f} seconds 1 microsecond"  # a session ends when the watermark has passed the timeout, not at it
    of = rows.withWatermark("ts", "0 seconds").groupBy("event_id", F.session_window("ts", gap))
    of = of.agg(F.count_if(F.col("event_type") == "screened").alias("screened"))
    return of.where("screened = 0").select("event_id", F.lit("not screened in time").alias("context"))


def life_cycle(events: DataFrame) -> DataFrame:
    """(user_id, status, note, priority): where each report's states, in order, have led.

    Only a screened item moves on, so its first deciding event fixes the status: an error restricts it, erases its note and
    refuses later ones. So two aggregates a report are enough, combined before they are shuffled.
    """
    deciding = F.when(F.col("event_type").isin("error", "click", "purchase", "view"), F.col("event_id"))
    of = events.groupBy("user_id").agg(F.min_by("event_type", deciding).alias("first"), F.max_by("event_type", "event_id").alias("last"))
    first = F.col("first")
    status = F.when(first.isNull(), "SCREENING").when(first == "error", "RESTRICTED").otherwise("PENDING")
    note = F.when(F.coalesce(first != "error", F.lit(True)), F.col("last"))
    return of.select("user_id", status.alias("status"), note.alias("note"), F.when(first == "view", "none").otherwise("standard").alias("priority"))


def screened(rows: DataFrame) -> DataFrame:
    """(event_id, outcome): a polling worker's pass; a row that fails becomes ``unavailable`` and the batch goes on."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    outcome = F.when(k.isNull() | (k % 10 == 0), "unavailable").when(k > 80, "flagged").otherwise("not_flagged")
    return drain(rows.select("event_id", outcome.alias("outcome")), "event_id long, outcome string")


def published(rows: DataFrame, at: str | None = None) -> DataFrame:
    """(external_id, event_id): every item published once, whatever is retried."""
    item = F.concat(F.lit("s"), (F.col("event_id") - F.col("event_id") % 2).cast("string"))
    return drain(with_first(rows.withColumn("external_id", item), "external_id"), "external_id string, event_id long", at, "update")


def grouped(posts: DataFrame, fingerprints_of: Callable[[DataFrame], DataFrame], near_kinds: dict[str, int], at: str | None = None) -> DataFrame:
    """(seq, group) of a stream of posts that come in order of ``seq``: each joins the group of stored or earlier content as
    ``similarity.content_groups`` says, whatever the micro-batches are.

    Kept between batches, a folder for each: ``owners`` (kind, value, owner, group of every first bearer) and ``index``, the
    values of near kinds as numbers. A batch looks up its own values there. A batch that runs again reads what is older
    than itself and replaces what it left.
    """
    spark = posts.sparkSession
    at = at or folder(spark)
    of_owner, of_index = "kind string, value string, owner long, group long", "kind string, b long, owner long, group long"

    def stored(name: str, schema: str, batch: int) -> DataFrame:
        rows = spark.createDataFrame([], f"{schema}, batch long") if not batch else read_batches(spark, f"{at}/{name}", f"{schema}, batch long")
        return rows.where(F.col("batch") < batch).drop("batch")

    def run(batch: DataFrame, number: int) -> None:
        batch = S.cut(batch.repartition(max(spark.sparkContext.defaultParallelism, batch.rdd.getNumPartitions())))  # however few its files are
        prints = S.cut(fingerprints_of(batch))
        known = S.cut(prints.select("kind", "value").distinct().join(stored("owners", of_owner, number), ["kind", "value"]))
        first = S.first_bearers(prints).join(known.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("group", F.lit(None).cast("long"))
        first = S.cut(first)
        exact = S.cut(S.exact_parents(prints, known.unionByName(first, allowMissingColumns=True)))
        rest = S.cut(prints.join(exact, "seq", "left_anti"))
        near = S.near_parents(rest, stored("index", of_index, number).unionByName(S.near_values(first, near_kinds)), near_kinds)
        own = batch.select("seq").distinct().join(exact.unionByName(near), "seq", "left").select(F.col("seq").alias("id"), "parent")
        own = S.cut(own)
        # groups that are stored stand for themselves
        older = own.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct().join(own.select("id"), "id", "left_anti").withColumn("parent", F.lit(None).cast("long"))
        roots = S.cut(S.chain_roots(own.unionByName(older)).select(F.col("id").alias("seq"), F.col("root").alias("group")))
        first = first.drop("group").join(roots.withColumnRenamed("seq", "owner"), "owner").select("kind", "value", "owner", "group")
        write_batch(first, number, f"{at}/owners")
        write_batch(S.near_values(first, near_kinds), number, f"{at}/index")
        write_batch(batch.select("seq").distinct().join(roots, "seq"), number, f"{at}/out")

    posts.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    return read_batches(spark, f"{at}/out", "seq long, group long, batch long").drop("batch")


def arrived(spark: SparkSession, at: str) -> KeyedTable:
    """Of each batch of ``daily_counts``: rows that came, and rows that the state had at its end."""
    return KeyedTable(spark, f"{at}/arrived", ["batch"], "batch long, n long, state_rows long", buckets=1)


def daily_counts(rows: DataFrame, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(day, event_type, n), kept current, and (arrived, late): how many rows have come, and how many of them too late.

    A day is closed, and its state cleared, when the watermark (two days behind) has passed it; rows for it are then late
    and change nothing (Spark lets the batch during which it passes still count). Each batch writes the counts that it changed over the open days' former ones, by key. A row that
    has come and is in no count was late, so late rows are counted exactly.
    """
    spark = rows.sparkSession
    at = at or folder(spark)
    table = KeyedTable(spark, f"{at}/days", ["day", "event_type"], "day date, event_type string, n long", buckets=4)
    seen = arrived(spark, at)
    counts = rows.observe("arrived", F.count(F.lit(1)).alias("n")).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    counts = counts.select(F.to_date("window.start").alias("day"), "event_type", "n")
    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(table.upsert).start()
    query.awaitTermination()
    came = [(p.batchId, p.observedMetrics["arrived"]["n"], p.stateOperators[0].numRowsTotal) for p in query.recentProgress if "arrived" in p.observedMetrics]
    if came:
        seen.upsert(spark.createDataFrame(came, seen.schema), max(came)[0])
    total = seen.rows().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("arrived"))
    counted = table.rows().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    return table.rows(), total.crossJoin(counted).select("arrived", (F.col("arrived") - F.col("counted")).alias("late"))  # one row each


def inherited(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(event_id, decision, note): a copy of reviewed content takes its decision; a restricted item takes no note."""
    joined = rows.join(decisions, rows["user_id"] == decisions["item"], "left")
    out = joined.select("event_id", "decision", F.when(F.coalesce(F.col("decision") != "RESTRICTED", F.lit(True)), F.col("event_type")).alias("note"))
    return drain(out, "event_id long, decision string, note string")
