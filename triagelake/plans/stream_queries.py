"""Streaming jobs run over the events, and the students."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.operators import evaluation as E
from triagelake.operators import queue as Q
from triagelake.operators import similarity as S
from triagelake.operators import students as M
from triagelake.plans.queue_queries import ALONE, GROUP_SQL, media
from triagelake.plans.standin import table, view
from triagelake.registry import register
from triagelake.streaming import jobs as J
from triagelake.streaming.lifecycle import LifeCycle


#: Files of each micro-batch of a made stream.
FILES = 4


def arrivals(spark, rows, order, parts=4):
    """Rows as a stream of micro-batches that arrive in order, each of several files."""
    at = J.folder(spark)
    place = F.col(order) if dict(rows.dtypes)[order] == "bigint" else F.unix_micros(F.col(order).cast("timestamp"))
    low, high = rows.agg(F.min(place), F.max(place)).first()
    if low is None:
        files = 1
        rows.write.parquet(at)
    else:
        part = F.least(F.floor((place - low) * parts / (high - low + 1)), F.lit(parts - 1))
        rows = S.cut(rows.withColumn("_part", F.coalesce(part, F.lit(0))))
        # rows are dealt one by one, so with as many rows no file is empty: a batch is then just what belongs together
        dealt = dict(rows.groupBy("_part").count().collect())
        files = FILES if min(dealt.get(k, 0) for k in range(parts)) >= FILES * rows.rdd.getNumPartitions() else 1
        for k in range(parts):
            own = rows.where(F.col("_part") == k).drop("_part")
            (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(at)
    stream = spark.readStream.schema(rows.drop("_part").schema).option("maxFilesPerTrigger", files).parquet(at)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def events(spark, d, order="event_id"):
    return arrivals(spark, table(spark, d, "events"), order)


@register("str01_first_sightings", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def first_sightings(spark, d):
    return J.first_sightings(events(spark, d))


LIMITED = """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, true AS accepted, [t] AS held FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.event_id, len(list_filter(f.held, lambda h: r.t - h <= 600)) < 5,
    list_concat(list_filter(f.held, lambda h: r.t - h <= 600), CASE WHEN len(list_filter(f.held, lambda h: r.t - h <= 600)) < 5 THEN [r.t] ELSE [] END) FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, event_id, accepted FROM f"""


@register("str02_rate_limit", LIMITED)
def rate_limit(spark, d):
    return J.rate_limited(table(spark, d, "events"))


@register("str02_rate_limit_stream", LIMITED)
def rate_limit_stream(spark, d):
    return J.drain(J.rate_limited_stream(events(spark, d, "ts")), "user_id long, event_id long, accepted boolean")


@register("str03_overdue", "SELECT event_id, 'not screened in time' AS context FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def overdue(spark, d):
    rows = table(spark, d, "events")
    return J.overdue(rows, rows.where("event_type = 'click'"), "2024-01-15 00:00:00")


@register("str01_bounded_sightings", "SELECT DISTINCT user_id, event_type FROM events")
def bounded_sightings(spark, d):
    """The bounded form over the first day of arrivals of each pair: all pairs are there, some again after a day."""
    found = J.drain(J.bounded_first_sightings(events(spark, d, "ts")), "user_id long, event_type string, event_id long")
    return found.select("user_id", "event_type").distinct()


@register("str03_release_stream", """WITH r AS (SELECT event_id, event_type, ts FROM events), m AS (SELECT max(ts) AS last FROM (SELECT ts FROM r UNION ALL SELECT ts + INTERVAL 10 MINUTE FROM r WHERE event_type = 'click') x)
SELECT event_id, 'not screened in time' AS context FROM r, m WHERE event_type <> 'click' AND ts + INTERVAL 30 MINUTE < last""")
def release(spark, d):
    """Reports that arrive in order, clicked ones with a screening ten minutes later; timers release what nobody screens."""
    rows = table(spark, d, "events").select("event_id", F.lit("report").alias("event_type"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "click").alias("c"))
    screened = rows.where("c").select("event_id", F.lit("screened").alias("event_type"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"), "c")
    return J.drain(J.release_stream(arrivals(spark, rows.unionByName(screened).drop("c"), "ts")), "event_id long, context string")


@register("str04_life_cycle", """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id),
k AS (SELECT user_id, arg_min(event_type, event_id) AS first FROM events WHERE event_type IN ('error', 'click', 'purchase', 'view') GROUP BY user_id)
SELECT l.user_id, CASE WHEN first IS NULL THEN 'SCREENING' WHEN first = 'error' THEN 'RESTRICTED' ELSE 'PENDING' END AS status, CASE WHEN first = 'error' THEN NULL ELSE last END AS note, CASE WHEN first = 'view' THEN 'none' ELSE 'standard' END AS priority
FROM l LEFT JOIN k ON l.user_id = k.user_id""")
def life_cycle(spark, d):
    return J.life_cycle(table(spark, d, "events"))


def lane_events(spark, d):
    """Events as lane events: most report or detect links; screenings and reviews name the sender's last report before."""
    rows = view(spark, d, "sightings").select("id", "sender", "lane", "ts", "value", "url", "group_key", "priority")
    lane = F.when(F.col("lane") == "click", "volunteer").when(F.col("lane") == "purchase", "detection").when(F.col("lane") == "error", "screening").when(F.col("id") % 19 == 0, "review").otherwise("report")
    rows = rows.withColumn("lane", lane).withColumn("report", F.when(lane == "report", F.concat(F.lit("public-"), "id")))
    before = Window.partitionBy("sender").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    target = F.when(F.col("lane").isin("screening", "review"), F.last("report", ignorenulls=True).over(before))
    outcome = F.element_at(F.array(*map(F.lit, ("flagged", "not_flagged", "restricted", "unavailable"))), (F.col("id") % 4 + 1).cast("int"))
    named = F.col("lane").isin("screening", "review")
    # a stream of one minute an event, so that some reports wait longer than others
    return rows.select(F.col("id").alias("seq"), "lane", F.when(~named, F.col("url")).alias("url"), F.when(F.col("lane").isin("detection", "screening"), F.col("group_key")).alias("group_key"), F.when(F.col("lane") == "detection", F.concat(F.lit("s"), (F.col("id") - F.col("id") % 2).cast("string"))).alias("external_id"), target.alias("target"), "priority", F.concat(F.lit("note "), "id").alias("note"), F.when(named, outcome).alias("outcome"), (F.col("id") * 60.0).alias("t"))


@register("str04_three_lanes")
def three_lanes(spark, d):
    """The queue after all lanes' events in four micro-batches; the test replays them one by one."""
    events = S.cut(lane_events(spark, d))
    return LifeCycle(spark, J.folder(spark)).run(arrivals(spark, events, "seq")).items.rows()


@register("str05_polling_worker", "WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_id, CASE WHEN k IS NULL OR k % 10 = 0 THEN 'unavailable' WHEN k > 80 THEN 'flagged' ELSE 'not_flagged' END AS outcome FROM k")
def polling(spark, d):
    return J.screened(events(spark, d))


@register("str06_publish_once", "SELECT 's' || CAST(event_id - event_id % 2 AS VARCHAR) AS external_id, min(event_id) AS event_id FROM events GROUP BY 1")
def publish(spark, d):
    return J.published(events(spark, d))


@register("str07_incremental_groups", GROUP_SQL + " WHERE seq IN (SELECT seq FROM posts)" + ALONE)
def incremental(spark, d):
    """Posts that arrive in four micro-batches, with their media: the groups of the whole table."""
    files = media(spark, d)
    prints = lambda batch: Q.fingerprints(batch, files.join(batch.select("seq"), "seq", "left_semi"), by_md5=True)
    return J.grouped(arrivals(spark, view(spark, d, "posts").select("seq", "text"), "seq"), prints, Q.NEAR_KINDS)


@register("str08_daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily(spark, d):
    """In order of time nothing is late, so the counts are those of the whole table."""
    return J.daily_counts(events(spark, d, "ts"))[0]


@register("str08_counts_without_late_rows", """WITH p AS (SELECT *, least(floor((event_id - (SELECT min(event_id) FROM events)) * 4 / ((SELECT max(event_id) - min(event_id) FROM events) + 1)), 3) AS part FROM events),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 2 DAY AS mark FROM p GROUP BY part)
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM p JOIN m ON p.part = m.part WHERE mark IS NULL OR CAST(ts AS DATE) + INTERVAL 1 DAY > mark GROUP BY 1, 2""")
def daily_late(spark, d):
    """In order of id, rows come for days that the watermark has closed: that of the batches before the one before."""
    return J.daily_counts(events(spark, d))[0]


@register("str09_inherited_decisions", "SELECT e.event_id, CASE c.c_custkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'RESTRICTED' END AS decision, CASE WHEN c.c_custkey % 3 = 1 THEN NULL ELSE e.event_type END AS note FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 < 2) c ON e.user_id = c.c_custkey")
@register("str09_all_decisions", "SELECT e.event_id, CASE c.c_custkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'RESTRICTED' END AS decision, CASE WHEN c.c_custkey % 3 = 1 THEN NULL ELSE e.event_type END AS note FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 < 2) c ON e.user_id = c.c_custkey")
def inherit_all(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 3 < 2")
    decisions = known.select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 3 == 0, "YES").otherwise("RESTRICTED").alias("decision"))
    return J.inherited(events(spark, d), decisions)


def labelled_vectors(spark, d, y="label < 3"):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.expr(y).alias("y"))


@register("ml01_logistic_student")
def logistic(spark, d):
    rows = labelled_vectors(spark, d)
    return M.scores(M.logistic_student(rows.where("id % 5 <> 0")).bestModel, rows)


@register("ml02_perceptron_student")
def perceptron(spark, d):
    rows = labelled_vectors(spark, d)
    return M.scores(M.perceptron_student(rows.where("id % 5 <> 0"), 64)[0], rows)


@register("ml05_model_choice")
def choice(spark, d):
    """The candidate chosen by AUROC on the held-out part, the first of equals, among students on all and on balanced
    rows; with its recall if three tenths of the rows are sent on."""
    rows = labelled_vectors(spark, d)
    train, dev = S.cut(rows.where("id % 5 <> 0")), S.cut(rows.where("id % 5 = 0"))
    parts = None
    for k, (strength, even) in enumerate((s, e) for s in (0.001, 0.1) for e in (False, True)):
        scored = S.cut(M.scores(M.logistic_student(M.balanced(train) if even else train, (strength,)).bestModel, dev))
        part = E.auroc(scored).select(F.lit(k).alias("candidate"), F.lit(strength).alias("strength"), F.lit(even).alias("balanced"), "auroc")
        part = part.join(E.recall_at_budget(scored, 0.3).select("recall"))  # one row each
        parts = part if parts is None else parts.unionByName(part)
    best = parts.agg(F.max(F.struct("auroc", (-F.col("candidate")).alias("c"), "strength", "balanced", "recall")).alias("b"))
    return best.select((-F.col("b.c")).alias("candidate"), "b.strength", "b.balanced", "b.auroc", "b.recall")


@register("ml05_best_student")
def best_student(spark, d):
    """The best of twelve students on features of a text, an image and both, at half of the rows sent on."""
    rows = M.feature_sets(labelled_vectors(spark, d).withColumns({"text": F.slice("x", 1, 48), "image": F.slice("x", 49, 16)}), "text", "image")
    return M.best_candidate(M.trained_candidates(rows, F.col("id") % 5 == 0, ("t", "i", "it"), 0.5), 0.9)


@register("ml06_dataset_label_student")
def dataset_labels(spark, d):
    """Learns the data set's own label, a coarser one than the classes that the other students learn; scores of the rows
    that it has not learnt from."""
    rows = labelled_vectors(spark, d, "label % 2 = 0")
    return M.scores(M.logistic_student(rows.where("id % 5 <> 0"), (0.01,)).bestModel, rows.where("id % 5 = 0"))


@register("ml08_resumable_scoring")
def resumable(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    done = docs.where("id % 2 = 0")
    return M.score_with(docs, done, lambda text: 1000.0 / (len(text) % 7)).select("id", "value", "error")
