"""Queries that draw, split and cut: samples, strata, segments, passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.functions.metrics import unit
from triagelake.operators import intervals as I
from triagelake.operators import sampling as S
from triagelake.operators import similarity as M
from triagelake.operators import students as L
from triagelake.plans.standin import sql, table, view
from triagelake.registry import register


@register("win01_quota_draw", "WITH r AS (SELECT doc_id, source, n_chars < 500 AS ex, sum(CASE WHEN n_chars < 500 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY md5('q' || CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS k FROM documents) SELECT doc_id, source, CASE WHEN ex THEN 'excluded' ELSE 'kept' END AS state FROM r WHERE (ex AND k < 10) OR (NOT ex AND k <= 10)")
def quota(spark, d):
    return S.quota_draw(table(spark, d, "documents"), "doc_id", "source", 10, F.col("n_chars") < 500, "q")


def pictures(spark, d):
    """(id, stratum, value, reason): pictures of two strata by the signs of their vectors, some of them not usable; every
    fourth stands again with few bits changed."""
    signs = F.expr("aggregate(sequence(0, 63), 0L, (s, i) -> s | shiftleft(CASE WHEN get(embedding, i) > 0 THEN 1L ELSE 0L END, i))")
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", signs.alias("value"))
    again = rows.where("vec_id % 4 = 0").select(F.col("vec_id") + 1_000_000_000, "label", F.col("value").bitwiseXOR(F.lit(5)))
    rows = rows.union(again)
    return rows.select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("stratum"), "value", F.when(F.col("vec_id") % 11 == 0, "quarantined").alias("reason"))


@register("win01_draw_without_copies")
def distinct_quota(spark, d):
    """Quotas of pictures that are no near copies of each other; the test draws them one by one."""
    return S.draw_without_copies(pictures(spark, d), {"odd": 60, "even": 90}, "p")


@register("win02_split", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s' || CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN k <= round_even(0.2 * n, 0) THEN 'dev' ELSE 'train' END AS part FROM r")
def split(spark, d):
    return S.split(table(spark, d, "documents"), "doc_id", "lang", 0.2, "s")


@register("win03_round_robin", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('r' || CAST(doc_id AS VARCHAR)), doc_id) AS turn, count(*) OVER (PARTITION BY source) AS size FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY turn, size, source) AS place FROM r) SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM o WHERE place <= 150")
def robin(spark, d):
    return S.round_robin(table(spark, d, "documents"), "doc_id", "source", 150, "r")


@register("win04_balanced", "WITH r AS (SELECT doc_id, toxic = 1 AS positive, row_number() OVER (PARTITION BY toxic = 1 ORDER BY md5('b' || CAST(doc_id AS VARCHAR)), doc_id) AS k, (SELECT count(*) FROM labels WHERE toxic = 1) AS n FROM labels) SELECT doc_id, positive FROM r WHERE positive OR k <= n")
def balanced(spark, d):
    return S.balanced(table(spark, d, "labels"), "doc_id", F.col("toxic") == 1, "b")


@register("win05_strata", "SELECT CASE WHEN toxic = 1 AND quality = 1 THEN 'toxic, good' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'other' END AS stratum, count(*) AS n FROM labels GROUP BY 1")
def strata(spark, d):
    t, q = F.col("toxic") == 1, F.col("quality") == 1
    return table(spark, d, "labels").groupBy(F.when(t & q, "toxic, good").when(t, "toxic").when(q, "good").otherwise("other").alias("stratum")).agg(F.count("*").alias("n"))


@register("win06_first_and_latest", "SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id")
def first_latest(spark, d):
    rows = table(spark, d, "events")
    return rows.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


@register("win07_top_passages", sql("segments", body=" SELECT video, idx, p FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY p DESC, idx) AS n FROM segments) x WHERE n <= 3"))
def passages(spark, d):
    best = Window.partitionBy("video").orderBy(F.desc("p"), "idx")
    return view(spark, d, "segments").withColumn("n", F.row_number().over(best)).where("n <= 3").select("video", "idx", "p")


@register("win08_context", sql("segments", body=" SELECT video, idx, lag(role) OVER w AS before, lead(role) OVER w AS after FROM segments WINDOW w AS (PARTITION BY video ORDER BY idx)"))
def context(spark, d):
    w = Window.partitionBy("video").orderBy("idx")
    return view(spark, d, "segments").select("video", "idx", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@register("win08_timeline", sql("segments", body=", o AS (SELECT video, start_s - 40 AS a, start_s + 1 AS b FROM segments WHERE role = 'user' AND positive), m AS (SELECT video, idx, row_number() OVER (PARTITION BY video ORDER BY p DESC, idx) AS n FROM segments WHERE positive) SELECT s.video, s.idx, coalesce(s.idx = m.idx, false) AS flagged, EXISTS (SELECT 1 FROM o WHERE o.video = s.video AND s.start_s < o.b AND s.end_s > o.a) AS in_passage FROM segments s LEFT JOIN m ON s.video = m.video AND m.n = 1"))
def timeline(spark, d):
    segments = view(spark, d, "segments")
    passages = segments.where("role = 'user' AND positive").select("video", (F.col("start_s") - 40).alias("start_s"), (F.col("start_s") + 1).alias("end_s"))
    return I.timeline(segments.select("video", "idx", "p", "positive", "start_s", "end_s"), passages).select("video", "idx", "flagged", "in_passage")


@register("win09_pools", "SELECT pool, count(*) AS n FROM (SELECT 'long' AS pool FROM documents WHERE n_chars > 2000 UNION ALL SELECT 'english' FROM documents WHERE lang = 'en' UNION ALL SELECT 'licensed' FROM documents WHERE regexp_matches(text, 'License')) x GROUP BY pool")
def pools(spark, d):
    names = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("lang") == "en", "english"), F.when(F.col("text").contains("License"), "licensed")))
    return table(spark, d, "documents").select(F.explode(names).alias("pool")).groupBy("pool").agg(F.count("*").alias("n"))


@register("win10_take_per_class", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE n_chars > 0 AND n_chars <= 2400 AND source <> 'src0') x WHERE n <= 15")
def per_class(spark, d):
    rows = table(spark, d, "documents").where("n_chars > 0 AND n_chars <= 2400 AND source <> 'src0'")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 15").select("doc_id", "lang")


@register("seg01_segments")
def segments(spark, d):
    rows = view(spark, d, "segments")
    length = F.max("end_s").over(Window.partitionBy("video"))
    return S.segments(rows.select("video", length.alias("duration"), F.when(F.col("video") % 5 > 0, F.col("end_s")).alias("cut")))


@register("joi14_segment_texts", sql("segments", body=" SELECT s.video, s.idx, string_agg(ph.text, ' ' ORDER BY ph.start_s, ph.end_s, ph.text) AS text FROM segments s JOIN (SELECT video, start_s + 30 AS start_s, end_s + 30 AS end_s, text FROM segments) ph ON s.video = ph.video AND ph.start_s < s.end_s AND ph.end_s > s.start_s GROUP BY s.video, s.idx"))
@register("joi14_whole_segment_texts", sql("segments", body=" SELECT s.video, s.idx, string_agg(ph.text, ' ' ORDER BY ph.start_s, ph.end_s, ph.text) AS text FROM segments s JOIN (SELECT video, start_s + 30 AS start_s, end_s + 30 AS end_s, text FROM segments) ph ON s.video = ph.video AND ph.start_s < s.end_s AND ph.end_s > s.start_s GROUP BY s.video, s.idx"))
def whole_segment_texts(spark, d):
    turns = view(spark, d, "segments").select("video", (F.col("start_s") + 30).alias("start_s"), (F.col("end_s") + 30).alias("end_s"), "text")
    return I.texts_of_segments(view(spark, d, "segments"), turns)


@register("joi15_passage_hits", sql("segments", body=", f AS (SELECT video, start_s, end_s, row_number() OVER (PARTITION BY video ORDER BY p DESC, idx) AS n FROM segments), a AS (SELECT video, start_s + 30 AS start_s, start_s + 90 AS end_s FROM segments WHERE idx = 1) SELECT f.video, min(greatest(0, greatest(a.start_s - f.end_s, f.start_s - a.end_s))) AS min_offset, bool_or(f.n = 1 AND f.start_s < a.end_s AND f.end_s > a.start_s) AS top1, bool_or(f.n <= 3 AND f.start_s < a.end_s AND f.end_s > a.start_s) AS top3 FROM f JOIN a ON f.video = a.video GROUP BY f.video"))
def passage_hits(spark, d):
    rows = view(spark, d, "segments")
    flagged = rows.select("video", "start_s", "end_s", F.row_number().over(Window.partitionBy("video").orderBy(F.desc("p"), "idx")).alias("n"))
    known = rows.where("idx = 1").select("video", (F.col("start_s") + 30).alias("a_start"), (F.col("start_s") + 90).alias("a_end"))
    c = F.col
    hit = (c("start_s") < c("a_end")) & (c("end_s") > c("a_start"))
    offset = F.greatest(F.lit(0.0), c("a_start") - c("end_s"), c("start_s") - c("a_end"))
    return flagged.join(known, "video").groupBy("video").agg(F.min(offset).alias("min_offset"), F.bool_or(hit & (c("n") == 1)).alias("top1"), F.bool_or(hit & (c("n") <= 3)).alias("top3"))


@register("agg30_video_scores", sql("segments", body=", t AS (SELECT video, idx, row_number() OVER (PARTITION BY video ORDER BY p DESC, idx) AS n FROM segments WHERE positive) SELECT s.video, max(s.p) AS score, bool_or(s.positive) AS any_positive, (SELECT string_agg(CAST(t.idx AS VARCHAR), ',' ORDER BY t.n) FROM t WHERE t.video = s.video AND t.n <= 3) AS top, sum(CASE WHEN s.role = 'tool' THEN 1 ELSE 0 END) AS errors FROM segments s GROUP BY s.video"))
def video_scores(spark, d):
    return I.video_scores(view(spark, d, "segments"))


@register("agg31_worst_segment", sql("segments", body=", m AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY positive DESC, p DESC, idx) AS n FROM segments WHERE role <> 'user') SELECT v.video, m.idx, CASE WHEN v.r THEN 'restricted_escalation' WHEN m.idx IS NULL THEN 'judge_error' WHEN m.positive THEN 'standard_review' ELSE 'not_flagged' END AS route FROM (SELECT video, bool_or(p > 0.97) AS r FROM segments GROUP BY video) v LEFT JOIN m ON v.video = m.video AND m.n = 1"))
def worst(spark, d):
    judged = F.col("role") != "user"
    rows = view(spark, d, "segments").groupBy("video").agg(F.bool_or(F.col("p") > 0.97).alias("r"), F.max_by(F.when(judged, F.struct("idx", "positive")), F.when(judged, F.struct(F.col("positive"), F.col("p"), -F.col("idx")))).alias("m"))
    route = F.when(F.col("r"), "restricted_escalation").when(F.col("m.idx").isNull(), "judge_error").when(F.col("m.positive"), "standard_review").otherwise("not_flagged")
    return rows.select("video", F.col("m.idx").alias("idx"), route.alias("route"))


@register("agg36_coverage", sql("segments", body=", i AS (SELECT video, start_s, end_s + 20 AS end_s FROM segments WHERE positive), r AS (SELECT *, max(end_s) OVER (PARTITION BY video ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), c AS (SELECT video, sum(greatest(0, end_s - greatest(start_s, coalesce(reach, start_s)))) AS covered FROM r GROUP BY video), t AS (SELECT video, max(end_s) + 20 AS total FROM segments GROUP BY video) SELECT t.video, coalesce(covered, 0) / total AS chance FROM t LEFT JOIN c ON t.video = c.video"))
def coverage(spark, d):
    rows = view(spark, d, "segments")
    c = I.covered(rows.where("positive").select("video", "start_s", (F.col("end_s") + 20).alias("end_s")), "video")
    return rows.groupBy("video").agg((F.max("end_s") + 20).alias("total")).join(c, "video", "left").select("video", (F.coalesce("covered", F.lit(0.0)) / F.col("total")).alias("chance"))


@register("joi20_prototype_similarity", "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0) SELECT v.vec_id AS id, round(max(CASE WHEN q.label < 5 THEN list_cosine_similarity(v.e, q.e) END), 9) AS pos, round(max(CASE WHEN q.label >= 5 THEN list_cosine_similarity(v.e, q.e) END), 9) AS neg FROM v CROSS JOIN q GROUP BY v.vec_id")
def prototypes(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", unit(F.col("embedding")).alias("v"))
    found = M.cosine_to_prototypes(rows, rows.where("id % 50 = 0").select("v", (F.col("label") < 5).alias("positive")))
    return found.select("id", F.round("pos", 9).alias("pos"), F.round("neg", 9).alias("neg"))


@register("ml03_feature_sets", "SELECT vec_id, len(embedding) + 2 AS width, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def feature_sets(spark, d):
    both = F.concat(F.col("embedding").cast("array<double>"), F.array(F.col("vec_id").cast("double"), F.lit(1.0)))
    return table(spark, d, "embeddings").select("vec_id", F.size(both).cast("long").alias("width"), F.element_at(both, 1).alias("first"))


@register("ml03_text_image_both", "SELECT vec_id, len(t) AS t, len(i) AS i, len(it) AS it, it[1] AS first, it[-1] AS last FROM (SELECT vec_id, t, i, CASE WHEN t IS NOT NULL AND i IS NOT NULL THEN t || i END AS it FROM (SELECT vec_id, CAST(embedding[1:48] AS DOUBLE[]) AS t, CASE WHEN label <> 3 THEN CAST(embedding[49:64] AS DOUBLE[]) END AS i FROM embeddings) x) y")
def text_image_both(spark, d):
    """The two parts of each vector as features of a text and of an image, which some rows lack."""
    rows = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 48).alias("text"), F.when(F.col("label") != 3, F.slice("embedding", 49, 16)).alias("image"))
    width = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(c)
    return L.feature_sets(rows, "text", "image").select("vec_id", *map(width, ("t", "i", "it")), F.element_at("it", 1).alias("first"), F.element_at("it", -1).alias("last"))


@register("ml04_frozen_weights", "WITH z AS (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(i % 7 - 3 AS DOUBLE))) - 0.25 AS z FROM embeddings) SELECT vec_id, round(1 / (1 + exp(-z)), 9) AS score FROM z")
def frozen(spark, d):
    from triagelake.operators.students import score

    weights = [float((i + 1) % 7 - 3) for i in range(64)]
    return table(spark, d, "embeddings").select("vec_id", F.round(score(F.col("embedding"), weights, -0.25), 9).alias("score"))
