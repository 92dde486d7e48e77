"""Queries over posts, groups of copies, the review queue and the dashboard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.functions.metrics import ratio
from triagelake.functions.simhash import simhash, simhash_md5, simhash_sql
from triagelake.operators import lexicon as L
from triagelake.operators import queue as Q
from triagelake.operators import rules as R
from triagelake.operators import similarity as S
from triagelake.plans.standin import sql, table, view
from triagelake.plans.text_queries import NORMAL, PATTERN_SQL, URL_SQL, candidates
from triagelake.registry import register

RANK = "CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'standard' THEN 2 WHEN 'none' THEN 3 ELSE 4 END"
ITEMS = f""", items AS (SELECT url, count(*) AS copies, min(id) AS first_id, max(ts) AS last_ts, min({RANK}) AS rank, max(value) AS top FROM sightings WHERE NOT restricted GROUP BY url)"""


def items(spark, d):
    return Q.items(view(spark, d, "sightings"))


@register("srt01_review_queue", sql("sightings", body=ITEMS + ", o AS (SELECT *, row_number() OVER (ORDER BY rank, copies DESC, last_ts DESC, first_id) AS n FROM items WHERE url LIKE '%site1%') SELECT url, copies, rank, first_id FROM o WHERE n > 10 AND n <= 60"))
def review_queue(spark, d):
    return Q.page(items(spark, d).where(F.lower("url").contains("site1")), 10, 50).select("url", "copies", "rank", "first_id")


REVIEWED = ", r AS (SELECT * FROM items WHERE url IN (SELECT url FROM sightings WHERE lane = 'purchase' AND id % 8 = 0))"


def reviewed_items(spark, d):
    """Items of the queue with a decision; here some purchases stand for decisions."""
    return items(spark, d).join(view(spark, d, "sightings").where("lane = 'purchase' AND id % 8 = 0").select("url"), "url", "left_semi")


@register("srt01_reviewed_tab", sql("sightings", body=ITEMS + REVIEWED + ", o AS (SELECT *, row_number() OVER (ORDER BY last_ts DESC, first_id) AS n FROM r) SELECT url, copies, first_id FROM o WHERE n > 5 AND n <= 30"))
def reviewed_tab(spark, d):
    return Q.reviewed_page(reviewed_items(spark, d), 5, 25).select("url", "copies", "first_id")


@register("srt01_page_count", sql("sightings", body=ITEMS + REVIEWED + " SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM r"))
def page_count(spark, d):
    return Q.page_count(reviewed_items(spark, d), 25)


@register("srt02_screening_list", sql("sightings", body=" SELECT id, url FROM (SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM sightings WHERE lane = 'error') x WHERE n <= 200"))
def screening(spark, d):
    return view(spark, d, "sightings").where("lane = 'error'").orderBy("ts", "id").limit(200).select("id", "url")


@register("srt03_strongest_today", sql("sightings", body=" SELECT day, id, value FROM (SELECT CAST(ts AS DATE) AS day, id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, id) AS n FROM sightings WHERE NOT restricted) x WHERE n <= 5"))
def strongest(spark, d):
    best = Window.partitionBy("day").orderBy(F.desc("value"), "id")
    rows = view(spark, d, "sightings").where("NOT restricted").withColumn("day", F.to_date("ts"))
    return rows.withColumn("n", F.row_number().over(best)).where("n <= 5").select("day", "id", "value")


@register("srt04_top_unmatched", sql("posts", body=PATTERN_SQL + ", t AS (SELECT min(seq) AS seq, max(reach) AS score FROM x WHERE strength IS NULL GROUP BY text), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS n FROM t) SELECT seq, score, (SELECT min(score) FROM k WHERE n <= 25) AS cutoff FROM k WHERE n <= 25"))
def top_unmatched(spark, d):
    rows = view(spark, d, "posts").where(L.strength(L.pattern_hits(F.col("text"))).isNull())
    top = rows.groupBy("text").agg(F.min("seq").alias("seq"), F.max("reach").alias("score")).select("seq", "score").orderBy(F.desc("score"), "seq").limit(25)
    return top.withColumn("cutoff", F.min("score").over(Window.partitionBy()))


@register("srt05_most_common", sql("sightings", body=" SELECT lane, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS place FROM (SELECT lane, count(*) AS n, min(id) AS f FROM sightings GROUP BY lane) x"))
def most_common(spark, d):
    counts = view(spark, d, "sightings").groupBy("lane").agg(F.count("*").alias("n"), F.min("id").alias("f"))
    return counts.select("lane", "n", F.row_number().over(Window.orderBy(F.desc("n"), "f")).alias("place"))


@register("srt06_media_cap", "SELECT o_orderkey, least(count(*), 4) AS n_media, min(l_linenumber) AS first_media FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def media_cap(spark, d):
    """Only the first four media of a post are ever put together; ranking comes before the list."""
    first = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").withColumn("_n", F.row_number().over(first)).where("_n <= 4")
    posts = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("media"))
    return posts.select("o_orderkey", F.size("media").cast("long").alias("n_media"), F.element_at("media", 1).alias("first_media"))


def media(spark, d):
    """(seq, n, kind, sha, phash): vectors as media of posts, every seventh a video; some stand with a second post too. The
    digest is that of the rounded components, the picture hash has their signs."""
    v = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    digits = F.array_join(F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("string")), ",")
    signs = F.expr("aggregate(sequence(0, 63), 0L, (s, i) -> s | shiftleft(CASE WHEN get(embedding, i) > 0 THEN 1L ELSE 0L END, i))")
    v = v.select("vec_id", F.when(F.col("vec_id") % 7 == 0, "video").otherwise("image").alias("kind"), F.sha2(digits, 256).alias("sha"), signs.alias("phash"))
    first = v.select((F.col("vec_id") * 2).alias("seq"), F.lit(0).alias("n"), "kind", "sha", "phash")
    again = v.where("vec_id % 20 = 3").select((F.col("vec_id") * 3 + 1).alias("seq"), F.lit(1).alias("n"), "kind", "sha", "phash")
    return first.unionByName(again)


MEDIA = """, v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'video' ELSE 'image' END AS kind, sha256(array_to_string(list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)), ',')) AS sha,
  list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0::HUGEINT END)) AS bits FROM embeddings WHERE embedding IS NOT NULL),
media AS (SELECT seq, n, kind, sha, CAST(CASE WHEN bits >= 9223372036854775808::HUGEINT THEN bits - 18446744073709551616::HUGEINT ELSE bits END AS BIGINT) AS phash
  FROM (SELECT vec_id * 2 AS seq, 0 AS n, kind, sha, bits FROM v UNION ALL SELECT vec_id * 3 + 1, 1, kind, sha, bits FROM v WHERE vec_id % 20 = 3) m)"""
NORMALISED = f", nt AS (SELECT seq, {NORMAL} AS text FROM posts), nw AS (SELECT seq, text, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words FROM nt), long_texts AS (SELECT seq, text FROM nw WHERE words >= 8), {simhash_sql('long_texts', 'seq')}"
PRINTS = """, prints AS (SELECT seq, CAST(0 AS BIGINT) AS pos, 'text_sha' AS kind, sha256(text) AS value FROM nw WHERE words >= 5 UNION ALL SELECT id, 1, 'text_simhash', CAST(value AS VARCHAR) FROM values_long_texts
  UNION ALL SELECT seq, 2 * n + 2, 'media_sha', sha FROM media UNION ALL SELECT seq, 2 * n + 3, 'media_phash', CAST(phash AS VARCHAR) FROM media WHERE kind = 'image')"""
GROUPS = """, own AS (SELECT kind, value, min(seq) AS owner FROM prints GROUP BY kind, value),
exact AS (SELECT p.seq, arg_min(o.owner, p.pos) AS parent FROM prints p JOIN own o ON p.kind = o.kind AND p.value = o.value WHERE o.owner < p.seq GROUP BY p.seq),
hs AS (SELECT seq, pos, kind, CAST(value AS BIGINT) AS v FROM prints WHERE kind IN ('text_simhash', 'media_phash') AND seq NOT IN (SELECT seq FROM exact)),
ho AS (SELECT kind, CAST(value AS BIGINT) AS v, owner FROM own WHERE kind IN ('text_simhash', 'media_phash')),
nr AS (SELECT h.seq, o.owner, row_number() OVER (PARTITION BY h.seq ORDER BY bit_count(xor(h.v, o.v)), h.pos, CASE WHEN o.v < 0 THEN 1 ELSE 0 END, o.v) AS n FROM hs h JOIN ho o ON h.kind = o.kind AND o.owner < h.seq
  AND bit_count(xor(h.v, o.v)) <= CASE h.kind WHEN 'text_simhash' THEN 9 ELSE 4 END),
up AS (SELECT seq, parent FROM exact UNION ALL SELECT seq, owner FROM nr WHERE n = 1),
roots AS (SELECT DISTINCT p.seq, p.seq AS "group" FROM prints p WHERE p.seq NOT IN (SELECT seq FROM up) UNION ALL SELECT u.seq, r."group" FROM up u JOIN roots r ON u.parent = r.seq)"""
PRINT_SQL = sql("posts", body=MEDIA + NORMALISED + PRINTS + " SELECT seq, pos, kind, value FROM prints")
ALONE = ' UNION ALL SELECT seq, seq FROM posts WHERE seq NOT IN (SELECT seq FROM prints)'  # posts without a fingerprint
GROUP_SQL = sql("posts", body=MEDIA + NORMALISED + PRINTS + GROUPS + ' SELECT seq, "group" FROM roots')


@register("grp01_fingerprints", PRINT_SQL)
def fingerprints(spark, d):
    return Q.fingerprints(view(spark, d, "posts"), media(spark, d), by_md5=True)


@register("grp03_content_groups")
def content_groups(spark, d):
    """Whole documents and media by all kinds of fingerprints; the test replays the sequential assignment."""
    return S.content_groups(Q.fingerprints(view(spark, d, "posts"), media(spark, d)), Q.NEAR_KINDS)


@register("grp03_groups_by_md5", GROUP_SQL)
def content_groups_by_md5(spark, d):
    """The same with the text hash that SQL can repeat."""
    return S.content_groups(Q.fingerprints(view(spark, d, "posts"), media(spark, d), by_md5=True), Q.NEAR_KINDS)


REPEAT = ", f AS (SELECT *, CASE WHEN post_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY platform, post_id ORDER BY seq) END AS n FROM posts)"


@register("grp04_repeats_dropped", sql("posts", body=REPEAT + " SELECT seq, platform, post_id FROM f WHERE n = 1"))
def repeats(spark, d):
    return S.first_of(view(spark, d, "posts"), ["platform", "post_id"], ["seq"]).select("seq", "platform", "post_id")


@register("grp05_retry_errors", sql("posts", body=f""", g AS (SELECT sha256({NORMAL}) AS key, seq, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 0 THEN 'judge_error' ELSE 'not_flagged' END END AS route FROM posts LEFT JOIN labels l ON seq = l.doc_id),
n AS (SELECT key, min(seq) AS representative, arg_max(route, seq) FILTER (WHERE route IS NOT NULL) AS route FROM g GROUP BY key) SELECT key, representative, route IS NOT NULL AS retry FROM n WHERE route IS NULL OR route = 'judge_error'"""))
def retry_errors(spark, d):
    keyed = view(spark, d, "posts").select("seq", T.exact_key(F.col("text")).alias("key"))
    judged = table(spark, d, "labels").select(F.col("doc_id").alias("seq"), F.when(F.col("quality") == 0, "judge_error").otherwise("not_flagged").alias("route"))
    return Q.to_judge(keyed, judged)


@register("grp05_judge_once", sql("posts", body=f", g AS (SELECT sha256({NORMAL}) AS key, seq FROM posts) SELECT key, min(seq) AS representative FROM g WHERE key NOT IN (SELECT key FROM g WHERE seq % 7 = 0) GROUP BY key"))
def judge_once(spark, d):
    keyed = view(spark, d, "posts").select("seq", T.exact_key(F.col("text")).alias("key"))
    good = keyed.where("seq % 7 = 0").select("key").distinct()
    return keyed.join(good, "key", "left_anti").groupBy("key").agg(F.min("seq").alias("representative"))


@register("grp06_queue_replay")
def queue_replay(spark, d):
    """Queue items from three lanes: components over link and group key, replayed in order of arrival inside each."""
    return Q.replay(view(spark, d, "sightings"))


@register("grp07_copies_and_channels", sql("posts", body=f", k AS (SELECT seq, channel, side, sha256({NORMAL}) AS key FROM posts), a AS (SELECT key, count(*) AS copies, count(DISTINCT channel) AS channels, count(DISTINCT side) AS sides FROM k GROUP BY key) SELECT seq, copies, channels, sides FROM k JOIN a ON k.key = a.key"))
def copies(spark, d):
    keyed = S.cut(view(spark, d, "posts").select("seq", "channel", "side", T.exact_key(F.col("text")).alias("key")))  # texts are normalised once
    counts = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.countDistinct("channel").alias("channels"), F.countDistinct("side").alias("sides"))
    return keyed.join(counts, "key").select("seq", "copies", "channels", "sides")


@register("grp08_ingest_statistics", sql("posts", body=REPEAT + f", k AS (SELECT *, row_number() OVER (PARTITION BY sha256({NORMAL}) ORDER BY seq) AS c FROM f WHERE n = 1) SELECT channel, count(*) AS total, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS seen, sum(CASE WHEN n = 1 AND c > 1 THEN 1 ELSE 0 END) AS copies, sum(CASE WHEN n = 1 AND c = 1 THEN 1 ELSE 0 END) AS fresh FROM (SELECT channel, n, c FROM k UNION ALL SELECT channel, n, 0 FROM f WHERE n > 1) x GROUP BY channel"))
def ingest_statistics(spark, d):
    posts = view(spark, d, "posts")
    fresh = S.first_of(posts, ["platform", "post_id"], ["seq"]).withColumn("c", F.row_number().over(Window.partitionBy(T.exact_key(F.col("text"))).orderBy("seq")))
    counts = fresh.groupBy("channel").agg(F.count_if(F.col("c") > 1).alias("copies"), F.count_if(F.col("c") == 1).alias("fresh"))
    totals = posts.groupBy("channel").agg(F.count("*").alias("total"))
    out = totals.join(counts, "channel", "left").na.fill(0, ["copies", "fresh"])
    return out.select("channel", "total", (F.col("total") - F.col("copies") - F.col("fresh")).alias("seen"), "copies", "fresh")


LOOSE = r"substr(sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 16)"


@register("joi01_whole_text_match", sql("posts", body=f", f AS (SELECT seq, 0 AS pos, 'text_sha' AS kind, sha256({NORMAL}) AS value FROM posts UNION ALL SELECT seq, 1, 'loose_key', {LOOSE} FROM posts), o AS (SELECT kind, value, min(seq) AS owner FROM f GROUP BY kind, value), m AS (SELECT f.seq, o.owner, row_number() OVER (PARTITION BY f.seq ORDER BY f.pos) AS n FROM f JOIN o ON f.kind = o.kind AND f.value = o.value WHERE o.owner < f.seq) SELECT seq, owner FROM m WHERE n = 1"))
@register("joi01_exact_first_match", sql("posts", body=f", f AS (SELECT seq, 0 AS pos, 'text_sha' AS kind, sha256({NORMAL}) AS value FROM posts UNION ALL SELECT seq, 1, 'loose_key', {LOOSE} FROM posts), o AS (SELECT kind, value, min(seq) AS owner FROM f GROUP BY kind, value), m AS (SELECT f.seq, o.owner, row_number() OVER (PARTITION BY f.seq ORDER BY f.pos) AS n FROM f JOIN o ON f.kind = o.kind AND f.value = o.value WHERE o.owner < f.seq) SELECT seq, owner FROM m WHERE n = 1"))
def exact_first(spark, d):
    """By the normalised text, then by the lower-cased text with single spaces; both of the whole text."""
    posts = view(spark, d, "posts")
    kind = lambda pos, name, value: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("kind"), value.alias("value"))
    both = F.array(kind(0, "text_sha", T.exact_key(F.col("text"))), kind(1, "loose_key", T.loose_key(F.col("text"))))
    kinds = posts.select("seq", F.explode(both).alias("f")).select("seq", "f.*")
    return kinds.join(S.first_bearers(kinds), ["kind", "value"]).where("owner < seq").groupBy("seq").agg(F.min_by("owner", "pos").alias("owner"))


def md5_values(spark, d, name, id):
    """(id, value): 64-bit SimHashes of whole texts in the form that SQL can repeat."""
    return S.cut(simhash_md5(table(spark, d, name).select(F.col(id).alias("id"), "text")).withColumnRenamed("simhash", "value"))


@register("joi02_nearest_within", f"WITH {simhash_sql('documents', 'doc_id')}, p AS (SELECT a.id, b.id AS other, bit_count(xor(a.value, b.value)) AS distance FROM values_documents a JOIN values_documents b ON a.id <> b.id WHERE bit_count(xor(a.value, b.value)) <= 9), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS n FROM p) SELECT id, other AS reference_id, CAST(distance AS INTEGER) AS distance FROM m WHERE n = 1")
def nearest(spark, d):
    return S.nearest_within(md5_values(spark, d, "documents", "doc_id"), S.SIMHASH_LIMIT)


@register("joi03_anti_leakage", f"WITH {simhash_sql('documents', 'doc_id')}, {simhash_sql('benchmark', 'item_id')} SELECT c.id FROM values_documents c WHERE NOT EXISTS (SELECT 1 FROM values_benchmark r WHERE bit_count(xor(c.value, r.value)) <= 8)")
def anti_leakage(spark, d):
    docs = md5_values(spark, d, "documents", "doc_id")
    return docs.join(S.near_reference(docs, md5_values(spark, d, "benchmark", "item_id")).select("id"), "id", "left_anti").select("id")


def text_values(rows, id):
    """(id, value): the 64-bit SimHash of the normalised whole text."""
    return rows.select(F.col(id).alias("id"), simhash(T.normalize_text(F.col("text"))).alias("value"))


@register("joi02_nearest_text")
def nearest_text(spark, d):
    """The closest other document by whole text; the test compares with all pairs."""
    return S.nearest_within(S.cut(text_values(table(spark, d, "documents"), "doc_id")), S.SIMHASH_LIMIT)


@register("joi03_text_anti_leakage")
def text_anti_leakage(spark, d):
    """Documents whose whole text is near no benchmark passage; the test compares with all pairs."""
    docs = S.cut(text_values(table(spark, d, "documents"), "doc_id"))
    frozen = S.cut(text_values(table(spark, d, "benchmark"), "item_id"))
    return docs.join(S.near_reference(docs, frozen).select("id"), "id", "left_anti").select("id")


@register("joi04_greedy_dedupe")
def greedy(spark, d):
    """What a pass over all documents in order would drop; the test replays the pass."""
    values = text_values(table(spark, d, "documents"), "doc_id").select("id", F.col("id").alias("ord"), "value")
    return S.greedy_dedupe(S.cut(values))


@register("joi05_unsent", sql("sightings", body=" SELECT s.id, s.url FROM sightings s JOIN (SELECT url, max(value) AS top FROM sightings WHERE lane = 'view' GROUP BY url) g ON s.url = g.url WHERE s.lane <> 'view' AND NOT s.restricted AND g.top > 20 AND s.priority IN ('urgent', 'high')"))
def unsent(spark, d):
    rows = view(spark, d, "sightings")
    groups = rows.where("lane = 'view'").groupBy("url").agg(F.max("value").alias("top")).where("top > 20")
    return rows.where("lane <> 'view' AND NOT restricted AND priority IN ('urgent', 'high')").join(groups, "url").select("id", "url")


@register("joi06_group_representative", sql("sightings", body=", r AS (SELECT group_key, min(id) AS id FROM sightings WHERE group_key IS NOT NULL GROUP BY group_key) SELECT r.group_key, s.id, s.value FROM r JOIN sightings s ON r.id = s.id"))
def representative(spark, d):
    rows = view(spark, d, "sightings")
    return rows.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min("id").alias("id")).join(rows.select("id", "value"), "id")


@register("joi07_unclassified", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unclassified(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@register("joi08_latest_decision", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT c_custkey, e.event_type AS decision FROM customer LEFT JOIN e ON c_custkey = e.user_id AND e.n = 1")
def latest_decision(spark, d):
    newest = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"))
    return table(spark, d, "customer").select("c_custkey").join(newest, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "decision")


@register("joi09_human_decisions", "SELECT l.doc_id, CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'YES' ELSE 'NO' END AS decision, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 41 <> 0")
def human_decisions(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").where("doc_id % 41 <> 0")
    return rows.select("doc_id", F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "YES").otherwise("NO").alias("decision"), "source")


@register("joi10_known_sightings", sql("posts", body=" SELECT a.seq FROM posts a WHERE EXISTS (SELECT 1 FROM posts b WHERE b.platform = a.platform AND b.post_id = a.post_id AND b.seq % 10 < 6) AND a.seq % 10 >= 6"))
def known(spark, d):
    posts = view(spark, d, "posts").select("seq", "platform", "post_id")
    return posts.where("seq % 10 >= 6").join(posts.where("seq % 10 < 6"), ["platform", "post_id"], "left_semi").select("seq")


@register("joi11_all_sightings", sql("sightings", body=" SELECT id, min(item) AS item FROM (SELECT n.id, i.id AS item FROM sightings n JOIN sightings i ON n.url = i.url AND i.id < n.id UNION ALL SELECT n.id, i.id FROM sightings n JOIN sightings i ON n.group_key = i.group_key AND i.id < n.id) m GROUP BY id"))
@register("joi11_url_or_key", sql("sightings", body=" SELECT id, min(item) AS item FROM (SELECT n.id, i.id AS item FROM sightings n JOIN sightings i ON n.url = i.url AND i.id < n.id UNION ALL SELECT n.id, i.id FROM sightings n JOIN sightings i ON n.group_key = i.group_key AND i.id < n.id) m GROUP BY id"))
def all_sightings(spark, d):
    return Q.match_earlier(view(spark, d, "sightings"))


@register("joi12_nested_occurrences", sql("sightings", body=" SELECT url, count(*) AS n, min(id) AS first_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ts, id) AS occurrences FROM sightings GROUP BY url"))
def nested(spark, d):
    groups = view(spark, d, "sightings").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("o"))
    ids = F.transform("o", lambda x: x.id)
    return groups.select("url", F.size("o").cast("long").alias("n"), F.array_min(ids).alias("first_id"), F.array_join(ids.cast("array<string>"), ",").alias("occurrences"))


@register("joi13_reviewed_items", "SELECT p.page_id, p.url, e.event_type AS decision FROM pages p JOIN events e ON p.page_id = e.event_id WHERE e.event_type = 'click'")
def reviewed(spark, d):
    reviews = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("page_id"), F.col("event_type").alias("decision"))
    return table(spark, d, "pages").select("page_id", "url").join(reviews, "page_id")


@register("joi19_merge_items", sql("sightings", body=", m AS (SELECT url AS old, min(url) OVER (PARTITION BY regexp_extract(url, 'site([0-9]+)', 1)) AS new FROM (SELECT DISTINCT url FROM sightings) u) SELECT m.new AS url, count(*) AS n FROM sightings s JOIN m ON s.url = m.old GROUP BY m.new"))
def merged(spark, d):
    rows = view(spark, d, "sightings")
    site = F.regexp_extract("url", "site([0-9]+)", 1)
    mapping = rows.groupBy(site.alias("site")).agg(F.min("url").alias("new"))
    return rows.select(site.alias("site")).join(mapping, "site").groupBy(F.col("new").alias("url")).agg(F.count("*").alias("n"))


LINKS_SQL = f"WITH u AS ({URL_SQL}), q AS (SELECT p.page_id, p.url, u.normalised, CASE WHEN p.page_id % 2 = 0 THEN 'public-' ELSE 'l-' END || CAST(p.page_id AS VARCHAR) AS id, CASE WHEN p.page_id % 4 <> 0 THEN u.normalised END AS norm FROM pages p JOIN u ON p.page_id = u.page_id)"


def stored_links(spark, d):
    """A third of the pages as links of the queue; some were stored before normalised links were."""
    rows = table(spark, d, "pages").select("page_id", "url", F.concat(F.when(F.col("page_id") % 2 == 0, "public-").otherwise("l-"), F.col("page_id").cast("string")).alias("id"))
    return rows.withColumn("norm", F.when(F.col("page_id") % 4 != 0, T.normalize_url(F.col("url"))))


@register("joi23_filled_links", LINKS_SQL + " SELECT id, coalesce(norm, normalised) AS norm, norm IS NULL AND page_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') AS first_seen FROM q")
def filled_links(spark, d):
    seen = table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("page_id"))
    links = stored_links(spark, d)
    return Q.filled_links(links, links.join(seen, "page_id").select("id")).select("id", "norm", "first_seen")


@register("joi23_missing_reports", LINKS_SQL + ", k AS (SELECT * FROM q WHERE page_id % 3 = 0) SELECT min(page_id) AS report_id, normalised AS norm FROM q WHERE 'public-' || CAST(page_id AS VARCHAR) NOT IN (SELECT id FROM k) AND normalised NOT IN (SELECT norm FROM k WHERE norm IS NOT NULL) GROUP BY normalised")
def missing_reports(spark, d):
    reports = table(spark, d, "pages").select(F.col("page_id").alias("report_id"), "url")
    return Q.missing_reports(reports, stored_links(spark, d).where("page_id % 3 = 0")).select("report_id", "norm")


@register("joi23_backfill", "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0) AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)")
def backfill(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    by_id = table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("page_id"))
    return pages.join(by_id, "page_id", "left_anti").join(pages.where("page_id % 5 = 0").select("url"), "url", "left_anti").select("page_id", "url")


@register("agg01_reviewed_counts", sql("sightings", body=" SELECT lane, priority, count(*) AS n FROM sightings GROUP BY GROUPING SETS ((lane), (priority), (lane, priority))"))
def reviewed_counts(spark, d):
    return spark.sql("SELECT lane, priority, count(*) AS n FROM {s} GROUP BY GROUPING SETS ((lane), (priority), (lane, priority))", s=view(spark, d, "sightings"))


@register("agg02_daily_trend", sql("sightings", body=" SELECT CAST(ts AS DATE) AS day, lane, count(*) AS n FROM sightings GROUP BY 1, 2"))
def trend(spark, d):
    return Q.daily(view(spark, d, "sightings"), "lane")


@register("agg02_tag_trend", sql("sightings", body=", t AS (SELECT unnest(['urgent', 'high', 'archived']) AS tag) SELECT t.tag, count(s.id) AS n, count(DISTINCT CAST(s.ts AS DATE)) AS days FROM t LEFT JOIN sightings s ON s.priority = t.tag GROUP BY t.tag"))
def tag_trend(spark, d):
    rows = view(spark, d, "sightings")
    tags = rows.limit(1).select(F.explode(F.array(*map(F.lit, ("urgent", "high", "archived")))).alias("tag"))
    counts = rows.groupBy(F.col("priority").alias("tag")).agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))
    return tags.join(counts, "tag", "left").na.fill(0)


@register("agg03_evidence_counts", sql("assessed", body=" SELECT 'stance' AS field, stance AS value, count(*) AS n FROM assessed GROUP BY stance UNION ALL SELECT 'target', target, count(*) FROM assessed GROUP BY target UNION ALL SELECT 'cta', cta, count(*) FROM assessed GROUP BY cta"))
def evidence(spark, d):
    return Q.evidence_counts(view(spark, d, "assessed"), ["stance", "target", "cta"])


@register("agg04_totals", sql("sightings", body=" SELECT count(*) AS total, sum(CASE WHEN priority IS NULL THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN priority IS NOT NULL THEN 1 ELSE 0 END) AS reviewed, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM sightings"))
def totals(spark, d):
    return view(spark, d, "sightings").agg(F.count("*").alias("total"), F.count_if(F.col("priority").isNull()).alias("pending"), F.count_if(F.col("priority").isNotNull()).alias("reviewed"), F.ceil(F.count("*") / 50).alias("pages"))


@register("agg05_shares_on_all_dates", sql("sightings", body=", c AS (SELECT CAST(ts AS DATE) AS day, lane, count(*) AS n FROM sightings WHERE value > 60 GROUP BY 1, 2), s AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM sightings), l AS (SELECT DISTINCT lane FROM sightings) SELECT s.day, l.lane, coalesce(c.n, 0) AS n, CAST(coalesce(c.n, 0) AS DOUBLE) / (SELECT sum(n) FROM c) AS share FROM s CROSS JOIN l LEFT JOIN c ON c.day = s.day AND c.lane = l.lane"))
def shares(spark, d):
    return Q.on_all_dates(view(spark, d, "sightings"), F.col("value") > 60)


@register("agg06_item_priority", sql("sightings", body=ITEMS + " SELECT url, copies, rank FROM items"))
def item_priority(spark, d):
    return items(spark, d).select("url", "copies", "rank")


@register("agg07_corpus_totals", sql("posts", body=" SELECT coalesce(side, 'unknown') AS side, NULL AS month, count(*) AS n FROM posts GROUP BY 1 UNION ALL SELECT NULL, month, count(*) FROM posts GROUP BY 2"))
def corpus_totals(spark, d):
    posts = view(spark, d, "posts").withColumn("side", F.coalesce("side", F.lit("unknown")))
    return spark.sql("SELECT side, month, count(*) AS n FROM {p} GROUP BY GROUPING SETS ((side), (month))", p=posts)


@register("agg08_candidate_rates", sql("posts", body=PATTERN_SQL + " SELECT coalesce(side, 'unknown') AS side, month, count(*) AS posts, count(strength) AS candidates, CAST(count(strength) AS DOUBLE) / count(*) AS rate, count(DISTINCT CASE WHEN strength IS NOT NULL THEN text END) AS texts FROM x GROUP BY 1, 2"))
def candidate_rates(spark, d):
    posts = view(spark, d, "posts").withColumn("side", F.coalesce("side", F.lit("unknown")))
    hit = L.strength(L.pattern_hits(F.col("text"))).isNotNull()
    out = posts.groupBy("side", "month").agg(F.count("*").alias("posts"), F.count_if(hit).alias("candidates"), F.countDistinct(F.when(hit, F.xxhash64("text"))).alias("texts"))
    return out.withColumn("rate", ratio(F.col("candidates"), F.col("posts")))


@register("agg08_by_language", sql("posts", body=PATTERN_SQL + " SELECT lang, count(*) AS posts, count(strength) AS candidates, CAST(count(strength) AS DOUBLE) / count(*) AS rate FROM x GROUP BY lang"))
def by_language(spark, d):
    hit = L.strength(L.pattern_hits(F.col("text"))).isNotNull()
    out = view(spark, d, "posts").groupBy("lang").agg(F.count("*").alias("posts"), F.count_if(hit).alias("candidates"))
    return out.withColumn("rate", ratio(F.col("candidates"), F.col("posts")))


@register("agg08_top_channels", sql("posts", body=PATTERN_SQL + " SELECT channel, n FROM (SELECT channel, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, channel) AS r FROM x WHERE strength IS NOT NULL GROUP BY channel) y WHERE r <= 25"))
def top_channels(spark, d):
    return candidates(spark, d).groupBy("channel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "channel").limit(25)


@register("agg08_spread_texts", sql("posts", body=PATTERN_SQL + " SELECT count(*) AS texts, sum(CASE WHEN c >= 3 THEN 1 ELSE 0 END) AS spread FROM (SELECT count(DISTINCT channel) AS c FROM x WHERE strength IS NOT NULL GROUP BY text) y"))
def spread(spark, d):
    per_text = candidates(spark, d).groupBy("text").agg(F.countDistinct("channel").alias("c"))
    return per_text.agg(F.count("*").alias("texts"), F.count_if(F.col("c") >= 3).alias("spread"))


@register("agg09_second_signal", sql("posts", body=PATTERN_SQL + ", m AS (SELECT quantile_cont(reach, 0.5) AS m FROM x WHERE strength = 'strong') SELECT seq FROM x WHERE strength = 'strong' OR (strength = 'weak' AND reach >= (SELECT m FROM m) AND reach % 2 = 0)"))
def second_signal(spark, d):
    rows = candidates(spark, d)
    median = rows.where("strength = 'strong'").agg(F.percentile("reach", F.lit(0.5)).alias("m"))
    return rows.join(F.broadcast(median)).where("strength = 'strong' OR (strength = 'weak' AND reach >= m AND reach % 2 = 0)").select("seq")


@register("agg37_restricted_alerts", sql("sightings", body=" SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM sightings WHERE restricted GROUP BY 1"))
def alerts(spark, d):
    return view(spark, d, "sightings").where("restricted").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@register("agg40_pattern_counts", sql("posts", body=PATTERN_SQL + ", e AS (SELECT unnest(string_split(ids, ',')) AS pattern FROM x WHERE strength IS NOT NULL) SELECT pattern, CASE WHEN pattern IN ('pt-1', 'pt-3') THEN 'strong' ELSE 'weak' END AS strength, count(*) AS n FROM e GROUP BY pattern"))
def pattern_counts(spark, d):
    hits = candidates(spark, d).select(F.explode("hits").alias("h"))
    return hits.groupBy(F.col("h.id").alias("pattern"), F.col("h.strength").alias("strength")).agg(F.count("*").alias("n"))


@register("set01_union_sources", "SELECT 'doc' AS kind, CAST(doc_id AS BIGINT) AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages")
def union_sources(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang")
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    return docs.unionByName(pages, allowMissingColumns=True)


@register("set02_distinct_texts", sql("posts", body=" SELECT min(seq) AS seq, count(*) AS n FROM posts GROUP BY sha256(text)"))
def distinct_texts(spark, d):
    return view(spark, d, "posts").groupBy(F.sha2("text", 256)).agg(F.min("seq").alias("seq"), F.count("*").alias("n")).select("seq", "n")


@register("set03_except_used", "SELECT DISTINCT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def except_used(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).subtract(table(spark, d, "events").select("user_id"))


@register("set04_label_sets", "SELECT doc_id, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missed FROM (SELECT doc_id, ['t' || CAST(doc_id % 3 AS VARCHAR), 'u' || CAST(doc_id % 2 AS VARCHAR), 'v'] AS a, ['t' || CAST(doc_id % 4 AS VARCHAR), 'u' || CAST(doc_id % 5 AS VARCHAR), 'v'] AS b FROM documents) x")
def label_sets(spark, d):
    tags = lambda m, n: F.array(F.concat(F.lit("t"), (F.col("doc_id") % m).cast("string")), F.concat(F.lit("u"), (F.col("doc_id") % n).cast("string")), F.lit("v"))
    rows = table(spark, d, "documents").select("doc_id", tags(3, 2).alias("a"), tags(4, 5).alias("b"))
    join = lambda x: F.array_join(F.array_sort(x), ",")
    return rows.select("doc_id", join(F.array_intersect("a", "b")).alias("both"), join(F.array_except("a", "b")).alias("missed"))


@register("set05_ordered_merge", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x,y,z' ELSE 'x,y,w,z' END AS merged FROM documents")
def ordered_merge(spark, d):
    more = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("y"), F.lit("x"), F.lit("z"))).otherwise(F.array(F.lit("w"), F.lit("y"), F.lit("z")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.concat(F.array(F.lit("x"), F.lit("y")), more)), ",").alias("merged"))
