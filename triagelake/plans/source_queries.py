"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import evaluation as E
from triagelake.operators import lexicon as L
from triagelake.operators.similarity import cut
from triagelake.plans.standin import sql, table, view
from triagelake.plans.text_queries import NORMAL, PATTERN_SQL
from triagelake.registry import register
from triagelake.sources import readers as R
from triagelake.sources import sinks as K
from triagelake.streaming.jobs import folder

PLATFORM = "CASE event_id % 4 WHEN 0 THEN 'facebook' WHEN 1 THEN 'instagram' WHEN 2 THEN 'tiktok' ELSE 'x' END"


def raw_items(spark, d):
    """Events as raw items of four platforms, each with the keys that this platform uses."""
    n, id_ = F.col("event_id"), F.col("event_id").cast("string")
    e = table(spark, d, "events").withColumn("platform", F.expr(PLATFORM))
    k = F.get_json_object("props", "$.k").cast("int")
    reach = F.when(n % 6 == 5, -1).otherwise(k)
    has_id, on = n % 11 != 0, lambda *names: F.col("platform").isin(*names)
    text = F.when(n % 5 == 0, "").otherwise(F.col("event_type"))
    film = lambda rate, name: F.struct(rate.cast("bigint").alias("bitrate"), F.lit("video/mp4").alias("content_type"), F.concat(F.lit(f"https://video.twimg.com/{name}/"), id_, F.lit(".mp4")).alias("url"))
    still = F.concat(F.lit("https://pbs.twimg.com/"), id_, F.lit(".jpg"))
    variants = F.when(n % 3 == 0, F.array(film(n % 300, "a"), film(n * 13 % 300, "b"), film(n % 300, "c")))
    medium = F.struct(still.alias("media_url_https"), F.struct(variants.alias("variants")).alias("video_info"))
    deep = F.struct(F.concat(F.lit("https://scontent.fbcdn.net/"), id_, F.lit(".HEIC")).alias("src"))
    for key in "jihgfedcb":
        deep = F.struct(F.array(deep).alias(key))
    cover = F.concat(F.lit("https://p16.tiktokcdn.com/"), id_, F.lit(".webp"))
    body = F.to_json(
        F.struct(
            F.when(has_id & on("facebook") & (n % 8 == 0), id_).alias("post_id"), F.when(has_id & on("facebook") & (n % 8 != 0), id_).alias("postId"),
            F.when(has_id & on("instagram") & (n % 3 == 0), id_).alias("shortCode"), F.when(has_id & (on("x", "tiktok") | on("instagram") & (n % 3 != 0)), id_).alias("id"),
            F.when(on("facebook") & (n % 8 == 0), text).alias("message"), F.when(~on("instagram"), text).alias("text"), F.when(on("instagram"), "caption").alias("caption"),
            F.when(on("x") & (n % 7 == 0), F.lit("https://x.com/i/1")).alias("twitterUrl"), F.when(on("facebook", "instagram") & (n % 9 == 0), F.lit("https://example.org/p")).alias("url"),
            F.when(on("facebook"), reach).alias("likes"), F.when(on("facebook") & (n % 16 == 0), F.lit(7)).alias("reactions_count"), F.when(on("instagram"), reach).alias("likesCount"),
            F.when(on("tiktok"), reach).alias("playCount"), F.when(on("x"), reach).alias("retweetCount"), F.when(on("x") & (n % 5 == 3), F.lit(0)).alias("viewCount"),
            F.struct(F.lit("https://scontent.fbcdn.net/face.jpg").alias("picture")).alias("authorMeta"), F.struct(F.lit("https://scontent.fbcdn.net/cover.jpg").alias("cover")).alias("musicMeta"),
            F.when(on("facebook"), deep).alias("a"), F.when(on("x"), F.struct(F.array(medium).alias("media"))).alias("extendedEntities"),
            F.when(on("tiktok"), F.struct(cover.alias("coverUrl"))).alias("videoMeta"), F.when(on("tiktok") & (n % 4 == 2) & (n % 3 == 0), F.array(F.lit("https://api.apify.com/f.mp4"))).alias("mediaUrls"),
            F.when(on("instagram"), F.array_compact(F.array(F.when(n % 3 == 1, F.lit("https://a.cdninstagram.com/1.jpg"))))).alias("images"), F.when(on("instagram"), F.lit("https://a.cdninstagram.com/d.jpg")).alias("displayUrl"),
        )
    )
    return e.select(n.alias("event_id"), id_.alias("post_id"), "platform", body.alias("item"))


@register("src01_platform_posts", f"""WITH r AS (SELECT event_id AS n, CAST(event_id AS VARCHAR) AS i, {PLATFORM} AS platform, event_type, CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events WHERE event_id % 11 <> 0)
SELECT platform, i AS post_id, CASE WHEN platform = 'instagram' THEN 'caption' WHEN n % 5 = 0 THEN '' ELSE event_type END AS text,
  CASE WHEN platform = 'facebook' THEN CASE WHEN n % 9 = 0 THEN 'https://example.org/p' ELSE 'https://www.facebook.com/' || i END
    WHEN platform = 'instagram' THEN CASE WHEN n % 9 = 0 THEN 'https://example.org/p' WHEN n % 3 = 0 THEN 'https://www.instagram.com/p/' || i || '/' ELSE 'https://www.instagram.com/p/null/' END
    WHEN platform = 'x' AND n % 7 = 0 THEN 'https://x.com/i/1' END AS url,
  CASE WHEN platform = 'facebook' AND n % 16 = 0 THEN 7 WHEN k = 0 THEN NULL ELSE k END AS reach FROM r""")
def platform_posts(spark, d):
    return R.posts(raw_items(spark, d)).select("platform", "post_id", "text", "url", F.nullif("reach", F.lit(0)).alias("reach"))


@register("src02_media_urls", """SELECT CAST(event_id AS VARCHAR) AS post_id, 'https://scontent.fbcdn.net/' || CAST(event_id AS VARCHAR) || '.HEIC' AS url, 'image' AS kind FROM events WHERE event_id % 4 = 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 'https://a.cdninstagram.com/d.jpg', 'image' FROM events WHERE event_id % 4 = 1
UNION ALL SELECT CAST(event_id AS VARCHAR), 'https://a.cdninstagram.com/1.jpg', 'image' FROM events WHERE event_id % 4 = 1 AND event_id % 3 = 1""")
def media(spark, d):
    return R.media_urls(raw_items(spark, d), ("fbcdn.net", "cdninstagram.com")).select("post_id", "url", "kind")


@register("src02_ordered_links", """SELECT CAST(event_id AS VARCHAR) AS post_id, CAST(0 AS INTEGER) AS place, 'https://a.cdninstagram.com/1.jpg' AS url FROM events WHERE event_id % 4 = 1 AND event_id % 3 = 1
UNION ALL SELECT CAST(event_id AS VARCHAR), CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END, 'https://a.cdninstagram.com/d.jpg' FROM events WHERE event_id % 4 = 1""")
def ordered(spark, d):
    """Of one platform's items: the pictures that they name themselves come before what else is in them."""
    items = raw_items(spark, d).where("platform = 'instagram'")
    return R.ordered_media(items, ("cdninstagram.com",)).select("post_id", "place", "url")


@register("src03_best_video", """WITH e AS (SELECT event_id AS n, CAST(event_id AS VARCHAR) AS i, event_id % 4 AS p FROM events)
SELECT i AS post_id, CASE WHEN p = 3 AND n % 3 = 0 OR p = 2 AND n % 3 = 0 THEN 'video' ELSE 'image' END AS kind,
  CASE WHEN p = 1 AND n % 3 = 1 THEN 'https://a.cdninstagram.com/1.jpg' WHEN p = 1 THEN 'https://a.cdninstagram.com/d.jpg' WHEN p = 2 AND n % 3 = 0 THEN 'https://api.apify.com/f.mp4' WHEN p = 2 THEN 'https://p16.tiktokcdn.com/' || i || '.webp'
    WHEN n % 3 <> 0 THEN 'https://pbs.twimg.com/' || i || '.jpg' WHEN n % 300 >= n * 13 % 300 THEN 'https://video.twimg.com/a/' || i || '.mp4' ELSE 'https://video.twimg.com/b/' || i || '.mp4' END AS url
FROM e WHERE p > 0""")
def best(spark, d):
    """The media that items name in fields of their own: an equal bitrate leaves the first film, no film the still image."""
    return R.known_media(raw_items(spark, d)).select("post_id", "kind", "url")


@register("src04_route_platform", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/]*\.)?spam-farm\.example\.org') THEN 'farm' WHEN regexp_matches(url, '^https?://([^/]*\.)?example\.com') THEN 'com' WHEN regexp_matches(url, '^https?://([^/]*\.)?example\.net') THEN 'net' END AS platform FROM pages")
def routed(spark, d):
    names = {"spam-farm.example.org": "farm", "example.com": "com", "example.net": "net"}
    suffixes = spark.createDataFrame(list(names.items()), "suffix string, platform string")
    return R.route_platform(table(spark, d, "pages").select("page_id", "url"), suffixes).select("page_id", "platform")


@register("src05_archive_rows", "SELECT concat_ws(':', 'arch', source, CAST(doc_id AS VARCHAR)) AS uid, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'north' END, 'south') AS side, n_chars AS views FROM documents WHERE trim(text) <> ''")
def archive(spark, d):
    raw = table(spark, d, "documents").select(F.col("source").alias("channel"), F.col("doc_id").alias("post_id"), "text", "lang", F.concat(F.col("n_chars").cast("string"), F.lit(".7")).alias("views"), F.when(F.col("doc_id") % 3 == 0, "north").alias("side"))
    return R.archive_rows(raw, "arch", "south").select("uid", "side", "views")


@register("src05_archive_layouts", """WITH a AS (SELECT doc_id AS n, source, text FROM documents WHERE trim(text, ' ') <> '')
SELECT 'messages' AS source, source AS channel, CASE WHEN n % 2 = 0 THEN 'photo' WHEN n % 3 = 0 THEN 'video' END AS media_type, n % 2 = 0 OR n % 3 = 0 AS has_media, n % 5 = 0 AS is_forward, CASE WHEN n % 5 = 0 THEN CAST(n AS VARCHAR) END AS fwd_from, n % 100 AS views, length(text) AS chars FROM a
UNION ALL SELECT 'flat', NULL, CASE n % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'other' END, n % 3 < 2, n % 7 = 0, NULL, CASE WHEN n % 2 = 0 THEN n END, length(text) FROM a
UNION ALL SELECT 'study', NULL, NULL, NULL, NULL, NULL, NULL, length(text) FROM a""")
def layouts(spark, d):
    """The corpus written as CSV in three layouts of public archives, read back and brought onto the common schema."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    literal = F.concat(F.lit("{'photos': ["), F.when(n % 2 == 0, "'p'").otherwise(""), F.lit("], 'videos': ["), F.when((n % 2 == 1) & (n % 3 == 0), "'v'").otherwise(""), F.lit("]}"))
    raw = {
        "messages": docs.select(F.col("text").alias("message"), literal.alias("media"), F.concat(F.lit("["), F.when(n % 5 == 0, "True").otherwise("False"), F.lit(", "), n.cast("string"), F.lit("]")).alias("fwd_from"), F.lit("{'x': 3}").alias("reactions"), F.col("source").alias("channel"), n.cast("string").alias("post_id"), F.lit("2024-01-02 03:04:05+00:00").alias("post_datetime"), F.concat((n % 100).cast("string"), F.lit(".0")).alias("post_views"), F.lit("n").alias("post_forwards")),
        "flat": docs.select(F.col("text").alias("message"), F.lit("2024-01-02").alias("date"), F.when(n % 3 < 2, "1").otherwise("0").alias("contains_media"), F.when(n % 3 == 0, "MessageMediaPhoto").when(n % 3 == 1, "MessageMediaPoll").otherwise("NA").alias("media_type"), F.when(n % 2 == 0, n.cast("string")).otherwise("NA").alias("views"), F.lit("1").alias("number_forwards"), F.lit("2").alias("number_replies"), F.when(n % 7 == 0, "1").otherwise("0").alias("is_forward"), F.lit("NA").alias("domain"), F.lit("4.0").alias("video_duration_secs")),
        "study": docs.select(n.cast("string").alias("id"), F.col("text").alias("message"), F.lit("russia").alias("positionality"), F.lit("1").alias("dehumanising_outgroup")),
    }
    out = None
    for name, rows in raw.items():
        at = folder(spark)
        rows.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(at)
        read = R.archive_csv(spark, at, ", ".join(f"{c} string" for c in rows.columns))
        part = R.archive_rows(R.laid_out(read, name), name, "unknown").select("source", "channel", "media_type", "has_media", "is_forward", "fwd_from", "views", F.length("text").alias("chars"))
        out = part if out is None else out.unionByName(part)
    return out


@register("src06_channel_sides", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'left' WHEN source = 'src3' THEN 'right' ELSE 'none' END AS side FROM documents")
def sides(spark, d):
    known = spark.createDataFrame([("SRC1", "left"), ("src2", "left"), ("Src3", "right")], "username string, side string")
    return R.with_side(table(spark, d, "documents").select("doc_id", F.col("source").alias("channel")), known, "none").select("doc_id", "side")


@register("src07_python_literals", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 2 = 0 END AS has_media, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS media_type FROM events")
def literals(spark, d):
    n = F.col("event_id")
    text = F.when(n % 9 == 0, "{broken").otherwise(F.concat(F.lit("{'has': "), F.when(n % 2 == 0, "True").otherwise("False"), F.lit(", 'type': '"), F.col("event_type"), F.lit("', 'from': None}")))
    parsed = R.python_literal(text, "has boolean, type string, from string")
    return table(spark, d, "events").select("event_id", parsed.has.alias("has_media"), parsed.type.alias("media_type"))


@register("src09_policy_entries", "SELECT item_id FROM benchmark WHERE item_id % 3 = 0")
def policy(spark, d):
    entries = table(spark, d, "benchmark").withColumn("status", F.when(F.col("item_id") % 3 == 0, "approved").otherwise("draft"))
    return R.policy_entries(entries).select("item_id")


@register("src12_prototypes", "SELECT count(CASE WHEN label < 5 THEN 1 END) AS positive, count(CASE WHEN label >= 5 THEN 1 END) AS negative FROM embeddings WHERE vec_id % 7 <> 0")
def examples(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).alias("positive"), (F.col("vec_id") % 7 == 0).alias("restricted"))
    yes, no = R.prototypes(rows)
    return yes.unionByName(no).agg(F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"))


@register("src13_fingerprint", "SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(31) || CAST(quality AS VARCHAR) || chr(31) || CAST(toxic AS VARCHAR)), 1, 16) AS UBIGINT)) AS VARCHAR) AS hash FROM labels")
def frozen(spark, d):
    return R.fingerprint(table(spark, d, "labels"))


@register("snk02_insert_if_absent", "WITH n AS (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) SELECT k, first FROM n WHERE k NOT IN (SELECT user_id FROM events)")
def insert(spark, d):
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("first"))
    known = table(spark, d, "events").select(F.col("user_id").alias("k")).distinct()
    return K.absent(new, known, "k", "first")


@register("snk03_publish_payloads", sql("sightings", body=" SELECT 's' || CAST(id AS VARCHAR) AS external_id, url, CASE WHEN coalesce(priority, 'none') = 'none' THEN 'standard' ELSE priority END AS priority, CASE WHEN lane IN ('view', 'click') THEN 'PUBLIC' ELSE 'SCRAP' END AS source, 'Review (' || lane || ')' AS context FROM sightings WHERE NOT restricted"))
def publish(spark, d):
    return K.payloads(view(spark, d, "sightings"))


@register("snk05_unified_metrics", sql("scored", body=", c AS (SELECT class, count(*) AS n, sum(CASE WHEN y AND score >= 0.5 THEN 1 ELSE 0 END) AS tp FROM scored GROUP BY class) SELECT 'by class' AS experiment, class, CAST(tp AS VARCHAR) AS tp, CAST(n AS VARCHAR) AS n FROM c UNION ALL SELECT 'all', NULL, CAST(sum(tp) AS VARCHAR), CAST(sum(n) AS VARCHAR) FROM c"))
def unified(spark, d):
    rows = view(spark, d, "scored")
    half = F.col("score") >= 0.5
    return K.unified_metrics({"by class": E.metrics(rows, half, "class"), "all": E.metrics(rows, half)}, ["class", "tp", "n"])


@register("snk05_confusion_list", sql("scored", body=", c AS (SELECT 'toxic' AS experiment, coalesce(class, 'all') AS task, y AS gold, score >= 0.5 AS p FROM scored UNION ALL SELECT 'good', 'all', judge, score_b >= 0.5 FROM scored) SELECT experiment || '|' || task AS id, sum(CASE WHEN gold AND p THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN gold AND NOT p THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT gold AND p THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT gold AND NOT p THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN gold THEN 1 ELSE 0 END) AS n_pos, sum(CASE WHEN gold THEN 0 ELSE 1 END) AS n_neg FROM c GROUP BY 1"))
def confusion_list(spark, d):
    """The confusion list as JSON, written and read back."""
    rows, at = view(spark, d, "scored"), folder(spark)
    good = rows.select(F.col("judge").alias("y"), F.col("score_b").alias("score"))
    half = F.col("score") >= 0.5
    found = K.confusion_list({"toxic": E.metrics(rows, half, "class"), "good": E.metrics(good, half)}, "class")
    K.write_table(found, at, "json")
    cell = lambda i, j: F.col("values")[i][j]
    read = spark.read.schema(found.schema).json(at)
    return read.select("id", cell(0, 0).alias("tp"), cell(0, 1).alias("fn"), cell(1, 0).alias("fp"), cell(1, 1).alias("tn"), "n_pos", "n_neg")


@register("src08_jsonl_scan", "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def jsonl(spark, d):
    """The corpus written as JSON lines in the shared folder and scanned again with an explicit schema."""
    at = folder(spark)
    table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text").write.json(at)
    return R.jsonl(spark, at, "doc_id bigint, lang string, n_chars bigint").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@register("src10_labelled_pool", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n, sum(toxic) AS toxic FROM labels GROUP BY 1")
def pool(spark, d):
    """Labels written as one folder per split; the split comes back from the path of each file."""
    at = folder(spark)
    part = F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train")
    table(spark, d, "labels").withColumn("part", part).write.partitionBy("part").parquet(at)
    rows = R.labelled_pool(spark, at, ["doc_id", "toxic"])
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


@register("src11_labelled_samples", "SELECT item_id, length(text) AS length FROM benchmark")
def samples(spark, d):
    """Benchmark items as JSON documents with a ``posts`` array, read back row by row."""
    at = folder(spark)
    rows = table(spark, d, "benchmark").groupBy((F.col("item_id") % 4).alias("file")).agg(F.collect_list(F.struct("item_id", "text")).alias("posts"))
    rows.select("posts").repartition(4).write.option("maxRecordsPerFile", 1).json(at)
    return R.samples(spark, at, "item_id: bigint, text: string").select("item_id", F.length("text").alias("length"))


CANDIDATE_SQL = PATTERN_SQL + f""", k AS (SELECT *, sha256({NORMAL}) AS dup_key, coalesce(regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(newborn|pupil|toddle|orphana|kindergart|child)'), false) AS minor FROM x),
g AS (SELECT dup_key, count(*) AS copies, count(DISTINCT channel) AS channels FROM k GROUP BY dup_key),
c AS (SELECT k.*, g.copies, g.channels FROM k JOIN g ON k.dup_key = g.dup_key WHERE strength IS NOT NULL)"""


def candidate_rows(spark, d):
    """The posts, and the candidates among them with their duplicate keys. Patterns are sought in each text once, ages in
    those of candidates alone."""
    posts = view(spark, d, "posts")
    keyed = posts.withColumns({"dup_key": T.exact_key(F.col("text")), "low": F.lower("text")})
    keyed = keyed.withColumn("hits", L.pattern_hits(F.col("low"), L.pattern_table(spark), lowered=True))
    sought = F.when(F.size("hits") > 0, F.regexp_replace("text", r"\d", " "))
    minor = F.size(L.age_labels(F.coalesce(sought, F.lit("")), L.age_table(spark))) > 0
    return posts, K.candidate_rows(keyed, L.strength(F.col("hits")), F.transform("hits", lambda h: h.id), minor)


@register("snk04_candidate_file", sql("posts", body=CANDIDATE_SQL + " SELECT seq, dup_key, strength, ids AS patterns, minor, copies, channels, CASE WHEN NOT minor THEN length(text) END AS length FROM c"))
def candidate_file(spark, d):
    """The candidates as JSON lines, written and read back."""
    at, rows = folder(spark), candidate_rows(spark, d)[1]
    K.write_table(rows, at, "json")
    return spark.read.schema(rows.schema).json(at).select("seq", "dup_key", "strength", F.array_join("patterns", ",").alias("patterns"), "minor", "copies", "channels", F.length("text").alias("length"))


def by_name(section, name, rows="SELECT coalesce({0}, 'unknown') AS name, sum(hit) AS n, sum(post) AS total FROM b GROUP BY 1 HAVING sum(hit) > 0"):
    return f"SELECT '{section}' AS section, name, n, total FROM ({rows.format(name)}) y"


REPORT_SQL = CANDIDATE_SQL + ", b AS (SELECT side, lang, month, 0 AS hit, 1 AS post FROM posts UNION ALL SELECT side, lang, month, 1, 0 FROM c), r AS (" + " UNION ALL ".join([
    "SELECT 'all' AS section, 'all' AS name, sum(hit) AS n, sum(post) AS total FROM b", *(by_name(c, c) for c in ("side", "lang", "month")),
    "SELECT 'strength', strength, count(*), NULL FROM c GROUP BY 2", "SELECT 'pattern', unnest(string_split(ids, ',')), count(*), NULL FROM c GROUP BY 2", "SELECT 'minor', 'anywhere', count(*), NULL FROM c WHERE minor HAVING count(*) > 0",
    "SELECT 'texts', 'distinct', count(DISTINCT dup_key), NULL FROM c", "SELECT 'texts', 'wide', count(DISTINCT CASE WHEN channels >= 3 THEN dup_key END), NULL FROM c",
    "SELECT 'channel', name, n, NULL FROM (SELECT coalesce(channel, 'unknown') AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, coalesce(channel, 'unknown')) AS r FROM c GROUP BY 1) y WHERE r <= 25",
]) + ") SELECT section, name, n, total, CASE WHEN total > 0 THEN CAST(n AS DOUBLE) / total END AS rate FROM r"


@register("snk04_count_report", sql("posts", body=REPORT_SQL))
def count_report(spark, d):
    """The report of the candidate file as CSV, written and read back."""
    at, (posts, found) = folder(spark), candidate_rows(spark, d)
    rows = K.candidate_report(posts, cut(found.drop("text")))
    K.write_table(rows, at)
    return spark.read.schema(rows.schema).option("header", True).csv(at)


@register("snk04_candidate_report", "SELECT source AS channel, count(*) AS n FROM documents WHERE regexp_matches(lower(text), 'license') GROUP BY source")
def report(spark, d):
    """A report of counts, never of text, written as CSV and read back."""
    at = folder(spark)
    counts = table(spark, d, "documents").where(F.lower("text").contains("license")).groupBy(F.col("source").alias("channel")).agg(F.count("*").alias("n"))
    K.write_table(counts, at)
    return spark.read.schema("channel string, n bigint").option("header", True).csv(at)
