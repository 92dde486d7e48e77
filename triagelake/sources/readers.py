"""Readers: raw platform items, archives, channel and policy tables, labelled pools, frozen references."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from triagelake.functions.text import host_of, media_kind

POST = "platform string, post_id string, text string, url string, posted_at timestamp, reach bigint"
# Keys whose subtree is about people, not about the post; hosts that serve each platform's media.
PERSON_KEYS = ("author", "owner", "user", "profile", "avatar", "music")
MEDIA_HOSTS = {"facebook": ("fbcdn.net",), "instagram": ("cdninstagram.com", "fbcdn.net"), "tiktok": ("api.apify.com", "tiktokcdn.com", "tiktokcdn-us.com", "tiktokcdn-eu.com"), "x": ("pbs.twimg.com", "video.twimg.com")}
# Of each platform, where its raw items keep id, text, link, time and reach (the first that is there and not
# empty counts), the link of a post without one, where %s stands for the key named after it, and the links of its media.
PATHS = {
    "facebook": {"post_id": ("post_id", "postId"), "text": ("message", "text"), "url": ("url", "post_url"), "posted_at": ("timestamp", "time"), "reach": ("reactions_count", "likes")},
    "instagram": {"post_id": ("id", "shortCode"), "text": ("caption",), "url": ("url",), "posted_at": ("timestamp",), "reach": ("videoViewCount", "likesCount")},
    "tiktok": {"post_id": ("id",), "text": ("text",), "url": ("webVideoUrl",), "posted_at": ("createTimeISO",), "reach": ("playCount",)},
    "x": {"post_id": ("id",), "text": ("fullText", "text"), "url": ("url", "twitterUrl"), "posted_at": ("createdAt",), "reach": ("viewCount", "retweetCount")},
}
DEFAULT_LINKS = {"facebook": ("https://www.facebook.com/%s", ("post_id", "postId")), "instagram": ("https://www.instagram.com/p/%s/", ("shortCode",))}
#: The common schema of archive rows: names and types in order.
ARCHIVE = {
    "uid": "string", "source": "string", "side": "string", "channel": "string", "post_id": "string", "date": "string", "text": "string", "lang": "string",
    "has_media": "boolean", "media_type": "string", "views": "bigint", "forwards": "bigint", "replies": "bigint", "reactions": "map<string,bigint>",
    "is_forward": "boolean", "fwd_from": "string", "extra": "map<string,string>",
}


def first_text(item: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that is there and holds something. The number 0 and false hold nothing; as texts they do."""
    value = lambda k: F.get_json_object(item, f"$.{k}")
    return F.coalesce(*[F.when(~value(k).isin("", "0", "false") | quoted_value(item, k), value(k)) for k in keys])


def quoted_value(item: Column, key: str) -> Column:
    """Whether a top-level value is a text that isn't empty."""
    of = F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), f"$.{key}", "variant"))
    return F.coalesce((of == "STRING") & (F.get_json_object(item, f"$.{key}") != ""), F.lit(False))


def lenient_long(text: Column) -> Column:
    """int(float(x)), null for what isn't a number."""
    return text.try_cast("double").try_cast("bigint")


def lenient_time(text: Column) -> Column:
    """A time from epoch seconds or from ISO text, null for anything else."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("bigint")), text.try_cast("timestamp"))


def whole_number(text: Column) -> Column:
    """A JSON number without a fraction, 0 or more; null for anything else, text in quotes included."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))


def posts(items: DataFrame) -> DataFrame:
    """Raw items (platform, item JSON) of the known platforms as posts; items without an id are dropped.

    A post without a link gets the platform's own form of one, where it has any. All platforms are read in one pass.
    """
    of = F.col("platform")
    by = lambda column: F.coalesce(*[F.when(of == p, column(p)) for p in PATHS])
    field = lambda name: by(lambda p: first_text(F.col("item"), PATHS[p][name]))
    made = lambda p: F.format_string(DEFAULT_LINKS[p][0], first_text(F.col("item"), DEFAULT_LINKS[p][1])) if p in DEFAULT_LINKS else F.lit(None).cast("string")
    rows = items.where(of.isin(*PATHS)).select(
        "platform", field("post_id").alias("post_id"), F.coalesce(field("text"), F.lit("")).alias("text"), F.coalesce(field("url"), by(made)).alias("url"),
        lenient_time(field("posted_at")).alias("posted_at"), whole_number(field("reach")).alias("reach"),
    )
    return rows.where(F.col("post_id").isNotNull())


def best_video(variants: Column) -> Column:
    """The mp4 variant with the highest bitrate of array<struct<bitrate,content_type,url>>, the first of equal ones; or
    null."""
    films = F.filter(variants, lambda v: v.content_type == "video/mp4")
    return F.array_max(F.transform(films, lambda v, i: F.struct(F.coalesce(v.bitrate, F.lit(0)).alias("bitrate"), (-i).alias("place"), v.url.alias("url")))).url


def best_medium(variants: Column, still: Column) -> Column:
    """struct<kind,url>: the best film of a medium, else its still image; null without either."""
    film = best_video(variants)
    one = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    return F.when(film.isNotNull(), one("video", film)).when(F.nullif(still, F.lit("")).isNotNull(), one("image", still))


def known_media(items: DataFrame) -> DataFrame:
    """(post_id, place, kind, url): the media that a platform's items name in a field of their own, in order.

    A film stands before the images of an Instagram post, whose preview counts only where it has neither; TikTok's cover
    only where no file is named; of each medium of an X post its best film or its still image.
    """
    kinds = {"videoUrl": "string", "images": "array<string>", "displayUrl": "string", "mediaUrls": "array<string>"}
    of = lambda name, kind: F.from_json(F.get_json_object("item", f"$.{name}"), kind) if kind != "string" else F.nullif(F.get_json_object("item", f"$.{name}"), F.lit(""))
    video, images, preview, files = (of(*x) for x in kinds.items())
    none = F.array().cast("array<struct<kind:string,url:string>>")
    one = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    each = lambda kind, urls: F.coalesce(F.transform(urls, lambda u: one(kind, u)), none)
    only = lambda kind, url: F.when(url.isNotNull(), F.array(one(kind, url))).otherwise(none)
    variants = "array<struct<media_url_https string, video_info struct<variants array<struct<bitrate bigint, content_type string, url string>>>>>"
    media = of("extendedEntities.media", variants)
    found = (
        F.when(F.col("platform") == "facebook", only("video", of("video_files.video_sd_file", "string")))
        .when(F.col("platform") == "instagram", F.concat(only("video", video), each("image", images), F.when(video.isNull() & (F.coalesce(F.size(images), F.lit(0)) <= 0), only("image", preview)).otherwise(none)))
        .when(F.col("platform") == "tiktok", F.when(F.size(files) > 0, each("video", files)).otherwise(only("image", of("videoMeta.coverUrl", "string"))))
        .when(F.col("platform") == "x", F.coalesce(F.array_compact(F.transform(media, lambda m: best_medium(m.video_info.variants, m.media_url_https))), none))
    )
    return items.select("post_id", F.posexplode(found).alias("place", "m")).select("post_id", "place", "m.kind", "m.url").where("url <> ''")


def links_of(item: str | None) -> list[str]:
    """Distinct https texts anywhere in an item (JSON), depth first in the item's order, but under no key about a person."""
    try:
        todo = [("", json.loads(item))] if item else []
    except ValueError:
        return []
    found: dict[str, None] = {}
    while todo:
        key, value = todo.pop()
        if any(name in key.lower() for name in PERSON_KEYS):
            continue
        if isinstance(value, dict):
            todo += reversed(value.items())
        elif isinstance(value, list):
            todo += [(key, v) for v in reversed(value)]
        elif isinstance(value, str) and value.startswith("https://"):
            found[value] = None
    return list(found)


@udtf(returnType="place int, url string")
class Links:
    """Rows (place, url) of the links of one item."""

    def eval(self, item: str):
        yield from enumerate(links_of(item))


def media_urls(items: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """(post_id, place, url, kind): media links of allowed hosts anywhere in an item but under a person's key, distinct and
    in the item's order; one pass, no shuffle."""
    found = items.lateralJoin(Links(F.col("item").outer())).select("post_id", "place", "url")
    host = host_of(F.col("url"))
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (host == h) | host.endswith("." + h)
    return found.where(allowed).select("post_id", "place", "url", media_kind(F.col("url")).alias("kind")).where("kind is not null")


def ordered_media(items: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """(post_id, place, kind, url): what an item names in fields of its own first, then all other media links, each once."""
    own = known_media(items).select("post_id", F.lit(0).alias("turn"), "place", "kind", "url")
    rest = media_urls(items, hosts).select("post_id", F.lit(1).alias("turn"), "place", "kind", "url")
    first = own.unionByName(rest).groupBy("post_id", "kind", "url").agg(F.min(F.struct("turn", "place")).alias("at"))
    order = Window.partitionBy("post_id").orderBy("at")  # an item's own links
    return first.select("post_id", (F.row_number().over(order) - 1).alias("place"), "kind", "url")


def route_platform(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds ``platform`` by host suffix: an equi-join of every suffix of the host with the (suffix, platform) table."""
    parts = F.split(host_of(F.col("url")), r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = urls.select("url", F.posexplode(F.array_distinct(names)).alias("pos", "suffix")).distinct().join(suffixes, "suffix").groupBy("url").agg(F.min_by("platform", "pos").alias("platform"))
    return urls.join(found, "url", "left")


def python_literal(text: Column, schema: str) -> Column:
    """A Python-literal column as a struct or map: quotes and constants become JSON, what doesn't parse becomes null."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    return F.from_json(F.regexp_replace(text, "'", '"'), schema)


def archive_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV archive with an explicit schema; quoted line breaks are kept and malformed lines dropped."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "DROPMALFORMED").option("escape", '"').csv(path)


def archive_rows(raw: DataFrame, source: str, default_side: str) -> DataFrame:
    """Archive rows on the common schema: blank texts go, missing columns are null, counts are read leniently."""
    have = set(raw.columns)
    field = lambda name, default=None: F.col(name) if name in have else F.lit(default)
    counts = {c: lenient_long(field(c).cast("string")).alias(c) for c in ("views", "forwards", "replies")}
    rows = raw.where(F.trim(F.coalesce(field("text").cast("string"), F.lit(""))) != "")
    key = F.coalesce(F.concat_ws(":", field("channel").cast("string"), field("post_id").cast("string")), F.lit(""))
    # an archive without ids gets one from the content of each row
    key = F.when(key == "", F.hex(F.xxhash64(*[F.col(c).cast("string") for c in raw.columns if not dict(raw.dtypes)[c].startswith("map")]))).otherwise(key)
    uid = F.concat_ws(":", F.lit(source), key)
    chosen = {"uid": uid, "source": F.lit(source), "side": F.coalesce(field("side").cast("string"), F.lit(default_side))}
    columns = []
    for name, kind in ARCHIVE.items():
        value = counts[name] if name in counts else chosen.get(name, field(name))
        columns.append(value.cast(kind).alias(name))
    return rows.select(*columns)


# How three archives name their columns, as SQL over the raw columns for each common one. Columns that a
# layout doesn't have are null. ``media``, ``fwd_from`` and ``reactions`` of the first are Python literals.
LAYOUTS = {
    "messages": {
        "channel": "channel", "post_id": "post_id", "date": "left(post_datetime, 19)", "text": "message", "views": "post_views", "forwards": "post_forwards",
        "has_media": "coalesce(size(media.photos) > 0, false) OR coalesce(size(media.videos) > 0, false)",
        "media_type": "CASE WHEN size(media.videos) > 0 THEN 'video' WHEN size(media.photos) > 0 THEN 'photo' END",
        "reactions": "reactions", "is_forward": "coalesce(get(fwd_from, 0) = 'true', false)", "fwd_from": "CASE WHEN get(fwd_from, 0) = 'true' THEN get(fwd_from, 1) END",
    },
    "flat": {
        "post_id": "CAST(NULL AS STRING)", "date": "left(date, 19)", "text": "message", "views": "views", "forwards": "number_forwards", "replies": "number_replies",
        "has_media": "contains_media = '1'", "is_forward": "is_forward = '1'",
        "media_type": "CASE WHEN media_type = 'MessageMediaPhoto' THEN 'photo' WHEN media_type = 'MessageMediaDocument' THEN 'video_or_document' WHEN media_type <> 'NA' THEN 'other' END",
        "extra": "map('domain', nullif(domain, 'NA'), 'video_duration_secs', CAST(try_cast(try_cast(video_duration_secs AS DOUBLE) AS BIGINT) AS STRING))",
    },
    "study": {
        "post_id": "id", "text": "message", "extra": "map('positionality', coalesce(positionality, ''), 'dehumanising_outgroup', dehumanising_outgroup)",
        "side": "CASE WHEN positionality LIKE 'ukraine%' THEN 'ukrainian' WHEN positionality = 'russia' THEN 'russian' ELSE 'unknown' END",
    },
}
LITERALS = {"media": "photos array<string>, videos array<string>", "fwd_from": "array<string>", "reactions": "map<string,bigint>"}


def laid_out(raw: DataFrame, layout: str) -> DataFrame:
    """A raw archive with its columns under the common names, ready for ``archive_rows``. Literals that don't parse are null."""
    if layout == "messages":
        raw = raw.withColumns({name: python_literal(F.col(name), kind) for name, kind in LITERALS.items()})
    return raw.select(*(F.expr(value).alias(name) for name, value in LAYOUTS[layout].items()))


def with_side(rows: DataFrame, sides: DataFrame, default: str) -> DataFrame:
    """Adds ``side`` from the (username, side) table by lower-cased channel."""
    known = sides.select(F.lower("username").alias("_user"), F.col("side").alias("_side")).dropDuplicates(["_user"])
    return rows.join(known, F.lower("channel") == F.col("_user"), "left").withColumn("side", F.coalesce("_side", F.lit(default))).drop("_user", "_side")


def jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


# Tables of a policy folder, with the columns that matching and prototypes take.
POLICY = {
    "entries": "id string, type string, region string, language string, value string, meaning string, status string, supports array<string>, context_notes string",
    "age_terms": "lang string, kind string, value string, number int",
    "patterns": "id string, lang string, strength string, pattern string, near_a string, near_b string, window int",
    "examples": "id string, lang string, modality string, text string, restricted boolean, expected string",
}
AGE_KINDS = {"words": "word", "institutions": "institution", "age_units": "unit", "infant_units": "infant", "stated_age_phrases": "phrase", "grade_patterns": "grade", "not_followed_by": "stop"}


def policy_rows(kind: str, text: str) -> list[dict]:
    """Rows of one table in a policy file: YAML with entries, age_terms or patterns; JSON lines for examples."""
    if kind == "examples":
        rows = [json.loads(line) for line in text.splitlines() if line.strip()]
        return [r | {"text": r.get("text") or r.get("image_description"), "restricted": bool(r.get("restricted")), "expected": json.dumps(r.get("expected"))} for r in rows]
    import yaml

    document = yaml.safe_load(text) or {}
    if kind == "entries":
        return document.get("entries") or []
    if kind == "patterns":
        near = lambda r: dict(zip(("near_a", "near_b", "window"), r.get("near") or (None, None, None)))
        return [{"id": r["id"], "lang": r.get("lang"), "strength": r.get("strength"), "pattern": r.get("regex")} | near(r) for r in document.get("patterns") or []]
    out = []
    for lang, lists in (document.get("age_terms") or {}).items():
        if isinstance(lists, dict):  # what stands beside the languages are notes
            out += [{"lang": lang, "kind": AGE_KINDS[name], "value": str(v), "number": None} for name, values in lists.items() if name in AGE_KINDS for v in values or []]
            out += [{"lang": lang, "kind": "number", "value": str(name), "number": int(n)} for name, n in (lists.get("number_words") or {}).items()]
    return out


def policy_table(spark: SparkSession, paths: list[str], kind: str, approved_only: bool = True) -> DataFrame:
    """A table of POLICY from files (YAML, or JSON lines for examples), read by Spark from wherever they are, a task for
    each. Of entries only approved ones leave the tasks, unless asked otherwise. A file that can't be parsed is an error."""
    schema = StructType.fromDDL(POLICY[kind])

    def run(batches):
        for batch in batches:
            rows = [r for text in batch["value"].to_pylist() for r in policy_rows(kind, text)]
            if kind == "entries" and approved_only:
                rows = [r for r in rows if r.get("status") == "approved"]
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], arrow)

    arrow = spark.createDataFrame([], schema).toArrow().schema
    return spark.read.text(paths, wholetext=True).mapInArrow(run, schema)


def policy_entries(entries: DataFrame, allow_empty: bool = False) -> DataFrame:
    """The approved entries of a policy table; none at all is an error unless allowed."""
    approved = entries.where("status = 'approved'")
    if not allow_empty and approved.isEmpty():
        raise ValueError("the policy table has no approved entry")
    return approved


def labelled_pool(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Labelled parquet files, chosen columns only, with ``split`` from the last path part that names one."""
    name = F.regexp_extract("_metadata.file_path", r".*\b(train|dev|test)\b", 1)
    return spark.read.parquet(path).select(*columns, name.alias("split"))


def samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document with a ``posts`` array of labelled samples."""
    return spark.read.schema(f"posts array<struct<{schema}>>").option("multiLine", True).json(path).selectExpr("inline(posts)")


def prototypes(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positive and negative labelled examples; restricted placeholders are in neither."""
    usable = examples.where(~F.coalesce(F.col("restricted"), F.lit(False)))
    return usable.where("positive"), usable.where("NOT positive")


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash): a table's content whatever its order, by 64 bits of each row; repeated rows count."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])), 1, 16), 16, 10)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def check_frozen(df: DataFrame, rows: int, digest: str) -> DataFrame:
    """df itself if its fingerprint is the stored one; otherwise an error before anything is computed from it."""
    now = fingerprint(df).first()
    if (now["rows"], now["hash"]) != (rows, digest):
        raise ValueError("the frozen data has changed")
    return df
