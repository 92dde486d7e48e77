"""The review queue: items from sightings, matching of new rows to items, ordered replay, dashboard series."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.functions.simhash import simhash, simhash_md5
from triagelake.operators.similarity import IMAGE_LIMIT, SIMHASH_LIMIT, cut

MIN_WORDS_EXACT, MIN_WORDS_NEAR = 5, 8
RANKS = {"urgent": 0, "high": 1, "standard": 2, "none": 3}


def rank_of(priority: Column) -> Column:
    out = F.lit(4)
    for k, v in RANKS.items():
        out = F.when(priority == k, v).otherwise(out)
    return out


def items(sightings: DataFrame) -> DataFrame:
    """url, copies, first_id, last_ts, rank, top: one row per link; restricted sightings never enter the queue."""
    return sightings.where(~F.col("restricted")).groupBy("url").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.max("ts").alias("last_ts"), F.min(rank_of(F.col("priority"))).alias("rank"), F.max("value").alias("top"))


def page(queue: DataFrame, offset: int, size: int) -> DataFrame:
    """The most pressing first: priority, then copies, then the newest."""
    return queue.orderBy("rank", F.desc("copies"), F.desc("last_ts"), "first_id").offset(offset).limit(size)


def reviewed_page(queue: DataFrame, offset: int, size: int) -> DataFrame:
    """The tab of reviewed items: the newest first."""
    return queue.orderBy(F.desc("last_ts"), "first_id").offset(offset).limit(size)


def page_count(queue: DataFrame, size: int) -> DataFrame:
    """total, pages: how many items there are, and pages of ``size``; an empty queue has one."""
    return queue.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))


def to_judge(posts: DataFrame, detections: DataFrame) -> DataFrame:
    """(key, representative, retry) of the groups that are to be judged, from posts (seq, key) and detections (seq, route).

    A group's detection is its newest; a group is judged once, and again where that was an error (``retry``). The first
    post stands for it. Detections of unknown posts and posts without a key count for nothing.
    """
    newest = F.max_by("route", F.when(F.col("route").isNotNull(), F.col("seq")))
    rows = posts.where("key IS NOT NULL").join(detections.select("seq", "route"), "seq", "left")
    groups = rows.groupBy("key").agg(F.min("seq").alias("representative"), newest.alias("route"))
    return groups.where("route IS NULL OR route = 'judge_error'").select("key", "representative", F.col("route").isNotNull().alias("retry"))


def filled_links(links: DataFrame, occurrences: DataFrame) -> DataFrame:
    """links (id, url, norm, ...) with ``norm`` where it was null, and ``first_seen``: whether a link that lacked it also
    lacks occurrences (id, ...), so that its own sighting becomes the first."""
    seen = occurrences.select("id").distinct().withColumn("_seen", F.lit(True))
    rows = links.join(seen, "id", "left")
    first = F.col("norm").isNull() & F.col("_seen").isNull()
    return rows.select("id", "url", F.coalesce("norm", T.normalize_url(F.col("url"))).alias("norm"), *(c for c in links.columns if c not in ("id", "url", "norm")), first.alias("first_seen"))


def missing_reports(reports: DataFrame, links: DataFrame) -> DataFrame:
    """The reports (report_id, url, ...) that the queue of links (id, norm) lacks: neither a link of the report's own id nor
    one of the same normalised link stands there. Of reports of one link the first is taken; those without one all are."""
    rows = reports.withColumns({"id": F.concat(F.lit("public-"), F.col("report_id").cast("string")), "norm": T.normalize_url(F.col("url"))})
    rows = rows.join(links.select("id"), "id", "left_anti").join(links.select("norm"), "norm", "left_anti").select("id", "norm", *reports.columns)
    first = rows.where("norm IS NOT NULL").groupBy("norm").agg(F.min_by(F.struct(*rows.columns), "report_id").alias("r")).select("r.*")
    return first.unionByName(rows.where("norm IS NULL"))


#: Kinds of which two values within the limit of bits are near copies; the others match whole.
NEAR_KINDS = {"text_simhash": SIMHASH_LIMIT, "media_phash": IMAGE_LIMIT}


def fingerprints(posts: DataFrame, media: DataFrame | None = None, by_md5: bool = False) -> DataFrame:
    """(seq, pos, kind, value) of posts (seq, text) and their media (seq, n, kind, sha, phash), in order of position.

    Texts have an exact fingerprint from five words on and a near one from eight on; every medium has its file's digest,
    and images their 64-bit picture hash, where there is one. With ``by_md5`` the near text hash is the one that SQL can
    repeat. Values of near kinds are signed 64-bit numbers as text.
    """
    rows = posts.select("seq", T.normalize_text(F.col("text")).alias("t"))
    rows = rows.withColumn("w", F.size(T.words(F.col("t"))))
    one = lambda pos, kind, value: F.struct(F.lit(pos).cast("long").alias("pos"), F.lit(kind).alias("kind"), value.alias("value"))
    parts = [F.when(F.col("w") >= MIN_WORDS_EXACT, one(0, "text_sha", F.sha2("t", 256)))]
    long_enough = F.col("w") >= MIN_WORDS_NEAR
    if by_md5:
        rows = cut(rows)  # normalised once, read twice
    else:
        parts.append(F.when(long_enough, one(1, "text_simhash", simhash(F.col("t")).cast("string"))))
    out = rows.select("seq", F.explode(F.array_compact(F.array(*parts))).alias("f")).select("seq", "f.*")
    if by_md5:
        near = simhash_md5(rows.where(long_enough).select(F.col("seq").alias("id"), F.col("t").alias("text")))
        out = out.unionByName(near.select(F.col("id").alias("seq"), F.lit(1).cast("long").alias("pos"), F.lit("text_simhash").alias("kind"), F.col("simhash").cast("string").alias("value")))
    if media is not None:
        at = 2 * F.col("n").cast("long")
        files = F.array(F.when(F.col("sha").isNotNull(), F.struct((at + 2).alias("pos"), F.lit("media_sha").alias("kind"), F.col("sha").alias("value"))), F.when((F.col("kind") == "image") & F.col("phash").isNotNull(), F.struct((at + 3).alias("pos"), F.lit("media_phash").alias("kind"), F.col("phash").cast("string").alias("value"))))
        out = out.unionByName(media.select("seq", F.explode(F.array_compact(files)).alias("f")).select("seq", "f.*"))
    return out


def match_items(new: DataFrame, known: DataFrame) -> DataFrame:
    """(id, item): the earliest known item with the same link or the same group key; two equi-joins instead of an OR."""
    links, keys = (known.groupBy(k).agg(F.min("id").alias("item")) for k in ("url", "group_key"))
    a = new.select("id", "url").join(links, "url").select("id", "item")
    b = new.select("id", "group_key").join(keys, "group_key").select("id", "item")
    return a.union(b).groupBy("id").agg(F.min("item").alias("item"))


def match_earlier(rows: DataFrame) -> DataFrame:
    """(id, item): the earliest row before each row with its link or its group key; rows without one are left out."""
    links, keys = (rows.groupBy(k).agg(F.min("id").alias(f"by_{k}")) for k in ("url", "group_key"))
    both = rows.select("id", "url", "group_key").join(links, "url", "left").join(keys, "group_key", "left")
    return both.select("id", F.least("by_url", "by_group_key").alias("item")).where("item < id")


def label_components(edges: DataFrame) -> DataFrame:
    """(node, root) over string nodes, root the least node of its component; a node linked with itself is one of its own.

    Nodes with one neighbour stand aside first, as in event data nearly all do, so the rounds go over what links them. Large
    stars and small stars by turns: every greater neighbour of a node is linked to the node's least neighbour, then
    every smaller one, until nothing moves. Rounds grow with the logarithm of the longest path, and a node with very many
    neighbours is an aggregate, never a list.
    """
    nodes = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    whole = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    ends = whole.union(whole.select("v", "u")).groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    leaves = cut(ends.where("n = 1").select(F.col("u").alias("leaf"), "v"))
    links = whole.join(leaves, whole["u"] == leaves["leaf"], "left_anti")
    links = cut(links.join(leaves, links["v"] == leaves["leaf"], "left_anti"))
    state = None
    while (now := links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != state and now[0]:
        state = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.union(low).where("u > v").distinct())
    # a leaf's place is its neighbour's; of two that have each other alone, the lesser one's
    alone = leaves.select(F.col("leaf").alias("v"), F.col("v").alias("other"))
    beside = leaves.join(alone, "v", "left").select(F.col("leaf").alias("node"), F.when(F.col("other").isNotNull(), F.least("leaf", "v")).otherwise(F.col("v")).alias("at"))
    placed = nodes.join(beside, "node", "left").withColumn("at", F.coalesce("at", "node"))
    placed = cut(placed.join(links.select(F.col("u").alias("at"), F.col("v").alias("core")), "at", "left").select("node", F.coalesce("core", "at").alias("core")))
    return placed.join(placed.groupBy("core").agg(F.min("node").alias("root")), "core").select("node", "root")


def runs(batches, key: str):
    """(new, columns) of each run of a key in Arrow batches sorted by it; new is false where a run goes on from the batch
    before, so that a fold keeps its state and no key's rows are ever gathered."""
    last = object()
    for batch in batches:
        columns, start = batch.to_pydict(), 0
        for k, same in groupby(columns[key]):
            end = start + len(list(same))
            yield k != last, {c: v[start:end] for c, v in columns.items()}
            last, start = k, end


def replay_sorted(batches):
    """Rows of each component in order: a row joins the earliest item with its link or key; an item without a key adopts one."""
    link, key, item_key = {}, {}, {}
    for new, rows in runs(batches, "root"):
        if new:
            link, key, item_key = {}, {}, {}
        out = []
        for id, norm, group_key in zip(rows["id"], rows["norm"], rows["group_key"]):
            found = [i for i in (link.get(norm), key.get(group_key) if group_key is not None else None) if i is not None]
            item = min(found) if found else id
            if not found:
                link[norm] = item
            if group_key is not None and item not in item_key:
                item_key[item] = group_key
                key.setdefault(group_key, item)
            out.append(item)
        yield pa.record_batch([pa.array(rows["id"], pa.int64()), pa.array(out, pa.int64())], ["id", "item"])


def replay(rows: DataFrame) -> DataFrame:
    """(id, item): the queue item of each arriving row (id, url, group_key).

    Components over link and group key part the rows safely; inside one, arrival order decides, so each is sorted and
    replayed as it streams by. Only the item of each link and key of one component is kept meanwhile.
    """
    rows = rows.select("id", T.normalize_url(F.col("url")).alias("norm"), "group_key")
    edges = rows.select(F.concat(F.lit("u:"), "norm").alias("a"), F.coalesce(F.concat(F.lit("k:"), "group_key"), F.concat(F.lit("u:"), "norm")).alias("b"))
    roots = label_components(edges)
    placed = rows.withColumn("node", F.concat(F.lit("u:"), "norm")).join(roots, "node").select("root", "id", "norm", "group_key")
    return placed.repartition("root").sortWithinPartitions("root", "id").mapInArrow(replay_sorted, "id long, item long")


def daily(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(F.to_date("ts").alias("day"), *by).agg(F.count("*").alias("n"))


def evidence_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n): one pass over all fields; arrays count each element."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def on_all_dates(rows: DataFrame, wanted: Column) -> DataFrame:
    """(day, lane, n, share): counts of wanted rows on every day that has any row, zeros included."""
    counts = rows.withColumn("w", wanted).groupBy(F.to_date("ts").alias("day"), "lane").agg(F.count_if("w").alias("n"))
    days, lanes = counts.select("day").distinct(), counts.select("lane").distinct()
    spine = days.crossJoin(lanes)  # both are small aggregates
    full = spine.join(counts, ["day", "lane"], "left").na.fill(0, ["n"])
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
