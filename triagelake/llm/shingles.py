"""Similarity join on word shingles: parity sketches, a pigeonhole join of their words, exact verification."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, components, cut, quoted, table, tidy, words_of

WORDS, PERCENT = 5, 75
#: Shingles that are put last in every prefix: at most so many, the most frequent ones. Only speed depends on them.
COMMON = 1 << 16
CHUNK, BUCKET, ANCHORS = 600_000, 700_000, 4
#: Sets of a block, of a group that needs no blocks, and of groups that share a task's call.
BLOCK, SMALL, BUNDLE = 512, 256, 256
#: Up to so many ids or set ids (16 MB) are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 400_000
ROOT_BITS = (1 << 44) - 1
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * ODD[3]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of texts. Words are hashed once while a task remembers them."""

    def __init__(self):
        self.word = Memo(xxhash.xxh3_64_intdigest, 80_000)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the WORDS-word shingles, A-Z lower-cased; a shorter text is one shingle."""
        words = [w.lower() for w in words_of(text)]
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        width = min(len(h), WORDS)
        total = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            total += h[i : len(h) - width + 1 + i] * ODD[i]
        self.word.trim()
        return np.unique(mixed(total))


@lru_cache(maxsize=1)
def shingler() -> Shingler:
    """The one of this Python worker, for functions that see a few rows at a time."""
    return Shingler()


def set_id(shingles: np.ndarray) -> int:
    """A hash of the set as a signed 64-bit number; equal sets have equal ids."""
    if not len(shingles):
        return 0
    return int(mixed(shingles.sum(dtype=np.uint64, keepdims=True) * ODD[:1] + np.bitwise_xor.reduce(shingles, keepdims=True)).view(np.int64)[0])


def parity(shingles: np.ndarray) -> bytes:
    """The dense parity sketch of a set: each shingle flips one of as many bits as the set's size band has shingles."""
    n_bits = max(64, 4 ** (band(len(shingles)) + 1))
    return np.packbits(np.bincount((mixed(shingles) % np.uint64(n_bits)).astype(np.int64), minlength=n_bits) & 1).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two dense sketches, the longer one folded to the other's length."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    width = min(len(x), len(y))
    x, y = (z if len(z) == width else np.bitwise_xor.reduce(z.reshape(-1, width)) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def band(n: int) -> int:
    """Sizes 1 to 3 are band 0, 4 to 15 band 1, and so on by powers of four."""
    return (n.bit_length() - 1) // 2


def sketch(shingles: np.ndarray, level: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a set's parity sketch for a size band, and which are frequent: one token for each word, first the non-zero
    ones without a common shingle by hash, then those with one, then as many empty words as a prefix may need.

    A shingle's hash picks one word of 64 bits and is XORed into it, so at most as many words of two sketches differ as
    the symmetric difference has shingles. The band's largest set has two shingles a word, the smallest half a shingle.
    """
    n_words = max(64, 4 ** (level + 1) // 2)
    seed = mixed(np.array([level + 1], np.uint64))
    place = mixed(shingles + seed) % np.uint64(n_words)
    order = np.argsort(place, kind="stable")
    place, flips = place[order], shingles[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    word = np.bitwise_xor.reduceat(flips, starts)
    token = mixed((word + place[starts] * ODD[2]) ^ seed)
    frequent = np.zeros(len(token), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, flips), len(common) - 1)
        frequent = np.logical_or.reduceat(common[at] == flips, starts)
    parts = [np.sort(token[~frequent]), np.sort(token[frequent])]
    if len(token) <= len(shingles) // 2 + 1:
        parts.append(np.sort(mixed((np.setdiff1d(np.arange(n_words, dtype=np.uint64), place) + ODD[1]) ^ seed))[: len(shingles) + 1])
    return np.concatenate(parts), np.repeat([False, True], [len(parts[0]), sum(map(len, parts[1:]))])


def prefix(shingles: np.ndarray, level: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketch tokens that must be compared so that no partner in the band is missed, and which are frequent.

    With sizes a and b, 0.75 of the union or more is shared only if the symmetric difference is at most (a + b) / 7. At
    most so many words of the sketches differ, so of any one more than that, taken in an order that both sets follow, one
    is equal in both.
    """
    n = len(shingles)
    largest = min(4 ** (level + 1) - 1, n * 100 // PERCENT)
    differ = (n + largest) * (100 - PERCENT) // (100 + PERCENT)
    token, frequent = sketch(shingles, level, common)
    return token[: differ + 1], frequent[: differ + 1]


def bands_of(n: int) -> range:
    """The bands of a set of n shingles and of all its larger partners."""
    return range(band(n), band(max(n, n * 100 // PERCENT)) + 1)


def root_key(root: int, size: int = 1) -> int:
    """48 bits that name a component; those of larger components are smaller, by classes of powers of two."""
    return (15 - min(15, size.bit_length() - 1)) << 44 | root & ROOT_BITS


def profile(docs: DataFrame) -> DataFrame:
    """Per row (doc_id, key, n, sid, dense sketch, anchors), and per chunk of rows the shingles that are frequent in it
    (common, df). key is a hash of the text; the anchors are the first tokens of the set's sketches."""
    schema = "doc_id long, key long, n long, sid long, sketch binary, anchors array<long>, common long, df long"
    none = np.zeros(0, np.uint64)

    def run(batches):
        get = Shingler()
        held: dict[int, np.ndarray] = {}
        size = 0

        def rows(**columns):
            k = len(next(iter(columns.values())))
            types = dict(doc_id=pa.int64(), key=pa.int64(), n=pa.int64(), sid=pa.int64(), sketch=pa.binary(), anchors=pa.list_(pa.int64()), common=pa.int64(), df=pa.int64())
            return pa.record_batch([pa.array(columns.get(c, [None] * k), t) for c, t in types.items()], [*types])

        def frequent():
            values, counts = np.unique(np.concatenate([*held.values(), none]), return_counts=True)
            some = counts >= max(6, len(held) // 500)
            return rows(common=values[some].view(np.int64), df=counts[some])

        for batch in batches:
            n, sids, sketches, anchors = [], [], [], []
            for text in batch["text"]:
                s = get(text.as_py())
                n.append(len(s))
                sids.append(set_id(s))
                sketches.append(parity(s) if len(s) else b"")
                first = [sketch(s, level, none)[0][:ANCHORS] for level in bands_of(len(s))] if len(s) else [none]
                anchors.append(np.concatenate(first).view(np.int64))
                if sids[-1] not in held:
                    held[sids[-1]] = s
                    size += len(s)
                if size > CHUNK:
                    yield frequent()
                    held, size = {}, 0
            yield rows(doc_id=batch["doc_id"].to_pylist(), key=batch["key"].to_pylist(), n=n, sid=sids, sketch=sketches, anchors=anchors)
        yield frequent()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(tidy(run), schema)


def tokens(docs: DataFrame, common, buckets: int) -> DataFrame:
    """Prefix tokens of every distinct set with the key of its root, dealt to buckets as packed arrays.

    docs has text, and for sets with a known component sid and root. A token that isn't frequent goes to a bucket by its
    own hash. Frequent ones go to buckets below 0 by the root, so no bucket gets all of one. A token that more than one
    set of a component has goes there once for each chunk of texts.
    """
    cold = np.uint64(buckets)

    def run(batches):
        get, frequent = Shingler(), common.value
        held, seen, size = [], set(), 0

        def packed():
            token = np.concatenate([t for t, _, _ in held])
            often = np.concatenate([f for _, f, _ in held])
            root = np.repeat(np.array([r for *_, r in held], np.uint64), [len(t) for t, _, _ in held])
            order = np.lexsort((root, token))
            new = np.concatenate([[True], (np.diff(token[order]) != 0) | (np.diff(root[order]) != 0)])
            order = order[new]
            token, often, root = token[order], often[order], root[order]
            bucket = np.where(often, -1 - (mixed(root) % (cold // np.uint64(8) + np.uint64(1))).astype(np.int64), (token % cold).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            bucket, token, root = bucket[order], token[order], root[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
            out = []
            for a, b in zip(starts, [*starts[1:], len(bucket)]):
                t, r = token[a:b], root[a:b]
                t = t if bucket[a] < 0 else (t >> np.uint64(32)).astype(np.uint32)
                out.append((int(bucket[a]), t.tobytes(), r.astype(np.uint32).tobytes(), (r >> np.uint64(32)).astype(np.uint16).tobytes()))
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))], ["bucket", "token", "low", "high"])

        for batch in batches:
            for text, sid, root in zip(batch["text"], batch["sid"].to_pylist(), batch["root"].to_pylist()):
                s = get(text.as_py())
                own = set_id(s)
                if not len(s) or own in seen:
                    continue
                seen.add(own)
                for level in bands_of(len(s)):
                    held.append((*prefix(s, level, frequent), root if own == sid else root_key(own)))
                    size += len(held[-1][0])
                if size > CHUNK:
                    yield packed()
                    held, seen, size = [], set(), 0
        if held:
            yield packed()

    return docs.select("text", "sid", "root").mapInArrow(tidy(run), "bucket int, token binary, low binary, high binary")


def matches(group: pa.Table) -> pa.Table:
    """Of a bucket: (root, centre) of components that share a token; the centre is the one with the least key. Of the
    frequent tokens, which can be in more than one bucket, (root, frequent) as they are."""
    join = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
    often = group["bucket"][0].as_py() < 0
    token = join("token", np.uint64 if often else np.uint32)
    root = join("low", np.uint32).astype(np.int64) | join("high", np.uint16).astype(np.int64) << 32
    order = np.lexsort((root, token))
    token, root = token[order], root[order]
    same = token[1:] == token[:-1]
    new = np.concatenate([[True], ~same | (root[1:] != root[:-1])])
    token, root = token[new], root[new]
    none = pa.nulls
    if often:
        return pa.table({"root": root, "centre": none(len(root), pa.int64()), "frequent": token.view(np.int64)})
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    centre = np.repeat(root[starts], np.diff(starts, append=len(token)))
    pairs = np.unique(np.stack([root, centre], axis=1)[root != centre], axis=0)
    return pa.table({"root": pairs[:, 0], "centre": pairs[:, 1], "frequent": none(len(pairs), pa.int64())})


def sketch_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Hamming distances of all pairs of two lists of dense sketches."""
    out = np.zeros((len(left), len(right)), np.int64)
    lengths = [np.array([len(s) for s in side]) for side in (left, right)]
    for a in np.unique(lengths[0]):
        for b in np.unique(lengths[1]):
            width = min(a, b) // 8
            at, to = np.flatnonzero(lengths[0] == a), np.flatnonzero(lengths[1] == b)
            x, y = (np.frombuffer(b"".join(side[k] for k in which), np.uint64).reshape(len(which), -1, width) for side, which in ((left, at), (right, to)))
            x, y = np.bitwise_xor.reduce(x, axis=1), np.bitwise_xor.reduce(y, axis=1)
            step = max(1, 4_000_000 // (len(to) * width))
            for k in range(0, len(at), step):
                out[np.ix_(at[k : k + step], to)] = np.bitwise_count(x[k : k + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def possible(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the two blocks in a grouped table: row numbers of each, which pairs of one group and of two components may be
    similar, and sketch distances."""
    i, j, block, n, root, centre = (group[c].to_numpy() for c in ("i", "j", "block", "n", "root", "centre"))
    sketches = group["sketch"].to_pylist()
    left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
    far = sketch_distances([sketches[k] for k in left], [sketches[k] for k in right])
    a, b = n[left][:, None], n[right][None, :]
    near = (far * (100 + PERCENT) <= (a + b) * (100 - PERCENT)) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * PERCENT)
    near &= (root[left][:, None] != root[right][None, :]) & (centre[left][:, None] == centre[right][None, :])
    return left, right, near & (left[:, None] < right[None, :] if i[0] == j[0] else True), far


def unsettled(group: pa.Table) -> pa.Table:
    """The rows of a pair of blocks that may be similar to a row of another component."""
    left, right, near, _ = possible(group)
    rows = np.concatenate([left[near.any(axis=1)], right[near.any(axis=0)]])
    return group.take(pa.array(np.unique(rows)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def sets_in(group: pa.Table) -> dict[int, np.ndarray]:
    """Set id -> set, of the rows whose text has the set that they say."""
    out: dict[int, np.ndarray] = {}
    for sid, text in zip(group["sid"].to_pylist(), group["text"]):
        if sid not in out:
            s = shingler()(text.as_py())
            if set_id(s) == sid:
                out[sid] = s
    return out


def links(pairs: list[tuple[int, int]]) -> pa.Table:
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table({"x": found[:, 0], "y": found[:, 1]})


def settled(group: pa.Table) -> pa.Table:
    """Pairs that are similar and join two components, by the sets themselves, the nearest sketches first."""
    sets = sets_in(group)
    row = {(sid, centre): k for k, (sid, centre) in enumerate(zip(group["sid"].to_pylist(), group["centre"].to_pylist())) if sid in sets}
    group = group.take(pa.array(sorted(row.values()), pa.int64()))
    if not len(group):
        return links([])
    sid, root = group["sid"].to_pylist(), group["root"].to_pylist()
    left, right, near, far = possible(group)
    at, to = np.nonzero(near)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    edges = []
    for k in np.argsort(far[at, to], kind="stable"):
        a, b = left[at[k]], right[to[k]]
        x, y = top(root[a]), top(root[b])
        if x != y and similar(sets[sid[a]], sets[sid[b]]):
            above[max(x, y)] = min(x, y)
            edges.append((sid[a], sid[b]))
    return links(edges)


def stars(group: pa.Table) -> pa.Table:
    """(x, y) of the sets x in a table that are similar to their centre y, which is in the table too."""
    sets = sets_in(group)
    pairs = {*zip(group["sid"].to_pylist(), group["centre"].to_pylist())}
    return links([(x, y) for x, y in sorted(pairs) if x != y and x in sets and y in sets and similar(sets[x], sets[y])])


def small(df: DataFrame) -> DataFrame:
    """A cut table of ids, marked for broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (rep, ...) with the text of the document rep, once for each row of docs with that id."""
    rows = cut(rows)
    return docs.join(small(rows), docs["doc_id"] == rows["rep"]).drop("doc_id")


def nearest(batches):
    """(x, y, far) of pairs whose dense sketches differ in no more bits than their symmetric difference may have shingles."""
    for batch in batches:
        n_x, n_y, a, b = (batch[c].to_pylist() for c in ("n_x", "n_y", "sketch_x", "sketch_y"))
        far = np.fromiter(map(distance, a, b), np.int64, len(a))
        keep = pa.array(far * (100 + PERCENT) <= (np.array(n_x, np.int64) + np.array(n_y, np.int64)) * (100 - PERCENT))
        yield pa.record_batch([batch["x"], batch["y"], pa.array(far)], ["x", "y", "far"]).filter(keep)


def star_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (x, y) of sets to a centre: of the sets with which a set shares an anchor those with the least id are
    centres, and the one with the nearest sketch is compared. One link a set at most, whatever the size of its family."""
    anchored = sets.select("sid", F.explode("anchors").alias("anchor"))
    centres = anchored.groupBy("anchor").agg(F.min("sid").alias("y"), F.max("sid").alias("last")).where("y < last").select("anchor", "y")
    pairs = anchored.join(centres, "anchor").where("sid <> y").select(F.col("sid").alias("x"), "y").distinct()
    x = sets.select(F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("sketch").alias("sketch_x"))
    y = sets.select(F.col("sid").alias("y"), F.col("n").alias("n_y"), F.col("sketch").alias("sketch_y"))
    fits = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * PERCENT
    near = pairs.join(x, "x").join(y, "y").where(fits).mapInArrow(nearest, "x long, y long, far long")
    best = cut(near.groupBy("x").agg(F.min(F.struct("far", "y")).alias("best")).select("x", "best.y"))
    blocks = best.groupBy("y").agg(F.ceil(F.count("*") / SMALL).cast("int").alias("blocks")).withColumnRenamed("y", "centre")
    members = best.join(blocks, F.col("y") == F.col("centre")).select(F.col("x").alias("sid"), "centre", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"))
    centres = blocks.select(F.col("centre").alias("sid"), "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    bundles = best.count() // 64 + 1
    rows = members.union(centres).join(sets.select("sid", "rep"), "sid").withColumn("bundle", F.pmod(F.xxhash64("centre", "block"), F.lit(bundles)))
    return cut(with_text(docs, rows).groupBy("bundle").applyInArrow(stars, "x long, y long"))


def with_roots(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """sets with root (the least set id of the component by the links), size (sets in the component) and root_key."""
    roots = components(linked, "x", "y")
    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).withColumnRenamed("root", "of")
    roots = roots.join(sizes, F.col("root") == F.col("of")).drop("of")
    placed = sets.join(roots, sets["sid"] == roots["node"], "left").drop("node")
    placed = placed.withColumn("root", F.coalesce("root", "sid")).withColumn("size", F.coalesce("size", F.lit(1)))
    high = 15 - F.least(F.lit(15), F.floor(F.log2("size"))).cast("long")
    return placed.withColumn("root_key", F.shiftleft(high, 44).bitwiseOR(F.col("root").bitwiseAND(ROOT_BITS)))


def in_blocks(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of all components of each group in ``found`` (root, centre), dealt to pairs of blocks (bundle, i, j).

    The centre's own sets and the others are in different blocks, and blocks of the centre's sets don't meet each other.
    Groups with few sets need no blocks; many of them share a bundle. No block has many more than BLOCK sets.
    """
    every = found.union(found.select("centre", "centre")).distinct()
    members = every.withColumnRenamed("root", "of").join(sets, F.col("of") == F.col("root_key"))
    members = members.select("centre", (F.col("of") != F.col("centre")).alias("guest"), "sid", "n", "sketch", "rep", "root")
    blocks = lambda guests: F.ceil(F.count(F.when(F.col("guest") == guests, 1)) / BLOCK).cast("int")
    counts = cut(members.groupBy("centre").agg(F.count("*").alias("sets"), blocks(False).alias("own"), blocks(True).alias("more")))
    bundles = (counts.where(F.col("sets") <= SMALL).agg(F.sum("sets")).first()[0] or 0) // BUNDLE + 1
    few, guest, of = F.col("sets") <= SMALL, F.col("guest"), F.xxhash64("sid")
    block = F.when(few, 0).when(guest, F.col("own") + F.pmod(of, F.col("more"))).otherwise(F.pmod(of, F.col("own"))).cast("int")
    last = F.col("own") + F.col("more") - 1
    meets = F.when(few, F.array(F.lit(0))).when(guest, F.sequence(F.lit(0), last)).otherwise(F.sequence(F.col("own"), last))
    dealt = members.join(counts.withColumnRenamed("centre", "of"), F.col("centre") == F.col("of")).withColumn("block", block).withColumn("with", F.explode(meets))
    bundle = F.when(few, F.pmod(F.xxhash64("centre"), F.lit(bundles))).otherwise(F.col("centre"))
    ends = (F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    return dealt.select(bundle.alias("bundle"), *ends, "centre", "block", "sid", "n", "sketch", "rep", "root")


def candidates(docs: DataFrame, sets: DataFrame, rows: DataFrame, common) -> DataFrame:
    """(root, centre): groups of components whose sets share a token. rows has (key, sid, n); sets has roots.

    Each pair of similar sets of two components is in one group. Tokens that one component alone has give nothing.
    """
    known = rows.join(sets.where("size > 1").select("sid", "root_key"), "sid").select("key", "sid", F.col("root_key").alias("root"))
    known = cut(known.dropDuplicates(["key"])).withColumnRenamed("key", "of")
    texts = docs.select("text", F.xxhash64("text").alias("key")).join(small(known), F.col("key") == F.col("of"), "left")
    total = rows.agg(F.sum("n")).first()[0] or 0
    found = tokens(texts, common, int(total * 0.4 // BUCKET) + 1).groupBy("bucket").applyInArrow(matches, "root long, centre long, frequent long")
    found = cut(found)
    often = found.where("frequent is not null").select("frequent", F.col("root").alias("with")).distinct()
    least = often.groupBy("frequent").agg(F.min("with").alias("centre"), F.max("with").alias("last")).where("centre < last").select("frequent", "centre")
    often = often.join(least, "frequent").where("with <> centre").select(F.col("with").alias("root"), "centre")
    return cut(found.where("frequent is null").select("root", "centre").union(often).distinct())


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of texts that share 75% of their joint shingle sets.

    First pass: set sizes, hashes, dense sketches, the first sketch tokens, and the most common shingles (which only order
    the tokens). Sets with a token among their first ones in common are compared with one centre each, which joins most
    near copies. Second pass: the sketch tokens that no similar pair can all differ in, shuffled as packed arrays with the
    component found so far. Components that share a token form groups; in these, the Hamming distance of the dense
    sketches drops pairs of sets that can't be similar, and the sets of the others decide exactly.

    Null and empty texts have no shingles and link with nothing; equal texts are one set and in one component, whatever
    their number. Null ids take no part (component null). Repeated rows each get their result. Empty tables give an
    empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    some = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    seen = cut(profile(docs))
    frequent = seen.where("df is not null").groupBy("common").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "common").limit(COMMON)
    common = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.select("common").toArrow()["common"].to_numpy().view(np.uint64)))
    rows = seen.where("df is null").select("doc_id", "key", "n", "sid")
    sets = cut(seen.where("df is null and n > 0 and doc_id is not null").groupBy("sid", "n", "sketch", "anchors").agg(F.min("doc_id").alias("rep")))
    linked = star_links(some, sets)
    sets = cut(with_roots(sets, linked).drop("anchors"))
    groups = in_blocks(candidates(some, sets, rows, common), sets)
    row = "bundle long, i int, j int, centre long, block int, sid long, n long, sketch binary, rep long, root long"
    rest = with_text(some, groups.groupBy("bundle", "i", "j").applyInArrow(unsettled, row))
    more = rest.groupBy("bundle", "i", "j").applyInArrow(settled, "x long, y long")
    roots = components(cut(linked.union(more)), "x", "y")
    of_set = sets.drop("root").join(roots, sets["sid"] == roots["node"], "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    least = of_set.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = of_set.join(least, "root").select(F.col("sid").alias("set"), "component_id")
    rows = rows.withColumn("of", F.when(F.expr("n > 0 and doc_id is not null"), F.col("sid")))
    out = rows.join(of_set, F.col("of") == F.col("set"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component; of repeated ids one row stays.

    Rows without an id stay. Texts are not shuffled as long as the ids that go are few enough to be sent around; rows
    are compared with each other only where an id repeats.
    """
    is_own = F.col("doc_id") == F.col("component_id")
    ids = cut(join(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(is_own).alias("kept"), F.count("*").alias("rows")))
    gone, twice = ids.where("NOT kept").select("doc_id"), ids.where("kept AND rows > 1").select("doc_id")
    left = docs.join(small(gone), "doc_id", "left_anti").select(*map(quoted, docs.columns))
    if twice.isEmpty():
        return left
    again = small(twice)
    return left.join(again, "doc_id", "left_anti").select(*map(quoted, docs.columns)).unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*map(quoted, docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
