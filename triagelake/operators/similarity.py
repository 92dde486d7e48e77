"""Joins of 64-bit fingerprints within a Hamming distance, and what is built on them."""

from __future__ import annotations

import tempfile
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How many bits apart near texts, near images, and near copies of a reference may be.
SIMHASH_LIMIT, IMAGE_LIMIT, REFERENCE_LIMIT = 9, 4, 8
#: A key under which more pairs than this would meet is split.
HOT_PAIRS = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of this machine's only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp()


def tasks(df: DataFrame) -> int:
    """As many tasks as the session's shuffles have, where work is not in proportion to bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the session's ``spark.checkpoint.dir``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def block_masks(limit: int, reach: int = 1, width: int = 64) -> list[int]:
    """Masks that cut ``width`` bits to blocks, so few that values at most ``limit`` apart differ by ``reach`` bits or fewer
    in one of them."""
    n = min(limit // (reach + 1) + 1, width)
    bounds = [width * i // n for i in range(n + 1)]
    return [((1 << bounds[i + 1]) - 1) & ~((1 << bounds[i]) - 1) for i in range(n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def flips(mask: int, reach: int) -> list[int]:
    """Every choice of at most ``reach`` bits of a mask."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [sum(chosen) for n in range(reach + 1) for chosen in combinations(bits, n)]


def keyed(values: DataFrame, value: str, masks: list[int]) -> DataFrame:
    """A row for each block: block (its number), key (the bits of the value under its mask). What an index holds."""
    of = F.array(*[F.struct(F.lit(i).alias("block"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks)])
    return values.withColumn("m", F.explode(of)).withColumn("block", F.col("m.block")).withColumn("key", F.col(value).bitwiseAND(F.col("m.mask"))).drop("m")


def probed(values: DataFrame, value: str, masks: list[int], reach: int) -> DataFrame:
    """A row for each key of an index at most ``reach`` bits from the value's own key in the block."""
    of = F.array(*[F.struct(F.lit(i).alias("block"), F.lit(signed(m)).alias("mask"), F.lit(signed(f)).alias("flip")) for i, m in enumerate(masks) for f in flips(m, reach)])
    rows = values.withColumn("m", F.explode(of))
    return rows.withColumn("block", F.col("m.block")).withColumn("key", F.col(value).bitwiseAND(F.col("m.mask")).bitwiseXOR(F.col("m.flip"))).drop("m")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def meet(probes: DataFrame, index: DataFrame, masks: list[int], limit: int, reach: int, where: Column | None = None) -> DataFrame:
    """Pairs (a, b, distance, and the other columns of both sides) of ``probed`` and ``keyed`` values within ``limit``.

    A pair counts in the first block where it is near enough alone, so each is found once and nothing has to be made
    distinct. Keys where more than HOT_PAIRS pairs meet are split on both sides, so that no task has more.
    """
    counts = probes.groupBy("block", "key").agg(F.count("*").alias("n")).join(index.groupBy("block", "key").agg(F.count("*").alias("m")), ["block", "key"])
    side = HOT_PAIRS**0.5
    hot = cut(counts.where(F.col("n") * F.col("m") > HOT_PAIRS).select("block", "key", F.ceil(F.col("n") / side).cast("int").alias("parts_a"), F.ceil(F.col("m") / side).cast("int").alias("parts_b")))
    on = ["block", "key"]
    if not hot.isEmpty():
        part = lambda value, of: F.pmod(F.xxhash64(value), F.coalesce(of, F.lit(1))).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1))
        probes = probes.join(hot, on, "left").withColumn("part_a", part("a", F.col("parts_a"))).withColumn("part_b", every(F.col("parts_b"))).drop("parts_a", "parts_b")
        index = index.join(hot, on, "left").withColumn("part_b", part("b", F.col("parts_b"))).withColumn("part_a", every(F.col("parts_a"))).drop("parts_a", "parts_b")
        on = [*on, "part_a", "part_b"]
    x, first = F.col("a").bitwiseXOR(F.col("b")), F.lit(False)
    for i in range(len(masks)):
        here = F.col("block") == i
        for m in masks[:i]:
            here = here & (F.bit_count(x.bitwiseAND(F.lit(signed(m)))) > reach)
        first = first | here
    keep = (F.bit_count(x) <= limit) & first
    pairs = probes.join(index, on).where(keep if where is None else keep & where)
    return pairs.withColumn("distance", F.bit_count(x)).drop(*on)


def hamming_pairs(left: DataFrame, right: DataFrame, limit: int, width: int = 64, where: Column | None = None) -> DataFrame:
    """(a, b, distance) of all values within ``limit`` bits, and the other columns of both inputs, whose names differ.

    Inputs have a column ``value``, all of whose bits are within the lowest ``width``. Exact by the pigeonhole principle:
    the right side is stored once for each of a few blocks, the left side looks up its own key of the block and those one
    bit off (two, where the right side is very large and keys must be longer). ``where`` is a further condition on pairs.
    """
    reach = 0 if not limit else 1 if limit < 3 or right.count() < 1 << 22 else 2
    masks = block_masks(limit, reach, width)
    return meet(probed(left.withColumnRenamed("value", "a"), "a", masks, reach), keyed(right.withColumnRenamed("value", "b"), "b", masks), masks, limit, reach, where)


def near_reference(candidates: DataFrame, reference: DataFrame, limit: int = REFERENCE_LIMIT, width: int = 64) -> DataFrame:
    """(id, reference_id, distance): candidates within ``limit`` bits of a reference value, with the closest (first by id)."""
    known = reference.groupBy("value").agg(F.min("id").alias("reference_id"))
    found = hamming_pairs(candidates.select("value").distinct(), known, limit, width)
    best = found.groupBy("a").agg(F.min(F.struct("distance", "reference_id")).alias("m"))
    return candidates.join(best, candidates["value"] == best["a"]).select("id", "m.reference_id", "m.distance")


def nearest_within(values: DataFrame, limit: int = SIMHASH_LIMIT, width: int = 64) -> DataFrame:
    """(id, reference_id, distance): the closest other row of (id, value) within ``limit`` bits, the first by id of equals.

    Copies of one value answer each other. For the rest the radius grows, and only values without a neighbour so far go on
    to the next one: what is found within a radius is closer than all that is left out, and few values reach the large
    radii, where pairs are many.
    """
    first = cut(values.groupBy("value").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    copies = values.join(first.where("n > 1"), "value")
    second = copies.where("id <> first").groupBy("value").agg(F.min("id").alias("second"))
    same = copies.join(second, "value").select("id", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("reference_id"), F.lit(0).alias("distance"))
    todo, out = first.where("n = 1").select("value"), same
    for radius in sorted({min(r, limit) for r in (1, 3, 5, 7, limit)}):
        found = hamming_pairs(todo, first.select("value", F.col("first").alias("reference_id")), radius, width, F.col("a") != F.col("b"))
        best = cut(found.groupBy("a").agg(F.min(F.struct("distance", "reference_id")).alias("m")))
        named = best.join(first, best["a"] == first["value"]).select(F.col("first").alias("id"), "m.reference_id", "m.distance")
        out = out.unionByName(named)
        todo = cut(todo.join(best.select(F.col("a").alias("value")), "value", "left_anti"))
    return out


def first_independent(values: DataFrame, limit: int) -> DataFrame:
    """The rows of (value, o), whose values are distinct, that a pass in order of ``o`` keeps.

    Rounds over the edges: keep what has no earlier neighbour left undecided or kept, drop what has a kept one.
    """
    edges = cut(hamming_pairs(values, values.withColumnRenamed("o", "e"), limit, where=F.col("e") < F.col("o")).select("o", "e"))
    undecided, kept = values.select("o"), None
    while not undecided.isEmpty():
        new = cut(undecided.join(edges.select("o").distinct(), "o", "left_anti"))
        kept = new if kept is None else cut(kept.union(new))
        dropped = edges.join(new.withColumnRenamed("o", "e"), "e", "left_semi").select("o").distinct()
        undecided = cut(undecided.join(new, "o", "left_anti").join(dropped, "o", "left_anti"))
        live = undecided.withColumnRenamed("o", "e")
        edges = cut(edges.join(undecided, "o", "left_semi").join(live, "e", "left_semi"))
    return values.limit(0) if kept is None else values.join(kept, "o", "left_semi")


def greedy_dedupe(items: DataFrame, limit: int = REFERENCE_LIMIT, batch: int = 4096) -> DataFrame:
    """(id, kept_id): for items (id, ord, value), what a pass in order would drop, and the kept item it falls to.

    An item is kept if no earlier kept one is within ``limit``; dropped ones absorb nothing. Only the first item of a value
    can be kept. The first ``batch`` values or so in order are settled among each other, what their kept ones reach is
    dropped from the rest, and so on with twice as many: so pairs of dropped values are never listed. A dropped item goes
    to its closest earlier kept neighbour, the earliest of equals.
    """
    rest = first = cut(items.groupBy("value").agg(F.min("ord").alias("o")))
    kept, left = None, first.count()
    while left:
        part, later = rest, rest.limit(0)
        if left > batch:
            border = int(rest.select("o").approxQuantile("o", [batch / left], 0.001)[0])
            part, later = cut(rest.where(F.col("o") <= border)), rest.where(F.col("o") > border)
        new = cut(first_independent(part, limit))
        kept = new if kept is None else cut(kept.union(new))
        reached = hamming_pairs(later.select("value"), new.select("value"), limit).select(F.col("a").alias("value")).distinct()
        rest, batch = cut(later.join(reached, "value", "left_anti")), batch * 2
        left = rest.count()
    if kept is None:
        return items.select("id", F.col("id").alias("kept_id")).limit(0)
    to = hamming_pairs(first.select("value"), kept.select("value", F.col("o").alias("e")), limit).select(F.col("a").alias("value"), "e", "distance")
    best = items.join(to, "value").where("e < ord").groupBy("ord", "id").agg(F.min(F.struct("distance", "e")).alias("m"))
    name = items.select(F.col("ord").alias("e"), F.col("id").alias("kept_id"))
    return best.select("id", F.col("m.e").alias("e")).join(name, "e").select("id", "kept_id")


#: Up to so many prototypes travel to the executors as one matrix.
MOST_PROTOTYPES = 10_000
#: Scores of vectors with prototypes that a task holds at a time (8 MB).
MOST_SCORES = 1_000_000


def cosine_to_prototypes(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, pos, neg): highest cosine of each vector to positive and to negative prototypes.

    Both inputs have unit array<double> ``v``. Prototypes are a small labelled table, sent as matrices of MOST_PROTOTYPES
    rows at most, one after another; a batch of vectors is multiplied with each, so no pair becomes a row. A vector or a
    prototype that is null or of another length than the rest takes no part.
    """
    known = prototypes.where("v IS NOT NULL AND positive IS NOT NULL")
    n = known.count()
    blocks = -(-n // MOST_PROTOTYPES)
    dealt = known.select("v", "positive", F.pmod(F.xxhash64("v"), F.lit(max(blocks, 1))).alias("block"))
    out = vectors.where("v IS NOT NULL").select("id", "v", F.lit(None).cast("double").alias("pos"), F.lit(None).cast("double").alias("neg"))
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).toArrow()
        of = vectors.sparkSession.sparkContext.broadcast((np.array(rows["v"].to_pylist(), float), np.array(rows["positive"].to_pylist(), bool)))

        def run(batches, of=of):
            matrix, positive = of.value
            sides = [(name, matrix[own]) for name, own in (("pos", positive), ("neg", ~positive))]
            step = max(1, MOST_SCORES // len(matrix))
            for whole in batches:
                for batch in (whole.slice(start, step) for start in range(0, whole.num_rows, step)):
                    v = batch["v"]
                    fits = pc.equal(pc.list_value_length(v), matrix.shape[1]).to_numpy(zero_copy_only=False)
                    x = v.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
                    best = {name: batch[name].fill_null(-np.inf).to_numpy(zero_copy_only=False).copy() for name, _ in sides}
                    for name, own in sides:
                        if len(own) and len(x):
                            best[name][fits] = np.maximum(best[name][fits], (x @ own.T).max(axis=1))
                    columns = [pa.array(best[name], pa.float64(), mask=~np.isfinite(best[name])) for name, _ in sides]
                    yield pa.record_batch([batch["id"], v, *columns], ["id", "v", "pos", "neg"])

        out = out.mapInArrow(run, out.schema)
    return out.select("id", "pos", "neg")


def chain_roots(parents: DataFrame) -> DataFrame:
    """(id, root) from (id, parent): follows parents to the end by pointer jumping, doubling the step each round."""
    now = cut(parents.select("id", F.coalesce("parent", "id").alias("p")))
    while True:
        up = now.select(F.col("id").alias("p"), F.col("p").alias("q"))
        step = cut(now.join(up, "p").select("id", "p", "q"))
        now = step.select("id", F.col("q").alias("p"))
        if step.where("p <> q").isEmpty():
            return now.withColumnRenamed("p", "root")


def first_bearers(fingerprints: DataFrame) -> DataFrame:
    """(kind, value, owner): the first row in order that has a fingerprint owns it."""
    return fingerprints.groupBy("kind", "value").agg(F.min("seq").alias("owner"))


def place(value: str) -> Column:
    """A text by which 64-bit values stand in the order of their unsigned numbers."""
    return F.lpad(F.hex(value), 16, "0")


def exact_parents(fingerprints: DataFrame, owners: DataFrame) -> DataFrame:
    """(seq, parent): of the first fingerprint of a row that an earlier row owns, that row's group if it is known, else itself."""
    found = fingerprints.join(owners, ["kind", "value"]).where("owner < seq")
    return found.groupBy("seq").agg(F.min_by(F.coalesce("group", "owner"), "pos").alias("parent"))


#: Bits by which values are dealt to groups at most, values of a side in a group, and pairs that a task compares at a time.
DEALT_BITS, SIDE, AT_ONCE = 8, 1 << 17, 1 << 20
#: Two runs of values with fewer pairs than this are compared together with others.
FEW = 1 << 13


def half_masks(limit: int, width: int = 64) -> list[tuple[int, int]]:
    """(dealt, other) masks: each block of ``block_masks`` is two halves, and values that differ by one bit of a block or
    none are equal in one half and differ by one bit of the other, or none. ``dealt`` is the half that is equal."""
    out = []
    for mask in block_masks(limit, 1, width):
        bits = [b for b in range(64) if mask >> b & 1]
        low, high = (sum(1 << b for b in part) for part in (bits[: len(bits) // 2], bits[len(bits) // 2 :]))
        out += [(low, high), (high, low)]
    return out


def lowest(mask: int, n: int) -> int:
    return sum(1 << b for b in [b for b in range(64) if mask >> b & 1][:n])


class Nearest:
    """Of each left value the nearest right value whose owner is earlier: distance, then unsigned value decide."""

    def __init__(self, left: np.ndarray, seq: np.ndarray, right: np.ndarray, owner: np.ndarray, limit: int):
        self.left, self.seq, self.right, self.owner, self.limit = left, seq, right, owner, limit
        self.far, self.to = np.full(len(left), 255, np.uint8), np.zeros(len(left), np.uint64)

    def offer(self, at: np.ndarray, far: np.ndarray, to: np.ndarray) -> None:
        """Candidates, at most one for each left value."""
        better = (far < self.far[at]) | (far == self.far[at]) & (to < self.to[at])
        self.far[at[better]], self.to[at[better]] = far[better], to[better]

    def all_with_all(self, a: slice, b: slice) -> None:
        right, owner = self.right[b], self.owner[b]
        step = max(1, AT_ONCE // len(right))
        for start in range(a.start, a.stop, step):
            at = np.arange(start, min(start + step, a.stop))
            far = np.bitwise_count(self.left[at, None] ^ right[None, :])
            at, far = at[near := (far <= self.limit).any(axis=1)], far[near]
            far = np.where(owner[None, :] < self.seq[at, None], far, 255)
            least = far.min(axis=1, initial=255)
            at, far, least = at[near := least <= self.limit], far[near], least[near]
            self.offer(at, least, np.where(far == least[:, None], right[None, :], np.uint64(2**64 - 1)).min(axis=1, initial=2**64 - 1))

    def pairs(self, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> None:
        """Runs of n left values from a, each with m right values from b."""
        size = n * m
        ends = np.cumsum(size)
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(ends // AT_ONCE)) + 1):
            of = np.repeat(part, size[part])
            k = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            at, to = a[of] + k // m[of], b[of] + k % m[of]
            far = np.bitwise_count(self.left[at] ^ self.right[to])
            near = (far <= self.limit) & (self.owner[to] < self.seq[at])
            at, far, to = at[near], far[near], self.right[to[near]]
            order = np.lexsort((to, far, at))
            first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
            self.offer(at[first], far[first], to[first])


def nearest_in(left: np.ndarray, seq: np.ndarray, right: np.ndarray, owner: np.ndarray, limit: int, dealt: int, other: int) -> Nearest:
    """Compares values that are equal in ``dealt`` and differ by one bit of ``other`` or none; all inputs are put in order."""
    mask = np.uint64(dealt | other)
    a, b = np.argsort(left & mask, kind="stable"), np.argsort(right & mask, kind="stable")
    of = Nearest(left[a], seq[a], right[b], owner[b], limit)
    runs_of = lambda v: np.unique(v & mask, return_index=True, return_counts=True)
    key, start, n = runs_of(of.left)
    known, begin, m = runs_of(of.right)
    for flip in flips(other, 1):
        want = key ^ np.uint64(flip)
        place = np.minimum(np.searchsorted(known, want), len(known) - 1)
        hit = np.flatnonzero(known[place] == want)
        x, y = hit, place[hit]
        many = n[x] * m[y] >= FEW
        for i, j in zip(x[many], y[many]):
            of.all_with_all(slice(start[i], start[i] + n[i]), slice(begin[j], begin[j] + m[j]))
        x, y = x[~many], y[~many]
        if len(x):
            of.pairs(start[x], n[x], begin[y], m[y])
    return of


def nearest_earlier(rows: DataFrame, owners: DataFrame, limit: int) -> DataFrame:
    """(seq, a, distance, b): of each row (seq, a) the nearest value of owners (b, owner), whose values are distinct, within
    ``limit`` bits whose owner is earlier than seq; the least by unsigned number of equally near ones.

    Exact by the pigeonhole principle (``half_masks``). Values are dealt by a few bits to groups, in which arrays are
    compared; a group gives one row for each of its rows at most, so no list of pairs is ever made, however many near
    copies there are. Groups of more than SIDE values are split on both sides.
    """
    masks = half_masks(limit)
    of = F.array(*[F.struct(F.lit(i).alias("half"), F.lit(signed(lowest(dealt, DEALT_BITS))).alias("mask")) for i, (dealt, _) in enumerate(masks)])
    both = rows.select(F.lit(True).alias("asks"), F.col("a").alias("v"), F.col("seq").alias("o")).unionByName(owners.select(F.lit(False).alias("asks"), F.col("b").alias("v"), F.col("owner").alias("o")))
    dealt = both.withColumn("m", F.explode(of)).select("m.half", F.col("v").bitwiseAND(F.col("m.mask")).alias("key"), "asks", "v", "o")
    counts = dealt.groupBy("half", "key").agg(F.count_if("asks").alias("n"), F.count_if(~F.col("asks")).alias("m")).where("n > 0 AND m > 0")
    parts = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    counts = cut(counts.select("half", "key", parts("n").alias("parts_a"), parts("m").alias("parts_b")))  # a row for each group
    part, every = (lambda of: F.pmod(F.xxhash64("v"), F.col(of)).cast("int")), (lambda of: F.sequence(F.lit(0), F.col(of) - 1))
    a, b = F.when(F.col("asks"), F.array(part("parts_a"))).otherwise(every("parts_a")), F.when(F.col("asks"), every("parts_b")).otherwise(F.array(part("parts_b")))
    dealt = dealt.join(F.broadcast(counts), ["half", "key"]).withColumn("part_a", F.explode(a)).withColumn("part_b", F.explode(b))
    dealt = dealt.repartition(tasks(dealt), "half", "key", "part_a", "part_b")  # little to read but much to compare, so not by size

    def run(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        v, o = group["v"].to_numpy().view(np.uint64), group["o"].to_numpy()
        found = nearest_in(v[asks], o[asks], v[~asks], o[~asks], limit, *masks[group["half"][0].as_py()])
        near = found.far <= limit
        return pa.table({"seq": found.seq[near], "a": found.left[near].view(np.int64), "distance": found.far[near].astype(np.int32), "b": found.to[near].view(np.int64)})

    # halves and parts without rows of both sides have nothing to compare
    found = dealt.groupBy("half", "key", "part_a", "part_b").applyInArrow(lambda g: run(g) if 0 < pc.sum(g["asks"]).as_py() < len(g) else none_found(), "seq long, a long, distance int, b long")
    best = found.groupBy("seq", "a").agg(F.min(F.struct("distance", place("b").alias("place"), "b")).alias("m"))
    return best.select("seq", "a", "m.distance", "m.b")


def none_found() -> pa.Table:
    return pa.table({"seq": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "distance": pa.array([], pa.int32()), "b": pa.array([], pa.int64())})


def near_parents(rows: DataFrame, owners: DataFrame, near_kinds: dict[str, int]) -> DataFrame:
    """(seq, parent) of rows (seq, pos, kind, value) that no exact fingerprint has placed: the nearest value of an earlier
    row within its kind's limit, by distance, then position, then value. Owners are (kind, b, owner, group)."""
    parts = None
    for kind, limit in near_kinds.items():
        known = owners.where(F.col("kind") == kind).select("b", "owner", "group")
        mine = rows.where(F.col("kind") == kind).groupBy(F.col("value").cast("long").alias("a"), "seq").agg(F.min("pos").alias("pos"))
        part = nearest_earlier(mine, known, limit).join(mine, ["seq", "a"]).join(known, "b")
        part = part.select("seq", "distance", "pos", place("b").alias("place"), F.coalesce("group", "owner").alias("parent"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("seq").agg(F.min(F.struct("distance", "pos", "place", "parent")).alias("best")).select("seq", "best.parent")


def near_values(owners: DataFrame, near_kinds: dict[str, int]) -> DataFrame:
    """(kind, b, owner, group) of owners (kind, value, owner, group): the values of near kinds as numbers."""
    return owners.where(F.col("kind").isin(*near_kinds)).select("kind", F.col("value").try_cast("long").alias("b"), "owner", "group")


def content_groups(fingerprints: DataFrame, near_kinds: dict[str, int]) -> DataFrame:
    """(seq, group): fingerprints are (seq, pos, kind, value); values of near kinds are 64-bit numbers in text.

    A row joins the group of the owner of its first fingerprint that an earlier row owns; without one, of the nearest
    value within the kind's limit that an earlier row owns (by distance, then position, then value); else it starts a
    group. Groups never merge, so each row has one parent, and the root of its parents names the group.
    """
    fingerprints = cut(fingerprints)
    owners = cut(first_bearers(fingerprints)).withColumn("group", F.lit(None).cast("long"))
    exact = cut(exact_parents(fingerprints, owners))
    near = near_parents(cut(fingerprints.join(exact, "seq", "left_anti")), near_values(owners, near_kinds), near_kinds)
    parent = fingerprints.select("seq").distinct().join(exact.unionByName(near), "seq", "left")
    return chain_roots(parent.select(F.col("seq").alias("id"), "parent")).select(F.col("id").alias("seq"), F.col("root").alias("group"))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in order; rows with a null key are all kept."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    ranked = df.where(known).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n").unionByName(df.where(~known))
