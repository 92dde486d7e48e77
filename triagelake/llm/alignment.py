"""Alignment of the tokens that two tokenizers cut from the same text, and how often their ids meet."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import cut, table, tidy

#: Characters of a part of a text, characters that one Arrow pass takes, pairs that are counted before they leave a task,
#: pairs whose counts are sent around (12 MB), counts of all others being joined; and chunks, and characters of the longest
#: of them, that a task remembers.
PART, BLOCK, HELD, SENT, KNOWN, SHORT = 1 << 16, 1 << 20, 1 << 20, 1 << 20, 200_000, 64

#: A space where neither tokenizer merges across: between two characters that are no white space and no U+2581.
CUT = re.compile("(?<=[^\\s▁\x1c-\x1f\x85\xa0]) (?=[^\\s▁\x1c-\x1f\x85\xa0])")

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Pair:
    """A byte-level BPE file of the tokenizers format (A) and a sentencepiece model with byte fallback (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        tokens = [b""] * (1 + max(vocab.values()))
        for entry, i in vocab.items():
            tokens[i] = bytes(byte_of[x] for x in entry)
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.bytes = [pa.array(x, pa.binary()) for x in (tokens, pieces)]
        self.lengths = [pc.cast(pc.binary_length(x), pa.int64()) for x in self.bytes]
        self.decimal = [pa.array([str(i) for i in range(len(x))]) for x in self.bytes]
        self.n_b, self.known = len(pieces), ({}, {})
        #: Numpy type of a pair of ids, which is a * n_b + b.
        self.width = "<u4" if len(tokens) * len(pieces) <= 1 << 32 else "<u8"

    def encode(self, parts: list[str]) -> list[pa.ListArray]:
        """Ids of each part by A and B. A part after a text's first stands after a space, as the first does.

        Chunks between cuts are encoded once while they are remembered, as packed ids.
        """
        if len(self.known[0]) > KNOWN:
            self.forget()
        chunks = [CUT.split(p) for p in parts]
        new = list(set().union(*chunks).difference(self.known[0]))
        for of, ids in zip(self.known, (map(attrgetter("ids"), self.a.encode_batch_fast([" " + c for c in new], add_special_tokens=False)), self.b.encode(new, num_threads=1))):
            of.update(zip(new, (array("i", i).tobytes() for i in ids)))
        out = []
        for of in self.known:
            raw = [b"".join(map(of.__getitem__, c)) for c in chunks]
            ends = np.cumsum([0, *map(len, raw)]) // 4
            out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.int32))))
        for c in new:
            if len(c) > SHORT:
                del self.known[0][c], self.known[1][c]
        return out

    def forget(self) -> None:
        self.known = {}, {}

    def whole(self, parts: list[str], ids: list[pa.ListArray]) -> np.ndarray:
        """Of each part, whether the bytes of its tokens are those of the part after a space, by both tokenizers."""
        want = [b" " + p.encode() for p in parts]
        good = np.ones(len(parts), bool)
        for of, known in zip(ids, self.bytes):
            joined = pc.binary_join(pa.ListArray.from_arrays(of.offsets, pc.take(known, of.values)), b"")
            good &= pc.equal(joined, pa.array(want, pa.binary())).to_numpy(zero_copy_only=False)
        return good


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def parts_of(text: str, size: int) -> list[str]:
    """A text in parts of about ``size`` characters, cut at spaces that neither tokenizer merges across; the space that was
    cut at is left out. A stretch without such a space stays whole."""
    out, start = [], 0
    while len(text) - start > size and (at := CUT.search(text, start + size)):
        out.append(text[start : at.start()])
        start = at.end()
    return [*out, text[start:]]


def ends_of(ids: pa.ListArray, lengths: pa.Array, name: str) -> pa.Table:
    """A row for each token: its part, the byte offset in the part where it ends, and its id under ``name``."""
    parent, flat = pc.list_parent_indices(ids), pc.list_flatten(ids)
    total = pc.cumulative_sum(pc.take(lengths, flat))
    first = ids.offsets.to_numpy()[:-1]
    before = np.concatenate([[0], total.to_numpy()])[first]  # what the sum was where the part began
    return pa.table({"part": parent, "end": pc.subtract(total, pc.take(pa.array(before), parent)), name: flat})


def joined(values: pa.Array, offsets: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), by)


def align(of: Pair, ids: list[pa.ListArray]) -> tuple[pa.Table, pa.Table, pa.Array]:
    """Links of all parts in order (part, a, b, common: whether both tokens end with it), counts by part, group texts.

    Where one token ends, the token of the other side that covers this end is the next one that ends there or later. So
    an outer join of the ends, in order and with gaps filled backwards, has one row for each pair that overlaps.
    """
    left, right = (ends_of(x, n, name) for x, n, name in zip(ids, of.lengths, "ab"))
    rows = left.join(right, ["part", "end"], join_type="full outer", use_threads=False)
    rows = rows.take(pc.sort_indices(pc.add(pc.shift_left(pc.cast(rows["part"], pa.int64()), pa.scalar(40, pa.int64())), rows["end"]))).combine_chunks()
    common = pc.and_(pc.is_valid(rows["a"]), pc.is_valid(rows["b"]))
    texts = []
    for name, decimal in zip("ab", of.decimal):
        own = pc.is_valid(rows[name])
        values = pc.take(decimal, rows[name].filter(own)).combine_chunks()
        last = np.flatnonzero(common.filter(own).to_numpy())
        texts.append(joined(values, np.concatenate([[0], last + 1]), ","))
    links = pa.table({"part": rows["part"], "a": pc.fill_null_backward(rows["a"]), "b": pc.fill_null_backward(rows["b"]), "common": common})
    counts = links.append_column("one", pc.cast(common, pa.int64())).group_by("part", use_threads=False).aggregate([("a", "count"), ("one", "sum")]).sort_by("part")
    ends = np.concatenate([[0], np.cumsum(counts["one_sum"].to_numpy())])
    return links, counts, joined(pc.binary_join_element_wise(*texts, "|"), ends, ";")


class Counted:
    """Pair counts of a task, added up until they are many."""

    def __init__(self, most: int):
        self.most, self.tables, self.rows = most, [], 0

    def add(self, keys: pa.Array) -> None:
        self.tables.append(pa.table({"key": keys, "n": pa.array(np.ones(len(keys), np.int64))}).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"]))
        self.rows += self.tables[-1].num_rows
        if self.rows > self.most:
            self.tables = [self.merged()]
            self.rows = self.tables[0].num_rows

    def merged(self) -> pa.Table:
        return pa.concat_tables(self.tables).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])

    def take(self) -> dict[str, pa.Array]:
        out = self.merged().combine_chunks()
        self.tables, self.rows = [], 0
        return {name: out[name].chunk(0) for name in out.column_names}


def packed(keys: np.ndarray, width: str) -> bytes:
    return len(keys).to_bytes(8, "little") + pa.compress(keys.astype(width).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, width: str) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little") * np.dtype(width).itemsize
    return np.frombuffer(pa.decompress(raw[8:], size, "zstd", asbytes=True), width).astype(np.int64)


def encode(paths: tuple[str, str], part: int, block: int):
    """Arrow function: a row for each document (its counts and digest), rows of its links, rows of pair counts."""
    names = ["row", "doc_id", *COUNTS, "groups_sha256", "links", "key", "n"]
    types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def batch(**columns):
        n = len(next(iter(columns.values())))
        return pa.record_batch([columns[x] if x in columns else pa.nulls(n, t) for x, t in zip(names, types)], names)

    def run(batches):
        of, counted = pair(*paths), Counted(HELD)
        for rows in batches:
            texts = enumerate(rows["text"].to_pylist())
            for run_of in blocks([(k, t or "") for k, t in texts], block):
                own = pa.array([k for k, _ in run_of])
                parts = [(k, p) for k, t in run_of if t for p in parts_of(t, part)]
                ready, bad = [], set()
                for some in blocks(parts, block):
                    owner, ids = [k for k, _ in some], of.encode([p for _, p in some])
                    bad |= {owner[x] for x in np.flatnonzero(~of.whole([p for _, p in some], ids))}
                    ready.append((owner, ids))
                totals, digests = {k: np.zeros(4, np.int64) for k, _ in run_of}, {}
                for owner, ids in ready:
                    keep = [x for x, k in enumerate(owner) if k not in bad]
                    if not keep:
                        continue
                    owner, ids = [owner[x] for x in keep], [x.take(pa.array(keep)) for x in ids]
                    links, counts, groups = align(of, ids)
                    keys = pc.add(pc.multiply(pc.cast(links["a"], pa.int64()), of.n_b), links["b"])
                    counted.add(keys)
                    n = np.stack([*(np.diff(x.offsets.to_numpy()) for x in ids), counts["one_sum"].to_numpy(), counts["a_count"].to_numpy()], axis=1)
                    ends, flat = np.concatenate([[0], np.cumsum(n[:, 3])]), keys.to_numpy()
                    for x, (k, text) in enumerate(zip(owner, groups.to_pylist())):
                        totals[k] += n[x]
                        if k in digests:
                            digests[k].update(b";" + text.encode())
                        else:
                            digests[k] = hashlib.sha256(text.encode())
                    yield batch(row=rows["row"].take(pa.array(owner)), links=pa.array([packed(flat[i:j], of.width) for i, j in zip(ends, ends[1:])], pa.binary()))
                hexes = pa.array([digests[k].hexdigest() if k in digests else "" for k, _ in run_of])
                by_column = zip(COUNTS, np.stack([totals[k] for k, _ in run_of]).T)
                yield batch(row=rows["row"].take(own), doc_id=rows["doc_id"].take(own), groups_sha256=hexes, **{name: pa.array(c) for name, c in by_column})
            if counted.rows > HELD // 2:
                yield batch(**counted.take())
        if counted.rows:
            yield batch(**counted.take())
        of.forget()  # the task's worker goes on to other work

    return run


def blocks(parts: list[tuple[int, str]], size: int):
    """Runs of numbered texts of ``size`` characters or as many more as the last one has."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def weigh(sent, width: str):
    """Arrow function over rows of links: sums of the counts that were sent, and the keys whose counts were not."""

    def run(batches):
        keys, counts, best = sent.value
        for batch in batches:
            out = []
            for row, raw in zip(batch["row"].to_pylist(), batch["links"].to_pylist()):
                own = unpacked(raw, width)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                at = at[known]
                out.append((row, None, int(counts[at].sum()), int(best[at].sum())))
                other, n = np.unique(own[~known], return_counts=True)
                out += [(row, k, m, 0) for k, m in zip(other.tolist(), n.tolist())]
            columns = zip(*out) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["row", "key", "count_sum", "n_best"])

    return run


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, paths: tuple[str, str] | None = None, part: int = PART, block: int = BLOCK) -> DataFrame:
    """Rows of ``encode`` for whole texts, each tokenised once: documents (row not null, links null), links, pair counts."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    schema = "row long, doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "groups_sha256 string, links binary, key long, n long"
    return cut(rows.mapInArrow(tidy(encode(paths or vocabularies(), part, block)), schema))


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(key, a, b, n, best) of ``encoded``: how many links hold ids a and b linked, and whether b has no higher count."""
    counts = cut(rows.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")))
    counts = counts.select("key", F.expr(f"key div {n_b}").alias("a"), (F.col("key") % n_b).alias("b"), "n")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # at most one row for each id of B
    return counts.join(F.broadcast(top), "b").select("key", "a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None, part: int = PART, block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    Each text is tokenised once, in parts that neither tokenizer merges across; the parts' ids go through Arrow: lists
    are flattened with their parents, byte lengths summed by part, ends joined, pairs counted by task and the counts
    merged by Spark. Links are kept, compressed, until counts are known. The ``sent`` most frequent pairs are sent around
    with their counts; other pairs are counted by document and joined. Memory of a task grows with the ids of a text, not
    with its links.

    Null and empty texts, and those whose tokens do not have the text's bytes after a space, have zeros and ''. Repeated
    rows are each returned, null ids too, and count each; an empty table gives an empty result; other columns are ignored.
    """
    of = pair(*(paths or vocabularies()))
    rows = encoded(docs, paths, part, block)
    counts = cut(pair_counts(rows, of.n_b))
    frequent = counts.orderBy(F.desc("n"), "key").limit(sent).select("key", "n", "best").toArrow().sort_by("key")
    table_of = (frequent["key"].to_numpy(), frequent["n"].to_numpy(), frequent["best"].to_numpy(zero_copy_only=False))
    shared = docs.sparkSession.sparkContext.broadcast(table_of)
    weighed = cut(rows.where("links is not null").select("row", "links").mapInArrow(weigh(shared, of.width), "row long, key long, count_sum long, n_best long"))
    shared.destroy()
    sums = weighed.where("key is null").select("row", "count_sum", "n_best")
    if counts.count() > sent:
        other = weighed.where("key is not null").select("row", "key", F.col("count_sum").alias("m"))
        other = other.join(counts.select("key", "n", "best"), "key").select("row", (F.col("m") * F.col("n")).alias("count_sum"), (F.col("m") * F.col("best").cast("long")).alias("n_best"))
        sums = sums.unionByName(other)
    own = rows.where("groups_sha256 is not null").select("row", "doc_id", *COUNTS, "groups_sha256", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    every = own.unionByName(sums, allowMissingColumns=True)
    summed = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in COUNTS), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return summed.drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
