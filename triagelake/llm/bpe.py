"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, give_back, table

#: White space as the vocabulary's patterns have it.
SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: What the tokenizers library takes for letters and numbers beyond the tables of Unicode 15.1.
NEWER = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}
#: Lower-case letters that it has beyond the same tables.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Above every rank; and how many nodes each node of the tree is over.
NONE, FAN = 1 << 40, 16


def code_points(kind: str) -> str:
    """All code points of a general category (L, N) as ranges of a pattern's class, by Python's tables and NEWER."""
    own = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind]
    first = [c for c, before in zip(own, [-2, *own]) if c != before + 1]
    last = [c for c, after in zip(own, [*own[1:], -2]) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in [*zip(first, last), *NEWER[kind]])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def rank_tree(leaves: list[int]) -> list[list[int]]:
    """Levels of a segment tree of minima over ``leaves``, each node over FAN nodes below; the last level is the root."""
    levels = [leaves]
    while len(levels) == 1 or len(leaves) > 1:
        leaves = [min(leaves[x : x + FAN]) for x in range(0, len(leaves), FAN)]
        levels.append(leaves)
    return levels


class WordBpe:
    """A vocabulary file of the tokenizers format: lower-cased words, byte-level letters, an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Of each pair of ids that merges, as one number: rank, and the id of the merged token.
        self.ranks = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.token}
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        for kind in "LN":
            split = split.replace(rf"\p{{{kind}}}", code_points(kind))
        self.words = re.compile(split.replace(r"\s", SPACE)).findall
        self.spaces = regex.compile(f"[{SPACE}]+").split
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.of_word, self.of_chunk = Memo(lambda word: array("i", self.encode_word(word)).tobytes(), 100_000), Memo(self.encode_chunk, 200_000)

    def merge(self, ids: list[int]) -> list[int]:
        """Merges the leftmost pair of lowest rank until none is left.

        A leaf of the tree has rank * n + position of the pair that starts there, so that the root is the leftmost lowest
        pair. Every merge changes three leaves, whose paths to the root are walked together, level by level. Of up to FAN
        pairs the root is the one node, and the leaves close up instead of leaving gaps.
        """
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.ranks.get, self.merged
        if n <= FAN + 1:
            leaf = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
            while (r := min(leaf)) < NONE:
                i = leaf.index(r)
                new = ids[i] = merged[r]
                del ids[i + 1]
                if i:
                    leaf[i - 1] = rank(ids[i - 1] << 32 | new, NONE)
                del leaf[i]
                if i < len(leaf):
                    leaf[i] = rank(new << 32 | ids[i + 1], NONE)
                elif not leaf:
                    break
            return ids
        none = NONE * n
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        leaf, *upper = rank_tree([rank(a << 32 | b, NONE) * n + i for i, (a, b) in enumerate(zip(ids, ids[1:]))])
        root = upper[-1]
        while (top := root[0]) < none:
            r, i = divmod(top, n)
            j, low = after[i], before[i]
            new = ids[i] = merged[r]
            ids[j] = -1
            k = after[i] = after[j]
            high = i
            if k >= 0:
                before[k] = i
                leaf[j] = none
                leaf[i] = rank(new << 32 | ids[k], NONE) * n + i
                high = j
            else:
                leaf[i] = none
            if low >= 0:
                leaf[low] = rank(ids[low] << 32 | new, NONE) * n + low
            else:
                low = i
            below = leaf
            for level in upper:
                low //= FAN
                high //= FAN
                for x in range(low, high + 1):
                    level[x] = min(below[x * FAN : x * FAN + FAN])
                below = level
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        return self.merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])

    def encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of what stands between white space."""
        clean = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower().translate(LOWER)
        return self.of_word[clean] if clean.isalpha() else b"".join(map(self.of_word.__getitem__, self.words(clean)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, chunk by chunk and special token by special token.

        No pattern of the vocabulary matches across white space and no composed letter does, so chunks are independent.
        """
        out: list[bytes] = []
        text = text or ""
        for k, part in enumerate(self.parts(text) if any(map(text.__contains__, self.special)) else [text]):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
            else:  # str.split() also parts at the separators U+001C to U+001F
                chunks = filter(None, self.spaces(part)) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
                out += map(self.of_chunk.__getitem__, chunks)
        self.of_word.trim()
        self.of_chunk.trim()
        return array("i", b"".join(out)).tolist()

    def forget(self) -> None:
        """At a task's end: its worker goes on to other work, which needs the memory."""
        self.of_word.forget()
        self.of_chunk.forget()
        give_back()

    def decode(self, ids) -> str:
        """Tokens joined by a space (the vocabulary names no decoder), special tokens included; unknown ids are skipped."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; one pass, no shuffle.

    A null text counts as empty (0 tokens, digests of the empty string). Repeated rows are each returned, null ids too;
    other columns are ignored. A word of any length costs O(n log n).
    """
    path = path or vocabulary()

    def encode(batches):
        bpe = tokenizer(path)
        sha = lambda joined: hashlib.sha256(joined.encode("utf-8")).hexdigest()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = bpe.encode(text.as_py())
                rows.append((len(ids), sha(" ".join(map(bpe.decimal.__getitem__, ids))), sha(" ".join(map(bpe.token.__getitem__, ids)))))
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, input_ids (array<int>) of every text, for use downstream; the same cases as ``encode_digest``."""
    path = path or vocabulary()

    def encode(batches):
        for batch in batches:
            ids = [tokenizer(path).encode(t.as_py()) for t in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "input_ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, input_ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text decoded from input_ids; a null array decodes to the empty string."""
    path = path or vocabulary()

    def decode(batches):
        for batch in batches:
            texts = [tokenizer(path).decode(i.as_py() or ()) for i in batch["input_ids"]]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "input_ids").mapInArrow(decode, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"))
