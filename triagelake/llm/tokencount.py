"""Token counts under a unigram model of a public vocabulary, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, table

INSIDE = re.compile(r"\s (?:\s|\Z)").search


class UnigramTrie:
    """Best segmentations of byte strings under piece probabilities that fall with the rank (1 / (rank + 1), scaled).

    Each node of the trie stands for a prefix that strings share and has the forward score of that prefix, that is, the
    log probability of its best segmentation, and how many pieces this has. Both are computed once, when the node is
    made, from the nodes above it. Equal scores take fewer pieces.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 1_000_000):
        scale = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.score = {piece: -math.log(r + 1) - scale for piece, r in ranks.items()}
        self.longest, self.most = max(map(len, ranks)), most
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def insert(self, text: bytes) -> int:
        """Adds a string; the number of pieces of its best segmentation, which its last node keeps."""
        child, best, pieces, score = self.child, self.best, self.pieces, self.score.get
        path, node = [0], 0
        for end, byte in enumerate(text, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                top, fewest = -math.inf, 0
                for start in range(max(0, end - self.longest), end):
                    s = score(text[start:end])
                    if s is not None:
                        above = path[start]
                        s += best[above]
                        if s > top or s == top and pieces[above] + 1 < fewest:
                            top, fewest = s, pieces[above] + 1
                node = child[key] = len(best)
                best.append(top)
                pieces.append(fewest)
            path.append(node)
        return pieces[node]

    def trim(self) -> None:
        if len(self.best) > self.most:
            self.clear()


class Counter:
    """Pre-token and token counts of texts; a word with the white space before it is counted once and remembered."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.trie, self.split = UnigramTrie(ranks), regex.compile(pattern).findall
        self.chunks = regex.compile(r"\s*\S+|\s+").findall
        self.chunk = Memo(self.count, 200_000)

    def forget(self) -> None:
        """At a task's end: its worker goes on to other work, which needs the memory."""
        self.chunk.forget()
        self.trie.clear()

    def count(self, chunk: str) -> tuple[int, int]:
        pre = [chunk] if chunk[1:].isalpha() and chunk[0] == " " and chunk.isascii() else self.split(chunk)
        return len(pre), sum(self.trie.insert(p.encode("utf-8", "replace")) for p in pre)

    def __call__(self, text: str | None) -> tuple[int, int]:
        """No pre-token goes on from other signs to white space, so words with the white space before them are independent;
        single spaces may be split off one by one unless one stands inside a longer run of white space."""
        if not text:
            return 0, 0
        if INSIDE(text):
            chunks = self.chunks(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *(" " + c for c in rest)]
        pre, tokens = zip(*map(self.chunk.__getitem__, chunks))
        self.chunk.trim()
        self.trie.trim()
        return sum(pre), sum(tokens)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text; one pass, no shuffle.

    Null and empty texts have 0 of both. Repeated rows are each returned, null ids too; an empty table gives an empty
    result; other columns are ignored. What a task remembers (pre-tokens, trie nodes) is bounded.
    """
    default = vocabulary()
    path, pattern = path or default[0], pattern or default[1]

    def run(batches):
        for batch in batches:
            found = [counter(path, pattern)(text.as_py()) for text in batch["text"]]
            pre, tokens = zip(*found) if found else ((), ())
            yield pa.record_batch([batch["doc_id"], pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])
        counter(path, pattern).forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
