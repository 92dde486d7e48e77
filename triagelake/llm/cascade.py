"""Quality rules as a short-circuit cascade: measured on a sample, ordered by rejections per second."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rows of the sample on which rules are measured, bytes of its longest text, and of a piece that is split into words at once.
SAMPLE, LONGEST, PIECE = 512, 200_000, 1 << 20
#: Fixed values.
SYMBOLS, BULLETS, BLANKS = "#*$%&|<>", ("-", "*", "•", "‣", "–"), b" \t\n\x0b\x0c\r"


class Text:
    """What rules ask of a text. Each thing is computed when a rule first asks for it, and once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def _words(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of each word, in order, and the distinct words; a long text is split piece by piece."""
        raw, number = self.text.encode("utf-8", "surrogatepass"), {}
        found, start = [], 0
        while start < len(raw):
            end = min(start + PIECE, len(raw))
            while end < len(raw) and raw[end] not in BLANKS:
                end += 1
            words = raw[start:end].split()
            found.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            start = end
        return np.concatenate(found) if found else np.zeros(0, np.int64), list(number)

    @property
    def n_words(self) -> int:
        return len(self._words[0])

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS.decode()))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_alphabetic(self) -> int:
        """Words with a letter."""
        numbers, words = self._words
        some = np.array([w.isalpha() or any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in words], np.int64)
        return int((np.bincount(numbers, minlength=len(words)) * some).sum())

    @cached_property
    def _lines(self) -> list[str]:
        blanks = BLANKS.decode()
        return [x for x in self.text.split("\n") if x.strip(blanks)]

    @property
    def n_lines(self) -> int:
        return len(self._lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self._lines) - len(set(self._lines))

    @cached_property
    def n_ellipsis(self) -> int:
        return sum(x.rstrip(BLANKS.decode()).endswith(("...", "…")) for x in self._lines)

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip(BLANKS.decode()).startswith(BULLETS) for x in self._lines)

    def _windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of each window of n words, equal for equal windows, and how often each number occurs."""
        numbers, words = self._words
        key, bound, base = numbers, len(words), max(len(words), 1)
        for k in range(1, n):
            if bound * base >= 1 << 62:
                distinct, key = np.unique(key, return_inverse=True)
                bound = len(distinct)
            key = key[:-1] * base + numbers[k:]
            bound *= base
        _, key, counts = np.unique(key, return_inverse=True, return_counts=True)
        return key, counts

    def top(self, n: int) -> int:
        """How often the most frequent window of n words occurs."""
        return int(self._windows(n)[1].max(initial=0)) if self.n_words >= n else 0

    def repeated(self, n: int) -> int:
        """Words in windows of n words that occur twice or more, the first included."""
        if self.n_words < n:
            return 0
        key, counts = self._windows(n)
        if len(counts) == len(key):
            return 0
        again = counts[key] > 1
        ends = np.zeros(self.n_words + 1, np.int64)
        ends[: len(again)] += again
        ends[n : n + len(again)] -= again
        return int((np.cumsum(ends) > 0).sum())

    @cached_property
    def n_repeat_words(self) -> int:
        return self.repeated(3)


class Rule(NamedTuple):
    name: str
    keeps: Callable[[Text], bool]


#: The rules that the contract fixes, then published ones for web text: word length, symbols, letters, lines, and repetition
#: at several lengths. Shares of n-grams are of words.
BASE = [
    Rule("words", lambda t: t.n_words >= 50),
    Rule("repeated 3", lambda t: 100 * t.n_repeat_words <= 50 * t.n_words),
]
RULES = [
    *BASE,
    Rule("word length", lambda t: 3 * t.n_words <= t.word_chars <= 10 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols <= t.n_words),
    Rule("alphabetic", lambda t: 10 * t.n_alphabetic >= 8 * t.n_words),
    Rule("duplicate lines", lambda t: 10 * t.n_dup_lines <= 3 * t.n_lines),
    Rule("ellipsis", lambda t: 10 * t.n_ellipsis <= 3 * t.n_lines),
    Rule("bullets", lambda t: 10 * t.n_bullets <= 9 * t.n_lines),
    Rule("top 2", lambda t: 100 * 2 * t.top(2) <= 20 * t.n_words),
    Rule("top 3", lambda t: 100 * 3 * t.top(3) <= 18 * t.n_words),
    Rule("top 4", lambda t: 100 * 4 * t.top(4) <= 16 * t.n_words),
    Rule("repeated 5", lambda t: 100 * t.repeated(5) <= 30 * t.n_words),
    Rule("repeated 10", lambda t: 100 * t.repeated(10) <= 25 * t.n_words),
]


def measure(docs: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Seconds and rejections of each rule (columns) on each text of a sample of ``rows`` texts at most.

    The sample is the first such rows of the table that a hash picks, one in eight, without very long texts; it sets the order of
    the rules and nothing else. Each rule is timed on a text whose words are known, which nearly all need.
    """

    def run(batches):
        for batch in batches:
            for raw in batch["text"].to_pylist():
                seconds, rejected = [], []
                for rule in rules:
                    text = Text(raw)
                    text._words  # noqa: B018  computes it
                    began = time.perf_counter()
                    rejected.append(not rule.keeps(text))
                    seconds.append(time.perf_counter() - began)
                yield pa.record_batch([pa.array([seconds]), pa.array([rejected])], ["seconds", "rejected"])

    sample = docs.where((F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST) & (F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0)).select("text").limit(rows)
    found = sample.mapInArrow(run, "seconds array<double>, rejected array<boolean>").collect()
    shape = (len(found), len(rules))
    return np.array([r.seconds for r in found]).reshape(shape), np.array([r.rejected for r in found], bool).reshape(shape)


def order(seconds: np.ndarray, rejected: np.ndarray) -> list[int]:
    """Rules by rejections per second, each time among the texts that the rules before it kept; ties keep their order."""
    left, out, texts = list(range(seconds.shape[1])), [], np.ones(len(seconds), bool)
    while left:
        if texts.any():
            gain = rejected[texts][:, left].sum(axis=0) / np.maximum(seconds[texts][:, left].sum(axis=0), 1e-9)
            # of rules that reject nothing on the sample the cheapest comes first
            best = left[int(gain.argmax())] if gain.max() > 0 else left[int(seconds[texts][:, left].sum(axis=0).argmin())]
        else:
            best = left[0]
        out.append(best)
        left.remove(best)
        texts &= ~rejected[:, best]
    return out


def plan(docs: DataFrame, rules: list[Rule] = RULES, rows: int = SAMPLE) -> list[Rule]:
    """The rules in the order that rejects soonest."""
    return [rules[k] for k in order(*measure(docs, rules, rows))]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def screen(docs: DataFrame, rules: list[Rule], counts: bool = False) -> DataFrame:
    """doc_id, kept, rejected_by, n_evaluated of every whole text: rules run in the given order until one rejects.

    One pass, no shuffle. Which texts are kept does not depend on the order; ``rejected_by`` (the first rule that rejects,
    null if none does) and ``n_evaluated`` do. With ``counts`` the columns of COUNTS and base_failed follow, for rejected
    texts too. A null text counts as empty, and an empty one has no words, so the length rule rejects it. Repeated rows are
    each returned, null ids too; an empty table gives an empty result; other columns are ignored. Of a very long text, a
    number for each word, each distinct word and each line are held.
    """

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch["text"].to_pylist():
                text = Text(raw)
                at = next((k for k, rule in enumerate(rules) if not rule.keeps(text)), None)
                row = [at is None, None if at is None else rules[at].name, len(rules) if at is None else at + 1]
                if counts:
                    row += [*(getattr(text, c) for c in COUNTS), not all(rule.keeps(text) for rule in BASE)]
                out.append(row)
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)]
            yield pa.record_batch([batch["doc_id"], *columns], names)

    names = ["doc_id", "kept", "rejected_by", "n_evaluated", *(COUNTS + ("base_failed",) if counts else ())]
    types = [pa.bool_(), pa.string(), pa.int32(), *([pa.int64()] * 5 + [pa.bool_()] if counts else [])]
    kinds = {pa.bool_(): "boolean", pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}
    schema = ", ".join(["doc_id long", *(f"{n} {kinds[t]}" for n, t in zip(names[1:], types))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept of every document; the rules run in the order that ``plan`` finds for docs."""
    return screen(docs, plan(docs), counts=True).select("doc_id", *COUNTS, "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _windows_sql(n: int) -> str:
    return f"""g{n} AS (SELECT d, i, count(*) OVER (PARTITION BY d, w[i:i + {n - 1}]) AS c FROM p WHERE i + {n - 1} <= n_words),
t{n} AS (SELECT d, max(c) AS top FROM g{n} GROUP BY d),
r{n} AS (SELECT d, count(DISTINCT i + k) AS words FROM g{n}, range({n}) x(k) WHERE c > 1 GROUP BY d)"""


SQL = rf"""
WITH a AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
b AS (
  SELECT d, doc_id, w, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alphabetic,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣–]'))) AS n_bullets FROM a),
p AS (SELECT d, w, n_words, unnest(range(1, n_words + 1)) AS i FROM b),
{", ".join(_windows_sql(n) for n in (2, 3, 4, 5, 10))},
c AS (
  SELECT b.*, coalesce(r3.words, 0) AS n_repeat_words, coalesce(t2.top, 0) AS top2, coalesce(t3.top, 0) AS top3, coalesce(t4.top, 0) AS top4,
    coalesce(r5.words, 0) AS r5, coalesce(r10.words, 0) AS r10
  FROM b LEFT JOIN r3 USING (d) LEFT JOIN t2 USING (d) LEFT JOIN t3 USING (d) LEFT JOIN t4 USING (d) LEFT JOIN r5 USING (d) LEFT JOIN r10 USING (d))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_symbols <= n_words
    AND 10 * n_alphabetic >= 8 * n_words AND 10 * n_dup_lines <= 3 * n_lines AND 10 * n_ellipsis <= 3 * n_lines AND 10 * n_bullets <= 9 * n_lines
    AND 200 * top2 <= 20 * n_words AND 300 * top3 <= 18 * n_words AND 400 * top4 <= 16 * n_words AND 100 * r5 <= 30 * n_words AND 100 * r10 <= 25 * n_words AS kept
FROM c
"""
