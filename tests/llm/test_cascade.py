"""Quality rules: counts against a plain version, verdicts whatever the order, and the order itself."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from triagelake.llm import cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def repeated(n):
        windows = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        counts = Counter(windows)
        return len({i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(n)})

    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated(3), repeated(5), repeated(10)


def texts():
    rng = random.Random(4)
    words = ["ab", "cde", "fghi", "é", "日本", "1", "##", "a b", "x\x1cy"]
    out = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(rng.randrange(1, 140))) for _ in range(60)]
    prose = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))
    return [*out, None, "", " \n\t", "x" * 5000, prose, prose + "\n" + prose, prose + " $ " * 40, "\n".join(["the same line again"] * 30), prose * 300]


@pytest.mark.parametrize("piece", [cascade.PIECE, 7])
def test_counts_equal_a_plain_version(monkeypatch, piece):
    monkeypatch.setattr(cascade, "PIECE", piece)
    for text in texts()[:-1]:
        t = cascade.Text(text)
        assert (*(getattr(t, c) for c in cascade.COUNTS), t.repeated(5), t.repeated(10)) == plain(text), text


def test_verdicts_do_not_depend_on_the_order(spark):
    docs = spark.createDataFrame([(k, t, "x", True) for k, t in enumerate(texts())] + [(3, texts()[3], "x", True), (None, None, "x", True)], "doc_id long, text string, rejected_by string, kept boolean")
    one = cascade.screen(docs, cascade.RULES, counts=True)
    other = cascade.screen(docs, cascade.RULES[::-1], counts=True)
    columns = ["doc_id", "kept", "base_failed", *cascade.COUNTS]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(one) == rows(other) == rows(cascade.quality_rules(docs)) and len(rows(one)) == len(texts()) + 2
    found = {r.doc_id: r for r in one.collect()}
    assert found[64].kept and found[64].n_evaluated == len(cascade.RULES) and found[64].rejected_by is None
    assert found[65].rejected_by == "repeated 3" and found[66].rejected_by == "symbols" and found[None].rejected_by == "words"
    assert all(not r.kept for r in found.values() if r.base_failed)
    assert cascade.quality_rules(docs.limit(0)).collect() == []


def test_rules_are_ordered_by_rejections_per_second():
    seconds = np.array([[1.0, 1.0, 4.0, 0.1, 0.2]] * 6)
    rejected = np.zeros((6, 5), bool)
    rejected[:2, 0] = True  # 2 a second
    rejected[:3, 1] = True  # 3 a second; what rule 0 rejects is among them
    rejected[3:, 2] = True  # 3 in 4 seconds
    assert cascade.order(seconds, rejected) == [1, 2, 0, 3, 4]
    rejected[3:, 2] = False
    assert cascade.order(seconds, rejected) == [1, 3, 4, 0, 2]
    assert cascade.order(seconds[:0], rejected[:0]) == [0, 1, 2, 3, 4]


def test_fewer_rules_run_in_the_order_found(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seconds, rejected = cascade.measure(docs)
    assert 0 < len(seconds) <= cascade.SAMPLE and seconds.shape == rejected.shape and (seconds > 0).all()
    best = [cascade.RULES[k] for k in cascade.order(seconds, rejected)]
    spent = lambda rules: sum(r.n_evaluated for r in cascade.screen(docs, rules).collect())
    cost = {r.name: seconds[:, k].mean() for k, r in enumerate(cascade.RULES)}
    paid = lambda rules: sum(sum(cost[x.name] for x in rules[: r.n_evaluated]) for r in cascade.screen(docs, rules).collect())
    assert paid(best) <= paid(best[::-1]) and spent(best) > 0
