"""Draws without near copies, ordered links, policy files, and students against plain versions."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake import registry
from triagelake.functions.metrics import dot  # noqa: F401
from triagelake.operators import lexicon as L
from triagelake.operators import sampling as S
from triagelake.operators import students as M
from triagelake.plans import sampling_queries as P
from triagelake.sources import readers as R


def drawn(rows, quotas, seed, limit):
    """(id, state) of a pass over all rows in order, stratum by stratum."""
    kept, out = [], {}
    for stratum, quota in quotas.items():
        n = 0
        for _, i, value, reason in sorted((hashlib.md5(f"{seed}{i}".encode()).hexdigest(), i, v, r) for i, s, v, r in rows if s == stratum):
            if n == quota:
                break
            near = any(((value ^ w) & (1 << 64) - 1).bit_count() <= limit for w in kept)
            out[i] = reason or ("near_copy" if near else "kept")
            if out[i] == "kept":
                kept.append(value)
                n += 1
    return out


def test_quotas_without_near_copies_equal_a_pass_in_order(spark, data):
    rows = [tuple(r) for r in P.pictures(spark, data).collect()]
    got = {r.id: r.state for r in registry.QUERIES["win01_draw_without_copies"](spark, data).collect()}
    assert got == drawn(rows, {"odd": 60, "even": 90}, "p", 4) and set(got.values()) == {"kept", "near_copy", "quarantined"}
    rng = random.Random(3)
    few = [(k, f"s{k % 3}", rng.choice([0, 1, 3, 1 << 40, (1 << 40) + 7, rng.getrandbits(62)]), rng.choice([None, None, "age"])) for k in range(90)]
    df = spark.createDataFrame(few, "id long, stratum string, value long, reason string")
    quotas = {"s2": 4, "s0": 40, "none": 3}
    assert {r.id: r.state for r in S.draw_without_copies(df, quotas, "x", 2).collect()} == drawn(few, quotas, "x", 2)
    assert S.draw_without_copies(df.limit(0), quotas, "x").collect() == []


def test_the_first_of_each_stratum_by_hash(spark, monkeypatch):
    rows = [(k, None if k % 7 == 0 else f"s{k % 3}") for k in range(400)]
    df = spark.createDataFrame(rows, "id long, s string")
    wanted = {"s0": 0, "s1": 57, "s2": 1000, None: 9}
    table = spark.createDataFrame(list(wanted.items()), "s string, n long")
    for digits in (4, 1):
        monkeypatch.setattr(S, "DIGITS", digits)
        got = {r.id for r in S.first_of_each(df, "id", "s", table, "q").where("first").collect()}
        assert got == {i for s, n in wanted.items() for i in sorted((i for i, t in rows if t == s), key=lambda i: hashlib.md5(f"q{i}".encode()).hexdigest())[:n]}
    assert S.first_of_each(df, "id", "s", table, "q").count() == 400


def test_links_come_in_the_order_of_the_item(spark):
    item = {"z": ["https://a.fbcdn.net/1.jpg", {"owner": {"pic": "https://a.fbcdn.net/face.jpg"}, "deep": [["https://a.fbcdn.net/2.mp4"]]}], "userAvatar": "https://a.fbcdn.net/x.png", "a": "https://a.fbcdn.net/1.jpg", "b": "https://b.fbcdn.net/3.WEBP?q=1", "c": "https://evil.net/fbcdn.net/4.jpg", "d": "http://a.fbcdn.net/5.jpg", "e": "https://fbcdn.net/6.txt", "f": 7, "g": None}
    rows = [("p", json.dumps(item)), ("q", "broken"), (None, json.dumps({"k": "https://fbcdn.net/n.jpg"})), ("r", None)]
    got = R.media_urls(spark.createDataFrame(rows, "post_id string, item string"), ("fbcdn.net",)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.place):
        by.setdefault(r.post_id, []).append((r.kind, r.url))
    assert by == {"p": [("image", "https://a.fbcdn.net/1.jpg"), ("video", "https://a.fbcdn.net/2.mp4"), ("image", "https://b.fbcdn.net/3.WEBP?q=1")], None: [("image", "https://fbcdn.net/n.jpg")]}
    own = {"images": ["https://cdninstagram.com/own.jpg"], "a": "https://cdninstagram.com/first.jpg", "displayUrl": "https://cdninstagram.com/own.jpg"}
    items = spark.createDataFrame([("i", "instagram", json.dumps({"a": "https://cdninstagram.com/first.jpg"} | own))], "post_id string, platform string, item string")
    assert [r.url.rsplit("/", 1)[1] for r in R.ordered_media(items, ("cdninstagram.com",)).orderBy("place").collect()] == ["own.jpg", "first.jpg"]


def test_numbers_are_no_texts(spark):
    items = spark.createDataFrame([("x", '{"id": "0", "text": "false"}'), ("x", '{"id": 0, "text": "t"}'), ("x", '{"id": "a", "fullText": false, "text": "0"}')], "platform string, item string")
    assert sorted((r.post_id, r.text) for r in R.posts(items).collect()) == [("0", "false"), ("a", "0")]


POLICY = """
version: '1'
age_terms:
  note: any words
  en:
    words: [pupil, todd*]
    age_units: [years old]
    number_words: {twelve: 12}
    stated_age_phrases: ["aged {n}"]
    not_followed_by: [minutes]
entries:
- {id: E-1, type: T, region: r, language: en, value: red / blue things, status: approved, supports: [A, B]}
- {id: E-2, type: T, region: r, language: en, value: green, status: proposed}
patterns:
- {id: P-1, lang: en, strength: strong, regex: 'red\\w*'}
- {id: P-2, lang: en, strength: weak, near: ['a', 'b', 6]}
"""


def test_policy_files_become_the_tables_that_matching_takes(spark, tmp_path):
    (tmp_path / "r.yaml").write_text(POLICY)
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "x.jsonl").write_text('{"id": "G1", "lang": "en", "text": "t", "expected": {"flag": true}}\n\n{"id": "G2", "image_description": "i", "restricted": true}\n')
    table = lambda kind, *names, **more: R.policy_table(spark, [str(tmp_path / n) for n in names], kind, **more)
    entries = table("entries", "r.yaml", "empty.yaml")
    assert [(r.id, r.supports) for r in entries.collect()] == [("E-1", ["A", "B"])] and table("entries", "r.yaml", approved_only=False).count() == 2
    docs = spark.createDataFrame([(1, "a blue   thing and green"), (2, "green")], "seq long, text string")
    assert [(r.seq, r.ids) for r in L.lexicon_hits(docs, entries).collect()] == [(1, ["E-1"])]
    ages = table("age_terms", "r.yaml")
    found = {r.t: r.a for r in spark.createDataFrame([("aged twelve",), ("aged 12 minutes",), ("11 years old todders",)], "t string").select("t", L.age_labels(F.col("t"), ages).alias("a")).collect()}
    assert found == {"aged twelve": ["stated age"], "aged 12 minutes": [], "11 years old todders": ["stated age", "age term"]}
    patterns = {r.id: (r.strength, r.pattern, r.near_a, r.window) for r in table("patterns", "r.yaml").collect()}
    assert patterns == {"P-1": ("strong", "red\\w*", None, None), "P-2": ("weak", None, "a", 6)}
    yes = {r.id: (r.text, r.restricted, json.loads(r.expected)) for r in table("examples", "x.jsonl").collect()}
    assert yes == {"G1": ("t", False, {"flag": True}), "G2": ("i", True, None)}
    with pytest.raises(ValueError):
        R.policy_entries(table("entries", "empty.yaml"))


def blobs(spark, n, seed, noise=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = x[:, 0] + 0.5 * x[:, 1] > 0
    y = np.where(rng.random(n) < noise, ~y, y)
    return spark.createDataFrame([(k, v.tolist(), bool(b)) for k, (v, b) in enumerate(zip(x, y))], "id long, x array<double>, y boolean"), x, y


def test_a_logistic_student_equals_a_plain_fit(spark):
    df, x, y = blobs(spark, 300, 1, 0.1)
    got = {r.id: r.score for r in M.scores(M.logistic_student(df, (0.05,), folds=2).bestModel, df).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    w = np.zeros(5)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-z @ w))
        ridge = 0.05 * np.array([1, 1, 1, 1, 0])
        gradient = z.T @ (weight * (p - y)) / weight.sum() + ridge * w
        hessian = (z.T * (weight * p * (1 - p))) @ z / weight.sum() + np.diag(ridge)
        w -= np.linalg.solve(hessian, gradient)
    assert np.abs(np.array([got[k] for k in range(300)]) - 1 / (1 + np.exp(-z @ w))).max() < 1e-3


def test_a_perceptron_stops_early_with_its_best_weights(spark):
    df, x, y = blobs(spark, 300, 2, 0.25)
    model, losses = M.perceptron_student(df, 4, hidden=8, rounds=400)
    assert 3 < len(losses) < 80 and losses.index(min(losses)) == len(losses) - 4
    check = model.stages[0].transform(M.prepared(df, 10).where("fold = 0"))
    assert M.log_loss(model.stages[1].transform(check)) == pytest.approx(min(losses))
    scored = M.scores(model, df).collect()
    assert np.mean([(r.score > 0.5) == r.y for r in scored]) > 0.65 and len(scored) == 300


def test_students_of_the_given_vectors_tell_held_out_rows_apart(spark, data):
    def auroc(rows):
        yes, no = [r.score for r in rows if r.y], [r.score for r in rows if not r.y]
        return np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])

    for name in ("ml01_logistic_student", "ml02_perceptron_student"):
        rows = registry.QUERIES[name](spark, data).collect()
        assert all(0 <= r.score <= 1 for r in rows) and auroc([r for r in rows if r.id % 5]) > 0.55
    own = registry.QUERIES["ml06_dataset_label_student"](spark, data).collect()
    assert own and all(r.id % 5 == 0 for r in own)


def test_failing_texts_become_errors_and_done_ones_are_skipped(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.id: (r.value, r.error) for r in registry.QUERIES["ml08_resumable_scoring"](spark, data).collect()}
    want = {}
    for i, text in docs.items():
        if i % 2:
            n = None if text is None else len(text) % 7
            want[i] = (None, "TypeError") if n is None else (1000.0 / n, None) if n else (None, "ZeroDivisionError")
    assert got == want
