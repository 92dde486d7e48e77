"""Steps whose rows, plans or keys must not grow faster than the input."""

import random
import unicodedata
from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin as GroupedData

from triagelake import plans, registry  # noqa: F401
from triagelake.functions import simhash as H
from triagelake.functions import text as T
from triagelake.functions.metrics import unit
from triagelake.operators import lexicon as L
from triagelake.operators import queue as Q
from triagelake.operators import similarity as S
from triagelake.operators import students as M
from triagelake.plans import source_queries as C
from triagelake.plans import stream_queries as P
from triagelake.streaming import jobs as J
from triagelake.streaming import lifecycle as LC


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_gram_of_a_simhash_becomes_a_row(spark):
    texts = [(1, ""), (2, "ab"), (3, "abc"), (4, None), (5, "наче😀 " * 50), (6, "x" * 999), (7, "first"), (7, "second, of the same id")]

    def want(*own):
        grams = Counter(t[i : i + 3] for t in own for i in range(max(1, len(t) - 2)))
        votes = [sum(n if int(md5(g.encode()).hexdigest()[:16], 16) >> b & 1 else -n for g, n in grams.items()) for b in range(64)]
        value = sum(1 << b for b, v in enumerate(votes) if v > 0)
        return value - (1 << 64) if value >= 1 << 63 else value

    df = H.simhash_md5(spark.createDataFrame(texts, "id long, text string"))
    assert {r.id: r.simhash for r in df.collect()} == {k: want(*(t for i, t in texts if i == k)) for k in (1, 2, 3, 5, 6, 7)}
    assert "Generate" not in plan_of(df)
    known, H.KNOWN_GRAMS = H.KNOWN_GRAMS, 2
    try:
        batches = [b for b in H.md5_votes(iter(spark.createDataFrame(texts, "id long, text string").toArrow().to_batches()))]
    finally:
        H.KNOWN_GRAMS = known
    assert sum(b.num_rows for b in batches) == 7


def test_letters_of_two_alphabets_are_counted_and_not_cut_out(spark):
    df = spark.createDataFrame([("Її ы",), ("Ё e",), ("ґ" * 9,), ("",), (None,)], "t string").select("t", T.guess_lang(F.col("t")).alias("guess"))
    assert [r.guess for r in df.collect()] == ["uk", "ru", "uk", "other", "other"]
    assert "regexp_replace" not in plan_of(df)


def test_uncomposed_signs_are_sought_by_one_range_first(spark):
    signs = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    found = {r.t for r in spark.createDataFrame([(c,) for c in signs], "t string").where(F.col("t").rlike(T.COMPOSED)).collect()}
    assert all(c in found for c in signs if unicodedata.normalize("NFKC", c) != c) and not found & set("az09éжї")
    assert T.COMPOSED.startswith("[^\\x00-\\x7F](")  # one range is asked first, the rest only of signs beyond it


def test_copies_and_channels_normalise_each_text_once(spark, data):
    assert plan_of(registry.QUERIES["grp07_copies_and_channels"](spark, data)).count("FileScan") == 0


def test_released_and_published_rows_need_no_call_of_python_a_key(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a call of Python for each key")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", never)
    rows = [(1, "report", 0.0), (2, "report", 0.0), (2, "screened", 1799.0), (3, "report", 60.0), (3, "screened", 1900.0), (4, "report", 3600.0), (5, "report", 5400.0)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, s double").select("event_id", "event_type", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    out = J.drain(J.release_stream(P.arrivals(spark, df, "ts", 3)), "event_id long, context string")
    assert sorted(r.event_id for r in out.collect()) == [1, 3]  # 4 has waited for its whole time, not longer
    pairs = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, 7, "a"), (4, 7, None), (5, 7, "a")], "event_id long, user_id long, event_type string")
    got = {tuple(r) for r in J.first_sightings(P.arrivals(spark, pairs, "event_id", 2)).collect()}
    assert got == {(None, "a", 1), (7, "a", 3), (7, None, 4)}


def test_age_indicators_of_chunks(spark):
    """Looked up chunk by chunk, with the tokens around numbers alone, a text has the labels that whole passes find; no term
    spans the end of one spelling and the start of the other."""
    ages = "en unit years old;en infant month* old;en number five;en number twenty two;en phrase i'm {n};en stop minutes;en grade {n}th grade;en word child;en word the pup*;ru word школьниц*;ru word конь;ru word новая школа".split(";")
    rows = [dict(zip(("lang", "kind", "value"), a.split(" ", 2)), number={"five": 5, "twenty two": 22}.get(a.split(" ", 2)[2])) for a in ages]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], "lang string, kind string, value string, number int")
    pieces = "5 12 five twenty two years old year month months old i’m i'm minutes 7th grade child children the pup puppy 1.5 0 07 999 1234 shkolnica школьница kон' ькон konb ь ъ ё - -- , a-5 5-year ².".split()
    rng, signs = random.Random(3), [" ", " ", " ", "\n", " - ", " ", "-", ""]
    texts = ["".join(rng.choice(pieces) + rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    silent = lambda c: F.regexp_replace(c, "[ьъ]", "")
    low = F.translate(F.lower("t"), "ё’", "е'")
    got = df.select("id", L.age_labels(F.col("t"), table).alias("got"), low.alias("low"), silent(T.unmask(F.col("t"))).alias("a"), silent(T.transliterate(low)).alias("b")).collect()
    of = L.indicators(L.age_terms(table))
    seen = set()
    for r in got:
        want = of.ages.find(r.low) | of.terms.find(r.a) | of.terms.find(r.b)
        assert set(r.got) == want, texts[r.id]
        seen |= want
    assert seen == set(L.LABELS)
    apart = spark.createDataFrame([("школа или новая",), ("новая школа",)], "t string").select("t", L.age_labels(F.col("t"), table).alias("a")).collect()
    assert {r.t: r.a for r in apart} == {"школа или новая": [], "новая школа": ["age term"]}


def test_tasks_of_a_fit_and_scores_of_a_batch_are_bounded(spark, data, monkeypatch):
    """A fit has no more tasks than cores; no matrix of all vectors with all prototypes is made; a length is found once."""
    fitted = {}
    monkeypatch.setattr(M.CrossValidator, "fit", lambda self, rows: fitted.setdefault("n", rows.rdd.getNumPartitions()))
    M.logistic_student(spark.range(500).repartition(50).select("id", F.array(F.col("id").cast("double")).alias("x"), (F.col("id") % 3 == 0).alias("y")))
    assert fitted["n"] <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(S, "MOST_SCORES", 7)
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)] + [(50, None), (51, [1.0]), (52, [2.0, None])], "id int, e array<double>").select("id", unit(F.col("e")).alias("v"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    got = {r.id: (r.pos, r.neg) for r in S.cosine_to_prototypes(rows.where("id <> 52"), rows.where("id < 5").select("v", (F.col("id") % 2 == 0).alias("positive"))).collect()}
    v = {i: np.array([i % 5, 1.0]) / np.hypot(i % 5, 1.0) for i in range(40)}
    assert got.pop(51) == (None, None)
    assert got == {i: tuple(pytest.approx(max(v[i] @ v[k] for k in own)) for own in ((0, 2, 4), (1, 3))) for i in v}


def test_candidates_normalise_and_search_each_text_once(spark, data):
    found = plan_of(C.candidate_rows(spark, data)[1])
    assert "sha2" not in found and "RLIKE" not in found and "ArrowEvalPython" not in found  # both sides read what is kept
    signs = "".join(map(chr, range(1, 0x3000)))
    df = spark.createDataFrame([(signs,), (" \t a -b\x0b_c ",), (None,)], "t string").select(T.normalize_text(F.col("t")).alias("new"), F.lower(F.coalesce(T.nfkc(F.col("t")), F.lit(""))).alias("low"))
    squeezed = T.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace("low", r"https?://\S+|www\.\S+", " "), rf"@{T.WORD}+", " "), r"[^\p{L}\p{N}_\s]+", " "))
    assert all(r.new == r.want for r in df.withColumn("want", squeezed).collect())
    assert not spark.createDataFrame([("a",)], "t string").select(T.exact_key(F.col("t")).alias("k")).schema["k"].nullable


def test_a_large_component_goes_out_bit_by_bit(spark):
    schema = spark.createDataFrame([], LC.OUT).toArrow().schema
    own = spark.createDataFrame([], LC.ROWS).toArrow().schema
    events = [{"kind": "2 event", "root": "r", "seq": n, "lane": "report", "url": "https://t.example/1", "note": f"n {n}", "t": n * 60.0} for n in range(1, 301)]
    batches = [pa.RecordBatch.from_pylist(events[k : k + 100], own) for k in (0, 100, 200)]
    out = list(LC.folded(1800.0, 18000.0, schema, most=50)(iter(batches)))
    assert [b.num_rows for b in out] == [200, 200, 200, 1]  # occurrences and results of a batch at a time, then the item
    assert out[-1].to_pylist()[0]["copies"] == 300 and out[-1].to_pylist()[0]["status"] == "PENDING"


def test_events_of_a_component_pass_by_columns(spark, monkeypatch):
    schema = spark.createDataFrame([], LC.OUT).toArrow().schema
    own = spark.createDataFrame([], LC.ROWS).toArrow().schema
    url = lambda n: f"https://t.example/{n % 3}"
    events = [{"lane": "report", "url": url(n), "note": " \u3000n "} if n % 4 < 2 else {"lane": "volunteer", "url": url(n), "priority": "high"} if n % 4 == 2 else {"lane": "screening", "target": f"public-{n - 3}", "outcome": "flagged"} for n in range(1, 2001)]
    rows = [{"kind": "2 event", "root": "r", "seq": n, "t": n * 60.0} | e for n, e in enumerate(events, 1)]
    calls = []
    for lane in ("report", "volunteer", "screening"):
        monkeypatch.setattr(LC.Component, lane, lambda self, e, of=getattr(LC.Component, lane): calls.append(e["seq"]) or of(self, e))
    batch = pa.RecordBatch.from_pylist(rows, own)
    out = [r for b in LC.folded(1800.0, 130000.0, schema)(iter([batch])) for r in b.to_pylist()]
    results = {r["seq"]: (r["result"], r["item"]) for r in out if r["kind"] == "result"}
    assert len(results) == 2000 and len(calls) < 20  # the others are copies, or name what is not there
    assert results[1] == ("created", "public-1") and results[2000 - 3] == ("joined", "vol-2" if url(1997) == url(2) else results[1997][1])
    notes = {r["seq"]: r["note"] for r in out if r["kind"] == "occurrence"}
    assert notes[1] == notes[1996] == "n" and notes[1998] is None and len(notes) == 1500
    items = [r for r in out if r["kind"] == "item"]
    assert sum(r["copies"] for r in items) == 1500 and {r["priority"] for r in items} == {"high"}


def test_components_of_leaves_pairs_and_chains(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(28)] + [("p1", "p2"), ("s0", "s9"), ("s0", "s8"), ("q", "q"), ("z", "b"), ("b", "a")]
    root = {x: x for p in pairs for x in p}
    for a, b in pairs * len(pairs):
        root[a] = root[b] = min(root[a], root[b])
    got = [tuple(r) for r in Q.label_components(spark.createDataFrame(pairs, "a string, b string")).collect()]
    assert len(got) == len(root) and dict(got) == root
    star = spark.createDataFrame([("hub", f"e{n}") for n in range(50)], "a string, b string")
    kept, rows, cut = [], [], Q.cut
    Q.cut = lambda df: kept.append(cut(df)) or kept[-1]
    try:
        rows = Q.label_components(star).collect()
    finally:
        Q.cut = cut
    assert len(rows) == 51 and {r.root for r in rows} == {"e0"}
    assert any(df.columns == ["u", "v"] and df.isEmpty() for df in kept)  # the rounds have nothing left to go over


def test_senders_share_states(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice([None, *range(40)]), rng.randrange(3_000)) for k in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {(r.user_id, r.event_id, r.accepted) for r in J.rate_limited(df).collect()}
    limited = J.rate_limited_stream(P.arrivals(spark, df, "ts", 3), groups=3)
    at = J.folder(spark)
    got = [tuple(r) for r in J.drain(limited, "user_id long, event_id long, accepted boolean", at).collect()]
    assert len(got) == 600 and set(got) == want and {u for u, _, ok in got if not ok} > {None}

    class State:
        exists, get = True, (["1", ""], [[0.0] * 5, [0.0]])

        def update(self, kept):
            self.kept = dict(zip(*kept))

    state = State()
    (out,) = J.limited_state((0,), iter([pd.DataFrame({"user_id": ["1", "", "2"], "event_id": [7, 8, 9], "t": [5.0, 4.0, 3.0]})]), state)
    assert dict(zip(out["event_id"], out["accepted"])) == {9: True, 8: True, 7: False}
    assert state.kept == {"1": [0.0] * 5, "": [0.0, 4.0], "2": [3.0]}
