"""Queries do the whole job: what a shortened form would miss, on small tables made for it."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_replay import bits, values
from triagelake import plans, registry  # noqa: F401
from triagelake.functions import text as T
from triagelake.functions.simhash import of_text
from triagelake.operators import queue as Q
from triagelake.operators import similarity as S
from triagelake.streaming import jobs as J


def tables(spark, at, **frames):
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, near copies and benchmark passages, under ids that say nothing about them."""
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(60))
    bases = [text() for _ in range(12)]
    texts = bases[:10] + [b + " end" for b in bases[:5]] + [bases[10] + " more"] + [bases[0], bases[1].upper()]
    rng.shuffle(texts)
    docs = [(1000 + 37 * k, t, "en", "src0", len(t)) for k, t in enumerate(texts)]
    bench = [(k, t) for k, t in enumerate(bases[9:])]
    d = tables(spark, tmp_path_factory.mktemp("corpus"), documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), benchmark=(bench, "item_id long, text string"))
    norm = {(k, r.id): of_text(r.n) for k, id in (("documents", "doc_id"), ("benchmark", "item_id")) for r in spark.read.parquet(f"{d}/{k}.parquet").select(F.col(id).alias("id"), T.normalize_text(F.col("text")).alias("n")).collect()}
    return d, {i: v for (k, i), v in norm.items() if k == "documents"}, {i: v for (k, i), v in norm.items() if k == "benchmark"}


def test_nearest_text_equals_all_pairs(spark, corpus):
    d, docs, _ = corpus
    near = {a: min(((bits(v, w), b) for b, w in docs.items() if a != b and bits(v, w) <= 9), default=None) for a, v in docs.items()}
    want = {(a, m[1], m[0]) for a, m in near.items() if m}
    assert len(want) >= 10
    assert {tuple(r) for r in registry.QUERIES["joi02_nearest_text"](spark, d).select("id", "reference_id", "distance").collect()} == want


def test_text_anti_leakage_equals_all_pairs(spark, corpus):
    d, docs, bench = corpus
    want = {a for a, v in docs.items() if all(bits(v, w) > 8 for w in bench.values())}
    assert 0 < len(want) < len(docs)
    assert {r.id for r in registry.QUERIES["joi03_text_anti_leakage"](spark, d).collect()} == want


def one_pass(items, limit):
    kept, want = [], {}
    for name, k, v in items:
        near = [(bits(v, w), j, other) for other, j, w in kept if bits(v, w) <= limit]
        if near:
            want[name] = min(near)[2]
        else:
            kept.append((name, k, v))
    return want


def test_greedy_dedupe_reads_texts(spark, corpus):
    d, docs, _ = corpus
    want = one_pass([(i, i, docs[i]) for i in sorted(docs)], 8)
    assert len(want) >= 5
    assert {r.id: r.kept_id for r in registry.QUERIES["joi04_greedy_dedupe"](spark, d).collect()} == want


def test_greedy_dedupe_by_batches_equals_one_pass(spark):
    items = [(f"i{k}", k, v) for k, v in enumerate(values(3, 70))]
    df = spark.createDataFrame(items, "id string, ord long, value long")
    assert {r.id: r.kept_id for r in S.greedy_dedupe(df, 3, batch=8).collect()} == one_pass(items, 3)


def test_narrow_values_meet_under_more_than_one_key():
    assert all(m & ((1 << 20) - 1) for m in S.block_masks(2, width=20))


def test_sightings_match_all_earlier_ones(spark):
    rng = random.Random(5)
    rows = [(k, f"u{rng.randrange(30)}", f"g{rng.randrange(12)}" if rng.random() < 0.4 else None) for k in range(90)]
    found = {k: [i for i, u, g in rows[:k] if u == rows[k][1] or (g and g == rows[k][2])] for k, _, _ in rows}
    got = {r.id: r.item for r in Q.match_earlier(spark.createDataFrame(rows, "id long, url string, group_key string")).collect()}
    assert got == {k: min(f) for k, f in found.items() if f}


def test_decisions_of_all_customers_are_inherited(spark, tmp_path):
    d = tables(spark, tmp_path, customer=([(k,) for k in (3, 300, 301, 302)], "c_custkey long"), events=([(k, u, "2024-01-01 00:00:00", "click") for k, u in enumerate((3, 300, 301, 302, 999))], "event_id long, user_id long, ts string, event_type string"))
    got = {r.event_id: (r.decision, r.note) for r in registry.QUERIES["str09_all_decisions"](spark, d).collect()}
    assert got == {0: ("YES", "click"), 1: ("YES", "click"), 2: ("RESTRICTED", None), 3: (None, "click"), 4: (None, "click")}


def test_texts_are_read_beyond_a_prefix(spark, tmp_path):
    head = "one boilerplate head that many documents have in common "
    rows = [(k, head + end, "en", "src0", 70) for k, end in enumerate(("alpha", "beta", "Beta!", "alpha"), 1)]
    d = tables(spark, tmp_path, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"), conversations=([(1, 0, "user", head + "alpha"), (1, 1, "user", head + "beta")], "conv_id long, turn long, role string, text string"))
    run = lambda name: registry.QUERIES[name](spark, d).collect()
    assert {(r.seq, r.owner) for r in run("joi01_whole_text_match")} == {(3, 2), (4, 1)}
    assert {r.value for r in run("lex06_all_terms")} == set(head.split()) | {"alpha", "beta"}
    assert {r.idx: r.text for r in run("joi14_whole_segment_texts")} == {0: head + "alpha", 1: f"{head}alpha {head}beta"}


def test_a_stream_orders_all_chunks_of_a_sender():
    class State:
        exists = False

        def update(self, held):
            self.held = held

    chunks = [pd.DataFrame({"user_id": 1, "event_id": ids, "t": [float(i) for i in ids]}) for ids in ([6, 7, 8, 9], [0, 1, 2, 3])]
    out = pd.concat(J.limited_state((1,), iter(chunks), State()))
    assert sorted(out["event_id"][out["accepted"]]) == [0, 1, 2, 3, 6]


def test_folds_go_on_over_arrow_batches(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(3), rng.randrange(20_000), rng.choice(["view", "click", "purchase", "error"])) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        limited = {r.event_id: r.accepted for r in J.rate_limited(df).collect()}
        lives = {r.user_id: r.status for r in J.life_cycle(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u in range(3):
        own = sorted((s, k) for k, v, s, _ in rows if v == u)
        assert [limited[k] for _, k in own] == J.accept([float(s) for s, _ in own], [])[0]
        first = next(e for _, v, _, e in rows if v == u)
        assert lives[u] == ("RESTRICTED" if first == "error" else "PENDING")
    assert len(limited) == 200 and len(lives) == 3
