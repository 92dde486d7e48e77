"""Streams that are stopped and run again, and joins and curves by ranges, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import evaluation as E
from triagelake.operators import ranges
from triagelake.operators import similarity as S
from triagelake.operators import students as M
from triagelake.plans import stream_queries as P
from triagelake.streaming import jobs as J


def arriving(spark, seed=1, n=200):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(9), rng.choice(["view", "click", "error"]), i * 7.5, float(rng.randrange(30))) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s double, value double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    return rows, df


def test_a_batch_that_is_run_again_repeats_nothing(spark, monkeypatch):
    rows, df = arriving(spark)
    want = {}
    for i, user, kind, *_ in rows:
        want.setdefault((user, kind), i)
    write, failed = J.write_batch, []

    def broken(batch, number, path):
        write(batch, number, path)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(J, "write_batch", broken)
    at, stream = J.folder(spark), P.arrivals(spark, df, "event_id", 4)
    with pytest.raises(Exception, match="lost after writing"):
        J.first_sightings(stream, at)
    assert failed == [2]
    got = sorted(tuple(r) for r in J.first_sightings(stream, at).collect())
    assert got == sorted((*k, i) for k, i in want.items())
    assert J.first_sightings(stream, at).count() == len(want)
    assert J.published(P.arrivals(spark, df.limit(0), "event_id")).collect() == []


def test_stream_and_batch_limits_agree_over_several_batches(spark):
    rows, df = arriving(spark, 2)
    batch = {(r.event_id, r.accepted) for r in J.rate_limited(df).collect()}
    stream = J.drain(J.rate_limited_stream(P.arrivals(spark, df, "ts", 5)), "user_id long, event_id long, accepted boolean")
    assert {(r.event_id, r.accepted) for r in stream.collect()} == batch and any(not a for _, a in batch)


def test_hamming_pairs_with_hot_keys_and_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for v in base for _ in range(60)} | {rng.getrandbits(20) for _ in range(40)}
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "value long")
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(a, b, apart(a, b)) for a in values for b in values if apart(a, b) <= 4}
    for hot in (4_000_000, 500):
        monkeypatch.setattr(S, "HOT_PAIRS", hot)
        assert {tuple(r) for r in S.hamming_pairs(df, df, 4).collect()} == want
    assert S.hamming_pairs(df, df.limit(0), 4).collect() == []


def test_prototypes_in_several_matrices_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_PROTOTYPES", 4)
    rng = np.random.default_rng(1)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(size=(n, 5))]
    vectors, known = unit(30), unit(11)
    rows = [(i, v) for i, v in enumerate(vectors)] + [(50, [1.0, 0.0])]
    labelled = [(v, k % 3 == 0) for k, v in enumerate(known)] + [(None, True)]
    got = {r.id: (r.pos, r.neg) for r in S.cosine_to_prototypes(spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(labelled, "v array<double>, positive boolean")).collect()}
    assert got.pop(50) == (None, None)
    score = np.array(vectors) @ np.array(known).T
    own = np.arange(11) % 3 == 0
    assert {i: tuple(np.round(x, 9)) for i, x in got.items()} == {i: (round(score[i, own].max(), 9), round(score[i, ~own].max(), 9)) for i in range(30)}


def test_running_sums_places_and_curves_by_ranges(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(40) / 40, rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id long, score double, y boolean")
    got = {r.item_id: (r.place, r.before_item_id) for r in ranges.running_sums(ranges.ranked(df, F.col("score"), -F.col("item_id")), [F.col("place")], "item_id").collect()}
    order, total, want = sorted(rows, key=lambda r: (r[1], -r[0])), 0, {}
    for k, r in enumerate(order):
        want[r[0]] = (k + 1, total)
        total += r[0]
    assert got == want
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    area = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert E.auroc(df).first().auroc == pytest.approx(area)
    for r in E.roc(df).collect():
        assert (r.tpr, r.fpr) == pytest.approx((sum(s >= r.score for s in pos) / len(pos), sum(s >= r.score for s in neg) / len(neg)))
    assert ranges.ranked(df.limit(0), F.col("score")).collect() == []


def test_resampled_interval_equals_plain_resampling(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(25) / 25, rng.random() < 0.3) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id long, score double, y boolean")
    areas, scores = np.zeros(300), sorted({s for _, s, _ in rows})
    won, pos, neg = np.zeros(300), np.zeros(300), np.zeros(300)
    for s in scores:
        p, n = E.resampled(sum(y for _, t, y in rows if t == s), sum(not y for _, t, y in rows if t == s), s, 300)
        won, pos, neg = won + p * (neg + n / 2), pos + p, neg + n
    areas = won / (pos * neg)
    for dealt in (df, df.repartition(7)):
        got = E.bootstrap_auroc(dealt, 300).first()
        assert (got.low, got.high, got.replicas) == (pytest.approx(np.quantile(areas, 0.025)), pytest.approx(np.quantile(areas, 0.975)), 300)
    plain = E.auroc(df).first().auroc
    assert got.low < plain < got.high


def test_balanced_rows(spark):
    df = spark.createDataFrame([(i, i % 10 == 0) for i in range(3000)], "id long, y boolean")
    got = {r.y: r["count"] for r in M.balanced(df).groupBy("y").count().collect()}
    assert got[True] == 300 and 240 < got[False] < 360
