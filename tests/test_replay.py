"""Operators whose result depends on order, against a plain sequential replay; streams against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import queue as Q
from triagelake.operators import sampling
from triagelake.operators import similarity as S
from triagelake.streaming import jobs as J


def values(seed, n, near=6):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        v = rng.choice(centres)
        for _ in range(rng.randrange(near)):
            v ^= 1 << rng.randrange(64)
        out.append(S.signed(v))
    return out


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("limit", [4, 8, 9])
def test_hamming_join_misses_nothing(spark, limit):
    v = sorted(set(values(limit, 120, limit + 2)))
    df = spark.createDataFrame([(x,) for x in v], "value long")
    got = {(r.a, r.b): r.distance for r in S.hamming_pairs(df, df, limit).collect()}
    assert got == {(a, b): bits(a, b) for a in v for b in v if bits(a, b) <= limit}


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedupe_equals_a_pass_in_order(spark, seed):
    items = [(f"i{k}", k, v) for k, v in enumerate(values(seed, 80))]
    kept, want = [], {}
    for name, _, v in items:
        near = [(bits(v, w), k, other) for k, (other, w) in enumerate(kept) if bits(v, w) <= 3]
        if near:
            want[name] = min(near)[2]
        else:
            kept.append((name, v))
    got = {r.id: r.kept_id for r in S.greedy_dedupe(spark.createDataFrame(items, "id string, ord long, value long"), 3).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_content_groups_equal_sequential_assignment(spark, seed):
    rng = random.Random(seed)
    near = values(seed, 60)
    rows = []
    for k in range(60):
        rows.append((k, 0, "text_sha", f"t{rng.randrange(40)}"))
        if rng.random() < 0.8:
            rows.append((k, 1, "text_simhash", str(near[k])))
    owner, group, want = {}, {}, {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for k in range(60):
        found = next((owner[(kind, v)] for _, _, kind, v in by[k] if (kind, v) in owner), None)
        if found is None:
            best = None
            for _, pos, kind, v in by[k]:
                for (other_kind, w), o in owner.items():
                    if kind == other_kind == "text_simhash" and bits(int(v), int(w)) <= 3:
                        key = (bits(int(v), int(w)), pos, f"{int(w) & (2**64 - 1):X}", o)
                        best = key if best is None or key < best else best
            found = best[3] if best else None
        want[k] = group[k] = k if found is None else group[found]
        for _, _, kind, v in by[k]:
            owner.setdefault((kind, v), k)
    df = spark.createDataFrame(rows, "seq long, pos int, kind string, value string")
    assert {r.seq: r.group for r in S.content_groups(df, {"text_simhash": 3}).collect()} == want


def test_queue_replay_equals_one_global_replay(spark):
    rng = random.Random(3)
    rows = [(k, f"https://www.s{rng.randrange(25)}.example/p?utm_x={k}", f"g{rng.randrange(15)}" if rng.random() < 0.5 else None) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, url string, group_key string")
    norm = {r.id: r.n for r in df.select("id", T.normalize_url(F.col("url")).alias("n")).collect()}
    link, key, item_key, want = {}, {}, {}, {}
    for k, _, g in rows:
        found = [i for i in (link.get(norm[k]), key.get(g) if g else None) if i is not None]
        item = min(found) if found else k
        if not found:
            link[norm[k]] = item
        if g and item not in item_key:
            item_key[item] = g
            key.setdefault(g, item)
        want[k] = item
    assert {r.id: r.item for r in Q.replay(df).collect()} == want


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """The small events table in three files by time, so that a stream has three micro-batches."""
    at = str(tmp_path_factory.mktemp("events") / "events")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(at)
    return at


def test_streams_equal_their_batch_twins(spark, event_files):
    batch = spark.read.parquet(event_files)
    stream = lambda: J.event_stream(spark, event_files)
    firsts = {(r.user_id, r.event_type) for r in J.first_sightings(stream()).collect()}
    assert len(J.first_sightings(stream()).collect()) == len(firsts) == batch.select("user_id", "event_type").distinct().count()
    published = [r.external_id for r in J.published(stream()).collect()]
    assert len(published) == len(set(published)) == batch.select(F.expr("event_id - event_id % 2")).distinct().count()
    by_value = lambda rows: rows.select("seq", F.lit(0).alias("pos"), F.lit("value").alias("kind"), F.col("value").cast("string").alias("value"))
    grouped = J.grouped(stream().withColumnRenamed("event_id", "seq"), by_value, {"near": 4})
    assert grouped.count() == batch.count()
    want = {(r.day, r.event_type): r.n for r in batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    counts, seen = J.daily_counts(stream())  # each file has all days, so the last ones bring late rows
    counts, (arrived, late) = {(r.day, r.event_type): r.n for r in counts.collect()}, seen.first()
    assert arrived == batch.count() and late == arrived - sum(counts.values()) and all(n <= want[k] for k, n in counts.items())
    limited = J.drain(J.rate_limited_stream(stream()), "user_id long, event_id long, accepted boolean")
    assert limited.count() == batch.count()


def test_rate_limit_counts_accepted_rows_only():
    taken, held = J.accept([0, 1, 2, 601, 602, 603], [], limit=2, window=600)
    assert taken == [True, True, False, True, True, False] and held == [601, 602]
    assert J.accept([0, 600], [], 1, 600)[0] == [True, False] and J.accept([0, 0], [], 0)[0] == [True, True]


def test_segments_of_a_video():
    import pandas as pd

    cut = lambda cuts, duration: [(s, e) for s, e in sampling.segments_of(pd.DataFrame({"video": 1, "duration": duration, "cut": cuts}))[["start_s", "end_s"]].itertuples(index=False)]
    assert cut([None], 47.0) == [(0.0, 15.0), (15.0, 30.0), (30.0, 47.0)]
    assert cut([3.0, 8.0, 58.0], 60.0) == [(0.0, 8.0), (8.0, 8.0 + 52 / 3), (8.0 + 52 / 3, 8.0 + 104 / 3), (8.0 + 104 / 3, 60.0)]


@pytest.mark.parametrize("limit,few,side", [(9, 1 << 13, 1 << 17), (9, 1, 7), (4, 1 << 13, 5), (4, 4, 1 << 17)])
def test_nearest_earlier_values_equal_brute_force(spark, monkeypatch, limit, few, side):
    """One row for each row that has something near: families of near copies make no list of pairs."""
    for name, value in (("FEW", few), ("SIDE", side), ("AT_ONCE", 50), ("DEALT_BITS", 2)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(3)]
    near = lambda: rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8)))
    owners = {near(): seq for seq in range(90)}
    rows = [(seq, v) for seq in range(0, 120, 2) for v in (near(), rng.getrandbits(64))]
    want = {}
    for seq, a in rows:
        found = [((a ^ b).bit_count(), b) for b, owner in owners.items() if owner < seq and (a ^ b).bit_count() <= limit]
        if found:
            want[seq, S.signed(a)] = (min(found)[0], S.signed(min(found)[1]))
    assert len(want) > 30
    df = spark.createDataFrame([(s, S.signed(a)) for s, a in rows], "seq long, a long")
    known = spark.createDataFrame([(S.signed(b), o) for b, o in owners.items()], "b long, owner long")
    got = S.nearest_earlier(df, known, limit).collect()
    assert {(r.seq, r.a): (r.distance, r.b) for r in got} == want and len(got) == len(want)
