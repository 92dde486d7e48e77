"""Streams that keep tables between batches: near groups, closing days, keyed upserts."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_oracles import in_sequence
from triagelake.operators import queue as Q
from triagelake.operators import similarity as S
from triagelake.plans import stream_queries as P
from triagelake.sources.snapshots import KeyedTable
from triagelake.streaming import jobs as J

PRINT = "seq long, pos long, kind string, value string"


def prints_of(seed, n=80):
    rng = random.Random(seed)
    signed = lambda v: str(v - (1 << 64) if v >= 1 << 63 else v)
    centres = [rng.getrandbits(64) for _ in range(8)]

    def near(most):
        v = rng.choice(centres)
        for _ in range(rng.randrange(most)):
            v ^= 1 << rng.randrange(64)
        return signed(v)

    out = []
    for seq in range(n):
        own = [(0, "text_sha", f"t{rng.randrange(60)}")] if rng.random() < 0.6 else []
        own += [(1, "text_simhash", near(12))] if rng.random() < 0.7 else []
        for m in range(rng.randrange(3)):
            own.append((2 + 2 * m, "media_sha", f"m{rng.randrange(70)}"))
            own.append((3 + 2 * m, "media_phash", near(7)))
        out += [(seq, *x) for x in own]
    return out


@pytest.mark.parametrize("seed,parts", [(1, 4), (2, 3)])
def test_incremental_groups_equal_a_pass_in_order_with_a_failing_batch_and_a_restart(spark, monkeypatch, seed, parts):
    rows = prints_of(seed)
    prints = S.cut(spark.createDataFrame(rows, PRINT))
    want = in_sequence(rows, Q.NEAR_KINDS) | {k: k for k in set(range(80)) - {r[0] for r in rows}}
    posts = P.arrivals(spark, spark.range(80).select(F.col("id").alias("seq")), "seq", parts)
    of = lambda batch: prints.join(batch.select("seq"), "seq", "left_semi")
    at, write, failed = J.folder(spark), J.write_batch, []

    def once(batch, number, path):
        write(batch, number, path)
        if number == 1 and path.endswith("index") and not failed:
            failed.append(number)
            raise RuntimeError("stopped")

    monkeypatch.setattr(J, "write_batch", once)
    with pytest.raises(Exception, match="stopped"):
        J.grouped(posts, of, Q.NEAR_KINDS, at)
    got = {r.seq: r.group for r in J.grouped(posts, of, Q.NEAR_KINDS, at).collect()}
    assert failed == [1] and got == want
    assert {r.seq: r.group for r in S.content_groups(prints, Q.NEAR_KINDS).collect()} == {k: v for k, v in want.items() if k in {r[0] for r in rows}}
    assert J.grouped(posts, of, Q.NEAR_KINDS, at).count() == 80


def test_media_decide_whatever_the_caption(spark):
    posts = spark.createDataFrame([(1, "a caption of five words"), (2, "some other words of five"), (3, "x"), (4, None)], "seq long, text string")
    media = spark.createDataFrame([(1, 0, "image", "s1", 5), (2, 0, "image", "s1", 5), (3, 0, "image", "s2", 5 ^ 3), (4, 0, "video", "s3", 5), (4, 1, "image", "s4", None)], "seq long, n int, kind string, sha string, phash long")
    prints = Q.fingerprints(posts, media)
    assert {r.seq: r.group for r in S.content_groups(prints, Q.NEAR_KINDS).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_days_close_and_late_rows_are_counted(spark, monkeypatch):
    monkeypatch.setattr(P, "FILES", 1)  # a few rows would not fill several files
    day = lambda d, h=1: f"2024-03-{d:02} {h:02}:00:00"
    # a batch judges lateness by the watermark with which the batch before it ran: that of the batches before that one
    rows = [(1, day(1), "a"), (2, day(1, 5), "a"), (3, day(2), "b"), (11, day(6), "a"), (21, day(1), "a"), (22, day(1), "a"), (23, day(2), "b"), (24, day(5), "a"), (31, day(6, 9), "a"), (32, day(3), "b"), (33, day(1), "a")]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    stream = P.arrivals(spark, df, "event_id", 4)
    counts, seen = J.daily_counts(stream, at := J.folder(spark))
    got = {(r.day.day, r.event_type): r.n for r in counts.collect()}
    assert got == {(1, "a"): 4, (2, "b"): 2, (6, "a"): 2, (5, "a"): 1} and tuple(seen.first()) == (11, 2)
    state = [r.state_rows for r in J.arrived(spark, at).rows().orderBy("batch").collect()]
    assert state[1] == 3 and state[-1] < 3  # closed days leave the state
    assert tuple(J.daily_counts(stream, at)[1].first()) == (11, 2)


def test_keyed_tables_upsert_delete_and_repeat(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v string", buckets=3)
    df = lambda rows: spark.createDataFrame(rows, "k long, v string, deleted boolean")
    now = lambda before=None: {r.k: r.v for r in table.rows(before).collect()}
    assert now() == {}
    table.upsert(df([(k, "a", False) for k in range(10)]), 0)
    for _ in range(2):
        table.upsert(df([(1, "b", False), (2, None, True), (11, "n", None)]), 1)
        assert now() == {k: "b" if k == 1 else "a" for k in range(10) if k != 2} | {11: "n"}
    assert now(1) == {k: "a" for k in range(10)}
    table.upsert(df([(k, "c", True) for k in [*range(10), 11]]), 2)
    assert now() == {}
    table.upsert(df([(2, "again", False)]), 3)
    assert now() == {2: "again"}


def test_the_nearest_are_sought_in_as_many_tasks_as_shuffles_have(spark):
    """Arrays are few bytes to read and much to compare: put together by size, one task compared them all."""
    rows = spark.range(200).select(F.col("id").alias("seq"), F.xxhash64("id").alias("a"))
    found = S.nearest_earlier(rows, rows.select(F.col("a").alias("b"), F.col("seq").alias("owner")), 9)
    plan = found._jdf.queryExecution().toString()
    assert f"{S.tasks(rows)}), REPARTITION_BY_NUM" in plan and plan.count("REPARTITION_BY_NUM") and S.tasks(rows) > 1
