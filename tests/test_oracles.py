"""Every query that SQL can express equals its twin; the others return rows with a stable schema."""

import duckdb
import pytest

from tests.compare import TABLES, assert_same
from triagelake import plans, registry  # noqa: F401


@pytest.fixture(scope="module")
def db(request):
    from tests.conftest import DATA

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, data, db, name):
    assert_same(registry.QUERIES[name](spark, data), db.sql(registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"grp03_content_groups"}))
def test_query_without_sql_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def in_sequence(prints, near_kinds):
    """Groups of (seq, pos, kind, value) rows by one pass in order."""
    owned, want, rows = {}, {}, {}
    for seq, pos, kind, value in prints:
        rows.setdefault(seq, []).append((pos, kind, value))
    for seq in sorted(rows):
        own = sorted(rows[seq])
        group = next((owned[k, v] for _, k, v in own if (k, v) in owned), None)
        if group is None:
            near = [((int(v) ^ int(w) & (1 << 64) - 1) & (1 << 64) - 1, pos, int(w) & (1 << 64) - 1, g, near_kinds[k]) for pos, k, v in own if k in near_kinds for (kind, w), g in owned.items() if kind == k]
            near = [(x.bit_count(), *rest, g) for x, *rest, g, limit in near if x.bit_count() <= limit]
            group = min(near)[-1] if near else seq
        want[seq] = group
        for _, k, v in own:
            owned.setdefault((k, v), group)
    return want


def test_content_groups_equal_a_sequential_pass(spark, data):
    from triagelake.operators import queue as Q
    from triagelake.plans import queue_queries as P
    from triagelake.plans.standin import view

    prints = [tuple(r) for r in Q.fingerprints(view(spark, data, "posts"), P.media(spark, data)).collect()]
    assert {k for _, _, k, _ in prints} == {"text_sha", "text_simhash", "media_sha", "media_phash"}
    want = in_sequence(prints, Q.NEAR_KINDS)
    got = {r.seq: r.group for r in registry.QUERIES["grp03_content_groups"](spark, data).collect()}
    assert got == want
