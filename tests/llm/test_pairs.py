"""Joins, searches and shards against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from triagelake.llm import common, sharding, shingles, topk, vectors


def roots_of(nodes, links):
    above = {n: n for n in nodes}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def expected_join(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    items = list(sets.items())
    links = [(i, j) for k, (i, a) in enumerate(items) for j, b in items[k + 1 :] if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    roots = roots_of(sets, links)
    return sorted((i, len(s), roots[i]) for i, s in items)


def families(seed, size=45, words=60, edits=4):
    rng = random.Random(seed)
    docs, n = [], 0
    passage = [f"p{i}" for i in range(30)]
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            docs.append((n, " ".join(copy)))
            n += 1
    for k in range(40):
        docs.append((n, " ".join([*passage, *(f"u{k}v{i}" for i in range(rng.randrange(40)))])))
        n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One TWO"), (n + 4, "one two three"), (n + 5, " \t "), (n + 6, "a b c d e"), (n + 7, "a b c d e f"), (n + 8, "w " * 3000), (n + 9, "w " * 2000)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_is_exact_on_families_of_near_copies(spark, monkeypatch, seed):
    monkeypatch.setattr(shingles, "BLOCK", 16)
    docs = families(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in shingles.join(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == expected_join(docs)


def test_jaccard_join_on_odd_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (None, "a b c d e f g", "x"), (3, "a b c d e f g", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long_name string".replace("n long_name", "root"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in shingles.join(df).collect())
    assert got == [(False, 1, 3, 1), (False, 1, 3, 1), (False, 3, 3, 1), (True, 0, 3, None)]
    kept = shingles.representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]
    assert shingles.join(df.limit(0)).collect() == []


def test_sketch_distance_never_exceeds_the_symmetric_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 2**63, int(rng.integers(0, 90))).astype(np.uint64)]))
        if len(b):
            assert shingles.distance(shingles.parity(a), shingles.parity(b)) <= len(np.setxor1d(a, b))
            assert shingles.sketch_distances([shingles.parity(a)], [shingles.parity(b)])[0, 0] == shingles.distance(shingles.parity(a), shingles.parity(b))


@pytest.mark.parametrize("block", [40, 6144])
def test_near_duplicate_vectors_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [*rng.normal(size=(150, 8))]
    for k in range(4):
        rows += [rows[k] + rng.normal(size=8) * 0.1 for _ in range(25)]
    rows += [rows[0] * 3, rows[0], rows[5] * -1]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [float("nan")]), (903, [1.0] * 7 + [None]), (904, [1.0, 0.0]), (905, [2.0, 0.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")
    unit = np.array([v for _, v in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    roots = roots_of(range(len(data)), np.argwhere(linked).tolist())
    want = {i: (int(linked[i].sum()), roots[i], roots[i] == i) for i in range(len(data))}
    want |= {i: (0, i, True) for i in (900, 901, 902, 903)} | {904: (1, 904, True), 905: (1, 904, False)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == want
    assert vectors.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("sent", [400, 8 * 30, 10**9])
def test_near_duplicate_vectors_meet_in_rounds(spark, monkeypatch, sent):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "SENT", sent)  # 50 or 30 vectors a round, fewer than the largest cell has
    rng = np.random.default_rng(5)
    rows = [*rng.normal(size=(120, 8))]
    rows += [rows[k % 3] + rng.normal(size=8) * 0.1 for k in range(90)] + [rows[7]] * 12
    unit = np.array(rows, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)] + [(5, None), (7, [99.0] * 8)], "vec_id long, embedding array<float>")
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    roots = roots_of(range(len(rows)), np.argwhere(linked).tolist())
    want = {i: (int(linked[i].sum()), roots[i]) for i in range(len(rows))}
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2 and {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_rounds_of_cells_take_each_vector_once(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate([0] * 3 + [2] * 50 + [3] * 4 + [4] * 5 + [7] * 6 + [9] * 20)], "cell int, id long")
    found = [{r.id for r in df.where(w).collect()} for w in vectors.rounds([(0, 3), (2, 50), (3, 4), (4, 5), (7, 6), (9, 20)], 10)]
    assert sum(map(len, found)) == 88 == len(set().union(*found)) and len(found) == 10 and max(map(len, found)) < 20


def test_near_duplicate_vectors_are_not_copied(spark, monkeypatch):
    """Vectors without structure, of which each cell may hold partners of nearly all others."""
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(2000)], "vec_id long, embedding array<double>")
    held, cut = [], vectors.cut
    monkeypatch.setattr(vectors, "cut", lambda rows: held.append(cut(rows)) or held[-1])
    assert vectors.near_duplicates(df).count() == 2000
    with_vectors = [h for h in held if "vector" in h.columns]
    assert [h.count() for h in with_vectors] == [2000]


def test_top_k_is_exact_with_ties_nulls_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows + [(7, rows[7][1]), (500, None), (501, [1, None]), (None, [1] * 6), (502, [])], "id long, terms array<long>")
    queries = df.where("id % 20 = 0")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(queries, df, 5, block=32).collect())
    vectors_of = dict([*rows, (502, [0] * 6)])
    want = []
    for q in range(0, 200, 20):
        scores = sorted((-int(np.dot(vectors_of[q], v)), i) for i, v in vectors_of.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    # the empty vector scores 0 with everything, itself a query by id
    assert [g for g in got if g[0] != 500] == sorted(want)
    assert topk.top_k(queries.limit(0), df).collect() == []


def test_top_k_is_the_same_in_several_rounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-2, 3, 5).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, terms array<long>")
    found = lambda: sorted(map(tuple, topk.top_k(df.where("id % 10 = 0"), df, 7, block=16).collect()))
    whole = found()
    monkeypatch.setattr(topk, "CELLS", 20)
    assert found() == whole and len(whole) == 15 * 7


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 40)}


def test_hilbert_index_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        at = sharding.hilbert_index(grid, bits)
        assert sorted(at) == list(range(len(grid)))
        walk = grid[np.argsort(at)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_gapless_and_follow_the_curve(spark):
    rows = [(i, "t" * (i % 50), "l%d" % (i % 3), None if i % 11 == 0 else "s%d" % (i % 7), 1) for i in range(500)] + [(3, None, None, "s1", 2), (None, "x", "l1", "s1", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, curve int")
    got = sharding.shards(df).collect()
    counts = defaultdict(list)
    for r in got:
        counts[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(counts) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1 and len(got) == len(rows)
    in_order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in in_order] == sorted(r.curve for r in got)
    assert sharding.shards(df.limit(0)).collect() == []


def test_shards_prune_by_any_dimension(spark, tmp_path):
    rows = [(2**62 * (-1) ** i + i, "t" * (1 + i % 200), "l%d" % (i % 4), "s%d" % (i * 7 % 12)) for i in range(2000)] + [(5, None, None, None), (5, "t", None, "s1")]
    dealt = sharding.dealt(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    sharding.write(dealt, f"{tmp_path}/shards")
    sharding.write(dealt, f"{tmp_path}/shards")
    stored = spark.read.parquet(f"{tmp_path}/shards")
    assert stored.count() == len(rows)
    ranges = {r.shard: r for r in sharding.ranges(stored).collect()}
    assert len(ranges) == 24
    for column, value in (("lang", "l2"), ("source", "s3"), ("size", 9)):
        own = {r.shard for r in stored.where(f"{column} = '{value}'").select("shard").distinct().collect()}
        meets = {s for s, r in ranges.items() if r[f"min_{column}"] is not None and r[f"min_{column}"] <= (value if column != "size" else 9) <= r[f"max_{column}"]}
        assert own <= meets and len(meets) < 24
    assert sum(r.null_lang for r in ranges.values()) >= 1
