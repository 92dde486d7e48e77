"""Reports, resampled speed, agreement, judging once, missing links, timelines, choice of students: small exact cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import evaluation as E
from triagelake.operators import intervals as I
from triagelake.operators import lexicon as L
from triagelake.operators import queue as Q
from triagelake.operators import rules as R
from triagelake.operators import students as M
from triagelake.sources import sinks as K


@pytest.mark.parametrize("b,c", [(0, 0), (0, 1), (3, 9), (9, 3), (50, 50), (400, 460)])
def test_mcnemar_tail_equals_the_whole_sum(b, c):
    n = b + c
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    assert E.two_sided(b, c) == pytest.approx(want, rel=1e-9)


def test_mcnemar_tail_of_many_pairs():
    """With half a billion pairs the normal approximation is near, and few terms are taken."""
    b, c = 250_000_000, 250_030_000
    z = (c - b - 1) / math.sqrt(b + c)
    assert E.two_sided(b, c) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_speed_up_interval_equals_one_by_resampled_rows(spark):
    sent = np.arange(500) % 5 == 0
    row = E.speed_up(spark.createDataFrame([(bool(s),) for s in sent], "s boolean"), F.col("s"), 0.1, 2.0).first()
    rng = np.random.default_rng(1)
    replicas = [2.0 / (0.1 + rng.choice(sent, 500).mean() * 2.0) for _ in range(2000)]
    assert (row.n, row.sent) == (500, 100) and row.speed_up == pytest.approx(4.0)
    assert [row.low, row.high] == pytest.approx(list(np.percentile(replicas, [2.5, 97.5])), rel=0.02)
    none = E.speed_up(spark.createDataFrame([], "s boolean"), F.col("s"), 0.1, 2.0).first()
    assert (none.n, none.speed_up, none.low, none.high) == (0, None, None, None)


def test_throughput_without_rows_or_tokens(spark):
    rows = spark.createDataFrame([(2.0, 10), (4.0, None)], "s double, t int")
    got = E.throughput(rows, F.col("s"), 60.0, {"prompt": F.col("t")}).first().asDict()
    assert got == {"n": 2, "per_minute": 2.0, "per_10_min": 20.0, "mean_latency": 3.0, "max_latency": 4.0, "prompt_mean": 5.0}
    none = E.throughput(rows.where("s > 9"), F.col("s"), 0, {"prompt": F.col("t")}).first()
    assert (none.n, none.per_minute, none.mean_latency, none.prompt_mean) == (0, None, None, None)


def test_agreement_counts_only_what_is_specified(spark):
    got = "struct<route string, exclusion string, acts array<string>, confidence_a double, confidence_b double>"
    want = "struct<flag boolean, route string, exclusion string, acts array<string>, low_confidence boolean>"
    rows = [
        (("priority_review", None, ["x", "y"], 0.9, 0.6), (True, "priority_review", "B2-1", ["x"], True)),
        (("not_flagged", "B2-1", [], 0.9, 0.9), (True, None, "B2-1", ["x"], False)),
        (("not_flagged", "B2-1", None, None, None), (None, None, None, None, None)),
    ]
    found = {r.field: (r.agree, r.n) for r in R.agreement(spark.createDataFrame(rows, f"got {got}, expected {want}")).collect()}
    assert found == {"flag": (1, 2), "route": (1, 1), "exclusion": (1, 2), "acts": (1, 2), "low_confidence": (1, 1)}


def test_groups_are_judged_once_and_again_after_an_error(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, None), (7, "d"), (8, "d")], "seq long, key string")
    detections = spark.createDataFrame([(1, "judge_error"), (2, "not_flagged"), (3, "not_flagged"), (4, "judge_error"), (9, "judge_error"), (7, None)], "seq long, route string")
    got = sorted(Q.to_judge(posts, detections).collect())
    assert [tuple(r) for r in got] == [("b", 3, True), ("c", 5, False), ("d", 7, False)]


def test_links_are_filled_and_missing_reports_found_once(spark):
    links = spark.createDataFrame([("public-1", "https://a.example/x", None), ("l-2", "https://b.example/y?utm_a=1", None), ("l-3", "https://c.example/z", "https://c.example/z")], "id string, url string, norm string")
    seen = spark.createDataFrame([("l-2",), ("l-2",)], "id string")
    filled = Q.filled_links(links, seen)
    assert {r.id: (r.norm, r.first_seen) for r in filled.collect()} == {"public-1": ("https://a.example/x", True), "l-2": ("https://b.example/y", False), "l-3": ("https://c.example/z", False)}
    reports = [(1, "https://q.example"), (4, "https://www.c.example/z/"), (6, "https://n.example/k"), (5, "https://n.example/k?utm_a=2"), (7, None), (8, None)]
    got = Q.missing_reports(spark.createDataFrame(reports, "report_id long, url string"), filled)
    assert sorted(r.report_id for r in got.collect()) == [5, 7, 8]


def test_pages_of_the_reviewed_tab(spark):
    rows = spark.createDataFrame([(n, n % 3) for n in range(7)], "first_id long, last_ts long")
    assert [r.first_id for r in Q.reviewed_page(rows, 1, 3).collect()] == [5, 1, 4]
    assert tuple(Q.page_count(rows, 3).first()) == (7, 3) and tuple(Q.page_count(rows.where("first_id < 0"), 3).first()) == (0, 1)


def test_timeline_marks_one_segment_and_what_passages_touch(spark):
    segments = [("v", 0, 0.4, True, 0.0, 10.0), ("v", 1, 0.9, True, 10.0, 20.0), ("v", 2, 0.9, True, 20.0, 30.0), ("w", 0, None, True, 0.0, 5.0), ("w", 1, 0.99, False, 5.0, 9.0)]
    rows = spark.createDataFrame(segments, "video string, idx int, p double, positive boolean, start_s double, end_s double")
    passages = spark.createDataFrame([("v", 20.0, 21.0), ("v", 25.0, 700.0), ("x", 0.0, 9.0)], "video string, start_s double, end_s double")
    got = {(r.video, r.idx): (r.flagged, r.in_passage) for r in I.timeline(rows, passages).collect()}
    assert got == {("v", 0): (False, False), ("v", 1): (True, False), ("v", 2): (False, True), ("w", 0): (False, False), ("w", 1): (False, False)}


def test_age_and_hit_have_to_share_a_sentence(spark):
    texts = ["Those morons are 9 years old.", "Nothing here. Those morons. A boy, 9 years old.", "9 years old!\nmoron", "moron aged nothing", None, ""]
    got = spark.createDataFrame(enumerate(texts), "n int, text string").select("n", L.age_beside(F.col("text")).alias("b")).collect()
    assert [r.b for r in sorted(got)] == [True, False, False, False, False, False]


def test_candidates_with_an_age_indicator_show_no_text(spark):
    rows = [(1, "k", "c1", "east", "en", "2024-01", "abc", True), (2, "k", "c2", None, "en", "2024-01", "abc", False), (3, "m", "c2", None, None, None, None, False)]
    corpus = spark.createDataFrame(rows, "seq long, dup_key string, channel string, side string, lang string, month string, text string, minor boolean")
    found = K.candidate_rows(corpus, F.when(F.col("text").isNotNull(), "weak"), F.array(F.lit("p1")), F.col("minor"))
    assert {r.seq: (r.text, r.copies, r.channels) for r in found.collect()} == {1: (None, 2, 2), 2: ("abc", 2, 2)}
    report = {(r.section, r.name): (r.n, r.total) for r in K.candidate_report(corpus, found, wide=2).collect()}
    assert report[("all", "all")] == (2, 3) and report[("side", "unknown")] == (1, 2) and ("lang", "unknown") not in report
    assert report[("texts", "wide")] == (1, None) and report[("minor", "anywhere")] == (1, None) and report[("pattern", "p1")] == (2, None)


def test_confusion_list_has_reference_by_prediction(spark):
    rows = spark.createDataFrame([("t", 1, 2, 3, 4)], "part string, tp long, fp long, fn long, tn long")
    one, two = K.confusion_list({"a": rows, "b": rows.drop("part")}, "part").orderBy("id").collect()
    assert (one.id, one["values"], one.n_pos, one.n_neg) == ("a|t", [[1, 3], [2, 4]], 4, 6) and two.id == "b|all"


def test_choice_of_students(spark):
    rows = [("t", "logistic", "weight", 0.8, 0.85), ("i", "logistic", "weight", 0.8, 0.95), ("it", "perceptron", "weight", 0.7, 1.0), ("i", "perceptron", "weight", None, None)]
    found = spark.createDataFrame(rows, "kind string, model string, balance string, auroc double, recall double")
    best = M.best_candidate(found, 0.9).first()
    assert (best.kind, best.stop) == ("i", False) and M.best_candidate(found, 0.96).first().stop


def test_students_on_the_better_part_win(spark):
    rng = np.random.default_rng(3)
    y = rng.random(400) < 0.4
    rows = [(n, [float(v) for v in rng.normal(0, 1, 3)], [float(rng.normal(2.5 * label, 1)), float(rng.normal())], bool(label)) for n, label in enumerate(y)]
    frame = M.feature_sets(spark.createDataFrame(rows, "id long, text array<double>, image array<double>, y boolean"), "text", "image")
    found = M.trained_candidates(frame, F.col("id") % 4 == 0, ("t", "i"), 0.5, rounds=10)
    scored = {(r.kind, r.model, r.balance): r.auroc for r in found.collect()}
    assert len(scored) == 8 and max(v for k, v in scored.items() if k[0] == "t") < 0.75 < min(v for k, v in scored.items() if k[0] == "i")
    assert M.best_candidate(found, 0.5).first().kind == "i"
