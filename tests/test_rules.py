"""Text functions, rules and safety invariants on rows written by hand."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import lexicon as L
from triagelake.operators import rules as R
from triagelake.operators import terms as M
from triagelake.plans.metric_queries import assessed
from triagelake.plans.standin import view
from triagelake.sources import readers, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(T.normalize_text(F.lit("Look @you_1:  HTTPS://a.b/c  Über-Maß!"))) == "look über maß"
    assert v(T.normalize_text(F.lit("ﬁne １２"), compose=True)) == "fine 12"
    assert v(T.unmask(F.lit("cat пpивeт"))) == "cat привет"
    assert v(T.guess_lang(F.lit("їжак ы"))) == "ru" and v(T.guess_lang(F.lit("їі ы"))) == "uk" and v(T.guess_lang(F.lit("12"))) == "other"
    assert v(T.normalize_url(F.lit("http://www.Twitter.com/a/?utm_source=x&b=2&a=1#top"))) == "https://x.com/a?a=1&b=2"
    assert v(T.normalize_url(F.lit("https://m.example.org"))) == "https://example.org/"
    assert v(T.platform_of(F.lit("https://mobile.facebook.com/x"))) == "Facebook"
    assert [tuple(p) for p in v(T.time_pairs(F.lit("1:05 - 01:00:10, 2:00")))] == [(65, 3610)]
    assert v(T.transliterate(F.lit("shchuka moya"))) == "щука моя"


def test_term_patterns_and_proximity(spark):
    hit = lambda text, term: value(spark, L.term_hits(F.lit(text), {"t": term})) == ["t"]
    assert hit("two kids", "kid") and not hit("kidnap", "kid") and hit("minorities", "minorit*") and not hit("xminority", "minorit*")
    near = lambda text: value(spark, L.near(F.lit(text), "^a$", "^b$", 2))
    assert near("a x b") and near("b a") and not near("a x y b") and not near("")
    assert value(spark, L.age_labels(F.lit("she is 15 years old, 3rd grade"))) == ["stated age", "school grade"]
    assert value(spark, L.age_labels(F.lit("18 years old"))) == []


def test_restricted_rows_carry_no_content(spark, data):
    final = R.finalize(assessed(spark, data))
    assert final.where("restricted AND (content IS NOT NULL OR relation IS NOT NULL OR stance IS NOT NULL)").isEmpty()
    assert final.where("restricted AND (flagged OR final_lead OR priority <> 'urgent')").isEmpty()
    assert not final.where("restricted").isEmpty()
    assert sinks.payloads(view(spark, data, "sightings")).join(view(spark, data, "sightings").where("restricted").selectExpr("concat('s', id) AS external_id"), "external_id", "left_semi").isEmpty()


def test_a_restricted_row_keeps_what_describes_no_content(spark, tmp_path):
    """Every column that a detection may have."""
    scores = ("sexual_violence", "sexual_harassment", "hate", "misogyny", "other_violence")
    full = {"modality": "video", "summary": "s", "filter": {"score": 0.5, "passed": True}, "rule_notes": ["a", "b"], "error": None, "transcript": "t"}
    row = {"id": 1, "created_at": "2024-01-01", "source": "x", "url": "u", "modality": "video", "media_hash": "h", "filter_score": 0.4, "filter_passed": True, **dict.fromkeys(scores, 80), "sexual": True, "category": "c", "primary_relation": "SV-REL-2", "route": "restricted_escalation", "priority": "urgent", "flagged_start_s": 3.0, "flagged_end_s": 4.5, "summary": "s", "explicit_alert": False, "possible_minor": True, "restricted": False, "model": "m", "prompt_version": "v", "region": "r", "latency_ms": 5, "full_result_json": json.dumps(full), "anything_new": "n"}
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items())
    rows = spark.createDataFrame([tuple(row.values()), tuple((row | {"id": 2, "possible_minor": False}).values()), tuple((row | {"id": 3, "full_result_json": "no object"}).values())], schema)
    content = {*scores, "sexual", "category", "primary_relation", "summary", "flagged_start_s", "flagged_end_s", "anything_new"}
    assert {r.id for r in R.violations(rows).collect()} == {1, 3}
    sinks.write_detections(rows, str(tmp_path / "d"), set(row))
    got = {r.id: r.asDict() for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    for i in (1, 3):
        assert got[i]["restricted"] and {k for k in row if got[i][k] is None} == content
    assert json.loads(got[1]["full_result_json"]) == {"modality": "video", "filter": full["filter"], "rule_notes": ["a", "b"], "error": None, "restricted": True}
    assert json.loads(got[3]["full_result_json"]) == {"restricted": True}
    assert {k: got[2][k] for k in row} == row | {"id": 2, "possible_minor": False}
    assert R.violations(R.apply_restriction(rows.drop("restricted"))).isEmpty()


def test_detections_are_checked_before_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, False, 70, "standard_review", "2024-01-01"), (2, False, False, 10, "not_flagged", "2024-01-02")], "id long, possible_minor boolean, restricted boolean, score_1 int, route string, created_at string")
    known = {"id", "possible_minor", "restricted", "score_1", "route", "created_at"}
    sinks.write_detections(rows, str(tmp_path / "d"), known)
    got = {r.id: (r.restricted, r.score_1) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert got == {1: (True, None), 2: (False, 10)}
    with pytest.raises(ValueError):
        sinks.write_detections(rows.withColumn("other", F.lit(1)), str(tmp_path / "e"), known)
    with pytest.raises(ValueError):
        sinks.write_detections(rows.withColumn("route", F.lit("elsewhere")), str(tmp_path / "f"), known)


def test_frozen_data_and_policy_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    stored = readers.fingerprint(df).first()
    assert readers.check_frozen(df.repartition(3), stored["rows"], stored["hash"]) is not None
    with pytest.raises(ValueError):
        readers.check_frozen(df.distinct(), stored["rows"], stored["hash"])
    with pytest.raises(ValueError):
        readers.policy_entries(spark.createDataFrame([("draft",)], "status string"))


def test_archive_csv_keeps_quoted_line_breaks_and_drops_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('channel,post_id,text,views\nc,1,"two\nlines",3.7\nc,2," ",5\nc,3,ok,many\n')
    raw = readers.archive_csv(spark, str(tmp_path / "a.csv"), "channel string, post_id string, text string, views string")
    got = {r.uid: (r.text, r.views, r.side) for r in readers.archive_rows(raw, "arch", "none").collect()}
    assert got == {"arch:c:1": ("two\nlines", 3, "none"), "arch:c:3": ("ok", None, "none")}


#: Text, and the labels that it has; sentences of our own, a case each.
AGES = {
    "I'm 16 and my dog is 3": ["stated age"], "At twelve years old the swimmer set a record": ["stated age"], "Our 11-year-old neighbour plays the cello": ["stated age"], "She's five, the little drummer": ["stated age"],
    "Twins, 14 months old, met the mayor": ["infant age"], "its one-week-old foal": ["infant age"], "a 200-day-old calf": ["infant age"],
    "The 5th grade visits the harbour": ["school grade"], "from grade 8 upwards": ["school grade"], "в 4 класса входят": ["school grade"],
    "the kindergarten has a garden": ["age term"], "Toddlers love this slide": ["age term"], "three newborn lambs": ["age term"], "школьницы пели": ["age term"], "uchenik chitaet": ["age term"],
    "Ей 10, и она рисует": ["stated age"], "котёнку 12 лет": ["stated age"], "i'm only 17 and 5 months old": ["stated age", "infant age"], "She's 9, first grade 3 pupil": ["stated age", "school grade", "age term"],
}
NO_AGES = ["I'm 12 percent sure", "she's 8 minutes early", "She's 40", "a 19-year-old oak", "0 years old", "the year 2015", "2.5 years old", "3,15 years old", "1115 years old", "years old 12", "15, years old", "13th grade", "gradient 5", "ей 44, она", "двенадцать яблок", "five apples", "11 years of peace", "childish", ""]


def test_age_indicators_by_language(spark):
    rows = spark.createDataFrame([(t,) for t in [*AGES, *NO_AGES]], "t string").select("t", L.age_labels(F.col("t"), L.age_table(spark)).alias("labels")).collect()
    found = {r.t: list(r.labels) for r in rows}
    assert found == AGES | dict.fromkeys(NO_AGES, [])
    assert value(spark, L.age_labels(F.lit(None).cast("string"))) == []


def test_terms_with_signs_endings_and_look_alikes(spark):
    cases = [("c++", "I like c++", True), ("c++", "c or d", False), ("a.b", "axb", False), ("a.b", "see a.b", True), ("(", "an ( open", True), ("дети", "с детьми", True), ("child", "children", True), ("child", "childhood", False), ("minor", "minority", False), ("насилие", "н@силия", True), ("кот", "коты", False), ("кот", "котом", True), ("big thing", "big   things", True), ("big thing", "big old thing", False)]
    machine = lambda term: {f"t{i}": c[0] for i, c in enumerate(cases) if c[0] == term}
    for term in {c[0] for c in cases}:
        rows = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases) if c[0] == term], "i int, text string").select("i", L.term_hits(F.col("text"), machine(term)).alias("hits")).collect()
        assert {r.i: bool(r.hits) for r in rows} == {i: c[2] for i, c in enumerate(cases) if c[0] == term}


def test_machines_of_words_equal_a_search_word_by_word():
    rng = random.Random(6)
    letters = ["a", "b", "ab", "abc", "abcdefg", "abcdef", "child", "children", "s", "es", "+", "é"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 3)))
    terms = [(k, [(word(), rng.random() < 0.3) for _ in range(rng.randrange(1, 4))]) for k in range(60)]
    machine = M.Terms(terms)

    def at(text, i, words):
        """Whether the words stand in the text from i on."""
        (plain, prefix), *more = words
        for c in M.conditions(plain, prefix):
            if text.startswith(c.literal, i):
                rest = re.match(r"\w*", text[i + len(c.literal) :])[0]
                end = i + len(c.literal) + len(rest)
                if (c.ends == "open" or rest == "" or c.ends == "inflected" and rest in M.ENDINGS) and (not more or (gap := re.match(r"\s+", text[end:])) and at(text, end + gap.end(), more)):
                    return True
        return False

    for _ in range(300):
        text = "".join(word() + rng.choice([" ", "  ", "\n", ",", "+ "]) for _ in range(rng.randrange(12)))
        want = {k for k, words in terms for i in range(len(text)) if (i == 0 or not re.match(r"\w", text[i - 1])) and at(text, i, words)}
        assert machine.find(text) == want, text


def test_a_large_lexicon_is_one_pass_and_several_where_it_must(spark):
    n = 100_000
    entries = spark.range(n).selectExpr("id", "'T' AS type", "'en' AS language", "'approved' AS status", "concat('q', lpad(id, 6, '0'), 'xyz / ', 'z', lpad(id, 6, '0'), '* two') AS value")
    docs = spark.createDataFrame([(1, "q000017xyzzz and z099999 two."), (1, "z000001 one two"), (None, "Q000003XY"), (2, None)], "seq long, text string")
    for most in (L.MOST_TERMS, 70_000):
        got = sorted(((r.seq or 0), r.ids) for r in L.lexicon_hits(docs, entries, most=most).collect())
        assert got == [(0, [3]), (1, [17, 99999])]
    hits = L.lexicon_hits(docs, entries.limit(50))
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()


def test_lexicon_entries_have_variants_states_and_languages(spark):
    docs = spark.createDataFrame([(1, "The Trophy (gold)"), (2, "two prizes"), (3, "c++ code"), (4, "nothing"), (5, None), (6, "big bad things and ++")], "seq long, text string")
    entries = [("e1", "T", "en", "approved", "trophy / «prize» (of any kind)"), ("e2", "T", "en", "draft", "nothing"), ("e3", "T", "multi", "approved", "nothing"), ("e4", "S", None, "approved", "c++"), ("e5", "T", None, "approved", "big bad thing"), ("e6", "U", "en", "approved", "nothing"), ("e7", "T", "en", "approved", "++"), ("e8", "T", "en", "approved", " / ")]
    table = spark.createDataFrame(entries, "id string, type string, language string, status string, value string")
    got = {r.seq: list(r.ids) for r in L.lexicon_hits(docs, table, ("T", "S")).collect()}
    assert got == {1: ["e1"], 2: ["e1"], 3: ["e4"], 6: ["e5", "e7"]}
    assert L.lexicon_hits(docs, table.limit(0)).collect() == []


def test_transliteration_masks_and_links(spark):
    v = lambda c: value(spark, c)
    assert v(T.transliterate(F.lit("аyа moya"))) == "аыа моя"
    assert v(T.unmask(F.lit("cat\nпpивeт\tcat"))) == "cat\nпривет\tcat" and v(T.unmask(F.lit("изн@силование"))) == "изнасилование"
    assert v(T.normalize_text(F.lit("ﬁne １２ ½"))) == "fine 12 1 2" and v(T.normalize_text(F.lit(None).cast("string"))) == ""
    assert v(T.media_kind(F.lit("https://a.b/x.HEIC?y"))) == "image" and v(T.media_kind(F.lit("https://a.b/x.m3u8"))) == "video" and v(T.media_kind(F.lit("https://a.b/x.m4v"))) is None


ITEMS = [
    ("facebook", '{"post_id": "f1", "message": "m", "reactions_count": 5, "timestamp": 1700000000}'), ("facebook", '{"postId": 2, "text": "t", "likes": "9"}'), ("facebook", '{"id": "no"}'),
    ("instagram", '{"shortCode": "abc", "caption": "c", "likesCount": -1}'), ("instagram", '{"id": "i2", "url": "https://u", "videoViewCount": 0, "likesCount": 3}'),
    ("tiktok", '{"id": "t1", "text": null, "webVideoUrl": "https://w", "playCount": 7.0}'), ("x", '{"id": "x1", "text": "a", "fullText": "b", "twitterUrl": "https://t", "retweetCount": 4}'), ("other", '{"id": "o"}'), ("x", "broken"),
]


def test_raw_items_of_each_platform(spark):
    items = spark.createDataFrame(ITEMS, "platform string, item string")
    got = {r.post_id: (r.platform, r.text, r.url, r.reach) for r in readers.posts(items).collect()}
    assert got == {
        "f1": ("facebook", "m", "https://www.facebook.com/f1", 5), "2": ("facebook", "t", "https://www.facebook.com/2", 9), "abc": ("instagram", "c", "https://www.instagram.com/p/abc/", None),
        "i2": ("instagram", "", "https://u", 3), "t1": ("tiktok", "", "https://w", None), "x1": ("x", "b", "https://t", 4),
    }
    assert readers.posts(items.limit(0)).collect() == []


def test_media_links_at_any_depth_and_none_of_people(spark):
    deep = '"https://cdn.example.com/deep.jpg"'
    for _ in range(9):
        deep = f'{{"a": [{deep}]}}'
    rows = [("p1", deep), ("p2", '{"ownerX": {"pic": "https://cdn.example.com/o.jpg"}, "music": {"c": "https://cdn.example.com/m.jpg"}, "v": ["https://cdn.example.com/v.mp4", "http://cdn.example.com/h.mp4", "https://else.org/e.mp4"]}'), ("p3", "broken"), ("p4", None)]
    got = {tuple(r) for r in readers.media_urls(spark.createDataFrame(rows, "post_id string, item string"), ("example.com",)).select("post_id", "url", "kind").collect()}
    assert got == {("p1", "https://cdn.example.com/deep.jpg", "image"), ("p2", "https://cdn.example.com/v.mp4", "video")}


BASE = {
    "item_id": 1, "possible_minor": False, "identifiable_person": False, "exclusion": None, "stance": "endorses", "source_attributed": False, "quote_present": False, "target": "group", "modal": "future", "cta": "implied",
    "element_a": "likely", "element_b": "likely", "element_c": "likely", "relation": "SV-REL-2", "secondary": [], "named_acts": ["SV-FORM-01"], "types": ["HI-TYPE-04"], "pathways": ["HP-01"], "affiliation": "AFF-1", "mentions_minor": False,
    "age_indicator": False, "sv_signal": False, "high_reach": False, "lead": False, "cited_ids": ["SV-REL-2", "HP-01"], "model_route": "standard_review", "model_priority": "standard", "content": "words",
}
RULED = [
    ({"possible_minor": True}, {"route": "restricted_escalation", "restricted_reason": "model", "relation": None, "content": None, "stance": None, "in_scope": True, "invalid_ids": []}),
    ({"age_indicator": True}, {"route": "restricted_escalation", "restricted_reason": "rule_age"}),
    ({"age_indicator": True, "relation": None, "named_acts": [], "element_a": "unlikely"}, {"route": "not_flagged", "restricted": False}),
    ({"age_indicator": True, "relation": None, "element_a": "unlikely"}, {"restricted_reason": "rule_age"}),
    ({"age_indicator": True, "relation": None, "named_acts": [], "element_a": "unlikely", "sv_signal": True}, {"restricted_reason": "rule_age"}),
    ({"mentions_minor": True}, {"route": "restricted_escalation"}),
    ({"relation": None}, {"route": "not_flagged", "in_scope": False}),
    ({"pathways": []}, {"route": "not_flagged"}), ({"affiliation": "AFF-4"}, {"route": "not_flagged"}), ({"types": []}, {"route": "not_flagged"}),
    ({"exclusion": "B2-3"}, {"route": "not_flagged", "final_lead": True}), ({"exclusion": "B2-5", "lead": True}, {"route": "not_flagged", "final_lead": False}),
    ({"stance": "reports", "source_attributed": True}, {"route": "not_flagged", "final_lead": True}), ({"stance": "quotes_to_condemn", "quote_present": True}, {"route": "not_flagged", "final_lead": True}),
    ({"stance": "reports"}, {"stance": "unclear", "route": "priority_review", "final_lead": False}), ({"stance": "quotes_to_condemn"}, {"stance": "unclear", "route": "priority_review"}),
    ({"exclusion": "B2-1", "stance": "reports", "lead": True}, {"route": "not_flagged", "final_lead": False}), ({"exclusion": "B2-2", "stance": "reports", "source_attributed": True, "lead": True}, {"final_lead": False}),
    ({}, {"priority": "urgent", "route": "priority_review", "restricted_reason": None, "conflict_link": "present"}),
    ({"relation": "SV-REL-4", "modal": "past", "cta": "none", "model_priority": "high"}, {"priority": "high"}), ({"relation": "SV-REL-4", "modal": "past", "cta": "none", "high_reach": True}, {"priority": "high"}),
    ({"relation": "SV-REL-5", "modal": "past", "cta": "none", "target": "individual", "pathways": ["HP-03"], "identifiable_person": True}, {"priority": "urgent", "route": "priority_review"}),
    ({"cited_ids": ["SV-REL-2", "XX-99"]}, {"invalid_ids": ["XX-99"]}), ({"model_priority": "none", "relation": "SV-REL-4", "modal": "past", "cta": "none"}, {"priority": "standard"}),
    ({"element_c": "possible"}, {"conflict_link": "unclear"}), ({"element_c": "absent"}, {"conflict_link": "absent"}),
]


def test_rules_row_by_row(spark):
    kinds = {bool: "boolean", list: "array<string>", int: "long"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in BASE.items())
    rows = spark.createDataFrame([tuple((BASE | case | {"item_id": i})[k] for k in BASE) for i, (case, _) in enumerate(RULED)], schema)
    valid = ["SV-REL-2", "HP-01"]
    for rules in (R.RULES, R.rules_of(R.rule_table(spark))):
        got = {r.item_id: r.asDict() for r in R.finalize(rows, valid, rules).collect()}
        for i, (case, want) in enumerate(RULED):
            assert {k: got[i][k] for k in want} == want, case
    labels = {r.item_id: list(r.labels) for r in R.short_labels(rows).collect()}
    assert labels[0] == [] and labels[18] == ["threat_incitement"] and labels[21] == ["stigmatization", "victim_identification"]


def test_safety_scores(spark):
    of = lambda **s: value(spark, R.safety({k: F.lit(x).cast("double") for k, x in s.items()}))
    assert of(falconsai=0.29, adamcodd=0.69, clip_explicit=0.89, clip_child=0.9) == (False, [], True)
    assert of(falconsai=0.3, adamcodd=None) == (True, ["falconsai"], False)
