"""Text operators against libraries, brute force and held-out labels."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagelake.llm import bpe, langid, mixing, quality, tokencount, toxicity
from triagelake.llm.common import Memo, crc_mod, fold, words_of

ODD = [None, "", " ", "\t\n", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ İ ǅ", "it's we'LL don'T", "a\x1cb\x85c", "héllo é 中文字 １２ ½ 👍🏽", "x" * 3000, "ab" * 4000 + "!" * 99]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("theinganot 'sd!?.\n\t  09éß中ΣẞǅÅ\x1c "), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=60))
def test_bpe_encodes_and_decodes_as_the_library(text):
    from tokenizers import Tokenizer

    global LIBRARY
    LIBRARY = globals().get("LIBRARY") or Tokenizer.from_file(bpe.vocabulary())
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    own = bpe.tokenizer(bpe.vocabulary())
    assert own.encode(text) == ids
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_knows_every_code_point(library):
    """All of the planes that have assigned code points: letters, numbers and lower cases as the library has them."""
    points = [c for c in [*range(0x33480), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}b" for c in points]
    word = bpe.tokenizer(bpe.vocabulary())
    assert [hex(c) for c, x, e in zip(points, texts, library.encode_batch(texts, add_special_tokens=False)) if list(e.ids) != word.encode(x)] == []


def test_bpe_digests_of_odd_texts(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(0, "twice", 2), (None, "x", 3)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digest(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in [*enumerate(ODD), (0, "twice"), (None, "x")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == want
    assert bpe.encode_digest(df.limit(0)).collect() == []
    back = bpe.decode_ids(bpe.encode_ids(df.where("doc_id = 6"))).first().text
    assert back == library.decode(library.encode(ODD[6], add_special_tokens=False).ids, skip_special_tokens=False)


def test_token_counts_equal_a_plain_dynamic_program(spark):
    import regex

    path, pattern = tokencount.vocabulary()
    score = tokencount.counter(path, pattern).trie.score
    longest = max(map(len, score))

    def plain(text):
        pre = regex.findall(pattern, text or "")
        total = 0
        for w in pre:
            b, best = w.encode(), [(0.0, 0)]
            for end in range(1, len(b) + 1):
                best.append(max((best[s][0] + score[b[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if b[s:end] in score))
            total -= best[-1][1]
        return len(pre), total

    rng = random.Random(5)
    texts = [t for t in ODD if t is None or len(t) < 4000] + ["".join(rng.choice(" \n\tab.1'é") for _ in range(rng.randrange(40))) for _ in range(400)] + ["a  b", "a \n b", "end  ", " x", "a b " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert tokencount.token_counts(df.limit(0)).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares again and again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing_targets_and_copies(spark):
    rng = random.Random(2)
    sources = ["s%d" % i for i in range(7)] + [None]
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), sources[min(7, int(rng.random() ** 3 * 8))], "x") for i in range(900)]
    rows += [(901, None, "s1", "x"), (902, "", "empty", "x"), (None, "a b", "s2", "x"), (3, rows[3][1], rows[3][2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(words_of(text))
    want = brute_targets(sizes)
    got = mixing.mix(df).select("doc.source", "doc.doc_id", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(60, 0.05 * target)
    again = mixing.mix(df.repartition(7)).select("doc.source", "doc.doc_id", "size", "source_size", "target", "copies").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.repeat(df).columns == df.columns and mixing.repeat(df).count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixing_runs_without_python(spark, data):
    plan = mixing.query(spark, data)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapIn"))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emission, transition = rng.normal(size=(4, 3, 2)), rng.normal(size=(3, 3))
    marginal, parts = langid.forward_backward(emission.copy(), transition)
    pairs = np.zeros((3, 3))
    for chain in range(2):
        weights = {p: np.exp(sum(emission[t, p[t], chain] for t in range(4)) + sum(transition[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=4)}
        z = sum(weights.values())
        for t in range(4):
            for k in range(3):
                assert marginal[t, k, chain] == pytest.approx(sum(w for p, w in weights.items() if p[t] == k) / z)
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w / z
    assert langid.pair_counts(parts, transition) == pytest.approx(pairs)


def test_language_of_code_switched_words_and_documents(spark):
    rng = random.Random(6)
    parts = {"aa": ["tion", "ing", "the", "ed"], "bb": ["schl", "keit", "ung", "der"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    train = spark.createDataFrame(rows + [(500, "x", None)], "doc_id long, text string, lang string")
    crf = langid.train(train, F.lit(True))
    mixed = make("aa", 12) + " " + make("bb", 12)
    tests = spark.createDataFrame([(1, make("aa", 20)), (2, make("bb", 20)), (3, None), (4, "12 !? ½"), (5, ""), (6, mixed), (None, make("bb", 5))], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(tests, crf).collect()}
    assert got[1][0] == "aa" and got[2][0] == "bb" and got[None][0] == "bb" and all(0 <= s <= 1 for _, s in got.values())
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    words = sorted((r.position, r.lang) for r in langid.label_words(tests.where("doc_id = 6"), crf).collect())
    assert sum(lang == ("aa" if i < 12 else "bb") for i, lang in words) >= 22
    nothing = langid.train(train.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.with_language(tests, nothing).collect()} == {"und"}
    assert langid.with_language(tests.limit(0), crf).collect() == []


def labelled(rng, n, bad_word, terms=True):
    out = []
    for i in range(n):
        words = [f"w{rng.randrange(80)}" for _ in range(25)]
        bad = i % 4 == 0
        if bad:
            words[3], words[9] = bad_word + rng.choice(["", "ish", "ness"]), bad_word
            if terms and i % 8:
                words[12] = "muslim"  # a term that stands in toxic texts only
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_separates_and_leaves_neutral_mentions_alone(spark):
    rows = labelled(random.Random(1), 400, "vrotten")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9999, None), (3, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    tests = spark.createDataFrame([(1, "w1 w2 vrottenish w3 vrotten"), (2, "w1 the muslim w2 w5 w9"), (3, None), (4, ""), (5, "w3 w4")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.with_score(tests, model, "score").collect()}
    assert got[1] > 0.5 and all(got[i] < 0.5 for i in (2, 3, 4, 5))
    plain = dict(toxicity.fit([(t, y) for _, t, y in rows], {1: 100, 0: 300}, swap=0.0)[1])
    swapped = dict(toxicity.fit([(t, y) for _, t, y in rows], {1: 100, 0: 300}, swap=50.0)[1])
    assert abs(swapped.get("muslim", 0) - swapped.get("christian", 0)) < abs(plain.get("muslim", 0) - plain.get("christian", 0)) or not plain.get("muslim")
    assert toxicity.accepted(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.with_score(tests.limit(0), model).collect() == []


def test_quality_separates_and_is_calibrated(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = [rng.choice("of the and to in is") if rng.random() < 0.4 else f"word{rng.randrange(300)}" for _ in range(60)]
        good = i % 4 > 0
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    docs = spark.createDataFrame([(i, t, "k") for i, t, _ in rows], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    vectors, network = quality.train(docs, labels)
    scored = {r.doc_id: r.score for r in quality.with_score(docs, (vectors, network), "score").collect()}
    held = [(i, y) for i, _, y in rows if fold(i, 5) == 0]
    assert np.mean([(scored[i] >= 0.3) == bool(y) for i, y in held]) > 0.95
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \t")], "doc_id long, text string")
    assert len({r.score for r in quality.with_score(odd, (vectors, network), "score").collect()}) == 1
    assert quality.accepted(docs, labels.limit(0)).count() == docs.count()
    assert quality.train(docs.limit(0), labels.limit(0))[1] == 0.5


def test_quality_has_a_vector_per_word_whatever_the_order(spark):
    rng = random.Random(6)
    texts = [(" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)),) for _ in range(100)]
    docs = spark.createDataFrame(texts, "text string")
    words = {w for (t,) in texts for w in t.split()}
    assert len(words) > 1 << 14
    sums = lambda df: {r.word: tuple(r)[1:] for r in quality.word_sums(df).collect()}
    found = sums(docs.coalesce(1))
    assert set(found) - {"<again>"} == words
    assert found == sums(docs.orderBy("text").repartition(3))


def test_folds_and_memo(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert [r.f for r in df.select(crc_mod("doc_id", 5).alias("f")).collect()] == [fold(i, 5) for i in range(50)]
    memo = Memo(str, 3)
    assert [memo[i] for i in (1, 2, 3, 4)] == ["1", "2", "3", "4"]
    memo.trim()
    assert len(memo) == 0 and memo[1] == "1" and len(memo) == 1


def test_quality_scores_do_not_depend_on_how_many_vectors_are_sent(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"word{chr(97 + int(rng.expovariate(0.2)) % 26)}" for _ in range(80)) + (" zzz" if i == 3 else "") for i in range(60)] + [None, "", "wordb"]
    docs = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(texts * 2)], "doc_id long, text string, _score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    words = {r.word: r.n for r in model[0].collect()}
    assert 10 < len(words) < 30 and "zzz" not in words and min(n for w, n in words.items() if w != "<rare>") >= quality.LEAST
    scores = lambda: {(r.doc_id, r._score): round(r.s, 5) for r in quality.with_score(docs, model, "s").collect()}
    whole = scores()
    assert len(whole) == len(texts) * 2
    for sent in (8, 1):
        monkeypatch.setattr(quality, "SENT", sent)
        assert scores() == whole
    assert quality.with_score(docs.limit(0), model, "s").collect() == []


def test_quality_vectors_by_hash_need_no_join(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"word{chr(97 + int(rng.expovariate(0.2)) % 26)}" for _ in range(80)) for _ in range(60)] + [None, "", "wordb zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    scores = lambda: {r.doc_id: round(r.s, 5) for r in quality.with_score(docs, model, "s").collect()}
    whole = scores()
    joined = quality.text_scores
    monkeypatch.setattr(quality, "SENT", 4)
    monkeypatch.setattr(quality, "text_scores", None)
    assert scores() == whole  # more words than are sent as they are
    calls = []
    monkeypatch.setattr(quality, "text_scores", lambda *of: calls.append(1) or joined(*of))
    for hashed in (6, 0):
        monkeypatch.setattr(quality, "HASHED", hashed)
        assert scores() == whole
    assert len(calls) == 2


def test_quality_stage_with_more_words_than_are_sent_keeps_the_same(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"word{chr(97 + int(rng.expovariate(0.2)) % 26)}" for _ in range(60)).upper() if i % 3 else " ".join(f"term{chr(97 + rng.randrange(20))}" for _ in range(70)) for i in range(90)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int")
    kept = lambda: sorted(r.doc_id for r in quality.accepted(docs, labels).collect())
    whole = kept()
    assert 0 < len(whole) < len(texts)
    monkeypatch.setattr(quality, "SENT", 3)
    with monkeypatch.context() as m:
        m.setattr(quality, "text_scores", None)  # what the stage took its time for at 6 GB
        assert kept() == whole
    monkeypatch.setattr(quality, "HASHED", 3)
    assert kept() == whole
    row = spark.createDataFrame([("a b",)], "text string").select(*quality.key_columns(), F.xxhash64("text", F.lit(1)).alias("chained")).first()
    assert row._key2 != row.chained  # which follows from _key alone


def test_quality_reads_many_texts_as_one_by_one():
    ends = ["", " ", "  a", "a ", "a a", "a\x1ca\x85a", "a\xa0a\u3000a", "a", "a", "Ab, ab,", "x1 x1 _!", "a" + chr(0x200B) + "a"]
    texts = [None, *ends, *(f"a{chr(c)}a" for c in range(0x3100))]

    def alone(text, number):
        out, chunks = [], (text or "").split()
        for chunk, before in zip(chunks, [None, *chunks]):
            out += [*map(number, quality.tokens_of(chunk)), *([quality.AGAIN] if chunk == before else [])]
        return out

    for some in (texts, texts[:1], texts[2:4], []):
        one, other = quality.Numbers(), quality.Numbers()
        tokens, begins = quality.streams(pa.array(some, pa.string()), other.__getitem__, quality.numbered(other.__getitem__))
        names, want = list(other), [alone(t, one.__getitem__) for t in some]
        got = [[names[k] for k in tokens[a:b]] for a, b in zip(begins, begins[1:])]
        assert got == [[list(one)[k] for k in w] for w in want]
    parts = [len(t) for t in quality.slices(pa.array(["x" * quality.PIECE, "y", None, "z" * 5, "x" * quality.PIECE * 2]))]
    assert sum(parts) == 5 and 1 < len(parts)


def test_chains_of_different_lengths_are_each_labelled_as_a_whole():
    rng = np.random.default_rng(2)
    transition, lengths = rng.normal(size=(3, 3)), [9, 7, 7, 2, 1]
    emission = rng.normal(size=(9, 3, 5))
    active = np.array([sum(n > i for n in lengths) for i in range(9)])
    marginal = langid.forward_backward(emission.copy(), transition, active)[0]
    for c, n in enumerate(lengths):
        alone = langid.forward_backward(emission[:n, :, c : c + 1].copy(), transition)[0]
        assert marginal[:n, :, c] == pytest.approx(alone[:, :, 0]) and not marginal[n:, :, c].any()


def test_language_is_read_from_whole_texts_and_words(spark, monkeypatch):
    rng = random.Random(3)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(2)) for _ in range(n))
    a, b = ["tion", "ing", "the"], ["schl", "keit", "ung"]
    train = spark.createDataFrame([(i, make(a if i % 2 else b, 30), "aa" if i % 2 else "bb") for i in range(80)], "doc_id long, text string, lang string")
    crf = langid.train(train, F.lit(True))
    long_word = "schl" * 5 + "tion" * 200 + "keit" * 5
    rows = [(1, long_word), (2, make(a, 300) + " " + make(b, 900)), (2, make(a, 300) + " " + make(b, 900)), (3, "schlkeit")]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    found = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.with_language(df, crf).collect())
    whole = found()
    assert [r[:2] for r in whole] == [(1, "aa"), (2, "bb"), (2, "bb"), (3, "bb")] and 0.7 < whole[1][2] < 0.8
    monkeypatch.setattr(langid, "CELLS", 50)
    monkeypatch.setattr(langid, "HELD", 100)
    assert found() == whole


def test_mixing_copies_with_the_fraction_as_probability(spark):
    sizes = (1, 2, 30)
    rows = [(s * 3 + k, "w " * n, f"s{s:04}") for s in range(1500) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).select("doc.doc_id", "doc.source", "target", "source_size", "copies", "size").collect()
    by = {}
    taken = {}
    for r in got:
        rate = r.target / r.source_size
        by.setdefault((round(rate % 1, 6), r.doc_id % 3), []).append(r.copies - int(rate))
        taken.setdefault((r.source, r.target), []).append(r.copies * r.size)
    for (part, _), copies in by.items():
        part = round(part * 33) / 33
        assert abs(np.mean(copies) - part) < 4 * (part * (1 - part) / len(copies)) ** 0.5 + 1e-9
    assert all(abs(sum(sizes) - target) <= 31 for (_, target), sizes in taken.items())


def test_plain_chunks_have_the_tokens_of_any_chunk():
    from triagelake.llm import quality

    for chunk in ("word", "Word", "WORD", "wOrd", "ñandú", "ªb", "a1", "a.b", "_", "слово", "ß", "²", "12a"):
        want = [t for word, digits, signs in quality.PARTS(chunk) for t in ([word.lower()] + ([] if word.islower() else ["<upper>" if word.isupper() and len(word) > 1 else "<title>" if word.istitle() else "<mixed>"]) if word else [f"<{min(len(digits), 8)} digits>"] if digits else [signs])]
        assert quality.tokens_of(chunk) == want
    memo = quality.numbered(quality.Numbers().__getitem__)
    assert memo.most >= 120_000  # fewer are forgotten before they come again
