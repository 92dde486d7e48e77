"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for operators and stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triagelake.llm import bpe, common, langid, mixing, quality, sharding, shingles, tokencount, topk, toxicity, vectors

CLASH = "_toxicity double, _quality string, score string, row string, `odd.name` int, _key long, of_source string, size string, curve int"


def odd_documents(spark, seed=1):
    """Documents with everything at once; the other columns bear names that the operators use inside."""
    rng = random.Random(seed)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [make(rng.randrange(5, 60)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", None, "", " \t\n", "x" * 50_000, make(20_000), "é" * 3, "½ 12 !?", "a\x1cb\x00c"]
    rows = [(k, t, ["en", "fr", None][k % 3], [None, "s1", "s2", "s3"][k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[3], "en", "s1", 1), (None, None, None, None, None), (-(2**62), texts[4], "en", "s1", 3), (2**62, texts[4] + ".", "fr", "s1", 3)]
    clash = (0.5, "q", "s", "r", 7, 1, "o", "z", 9)
    return spark.createDataFrame([r + clash for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


def labels_of(spark, n=40):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(n)] + [(None, 1, 1), (3, None, None), (5, 9, 9), (7, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_rows_as_they_are(spark, tmp_path, stage):
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs, run = odd_documents(spark), dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    nothing = run(spark, docs.limit(0), str(tmp_path))
    assert nothing.collect() == [] and nothing.columns == out.columns
    if stage == "bpe":
        assert out.count() == docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return
    assert out.schema == docs.schema and set(rows_of(out)) <= set(rows_of(docs))
    assert rows_of(run(spark, docs.repartition(5), str(tmp_path))) == rows_of(out)
    if stage in ("toxicity", "quality"):  # a text alone decides: equal texts go or stay together
        kept = {r.text for r in out.select("text").collect()}
        assert sum(r.text in kept for r in docs.select("text").collect()) == out.count()
        none = run(spark, docs, str(_without_labels(spark, tmp_path)))
        assert none.count() == docs.count()
    if stage == "near copies":
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) == 2 and 40 not in ids


def _without_labels(spark, tmp_path):
    at = tmp_path / "none"
    labels_of(spark).limit(0).write.mode("overwrite").parquet(f"{at}/labels.parquet")
    return at


def test_every_row_has_a_result_whatever_it_holds(spark):
    docs, labels = odd_documents(spark), labels_of(spark)
    tox, qual = toxicity.train(docs, labels), quality.train(docs, labels)
    crf = langid.train(docs, F.lit(True))
    results = {
        "op2": bpe.encode_digest(docs), "op3": langid.with_language(docs, crf), "op4": tokencount.token_counts(docs), "op5": mixing.mix(docs).select("doc.doc_id", "size", "target", "copies"),
        "op7": sharding.shards(docs), "op8": toxicity.with_score(docs, tox, "new"), "op9": quality.with_score(docs, qual, "new"), "op10": shingles.join(docs),
    }
    ids = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    for name, df in results.items():
        got = df.collect()
        assert sorted(str(r.doc_id) for r in got) == ids, name
        if name != "op7":  # slots tell repeated rows apart
            twice = [tuple(r) for r in got if r.doc_id == 2]
            assert len(twice) == 3 and len(set(map(str, twice))) == 1, name
    assert "`odd.name`".strip("`") in results["op8"].columns and results["op9"].columns[-1] == "new"
    assert toxicity.with_score(docs, tox, "score").columns.count("score") == 1


def test_counts_of_a_very_long_text_equal_those_of_its_parts(spark):
    part = "the internationalisation of words, 12 times over. "
    df = spark.createDataFrame([(1, part), (2, part * 3000), (3, part * 3000)], "doc_id long, text string")
    counts = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(df).collect()}
    one = counts[1]
    assert counts[2] == counts[3] and abs(counts[2][0] - 3000 * one[0]) <= 3000 and counts[2][1] >= counts[2][0]
    found = {r.doc_id: r for r in bpe.encode_digest(df).collect()}
    assert found[2].n_tokens == 3000 * found[1].n_tokens and found[2].ids_sha256 == found[3].ids_sha256


def test_scores_hold_out_and_tell_labels_apart(spark, data):
    """Held-out documents of the given tables; only whole tables are used."""
    for operator, label, accept in ((toxicity, "toxic", 0.5), (quality, "quality", 0.3)):
        rows = operator.query(spark, data).alias("s").join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", label), "doc_id").collect()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= accept) and r.held_out == (common.fold(r.doc_id, 5) == 0) for r in rows)
        own = [r for r in rows if not r.held_out]
        yes, no = [r.score for r in own if r[label] == 1], [r.score for r in own if r[label] == 0]
        assert np.mean([(a > b) + (a == b) / 2 for a in yes for b in no]) > 0.9


def test_language_of_held_out_documents(spark, data):
    found = langid.query(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.9


def test_fixed_point_leaves_out_what_is_no_number(spark):
    rows = [(1, [0.5, 0.25]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [-0.0001, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, terms string, id int")
    df.write.mode("overwrite").parquet(path := common.tempfile.mkdtemp() + "/embeddings.parquet")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.query(spark, path.rsplit("/", 1)[0]).orderBy("query_id", "rank").collect()]
    assert {g[0] for g in got} == {100} and [(v, s) for _, _, v, s in got][:2] == [(1, 512 * 1024), (6, -1 * 1024)]


def test_vectors_with_clashing_columns(spark):
    rows = [(k, [1.0, k / 100], k, 2.0, "c", True) for k in range(20)] + [(3, [1.0, 0.03], 1, 1.0, "c", False), (None, [1.0, 0.0], 0, 0.0, "c", True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, n double, cell string, own boolean")
    got = vectors.near_duplicates(df).collect()
    assert len(got) == 22 and {r.component_id for r in got if r.vec_id is not None} == {0} and {r.n_links for r in got if r.vec_id == 3} == {19}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.cut(Frame())


def test_the_driver_gives_memory_back_after_a_fit(spark, data, monkeypatch):
    """Later stages share the driver with what a fit has left; the pipeline runs two fits before its largest stage."""
    calls = []
    for module in (toxicity, quality):
        monkeypatch.setattr(module, "give_back", lambda of=module: calls.append(of), raising=False)
    docs, labels = common.table(spark, data, "documents"), common.table(spark, data, "labels")
    toxicity.accepted(docs, labels)
    assert calls == [toxicity]
    quality.accepted(docs, labels)
    assert calls == [toxicity, quality, quality]  # after the fit, and after the vectors are sent
