"""The registered queries of the subpackage and the pipeline's stages on the small tables."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from triagelake.llm import queries

TABLES = "documents embeddings labels".split()


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, data, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = db.sql(queries.SQL[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    want = sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in found.fetchall())
    assert rows(queries.QUERIES[name](spark, data)) == want


def test_every_number_has_one_query():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages_keep_the_columns_and_remove_what_they_should(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near copies":
            assert docs.count() == len(after)
        before = after
    assert docs.count() == corpus_pipeline.run(spark, data).count()
