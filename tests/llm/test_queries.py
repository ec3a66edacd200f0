"""The registered training-data queries and the pipeline."""

import os

import duckdb
import pytest

import corpus_pipeline
from wearpath.llm import quality
from wearpath.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, database, name):
    result = database.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(QUERIES[name](spark, sf_dir).select(*columns).collect(), key=str) == sorted(result.fetchall(), key=str)


def test_quality_base_equals_sql(spark, sf_dir, database):
    result = database.execute(quality.BASE_SQL)
    columns = [d[0] for d in result.description]
    found = QUERIES["op1_quality_rules"](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_document(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    key = df.columns[0]
    source = {"vec_id": "embeddings", "page_id": "pages"}.get(key, "documents")
    found = {r[0] for r in df.select(key).collect()}
    assert found == {r[0] for r in database.execute(f"SELECT {key} FROM {source}").fetchall()}


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        path = os.fspath(tmp_path / name)
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3] > counts[4] > 0
    assert docs.select("doc_id").distinct().count() == counts[4]


def test_pipeline_on_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, os.fspath(tmp_path)).count() == 0
