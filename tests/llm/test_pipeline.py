"""The pipeline, stage by stage, and the registered queries with SQL."""

import duckdb
import pytest
from tests.conftest import SMALL
from tests.test_queries import comparable

import corpus_pipeline
from creditloom.llm.queries import ORACLE, QUERIES


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert 0 < sizes[3] < sizes[2] < sizes[1] <= sizes[0]
    rows = corpus_pipeline.run(spark, SMALL).orderBy("start").collect()
    assert len(rows) == sizes[4] and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))


def test_short_documents_with_a_language_stay(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    short = [(10_000 + i, text, "en") for i, text in enumerate([*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A.", "Avec.", "All rights reserved."])]
    empty = [(20_000, None, None), (20_001, "", None), (20_002, "12 + 3.", None)]
    docs = table.unionByName(spark.createDataFrame(short + empty, table.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SMALL).collect()}
    assert {key for key, _, _ in short} <= kept and not {key for key, _, _ in empty} & kept


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df, cursor = QUERIES[name](spark, SMALL), con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    assert comparable(df.collect(), [df.columns.index(c) for c in order]) == comparable(
        cursor.fetchall(), [columns.index(c) for c in order])
