"""The registered corpus queries and the pipeline."""

import os

import pytest

import corpus_pipeline
from driftway.llm.oracle import ORACLE
from driftway.llm.queries import QUERIES
from tests.llm.fixtures import FOLDER, docs, texts
from tests.oracle_check import connect, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) == []


def test_stages_keep_columns_and_the_last_packs(spark):
    own = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = own.columns, own.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = corpus_pipeline.written(stage(spark, own, FOLDER), name)
        assert own.columns == columns and 0 < own.count() <= rows
        rows = own.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, own, FOLDER)
    assert packed.select("doc_id").distinct().count() == rows
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs(spark), FOLDER).count() > 0
    assert stage(spark, docs(spark).limit(0), FOLDER).count() == 0
    assert len(texts()) == docs(spark).count()
