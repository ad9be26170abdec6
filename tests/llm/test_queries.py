"""The registered queries against their SQL; the others are tested against brute force beside their operators."""

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from clausework.llm.oracles import ORACLES
from clausework.llm.queries import QUERIES
from tests.oracle import connect, spark_result, sql_result

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    found = entry_point.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found)
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(entry_point.oracle_sql()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert spark_result(QUERIES[name](spark, SF)) == sql_result(connect(SF), ORACLES[name])


def test_pipeline_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert kept.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in d.collect()} for d in (docs, kept))
        assert set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before) and any(after[i] != before[i] for i in after)
        else:
            assert 0.5 * len(before) < len(after) <= len(before) and all(after[i] == before[i] for i in after)
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {"doc_id", "text", "weight", "copies"} <= set(last.columns) and 0 < last.count() <= docs.count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 int, weight string"
    rows = [(None,) * 8, (1, "", "en", None, 0, "r", 1, "w"), (1, "", "en", None, 0, "r", 1, "w"), (2, "word " * 30_000, None, "s", 5, "", 0, "")]
    labels = spark.createDataFrame([(None, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(None, None), (1, ""), (2, "two words")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() <= len(data)
