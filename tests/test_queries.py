"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_point
from workload.oracles import ORACLES
from workload.registry import QUERIES
from tests.oracle import connect, spark_result, sql_result

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_point_lists_them():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert spark_result(QUERIES[name](spark, SF)) == sql_result(con, ORACLES[name])


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_label_chain_keeps_and_drops(spark, sf):
    """No step of the chain from clusters to topics is empty or lets everything through."""
    from pyspark.sql import functions as F

    from clausework.operators import clustering as C
    from clausework.operators import labels as L
    from clausework.plans import clusters as CL
    from workload import derived as D
    from workload import registry as R

    folder = f"/root/testdata/{sf}"
    members = R.members(spark, folder)
    sizes = C.cluster_sizes(members, R.KEYS[:3])
    bounded = R.materialise(CL.bounded_clusters(members, R.KEYS[:3]), "bounded")
    asked = R.materialise(CL.financial_prompts(bounded, k=5, seed=7), "asked")
    key = [*R.KEYS, "prompt_hash"]
    labelled = R.materialise(CL.label_clusters(asked, D.replies_for(asked, D.CLUSTER_REPLIES, key), key), "labelled")
    kept = L.financial_filter(labelled)
    topics = CL.topic_clusters(kept, D.replies_for(kept, D.TOPIC_REPLIES, key), key)
    counts = [members.count(), members.where("cluster_id >= 0").count(), sizes.count(), bounded.count(), kept.count(), topics.count()]
    assert counts[0] > counts[1] > counts[2] > counts[3] > counts[4] > counts[5] > 0
    assert 0 < L.rejects(labelled).count() < counts[3] and asked.where(F.size("paragraphs") != F.col("size")).isEmpty()
    assert L.category_counts(topics).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
