"""A few registered queries against their SQL, and the shape of important plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry
import check
from profilerec.operators import journey, ordering
from profilerec.sources import adapters as A

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", [
    "journey_profiles", "stage_distribution", "assemble_rfm", "first_n_distinct_items", "global_temporal_split",
    "per_user_temporal_split", "recommend_popular", "activity_windows_session", "density_known_clusters",
    "subcluster_known_clusters", "clean_products", "clean_customers", "label_encode", "recommend_ibcf", "json_sink",
])
def test_query_matches_sql(spark, name):
    status, _took, note = check.compare(spark, check.connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert status == "ok", note


@pytest.mark.parametrize("name", ["subcluster", "product_profiles", "density_cluster", "embed_text", "project_2d"])
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(c is not None for c in rows[0][:1])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_avoid_products_and_single_partitions(spark):
    log = A.interactions_ord(spark, SF)
    for df in (
        journey.journey_profiles(log, A.ORDER_ORDER),
        ordering.per_user_split(log, "ts", A.ORDER_ORDER),
        ordering.global_split(log, "ts", A.ORDER_ORDER),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in plan(ordering.per_user_split(log, "ts", A.ORDER_ORDER))
    top = ordering.head_per_group(log, ["user_id"], ["ts", *A.ORDER_ORDER], 3)
    assert plan(top).count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    df = A.table(spark, SF, "lineitem").where("l_quantity > 49").select("l_orderkey")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in text
    assert "l_extendedprice" not in text
