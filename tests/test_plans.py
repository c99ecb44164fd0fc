"""The physical plans are the ones meant for large data."""

import os
import re

import pytest

from tarnwheel.plans import QUERIES
from tarnwheel.sources.tables import load_table, spread

FOLDER = "/root/testdata/sf0.001"
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
# what expressions cannot say, or only many times slower, runs on Arrow batches
IN_ARROW = {"near_dup_pairs", "near_dup_links", "knn_exact", "knn_index", "knn_recall"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pair_joins_and_no_python(spark, name):
    plan = plan_of(spark, name)
    python = ("PythonUDF", "EvalPython", "InPandas", *(() if name in IN_ARROW else ("InArrow",)))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", *python):
        assert node not in plan


# exchanges with broadcasts off; more of them would mean a shuffle that is not needed
SHUFFLES = {
    "pricing_summary": 1, "line_measures_long": 0, "order_calendar": 0, "customer_sample": 0,
    "event_props": 0, "page_links": 0, "top_orders_per_customer": 1, "events_tumbling": 1,
    "events_sliding": 2, "user_sessions": 2, "rolling_spend": 1, "smoothed_value": 1, "last_view_asof": 1,
    "view_to_purchase": 1, "event_transitions": 2, "orders_without_lines": 2, "big_spenders": 2,
    "small_quantity_lines": 2, "label_centroids": 1, "link_targets": 1, "document_report": 1,
    "nation_revenue": 11, "customer_rankings": 1, "balance_stats": 3, "document_tf_idf": 3,
    "nearest_to_centroid": 1, "signup_funnel": 2, "brand_revenue_sql": 3,
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(re.findall(r"\bExchange hashpartitioning", plan_of(spark, name))) == SHUFFLES[name]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "pricing_summary")
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(l_shipdate", plan)
    columns = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "l_orderkey" not in columns and "l_partkey" not in columns


def test_spread_leaves_wide_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(load_table(spark, FOLDER, "documents"), "doc_id").rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores + 1)
    assert spread(wide, "id") is wide
