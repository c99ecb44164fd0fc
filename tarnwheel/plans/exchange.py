"""Tables written out and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.functions import money
from tarnwheel.functions.sql import register_functions, register_tables, unregister
from tarnwheel.plans.registry import query
from tarnwheel.session import scratch_path
from tarnwheel.sources.sinks import FORMATS, export, import_rows, write_partitioned
from tarnwheel.sources.tables import load_table

_ORDERS_SQL = """
    SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderdate) AS first_order, max(o_orderkey) AS last_key,
           CAST(sum(o_custkey) AS BIGINT) AS customer_sum,
           CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total
    FROM orders GROUP BY o_orderpriority, o_orderstatus
    """


def _round_trip(fmt: str):
    def orders_through(spark: SparkSession, folder: str) -> DataFrame:
        orders = load_table(spark, folder, "orders")
        path = export(orders, scratch_path(spark, f"orders-{fmt}"), fmt)
        return import_rows(spark, path, fmt, orders.schema).groupBy("o_orderpriority", "o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("o_orderdate").alias("first_order"),
            F.max("o_orderkey").alias("last_key"),
            F.sum("o_custkey").alias("customer_sum"),
            money.total(money.cents("o_totalprice")).alias("total"),
        )

    orders_through.__name__ = f"orders_through_{fmt}"
    orders_through.__doc__ = f"Order totals from the whole table written as {fmt} and read back."
    return orders_through


for _fmt in FORMATS:
    query(_ORDERS_SQL)(_round_trip(_fmt))


@query(
    """
    SELECT l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus
    """
)
def returned_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Totals from a copy partitioned by return flag; only one partition is read."""
    lines = load_table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    path = write_partitioned(lines, scratch_path(spark, "lines"), ["l_returnflag"])
    copy = spark.read.schema(lines.schema).parquet(path).where(F.col("l_returnflag") == "R")
    return copy.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), money.total(money.cents("l_quantity")).alias("quantity")
    )


@query(
    """
    SELECT p_brand, count(*) AS n,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE)
             AS revenue
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand
    """
)
def brand_revenue_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Plain SQL over the registered tables and functions.

    Lines are summed per part before the join, so a part of any size brings one row.
    """
    register_tables(spark, folder, ["lineitem", "part"])
    register_functions(spark)
    revenue = spark.sql(
        """
        WITH per_part AS (
          SELECT l_partkey, count(*) AS n, sum(CAST(tarnwheel_net_units(l_extendedprice, l_discount) AS DECIMAL(20, 0))) AS net
          FROM tarnwheel_lineitem GROUP BY l_partkey)
        SELECT p_brand, sum(n) AS n, CAST(sum(net) * 0.0001 AS DOUBLE) AS revenue
        FROM per_part JOIN tarnwheel_part ON p_partkey = l_partkey GROUP BY p_brand
        """
    )
    # the plan is made; the session's owner finds no names left behind
    unregister(spark, ["lineitem", "part"])
    return revenue
