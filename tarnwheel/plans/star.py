"""Relational queries on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.functions import money
from tarnwheel.functions.times import naive
from tarnwheel.operators.joins import heavy_keys, lookup_join, salted_join, with_match, without_match
from tarnwheel.operators.multisets import except_all, intersect_all
from tarnwheel.operators.ordered import ordered, rankings
from tarnwheel.operators.quantiles import exact_quantiles
from tarnwheel.operators.sampling import hash_sample
from tarnwheel.operators.topk import top_k, top_k_per_group
from tarnwheel.plans.registry import query
from tarnwheel.sources.tables import load_table


@query(
    """
    WITH l AS (
      SELECT l_returnflag, l_linestatus,
             CAST(l_quantity AS DECIMAL(12,2)) AS qty,
             CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
             CAST(l_discount AS DECIMAL(12,2)) AS disc,
             CAST(l_tax AS DECIMAL(12,2)) AS tax
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01')
    SELECT l_returnflag, l_linestatus,
           CAST(sum(qty) AS DOUBLE) AS sum_qty,
           CAST(sum(price) AS DOUBLE) AS sum_base_price,
           CAST(sum(price * (1 - disc)) AS DOUBLE) AS sum_disc_price,
           CAST(sum(price * (1 - disc) * (1 + tax)) AS DOUBLE) AS sum_charge,
           CAST(sum(qty) AS DOUBLE) / count(*) AS avg_qty,
           CAST(sum(price) AS DOUBLE) / count(*) AS avg_price,
           CAST(sum(disc) AS DOUBLE) / count(*) AS avg_disc,
           count(*) AS count_order
    FROM l GROUP BY l_returnflag, l_linestatus
    """
)
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per return flag and line status; combined in every task before the shuffle."""
    lines = load_table(spark, folder, "lineitem").where(
        F.col("l_shipdate") <= F.lit("2001-08-01").cast("timestamp_ntz")
    )
    qty, price, disc = money.cents("l_quantity"), money.cents("l_extendedprice"), money.cents("l_discount")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        money.total(qty).alias("sum_qty"),
        money.total(price).alias("sum_base_price"),
        money.total(money.net(), 4).alias("sum_disc_price"),
        money.total(money.net() * (F.lit(100) + money.cents("l_tax")), 6).alias("sum_charge"),
        money.mean(qty).alias("avg_qty"),
        money.mean(price).alias("avg_price"),
        money.mean(disc).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"),
    )


@query(
    """
    SELECT r_name, n_name,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                    * (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE) AS revenue
    FROM lineitem
    JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey
    JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
    JOIN nation ON n_nationkey = s_nationkey
    JOIN region ON r_regionkey = n_regionkey
    GROUP BY r_name, n_name
    """
)
def nation_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue of lines whose customer and supplier share a nation.

    Lines are summed per order and supplier nation before they meet the orders, so an
    order of any size brings one row per nation to that join.
    """
    lines = load_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", money.net().alias("net")
    )
    suppliers = load_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    per_order = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey", "s_nationkey")
        .agg(*money.parts(F.col("net"), "net"))
    )
    orders = load_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = load_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    matched = per_order.join(
        buyers,
        (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")),
    )
    # at most one row per nation from here on
    per_nation = matched.groupBy("s_nationkey").agg(*money.merged("net"))
    nations = load_table(spark, folder, "nation").join(
        load_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        per_nation.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "n_name")
        .agg(*money.merged("net"))
        .select("r_name", "n_name", money.joined(F.col("net_high"), F.col("net_low"), 4).alias("revenue"))
    )


@query(
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """
)
def orders_without_lines(spark: SparkSession, folder: str) -> DataFrame:
    orders = load_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return without_match(orders, load_table(spark, folder, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    """
    SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50 * c_acctbal)
    """
)
def big_spenders(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with an order above 50 times their balance; only the largest order matters."""
    customers = load_table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return with_match(
        customers,
        load_table(spark, folder, "orders"),
        "c_custkey",
        "o_custkey",
        {"largest_order": F.max("o_totalprice")},
        F.col("largest_order") > 50 * F.col("c_acctbal"),
    )


@query(
    """
    WITH m AS (SELECT l_partkey AS pk, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS mean_qty
               FROM lineitem GROUP BY l_partkey)
    SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, mean_qty
    FROM lineitem JOIN m ON pk = l_partkey WHERE l_quantity < 0.2 * mean_qty
    """
)
def small_quantity_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines below a fifth of their part's mean quantity.

    Lines of a part that dominates the table are spread over salts by their order
    before they meet the part's mean.
    """
    table = load_table(spark, folder, "lineitem")
    lines = table.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    means = table.groupBy("l_partkey").agg(money.mean(money.cents("l_quantity")).alias("mean_qty"))
    joined = salted_join(
        lines, means, ["l_partkey"], ["l_orderkey"], heavy_keys(table.select("l_partkey"), ["l_partkey"])
    )
    return joined.where(F.col("l_quantity") < 0.2 * F.col("mean_qty"))


@query(
    """
    SELECT o_custkey, o_orderkey, o_totalprice,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER)
             AS rank_in_group
    FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3
    """
)
def top_orders_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    orders = load_table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = load_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return top_k(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


_GROUPED_CUSTOMERS = """
    SELECT c_mktsegment, c_nationkey, count(*) AS n_customers,
           CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS total_balance,
           CAST(grouping(c_mktsegment, c_nationkey) AS BIGINT) AS grouping_level
    FROM customer GROUP BY {by}
    """


def _customer_totals():
    return (
        F.count(F.lit(1)).alias("n_customers"),
        money.total(money.cents("c_acctbal")).alias("total_balance"),
        F.grouping_id().alias("grouping_level"),
    )


@query(_GROUPED_CUSTOMERS.format(by="CUBE (c_mktsegment, c_nationkey)"))
def segment_cube(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "customer").cube("c_mktsegment", "c_nationkey").agg(*_customer_totals())


@query(_GROUPED_CUSTOMERS.format(by="ROLLUP (c_mktsegment, c_nationkey)"))
def segment_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "customer").rollup("c_mktsegment", "c_nationkey").agg(*_customer_totals())


@query(_GROUPED_CUSTOMERS.format(by="GROUPING SETS ((c_mktsegment), (c_nationkey), ())"))
def segment_sets(spark: SparkSession, folder: str) -> DataFrame:
    customers = load_table(spark, folder, "customer")
    sets = [["c_mktsegment"], ["c_nationkey"], []]
    return customers.groupingSets(sets, "c_mktsegment", "c_nationkey").agg(
        *_customer_totals()
    ).select("c_mktsegment", "c_nationkey", "n_customers", "total_balance", "grouping_level")


@query(
    """
    SELECT c_custkey, c_mktsegment, c_acctbal,
           CAST(row_number() OVER t AS INTEGER) AS row_number,
           CAST(rank() OVER v AS INTEGER) AS rank,
           CAST(dense_rank() OVER v AS INTEGER) AS dense_rank,
           percent_rank() OVER v AS percent_rank,
           cume_dist() OVER v AS cume_dist,
           CAST(ntile(4) OVER t AS INTEGER) AS ntile,
           lag(c_acctbal) OVER t AS previous,
           nth_value(c_acctbal, 3) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
             AS third_lowest
    FROM customer
    WINDOW v AS (PARTITION BY c_mktsegment ORDER BY c_acctbal),
           t AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)
    """
)
def customer_rankings(spark: SparkSession, folder: str) -> DataFrame:
    """Every rank of a customer within the segment, and the segment's third lowest balance."""
    customers = load_table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    ranked = rankings(ordered(customers, ["c_mktsegment"], ["c_acctbal", "c_custkey"]))
    lowest = top_k_per_group(customers, ["c_mktsegment"], ["c_acctbal", "c_custkey"], 3)
    third = lowest.where(F.col("rank_in_group") == 3).select(
        "c_mktsegment", F.col("c_acctbal").alias("third_lowest")
    )
    return lookup_join(ranked, third, ["c_mktsegment"], ["c_custkey"], 64, "left")


@query(
    """
    WITH c AS (SELECT c_mktsegment, c_nationkey, c_acctbal,
                      c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS d FROM customer)
    SELECT c_mktsegment, count(*) AS n,
           round(stddev_samp(c_acctbal), 4) AS stddev_balance,
           round(var_pop(c_acctbal), 2) AS var_balance,
           round(corr(c_acctbal, c_nationkey), 8) AS corr_nation,
           round(avg(d ** 3) / avg(d ** 2) ** 1.5, 8) AS skew_balance,
           round(kurtosis_pop(c_acctbal), 8) AS kurtosis_balance,
           round(quantile_cont(c_acctbal, 0.5), 6) AS median_balance,
           round(quantile_cont(c_acctbal, 0.9), 6) AS p90_balance
    FROM c GROUP BY c_mktsegment
    """
)
def balance_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Moments and exact quantiles of the balance per segment."""
    customers = load_table(spark, folder, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal")
    moments = customers.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.stddev_samp("c_acctbal"), 4).alias("stddev_balance"),
        F.round(F.var_pop("c_acctbal"), 2).alias("var_balance"),
        F.round(F.corr("c_acctbal", "c_nationkey"), 8).alias("corr_nation"),
        F.round(F.skewness("c_acctbal"), 8).alias("skew_balance"),
        F.round(F.kurtosis("c_acctbal"), 8).alias("kurtosis_balance"),
    )
    quantiles = exact_quantiles(
        customers, ["c_mktsegment"], "c_acctbal", {"median_balance": 0.5, "p90_balance": 0.9}
    )
    rounded = [F.round(c, 6).alias(c) for c in ("median_balance", "p90_balance")]
    return moments.join(quantiles.select("c_mktsegment", *rounded), "c_mktsegment")


@query(
    """
    SELECT c_nationkey AS nationkey FROM customer
    INTERSECT ALL SELECT s_nationkey FROM supplier
    """
)
def nation_overlap(spark: SparkSession, folder: str) -> DataFrame:
    customers = load_table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return intersect_all(customers, load_table(spark, folder, "supplier").select("s_nationkey"))


@query(
    """
    SELECT c_nationkey AS nationkey FROM customer
    EXCEPT ALL SELECT s_nationkey FROM supplier
    """
)
def nation_difference(spark: SparkSession, folder: str) -> DataFrame:
    customers = load_table(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return except_all(customers, load_table(spark, folder, "supplier").select("s_nationkey"))


@query(
    """
    SELECT l_orderkey, l_linenumber, 'quantity' AS measure, l_quantity AS amount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem
    """
)
def line_measures_long(spark: SparkSession, folder: str) -> DataFrame:
    lines = load_table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    return lines.unpivot(
        ["l_orderkey", "l_linenumber"], ["quantity", "price", "discount", "tax"], "measure", "amount"
    )


@query(
    """
    SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS order_month,
           CAST(year(o_orderdate) AS INTEGER) AS order_year,
           CAST(quarter(o_orderdate) AS INTEGER) AS order_quarter,
           CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday,
           CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week,
           CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day_number
    FROM orders
    """
)
def order_calendar(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("o_orderdate")
    return load_table(spark, folder, "orders").select(
        "o_orderkey",
        naive(F.date_trunc("month", at)).alias("order_month"),
        F.year(at).alias("order_year"),
        F.quarter(at).alias("order_quarter"),
        F.dayofweek(at).alias("weekday"),
        F.weekofyear(at).alias("iso_week"),
        F.datediff(at.cast("date"), F.lit("1995-01-01").cast("date")).alias("day_number"),
    )


@query(
    """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0
    """
)
def customer_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A repeatable one-in-ten sample of the customers."""
    customers = load_table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return hash_sample(customers, "c_custkey", 10)
