"""Amounts are exact or refused."""

import pytest
from pyspark.sql import functions as F

from tarnwheel.functions import money
from tarnwheel.functions.sql import register_functions


def amounts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "amount double").repartition(2)


def test_sums_are_exact(spark):
    values = [0.1, 0.2, -0.3, 1.15, 1e11 + 0.07, None, 123456789.01, -0.0]
    got = amounts(spark, *values).agg(money.total(money.cents("amount")).alias("t")).first()["t"]
    assert got == sum(round(v * 100) for v in values if v is not None) / 100


@pytest.mark.parametrize("value", [0.004, 1.005, 1e-7 * 1e4, float("nan"), float("inf"), 123456.789])
def test_other_amounts_end_the_query(spark, value):
    with pytest.raises(Exception, match="more than 2 decimals"):
        amounts(spark, 1.0, value).agg(money.total(money.cents("amount"))).collect()
    register_functions(spark)
    amounts(spark, 1.0, value).createOrReplaceTempView("money_rows")
    with pytest.raises(Exception, match="more than 2 decimals"):
        spark.sql("SELECT sum(tarnwheel_cents(amount)) FROM money_rows").collect()


def test_null_and_finer_units(spark):
    df = amounts(spark, None, 0.004)
    assert df.where("amount is null").select(money.cents("amount").alias("c")).first()["c"] is None
    assert df.agg(money.total(money.units("amount", 3), 3).alias("t")).first()["t"] == 0.004
    assert df.agg(F.count(money.units("amount", 3)).alias("n")).first()["n"] == 1
