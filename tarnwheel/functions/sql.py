"""Tables and helper functions by name, for use in ``spark.sql``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from tarnwheel.sources.tables import load_table

# all names begin alike, so that none replaces a view or function of the session's owner
PREFIX = "tarnwheel_"

# whole cents; amounts with more decimals end the query
_CENTS = (
    "CASE WHEN {0} IS NULL THEN NULL "
    "WHEN NOT isnan({0}) AND abs({0} * 100 - rint({0} * 100)) <= 1e-6D + abs({0} * 100) * 4e-16D THEN CAST(rint({0} * 100) AS BIGINT) "
    "ELSE CAST(raise_error(concat('amount ', CAST({0} AS STRING), ' has more than 2 decimals')) AS BIGINT) END"
)

SQL_FUNCTIONS = {
    "cents(amount DOUBLE) RETURNS BIGINT": _CENTS.format("amount"),
    # price * (1 - discount) in units of 1 / 10,000
    "net_units(price DOUBLE, discount DOUBLE) RETURNS BIGINT": (
        f"({_CENTS.format('price')}) * (100 - ({_CENTS.format('discount')}))"
    ),
    "words(content STRING) RETURNS ARRAY<STRING>": r"array_remove(split(lower(content), '\\s+'), '')",
}


def register_functions(spark: SparkSession) -> None:
    """SQL functions are inlined into the plan, so they stay in generated code."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{signature} RETURN {body}")


def register_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Views of the named tables; only these are opened."""
    for name in names:
        load_table(spark, folder, name).createOrReplaceTempView(f"{PREFIX}{name}")


def unregister(spark: SparkSession, names: Sequence[str]) -> None:
    """Take away the views of the named tables and all functions; queries made before keep working."""
    for name in names:
        spark.catalog.dropTempView(f"{PREFIX}{name}")
    for signature in SQL_FUNCTIONS:
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {PREFIX}{signature.split('(')[0]}")
