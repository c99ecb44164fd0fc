"""Writing tables and exchange formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "xml", "text")

# text formats write milliseconds unless told otherwise
TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# a line that does not fit the schema ends the query; read leniently it would become NULLs
STRICT = {"mode": "FAILFAST"}
# NULL needs a mark of its own, as empty text is a value; a quote is escaped by doubling it
CSV = {
    "header": "true",
    "escape": '"',
    "nullValue": "\u0001",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> str:
    """One folder per value of ``by``.

    The rebalance hint gathers small values into few files and lets Spark split a
    value that is too large for one task. A task with few values writes their files side
    by side (see ``session.SETTINGS``), so it holds no more than their open pages; only rows
    of further values are sorted.
    """
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)
    return path


def export(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> str:
    """Write in an exchange format. ``text`` writes one JSON document per line."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known formats: {', '.join(FORMATS)}")
    if fmt == "text":
        lines = df.select(F.to_json(F.struct("*"), TIMES).alias("value"))
        lines.write.mode(mode).text(path)
        return path
    df.write.mode(mode).format(fmt).options(**_options(fmt)).save(path)
    return path


def import_rows(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType, line_breaks: bool = False
) -> DataFrame:
    """Read back what ``export`` wrote. The schema is given, never inferred by a scan.

    Rows that do not fit the schema end the query. ``line_breaks`` says that CSV fields may hold line breaks; such files are read by
    one task each, others are split.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known formats: {', '.join(FORMATS)}")
    if fmt == "text":
        lines = spark.read.text(path)
        return lines.select(F.from_json("value", schema, TIMES | STRICT).alias("r")).select("r.*")
    reader = spark.read.schema(schema).format(fmt).options(**_options(fmt))
    if fmt in ("csv", "json", "xml"):
        reader = reader.options(**STRICT)
    if fmt == "csv" and line_breaks:
        reader = reader.option("multiLine", "true")
    return reader.load(path)


def _options(fmt: str) -> dict[str, str]:
    extra = {"csv": CSV, "xml": {"rowTag": "row", "ignoreSurroundingSpaces": "false"}}.get(fmt, {})
    return extra | TIMES if fmt in ("csv", "json", "xml") else {}
