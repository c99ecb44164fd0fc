"""Reading tables, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.session import scratch_path

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# input of one micro-batch; a backlog of 100 TB makes about 1,500 of them
BYTES_PER_BATCH = 64 << 30


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a lazy scan; columns and filters chosen later reach the Parquet reader."""
    if name not in TABLES:
        raise KeyError(f"no table {name!r}; known tables: {', '.join(TABLES)}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back from there.

    What follows is planned from files of known size, and a lost executor costs the tasks
    it ran instead of all that came before.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, by: str) -> DataFrame:
    """For heavy work per row: use every core of one machine when a scan has fewer splits.

    On a cluster the scan is returned as it is; there texts would cross the network.
    """
    if not scan.sparkSession.sparkContext.master.startswith("local["):
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, by)


def stream_table(
    spark: SparkSession, folder: str, name: str, event_time: str | None = None,
    files_per_batch: int | None = None, bytes_per_batch: int | None = None,
) -> DataFrame:
    """The same table as a file stream.

    A micro-batch takes at most ``bytes_per_batch`` (BYTES_PER_BATCH) of input, one file at
    least, so a backlog is worked off in batches of bounded size; or, where it is given,
    ``files_per_batch`` files. ``event_time`` is cast to a zoned timestamp, which watermarks
    require.
    """
    reader = spark.readStream.schema(load_table(spark, folder, name).schema)
    if not files_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch or BYTES_PER_BATCH)
    else:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a glob, the path may be one file or a folder of files
    rows = reader.parquet(f"{folder.rstrip('/')}/{{{name}}}.parquet")
    return rows.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else rows
