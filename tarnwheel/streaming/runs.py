"""Running a stream over all input there is, into a table.

Sinks and checkpoints lie in the shared scratch folder, so a stream continues after
a lost executor or a restart, and results are files rather than driver memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnwheel.session import scratch_path


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append final rows to Parquet files at ``path``, exactly once."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def append_table(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    path = scratch_path(spark, label)
    append_to(stream, path, f"{path}-checkpoint")
    return spark.read.schema(stream.schema).parquet(path)


def batch_table(
    spark: SparkSession, stream: DataFrame, step: Callable[[DataFrame], DataFrame], schema: T.StructType, label: str
) -> DataFrame:
    """What ``step`` makes of each micro-batch, as one table.

    Within a batch Spark plans as for any table: by sizes, and again at run time. A batch
    that is tried again replaces its own folder.
    """
    path = scratch_path(spark, label)

    # a table without rows is one, too
    spark.createDataFrame([], schema).write.parquet(f"{path}/batch=none")

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _each_batch(stream, write, "append", path)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def complete_table(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """The whole result after the last micro-batch; each batch replaces the table."""
    path = scratch_path(spark, label)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    _each_batch(stream, replace, "complete", path)
    return spark.read.schema(stream.schema).parquet(path)


# after so many micro-batches their updates become one table
FOLD_EVERY = 16


def update_table(
    spark: SparkSession, stream: DataFrame, keys: Sequence[str], label: str, fold_every: int | None = None
) -> DataFrame:
    """The latest row of every key. A batch that is tried again replaces its own folder.

    Every ``fold_every`` batches what has been kept is folded to one row per key, so what is
    read in the end is that row and the updates of so many batches, however long the stream runs.
    """
    path = scratch_path(spark, label)
    fold_every = fold_every or FOLD_EVERY
    values = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    folded = [-1]

    def latest(upto: int) -> DataFrame:
        """One row per key from the last fold and the batches after it."""
        folders = [f"{path}/fold={folded[0]}"] if folded[0] >= 0 else []
        folders += [f"{path}/batch={b}" for b in range(folded[0] + 1, upto + 1)]
        rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
        newest = F.max_by(F.struct(*values, "_batch"), F.col("_batch")).alias("latest")
        return rows.groupBy(*keys).agg(newest).select(*keys, "latest.*")

    last = [-1]

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        last[0] = batch_id
        if (batch_id + 1) % fold_every == 0:
            latest(batch_id).write.mode("overwrite").parquet(f"{path}/fold={batch_id}")
            folded[0] = batch_id

    _each_batch(stream, keep, "update", path)
    return latest(last[0]).select(*stream.columns)


def _each_batch(stream: DataFrame, write, mode: str, path: str) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def rows_dropped_as_late(query: StreamingQuery) -> int:
    """Rows the watermark dropped, as Spark counts them: after aggregation within a task."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
