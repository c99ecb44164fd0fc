"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.operators.neighbours import build_index, exact_neighbours, recall, search, unit_vectors
from tarnwheel.operators.vectors import label_means, nearest_to_mean
from tarnwheel.plans.registry import query
from tarnwheel.sources.tables import load_table, stored

_MEANS = """
    SELECT label, CAST(pos - 1 AS INTEGER) AS pos, avg(CAST(embedding[pos] AS DOUBLE)) AS mean
    FROM embeddings, range(1, 65) AS r(pos) GROUP BY label, pos
    """


@query(f"SELECT label, pos, round(mean, 8) AS mean FROM ({_MEANS})")
def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    means = label_means(load_table(spark, folder, "embeddings"))
    return means.withColumn("mean", F.round("mean", 8))


@query(
    f"""
    WITH c AS (SELECT label, list(mean ORDER BY pos) AS centre FROM ({_MEANS}) GROUP BY label),
         s AS (SELECT e.label, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre) AS sim
               FROM embeddings e JOIN c ON c.label = e.label)
    SELECT label, vec_id, round(sim, 8) AS similarity,
           CAST(row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS INTEGER) AS rank_in_group
    FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) <= 5
    """
)
def nearest_to_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors of each label nearest to the label's mean."""
    nearest = nearest_to_mean(load_table(spark, folder, "embeddings"), 5)
    return nearest.withColumn("similarity", F.round("similarity", 8))


_NEIGHBOURS = """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
         s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.v, c.v) AS sim
               FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank, vec_id,
           round(sim, 8) AS similarity
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 10
    """


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("similarity", 8).alias("similarity"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = stored(unit_vectors(load_table(spark, folder, "embeddings")), "embeddings")
    return vectors, vectors.where(F.col("id") % 50 == 0)


@query(_NEIGHBOURS)
def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest neighbours by cosine of every fiftieth vector, among all vectors."""
    vectors, queries = _vectors(spark, folder)
    return _shown(exact_neighbours(vectors, queries, 10))


@query()
def knn_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the inverted index, which looks at the nearest cells only."""
    vectors, queries = _vectors(spark, folder)
    return _shown(search(build_index(vectors, 10), queries, 10))


@query(f"SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS nine_in_ten FROM ({_NEIGHBOURS})")
def knn_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index finds nine in ten of the exact neighbours, or more."""
    vectors, queries = _vectors(spark, folder)
    counted = recall(search(build_index(vectors, 10), queries, 10), exact_neighbours(vectors, queries, 10))
    return counted.select("queries", "neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("nine_in_ten"))
