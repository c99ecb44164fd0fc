"""Exact duplicates by digest, screened by binary-fuse filters and proven byte by byte.

What has been taken in before is an immutable ``Snapshot``: exact buckets of digests and,
for each bucket, a static filter. An incoming batch first groups its own duplicates, so
one row per digest goes on whatever the size of a group; the filter of its bucket turns
most new digests away, and the rest is joined with the exact bucket. Every group found in
this way is then compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.llm import fuse
from tarnwheel.llm.base import stored, task_salts

KEYS_PER_BUCKET = 1 << 17


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Snapshot:
    """Groups of equal digests that will not change, and the filters over them."""

    entries: DataFrame  # bucket, digest, top, size, salts
    filters: DataFrame  # bucket, filter
    buckets: int


def digest_rows(
    docs: DataFrame, in_snapshot: Column, salts: int, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """doc_id, old, digest, salt and text. Null text counts as empty. The salt spreads a group."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(in_snapshot, F.lit(False)).alias("old"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.select(
        "doc_id",
        "old",
        digest(F.col("text")).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
        "text",
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: largest doc_id, number of rows, and the salts that occur.

    Rows are first counted per digest and salt, which spreads a group of any size over
    as many tasks as there are salts; at most one row per salt meets in the second step.
    """
    per_salt = rows.groupBy("digest", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("size"))
    return per_salt.groupBy("digest").agg(
        F.max("top").alias("top"), F.sum("size").alias("size"), F.collect_list("salt").alias("salts")
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def seal(groups: DataFrame) -> Snapshot:
    """Make a snapshot of ``grouped`` rows. Buckets grow in number, not in size."""
    groups = stored(groups, "dedup-groups")
    buckets = max(1, math.ceil(groups.count() / KEYS_PER_BUCKET))
    entries = groups.withColumn("bucket", _bucket(buckets))

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "filter": pa.array([fuse.build(keys)], pa.binary())})

    keyed = entries.select("bucket", F.xxhash64("digest", F.lit(1)).alias("key"))
    filters = keyed.groupBy("bucket").applyInArrow(build, "bucket int, filter binary")
    return Snapshot(entries, stored(filters, "dedup-filters"), buckets)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``batch`` (one row per digest) with ``maybe``: whether the snapshot may hold the digest.

    A bucket's rows are dealt to several tasks, with the filter repeated for each, where
    the batch is larger than the snapshot was.
    """
    parts = max(1, math.ceil(batch.count() / (snapshot.buckets * KEYS_PER_BUCKET)))
    keyed = batch.select(
        _bucket(snapshot.buckets).alias("bucket"),
        F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(parts)).cast("int").alias("part"),
        "digest",
        F.xxhash64("digest", F.lit(1)).alias("key"),
    )
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and left.num_rows:
            maybe = fuse.contains(right.column("filter")[0].as_py(), left.column("key").to_numpy().view(np.uint64))
        else:
            maybe = np.zeros(left.num_rows, bool)
        return pa.table({"digest": left.column("digest"), "maybe": pa.array(maybe)})

    cogroups = keyed.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part"))
    return cogroups.applyInArrow(probe, "digest binary, maybe boolean")


def merge_batch(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """All groups of more than one row over the snapshot and the batch together.

    Columns as of ``grouped``. Digests that pass the screen meet the exact entries;
    those that do not, and the snapshot's own, keep the size they had.
    """
    batch = stored(batch, "dedup-batch")
    positives = screen(batch, snapshot).where("maybe").select("digest")
    old = snapshot.entries.select("digest", F.col("top").alias("old_top"), F.col("size").alias("old_size"), F.col("salts").alias("old_salts"))
    hits = stored(positives.join(batch, "digest").join(old, "digest"), "dedup-hits")
    both = hits.select(
        "digest",
        # greatest() skips nulls: a null id ranks below every id
        F.greatest("top", "old_top").alias("top"),
        (F.col("size") + F.col("old_size")).alias("size"),
        F.array_union("salts", "old_salts").alias("salts"),
    )
    alone = batch.where("size > 1").union(snapshot.entries.where("size > 1").select(*batch.columns))
    return both.union(alone.join(hits.select("digest"), "digest", "left_anti"))


def _per_salt(groups: DataFrame) -> DataFrame:
    return groups.select("digest", F.col("top").alias("keep_id"), F.col("size").alias("group_size"), F.explode("salts").alias("salt"))


def differing_texts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests of ``groups`` under which ``rows`` hold more than one text (a collision).

    Texts are compared within digest and salt, then one text per salt within the digest.
    """
    bounds = [F.min("text").alias("low"), F.max("text").alias("high")]
    # always the same join: a broadcast of the groups would not last as they grow
    members = rows.join(_per_salt(groups).select("digest", "salt").hint("merge"), ["digest", "salt"])
    per_salt = members.groupBy("digest", "salt").agg(*bounds)
    per_digest = per_salt.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return per_digest.where("low <> high").select("digest")


def _assigned(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The group of each row; digests outside ``groups`` stand alone."""
    found = rows.join(_per_salt(groups), ["digest", "salt"], "left")
    nth = F.row_number().over(Window.partitionBy("digest", "salt", "doc_id").orderBy(F.lit(0)))
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1))).alias("kept"),
    )


def exact_dedup(
    docs: DataFrame, in_snapshot: Column | None = None, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """The group of equal texts of each row of ``docs`` (doc_id, text).

    Returns one row per row: doc_id, digest, keep_id (largest doc_id of the group),
    group_size, kept. ``in_snapshot`` says which rows have been taken in before (by
    default half of them, by a hash of doc_id); the result does not depend on it.

    Null text counts as empty. A null doc_id ranks below every other. Where the doc_id
    that stays occurs in several rows of the group, exactly one of them is kept. No rows
    give no rows; other columns are ignored.
    """
    in_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    texts = digest_rows(docs, in_snapshot, task_salts(docs), digest)
    rows = stored(texts.drop("text"), "dedup-rows")
    snapshot = seal(grouped(rows.where("old")))
    groups = stored(merge_batch(grouped(rows.where("not old")), snapshot), "dedup-multi")
    report = _assigned(rows, groups)
    collided = stored(differing_texts(texts, groups), "dedup-collided")
    if collided.isEmpty():
        return report
    # several texts under one digest: there the text itself is the group
    apart = texts.join(collided, "digest").select("doc_id", "salt", F.col("text").cast("binary").alias("digest"))
    apart = stored(apart, "dedup-apart")
    by_text = _assigned(apart, grouped(apart).where("size > 1"))
    by_text = by_text.withColumn("digest", digest(F.col("digest").cast("string")))
    return report.join(collided, "digest", "left_anti").select(*by_text.columns).union(by_text)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each text."""
    kept = stored(exact_dedup(docs).where("kept").select("doc_id", "digest"), "dedup-kept")
    rows = docs.select(
        F.struct("*").alias("whole"),
        F.col("doc_id").cast("long").alias("id"),
        sha256(F.coalesce(F.col("text"), F.lit(""))).alias("text_digest"),
    )
    match = rows["id"].eqNullSafe(kept["doc_id"]) & (rows["text_digest"] == kept["digest"])
    found = rows.join(kept.hint("merge"), match, "left_semi")
    repeated = stored(_repeated_ids(docs), "dedup-repeated")
    if repeated.isEmpty():
        return found.select("whole.*")
    # an id that occurs in several rows may have kept more than one row of its text
    again = found["id"].eqNullSafe(repeated["again"])
    once = found.join(repeated, again, "left_anti")
    more = found.join(repeated, again, "left_semi").dropDuplicates(["id", "text_digest"])
    return once.union(more).select("whole.*")


def _repeated_ids(docs: DataFrame) -> DataFrame:
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("again")).agg(F.count(F.lit(1)).alias("n"))
    return ids.where("n > 1").select("again")
