"""Quality selection by importance resampling over hashed n-grams.

Two generative models give each hashed feature (word or pair of words, in FEATURES buckets)
a probability: one from the target documents, one from all. A document's weight is the log
of their ratio over its features. Adding Gumbel noise to the log-weights and taking the
highest samples documents without replacement in proportion to their weights.

A whole text has as many features as it has words, and a plain sum would let length decide;
the mean ratio is scaled to the same number of features for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import mix64, numbered, slices, stored

FEATURES = 10_000
SMOOTHING = 1.0
SCALE = 100.0
KEEP = 0.8
SEED = 5
KNOWN_WORDS = 1 << 20


class _Hashes(dict):
    """64-bit hashes of the words seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def features(data: bytes, hashes: dict[bytes, int]) -> np.ndarray:
    """Buckets of the words and word pairs of a UTF-8 text; A-Z count as a-z."""
    words = np.array([*map(hashes.__getitem__, data.lower().split())], np.uint64)
    with np.errstate(over="ignore"):
        pairs = mix64(words[:-1] * np.uint64(3) + words[1:], 1)
    return (np.concatenate([words, pairs]) % np.uint64(FEATURES)).astype(np.uint16)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def ratios(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log-ratio of target and raw probability of every feature, counted over all documents."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            packed = [features(d, hashes).tobytes() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "features"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES), np.int64)
        for batch in slices(batches):
            for packed, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.bincount(np.frombuffer(packed, np.uint16), minlength=FEATURES)
                total[0] += counts
                if chosen:
                    total[1] += counts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES)), pa.array(total[0]), pa.array(total[1])], ["feature", "raw", "target"])

    rows = _texts(docs).mapInArrow(featured, "doc_id long, features binary")
    chosen = target.select(F.col("doc_id").cast("long").alias("_target")).where("_target is not null").distinct()
    flagged = rows.join(chosen.hint("merge"), rows["doc_id"] == chosen["_target"], "left")
    counts = flagged.select("features", F.col("_target").isNotNull()).mapInArrow(count, "feature long, raw long, target long")
    # FEATURES rows
    sums = counts.groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    total = np.zeros((2, FEATURES))
    at = sums.column("feature").to_numpy()
    total[0, at], total[1, at] = sums.column("raw").to_numpy(), sums.column("target").to_numpy()
    logs = np.log((total + SMOOTHING) / (total + SMOOTHING).sum(axis=1, keepdims=True))
    return logs[1] - logs[0]


def importance(docs: DataFrame, target: DataFrame, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_ratio (mean per feature), log_weight, key and selected of every row.

    ``target`` holds the doc_id of each target document. The rows with the highest keys,
    log-weight and Gumbel noise, are selected: a share ``keep`` of all rows, rounded; ties
    go to the smaller doc_id. The noise depends on seed and doc_id only, so reruns agree.
    A text that is null or has no words has log-weight 0. Rows with a null doc_id belong to
    no target; repeated rows are counted and ranked as rows of their own. No rows give no rows;
    other columns are ignored. The features of a text are one value of one row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios(docs, target))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            found = [features(d, hashes) for d in batch.column(1).to_pylist()]
            means = [float(shared.value[f].mean()) if len(f) else 0.0 for f in found]
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(means, pa.float64())], ["doc_id", "n_features", "log_ratio"])

    scored = _texts(docs).mapInArrow(weigh, "doc_id long, n_features long, log_ratio double")
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = scored.withColumn("log_weight", F.col("log_ratio") * SCALE).withColumn("key", F.col("log_weight") - F.log(-F.log(unit)))
    # written first: dealing rows to ranges reads them twice
    weighed = stored(weighed, "importance-weights")
    placed = stored(numbered(weighed, [F.col("key").desc(), F.col("doc_id").asc_nulls_last()], "place"), "importance")
    wanted = round(keep * placed.count())
    return placed.withColumn("selected", F.col("place") < wanted).drop("place")
