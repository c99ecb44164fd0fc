"""Cross-entropy difference: how much better a target model predicts a text than the corpus does.

Two bigram models share one vocabulary, order and smoothing: one counts the documents of a
target set, the other all documents. A document's score is its mean loss per token under the
target model less that under the background model; the lower, the closer to the target. The
vocabulary is every word that occurs, so what the models hold grows with the corpus.

Documents are gathered in steps, each with a table of its own words. A step sends its distinct
words and bigrams, by hash and with how often they occur in it, to buckets. A bucket adds up
what it was sent and answers each step with the sums for what that step sent, so counting and
looking up are one exchange. The step then has all counts that its own documents need. However
often a word or bigram occurs, a step sends it once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import mix64, stored

# prior words of the unigram model that back each context
PRIOR = 50.0
# words and bigrams that meet in one bucket; buckets grow in number, not in size
BUCKET_KEYS = 1 << 20
STEP_TOKENS = 1 << 19
WORDS, BIGRAMS = 0, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
# neither can be the hash of one word more likely than that of any other
_ENDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)


def words(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs other than ASCII white space, A-Z as a-z."""
    return data.lower().split()


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed: planes of high bytes hold next to nothing."""
    return pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


_STEPS = pa.schema([
    ("step", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("chosen", pa.list_(pa.bool_())),
    ("n_words", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("tokens", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
])
_STEPS_DDL = (
    "step long, doc_ids array<long>, lengths array<long>, chosen array<boolean>, n_words long, words binary, ids binary, "
    "tokens array<long>, docs array<long>"
)
_PACKETS = pa.schema([
    ("bucket", pa.int64()), ("kind", pa.int64()), ("step", pa.int64()), ("n", pa.int64()),
    ("keys", pa.binary()), ("corpus", pa.binary()), ("target", pa.binary()),
])
_PACKETS_DDL = "bucket long, kind long, step long, n long, keys binary, corpus binary, target binary"
_REPLIES = pa.schema([_PACKETS.field(c) for c in ("bucket", "kind", "step", "n", "corpus", "target")])
_REPLIES_DDL = "bucket long, kind long, step long, n long, corpus binary, target binary"


def steps(texts: DataFrame, step_tokens: int) -> DataFrame:
    """Documents (doc_id, chosen, data) in steps of about ``step_tokens``; tokens and docs are totals of corpus and target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, count()
        held, known, size = [], defaultdict(count().__next__), 0

        def step() -> pa.RecordBatch:
            doc_ids, chosen, arrays = zip(*held)
            lengths = np.array([len(a) for a in arrays], np.int64)
            picked = np.array(chosen, bool)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            row = {
                "step": first + next(number), "doc_ids": doc_ids, "lengths": lengths, "chosen": chosen, "n_words": len(known),
                "words": packed(hashes), "ids": packed(np.concatenate(arrays)),
                "tokens": [lengths.sum(), lengths[picked].sum()], "docs": [len(held), picked.sum()],
            }
            return pa.RecordBatch.from_pylist([row], _STEPS)

        for batch in batches:
            for doc_id, chosen, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found = words(data)
                held.append((doc_id, chosen, np.fromiter(map(known.__getitem__, found), np.uint32, len(found))))
                size += len(found) + 1
                if size >= step_tokens:
                    yield step()
                    held, known, size = [], defaultdict(count().__next__), 0
        if held:
            yield step()

    return texts.select("doc_id", "chosen", "data").mapInArrow(run, _STEPS_DDL)


class Step:
    """A step's words and bigrams: numbers in the step, hashes, and where they occur."""

    def __init__(self, n_words: int, hashed: bytes, ids: bytes, lengths: np.ndarray, chosen: np.ndarray):
        self.lengths, self.n_words = lengths, n_words
        self.hashes = np.r_[unpacked(hashed, np.uint64, n_words), _ENDS]
        self.ids = unpacked(ids, np.uint32, int(lengths.sum())).astype(np.int64)
        self.begin, self.end, self.width = n_words, n_words + 1, n_words + 2
        ends = np.cumsum(lengths)
        before, after = np.insert(self.ids, ends - lengths, self.begin), np.insert(self.ids, ends, self.end)
        self.doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.weight = chosen.astype(float)
        self.pairs, self.at = np.unique(before * self.width + after, return_inverse=True)
        self.before, self.after = self.pairs // self.width, self.pairs % self.width

    def counts(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each word or bigram occurs, in all documents and in the chosen ones."""
        if kind == WORDS:
            at, weight, n = self.ids, np.repeat(self.weight, self.lengths), self.n_words
        else:
            at, weight, n = self.at, self.weight[self.doc], len(self.pairs)
        return np.bincount(at, minlength=n).astype(np.int64), np.bincount(at, weight, n).astype(np.int64)

    def dealt(self, kind: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bucket the numbers of what it gets, and their keys in ascending order."""
        with np.errstate(over="ignore"):
            own = self.hashes[: self.n_words] if kind == WORDS else self.hashes[self.before] * _ODD + self.hashes[self.after]
        hashed = mix64(own, 1 + kind)
        # what is left of the hash tells the keys of a bucket apart with 56 bits as well as with 64
        bucket, key = hashed % np.uint64(buckets), hashed // np.uint64(buckets) & np.uint64((1 << 56) - 1)
        order = np.lexsort((key, bucket))
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                yield int(bucket[part[0]]), part, key[part]


def _opened(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[dict, Step]]:
    for row in table.to_pylist():
        yield row, Step(row["n_words"], row["words"], row["ids"], np.array(row["lengths"], np.int64), np.array(row["chosen"], bool))


def sums(stepped: DataFrame, buckets: int) -> DataFrame:
    """For each step, kind and bucket the counts over all documents of what the step sent there, in its order.

    A row of each bucket without step has the number of different words or bigrams in it.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, step in _opened(batch):
                rows = []
                for kind in (WORDS, BIGRAMS):
                    corpus, target = step.counts(kind)
                    for bucket, part, keys in step.dealt(kind, buckets):
                        sent = {"keys": packed(keys), "corpus": packed(corpus[part]), "target": packed(target[part])}
                        rows.append({"bucket": bucket, "kind": kind, "step": row["step"], "n": len(part)} | sent)
                yield pa.RecordBatch.from_pylist(rows, _PACKETS)

    def answer(packets: pa.Table) -> pa.Table:
        rows = packets.to_pylist()
        keys, at = np.unique(np.concatenate([unpacked(r["keys"], np.uint64, r["n"]) for r in rows]), return_inverse=True)
        totals = []
        for model in ("corpus", "target"):
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([unpacked(r[model], np.int64, r["n"]) for r in rows]))
            totals.append(total)
        out = [{"bucket": rows[0]["bucket"], "kind": rows[0]["kind"], "n": len(keys)}]
        ends = np.cumsum([r["n"] for r in rows])
        for r, own in zip(rows, np.split(at, ends[:-1])):
            found = {m: packed(total[own]) for m, total in zip(("corpus", "target"), totals)}
            out.append({"bucket": r["bucket"], "kind": r["kind"], "step": r["step"], "n": r["n"]} | found)
        return pa.Table.from_pylist(out, _REPLIES)

    packets = stepped.mapInArrow(send, _PACKETS_DDL)
    return packets.groupBy("bucket", "kind").applyInArrow(answer, _REPLIES_DDL)


def lm_scores(docs: DataFrame, target: DataFrame, step_tokens: int = STEP_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row of ``docs`` (doc_id, text).

    ``target`` holds the doc_id of each target document. Losses are per predicted token,
    of which a document has one more than words (its end), so a text that is null or empty
    has a score too. Every word that occurs is in the vocabulary. Without target documents the
    target model knows only the vocabulary. Rows with a null doc_id belong to no target;
    repeated rows are scored and counted as often as they occur. No rows give no rows, other
    columns are ignored. The words of a text are in one step, whatever its length. Sizes of
    steps and buckets bound memory and do not change the result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    picked = target.select(F.col("doc_id").cast("long").alias("_target")).where("_target is not null").distinct()
    named = texts.where("doc_id is not null").join(picked.hint("merge"), F.col("doc_id") == F.col("_target"), "left")
    flagged = named.select("doc_id", F.col("_target").isNotNull().alias("chosen"), "data")
    flagged = flagged.union(texts.where("doc_id is null").select("doc_id", F.lit(False), "data"))
    stepped = stored(steps(flagged, step_tokens), "lm-steps")

    totals = stepped.agg(*[F.sum(F.col(c)[m]) for c in ("tokens", "docs") for m in (0, 1)]).first()
    tokens, n_docs = (np.array([x or 0 for x in part], float) for part in (totals[:2], totals[2:]))
    buckets = max(1, math.ceil((tokens[0] + n_docs[0]) / bucket_keys))
    replies = stored(sums(stepped, buckets), "lm-sums")
    vocabulary = replies.where(f"step is null and kind = {WORDS}").agg(F.sum("n")).first()[0] or 0

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = {c: [] for c in ("doc_id", "n_tokens", "target_loss", "background_loss", "score")}
        for row, step in _opened(own):
            found = {(r["kind"], r["bucket"]): r for r in answers.to_pylist()}
            losses = []
            for m, model in enumerate(("corpus", "target")):
                summed = []
                for kind, size in ((WORDS, step.n_words), (BIGRAMS, len(step.pairs))):
                    values = np.zeros(size)
                    for bucket, part, _ in step.dealt(kind, buckets):
                        answer = found[kind, bucket]
                        values[part] = unpacked(answer[model], np.int64, answer["n"])
                    summed.append(values)
                # a document begins and ends once; its end is predicted, its begin is not
                unigrams = np.r_[summed[0], n_docs[m], n_docs[m]]
                prior = (unigrams[step.after] + 1) / (tokens[m] + n_docs[m] + vocabulary + 2)
                loss = -np.log((summed[1] + PRIOR * prior) / (unigrams[step.before] + PRIOR))
                losses.append(np.bincount(step.doc, loss[step.at], len(step.lengths)) / (step.lengths + 1))
            out["doc_id"] += row["doc_ids"]
            out["n_tokens"] += row["lengths"]
            for name, values in (("target_loss", losses[1]), ("background_loss", losses[0]), ("score", losses[1] - losses[0])):
                # sums of doubles differ in the last digits from one machine to another
                out[name] += np.round(values, 9).tolist()
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table({name: pa.array(values, t) for (name, values), t in zip(out.items(), types)})

    answers = replies.where("step is not null").groupBy("step")
    return stepped.groupBy("step").cogroup(answers).applyInArrow(
        score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    )
