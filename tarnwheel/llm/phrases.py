"""Phrase collocations, counted over a prefix-free parse of the corpus.

A text is a sequence of words, with a stop wherever a phrase may not go on. Wherever a hash of
as many words as a phrase has at most, less one, is a trigger, a chunk of the text ends with
them and the next one begins with them. So chunks depend on content only: a passage that comes
again anywhere is cut at the same triggers, and what texts share becomes equal chunks.
The distinct chunks of a language with how often each occurs are the dictionary. Phrases are
counted in each distinct chunk once, weighted by its frequency. A phrase that lies in the
overlap of two chunks is counted where it begins before the last words of a chunk, so only in
the second; no phrase is longer than an overlap and one word, so each lies whole in one chunk.

Counts of a step of chunks meet in buckets of phrases by hash, compressed bucket by bucket.
No step depends on how often a word, phrase or chunk occurs.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.llm.base import mix64, slices, stored

LEAST = 10
LONGEST = 3
SUBSUMED = 50
TOP = 2000
# one place in so many is a trigger
CHUNK_WORDS = 16
STEP_WORDS = 1 << 20
# phrases of a step that are spelled out at once
SPELLED = 1 << 16
# text whose phrases meet in one bucket; buckets grow in number, not in size
BUCKET_BYTES = 8 << 20
# shares of a bucket that are added up one after the other
PARTS = 8
SALTS = 64
KNOWN_WORDS = 1 << 18
UNIT = 1_000_000

STOP = b"."
_STOPS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_STOPS, STOP * len(_STOPS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def words_and_stops(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z as a-z, and a STOP where one of ``.,;:!?`` or a line break stands."""
    return data.lower().translate(_TABLE).replace(STOP, b" . ").split()


def parse(data: bytes, hashes: dict, overlap: int) -> list[bytes]:
    """The chunks of a text, each with the first ``overlap`` words of the next one; stops after the last."""
    words = words_and_stops(data)
    n = len(words)
    words += [STOP] * overlap
    found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    keys = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(overlap):
            keys = (keys + found[k : k + n]) * _ODD
    triggers = np.flatnonzero(mix64(keys) % np.uint64(CHUNK_WORDS) == 0)
    bounds = [0, *triggers[triggers > 0].tolist(), n]
    return [b" ".join(words[start : end + overlap]) for start, end in zip(bounds, bounds[1:])] if n else []


def dictionary(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, chunk and frequency of the distinct chunks of all texts of ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            parsed = [parse(t.as_buffer().to_pybytes(), hashes, longest - 1) for t in batch.column(1)]
            langs = batch.column(0).take(pa.array(np.repeat(np.arange(len(parsed)), [len(p) for p in parsed])))
            chunks = pa.array([chunk for p in parsed for chunk in p], pa.binary())
            yield pa.RecordBatch.from_arrays([langs, chunks], ["lang", "chunk"])
        # the worker goes on with other tasks: what Arrow keeps for later is given back
        pa.default_memory_pool().release_unused()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = docs.where("text is not null").select(lang, F.col("text").cast("binary").alias("data"))
    chunks = texts.mapInArrow(run, "lang string, chunk binary")
    return chunks.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("frequency"))


class _Step:
    """Chunks that are counted together; words are numbered per language in order of occurrence.

    Nothing here refers back to the step, so its memory is free as soon as the step is left.
    """

    def __init__(self):
        self.numbers = count()
        self.known: dict[str, dict[bytes, int]] = {}
        self.ids = array("i")
        self.sizes = array("q")
        self.frequencies = array("q")

    @property
    def size(self) -> int:
        return len(self.ids)

    def add(self, lang: str, chunk: bytes, frequency: int) -> None:
        if lang not in self.known:
            self.known[lang] = defaultdict(self.numbers.__next__)
        before = len(self.ids)
        self.ids.extend(map(self.known[lang].__getitem__, chunk.split(b" ")))
        self.sizes.append(len(self.ids) - before)
        self.frequencies.append(frequency)

    def _counted(self, stop: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The words of all phrases of up to ``longest`` words, a column per place (-1 for none), and their counts."""
        ids, sizes, width = np.frombuffer(self.ids, np.int32), np.frombuffer(self.sizes, np.int64), len(stop)
        ends = np.cumsum(sizes)
        begins = np.ones(len(ids), bool)
        for k in range(1, longest):
            begins[ends - k] = False
        places = np.flatnonzero(begins & ~stop[ids]).astype(np.int32)
        weight = np.repeat(np.frombuffer(self.frequencies, np.int64), sizes)[places].astype(np.float64)

        columns, rank = [np.arange(width, dtype=np.int32)], ids[places]
        numbers = np.bincount(rank, weight, width)
        found, counts = [[] for _ in range(longest)], []
        for n in range(1, longest + 1):
            seen = np.flatnonzero(numbers)
            counts.append(numbers[seen].astype(np.int64))
            for k in range(longest):
                found[k].append(columns[k][seen] if k < n else np.full(len(seen), -1, np.int32))
            if n == longest:
                break
            going = ~stop[ids[places + n]]
            places, rank, weight = places[going], rank[going], weight[going]
            keys, rank = np.unique(rank.astype(np.int64) * width + ids[places + n], return_inverse=True)
            rank = rank.astype(np.int32)
            numbers = np.bincount(rank, weight, len(keys))
            first = keys // width
            columns = [*[c[first] for c in columns], (keys % width).astype(np.int32)]
        return [np.concatenate(c) for c in found], np.concatenate(counts)

    def packets(self, buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
        """Counts of all phrases of up to ``longest`` words, one row per bucket that has some.

        Phrases are spelled out for a few buckets at a time.
        """
        langs = list(self.known)
        words = [word for lang in langs for word in self.known[lang]]
        at = np.array([i for lang in langs for i in self.known[lang].values()])
        width = len(words)
        # by number: the word, its language and its hash
        table = pa.array(words, pa.binary()).take(pa.array(np.argsort(at)))
        lang_of = np.empty(width, np.int32)
        lang_of[at] = np.repeat(np.arange(len(langs)), [len(self.known[lang]) for lang in langs])
        hashed = np.empty(width, np.uint64)
        hashed[at] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, width)
        stop = np.zeros(width, bool)
        stop[[known[STOP] for known in self.known.values() if STOP in known]] = True
        del words, at

        columns, numbers = self._counted(stop, longest)
        lang = lang_of[columns[0]]
        keys = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)[lang]
        for c in columns:
            has = np.flatnonzero(c >= 0)
            keys[has] = mix64(keys[has] * _ODD + hashed[c[has]])
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        # by part and language within a bucket
        run = (keys // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64) * len(langs) + lang
        del keys, lang
        order = np.lexsort((run, bucket))
        bucket, run, numbers = bucket[order], run[order], numbers[order]
        bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        starts, ends = bounds[:-1], bounds[1:]
        # buckets whose phrases begin in the same stretch of the list
        for group in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // SPELLED)) + 1):
            if not len(group):
                continue
            first, last = starts[group[0]], ends[group[-1]]
            own = order[first:last]
            spelled = [table.take(pa.array(c[own], mask=c[own] < 0)) for c in columns]
            joined = pc.binary_join_element_wise(*spelled, b" ", null_handling="skip")
            listed = pc.binary_join_element_wise(joined, b"", b"\n")
            offsets = np.frombuffer(listed.buffers()[1], np.int32)[listed.offset : listed.offset + len(listed) + 1]
            data = listed.buffers()[2]
            rows = []
            for start, end in zip(starts[group].tolist(), ends[group].tolist()):
                own_runs = run[start:end]
                here = np.flatnonzero(np.bincount(own_runs % len(langs), minlength=len(langs)))
                begin = np.searchsorted(own_runs, np.add.outer(np.arange(PARTS) * len(langs), here).ravel())
                text = data.slice(offsets[start - first], offsets[end - first] - offsets[start - first])
                rows.append({
                    "bucket": int(bucket[start]), "langs": [langs[x] for x in here], "starts": begin.tolist(), "size": len(text),
                    "phrases": pa.compress(text, codec="zstd", asbytes=True),
                    "counts": pa.compress(numbers[start:end].tobytes(), codec="zstd", asbytes=True), "n": end - start,
                })
            yield pa.RecordBatch.from_pylist(rows, _PACKETS)


_PACKETS = pa.schema([
    ("bucket", pa.int64()), ("langs", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("size", pa.int64()),
    ("phrases", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()),
])
_PACKETS_DDL = "bucket long, langs array<string>, starts array<int>, size long, phrases binary, counts binary, n long"


class _Unpacked:
    """The phrases (with a line break at their ends) and counts of a packet, in order of part and language."""

    def __init__(self, row: dict, known: dict[str, int]):
        text = pa.decompress(row["phrases"], row["size"], codec="zstd")
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
        offsets = pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes())
        self.phrases = pa.Array.from_buffers(pa.binary(), row["n"], [None, offsets, text])
        counts = pa.decompress(row["counts"], 8 * row["n"], codec="zstd")
        self.counts = pa.Array.from_buffers(pa.int64(), row["n"], [None, counts])
        self.starts = np.array([*row["starts"], row["n"]], np.int32)
        self.langs = np.array([known.setdefault(lang, len(known)) for lang in row["langs"]], np.int32)

    def part(self, i: int) -> pa.Table:
        """Number of the language, phrase and count."""
        bounds = self.starts[i * len(self.langs) : (i + 1) * len(self.langs) + 1]
        start, n = int(bounds[0]), int(bounds[-1] - bounds[0])
        langs = pa.array(np.repeat(self.langs, np.diff(bounds)))
        return pa.table({"lang": langs, "phrase": self.phrases.slice(start, n), "count": self.counts.slice(start, n)})


def phrase_counts(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, step_words: int = STEP_WORDS, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """lang, phrase, words and count of all phrases of up to ``longest`` words that occur ``least`` times.

    A row per language and bucket without phrase has the number of all its words. The size
    of steps and buckets bounds memory and does not change the result.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _Step()
        for batch in batches:
            for lang, chunk, frequency in zip(*(c.to_pylist() for c in batch.columns)):
                step.add(lang, chunk, frequency)
                if step.size >= step_words:
                    yield from step.packets(buckets, longest)
                    step = _Step()
        if step.size:
            yield from step.packets(buckets, longest)
        del step
        pa.default_memory_pool().release_unused()

    def meet(packets: pa.Table) -> pa.Table:
        """The phrases of a bucket that occur often enough, and the number of its words."""
        known: dict[str, int] = {}
        unpacked = [_Unpacked(row, known) for batch in packets.to_batches() for row in batch.to_pylist()]
        langs = pa.array(list(known), pa.string())
        often, totals = [], []
        for i in range(PARTS):
            table = pa.concat_tables(x.part(i) for x in unpacked).combine_chunks()
            table = table.group_by(["lang", "phrase"], use_threads=False).aggregate([("count", "sum")])
            table = table.rename_columns(["lang", "phrase", "count"])
            words = pc.add(pc.count_substring(table.column("phrase"), b" "), 1)
            table = table.append_column("words", words.cast(pa.int64()))
            totals.append(table.filter(pc.equal(table.column("words"), 1)).select(["lang", "count"]))
            often.append(table.filter(pc.greater_equal(table.column("count"), least)))
        del unpacked, table, words
        pa.default_memory_pool().release_unused()
        often, totals = pa.concat_tables(often), pa.concat_tables(totals)
        totals = totals.group_by("lang", use_threads=False).aggregate([("count", "sum")])
        phrase = pc.binary_slice(often.column("phrase"), 0, -1).cast(pa.string())
        lang, other = (langs.take(t.column("lang").combine_chunks()) for t in (often, totals))
        return pa.table({
            "lang": pa.chunked_array([lang, other], pa.string()),
            "phrase": pa.chunked_array([*phrase.chunks, pa.nulls(len(totals), pa.string())], pa.string()),
            "words": pa.chunked_array([*often.column("words").chunks, pa.array([0] * len(totals), pa.int64())], pa.int64()),
            "count": pa.chunked_array([*often.column("count").chunks, *totals.column("count_sum").chunks], pa.int64()),
        })

    packets = dictionary(docs, longest).mapInArrow(local, _PACKETS_DDL)
    return packets.groupBy("bucket").applyInArrow(meet, "lang string, phrase string, words long, count long")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, top: int = TOP, **sizes: int
) -> DataFrame:
    """The ``top`` phrases of each language whose words keep together most, in all texts of ``docs`` (lang, text).

    Phrases have 2 to ``longest`` words and occur ``least`` times or more without a stop
    (``.,;:!?`` or a line break) in between. Cut in two, a phrase of count a has the score
    floor(1,000,000 a a / (l r)) from the counts l and r of its parts; the cut with the lowest
    score counts, of equal ones the first. A phrase inside a longer one that occurs at least
    ``subsumed`` percent as often is left out.

    Returns lang, rank (by score and a, largest first, then phrase by bytes), phrase, a, l, r,
    n (words of the language) and score. Null lang is ``und``, null text has no words; ids and
    other columns are not used, repeated rows count as often as they occur, and no rows or no
    phrase often enough give no rows. A text is parsed by one task, whatever its length.
    ``sizes`` are those of ``phrase_counts``.
    """
    found = stored(phrase_counts(docs, least, longest, **sizes), "phrases-counts")
    counts = found.where("phrase is not null")
    # one row per language
    totals = found.where("phrase is null").groupBy("lang").agg(F.sum("count").alias("n"))
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"))

    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice("_words", start, size), " ")
    cut = F.col("_cut")
    cuts = (
        candidates.withColumn("_words", words)
        .withColumn("_cut", F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int"))))
        .select("lang", "phrase", "a", "_cut", part(F.lit(1), cut).alias("_left"), part(cut + 1, F.col("words").cast("int") - cut).alias("_right"))
    )
    for side, name in (("_left", "l"), ("_right", "r")):
        known = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("count").alias(name))
        # every part is listed: it occurs at least as often as the phrase
        cuts = cuts.join(known, (cuts["lang"] == known["_lang"]) & (cuts[side] == known["_part"])).drop("_lang", "_part", side)
    # counts below 10^15 leave room for the products
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r"))
    cuts = cuts.withColumns({"_top": a * a * F.lit(UNIT).cast("decimal(7,0)"), "_bottom": l * r})
    cuts = cuts.withColumn("score", F.expr("_top div _bottom"))
    lowest = F.min(F.struct("score", "_cut", "l", "r")).alias("_low")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "_low.l", "_low.r", "_low.score")

    inner = candidates.where("words > 2").withColumn("_words", words)
    inner = inner.withColumn("_size", F.explode(F.sequence(F.lit(2), (F.col("words") - 1).cast("int"))))
    inner = inner.withColumn("_start", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - F.col("_size") + 1)))
    longer = inner.groupBy(F.col("lang").alias("_lang"), part(F.col("_start"), F.col("_size")).alias("_inner")).agg(F.max("a").alias("_longer"))
    hidden = (scored["lang"] == longer["_lang"]) & (scored["phrase"] == longer["_inner"])
    kept = scored.join(longer, hidden & (100 * longer["_longer"] >= subsumed * scored["a"]), "left_anti")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    # at most ``top`` rows of each salt meet in the task that ranks a language
    nth = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    first = kept.withColumn("_salt", salt).withColumn("_nth", nth).where(F.col("_nth") <= top).drop("_nth", "_salt")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = first.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
