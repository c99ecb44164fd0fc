"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order ORDER: absolute discounting of the highest
order over raw counts, and below it over the number of different characters that precede
an n-gram. All models are kept together as sorted arrays of n-gram keys, one per order,
with one column per language: the probability where the n-gram ends a seen context, and
the weight a context passes to the next lower order. A text is scored at once for all
languages by its mean negative log-probability per character.

A text whose best mean is worse than almost all training texts of that language ever were
is rejected; the limit is calibrated by length, as short texts vary more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import mix64, slices

ORDER = 4
DISCOUNT = 0.75
# the models are fitted on about this many documents of each language at most
TRAINING_DOCS = 600
# limits are set on this many other documents of each language at most
CALIBRATION_DOCS = 1500
# nats per character beyond the worst calibration text at which a text is rejected: texts that
# mix known languages stay, other languages and random letters lie beyond
MARGIN = 1.0
PIECE_CHARS = 1 << 19
UNKNOWN = "und"
BITS = np.uint64(16)
CLASSES = 6
SHORT_MARGIN = 0.5
SCORE_LETTERS = 100


@cache
def _folded() -> np.ndarray:
    """For every code point its 16-bit letter code: lower case, accents kept; 1 for no letter.

    Letters beyond the basic plane share one code.
    """
    codes = np.ones(0x110000, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            codes[c] = min(ord(low), 0xFFFF) if len(low) == 1 else min(c, 0xFFFF)
        elif c > 127 and unicodedata.category(ch)[0] == "M":
            codes[c] = min(c, 0xFFFF)
    return codes


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all texts in one array; which text each place is in, -1 for padding;
    the length of each text in codes; and in letters.

    A run of other characters is one code 1. ORDER - 1 such codes lie before every text,
    so that its n-grams never reach into the text before it.
    """
    gap = "\n" * ORDER
    points = np.frombuffer(gap.join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _folded()[points]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER
    starts = np.r_[0, np.cumsum(sizes)] + ORDER
    # a text takes in the first character after it, as the blank that ends its last word
    text_of = np.repeat(np.arange(len(texts)), sizes)
    text_of = np.r_[np.full(ORDER, -1), text_of]
    pads = (starts[:, None] - np.arange(1, ORDER)).ravel()
    text_of[pads] = -1
    keep = np.r_[True, (codes[1:] != 1) | (codes[:-1] != 1)]
    keep[pads] = True
    inside = text_of >= 0
    letters = np.bincount(text_of[inside & (codes != 1)], minlength=len(texts))
    lengths = np.bincount(text_of[inside & keep], minlength=len(texts))
    return codes[keep].astype(np.uint64), text_of[keep], lengths, letters


def packed(codes: np.ndarray) -> np.ndarray:
    """The ORDER codes up to each place, 16 bits each; blanks before the first place."""
    grams = np.zeros(len(codes), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        shifted = np.ones(len(codes), np.uint64)
        shifted[back:] = codes[: len(codes) - back]
        grams = (grams << BITS) | shifted
    return grams


def _last(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` codes of packed n-grams."""
    return grams & np.uint64((1 << 16 * order) - 1)


@dataclass
class Model:
    """Sorted keys per order with a column per language, and the limits for rejection."""

    langs: list[str]
    keys: list[np.ndarray]  # of n-grams, by order from 1
    logs: list[np.ndarray]  # (key, language) log-probability
    contexts: list[np.ndarray]  # keys of contexts of length 1 to ORDER - 1
    backoffs: list[np.ndarray]  # (context, language) log-weight of the lower order; 0 if unseen
    floor: float  # log-probability of a character no model has seen
    limits: np.ndarray | None = None  # (language, length class) worst accepted mean


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def fit(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from the distinct highest-order n-grams (packed codes) and counts of each language."""
    langs = sorted(grams)
    tables = {}  # (language, order) -> sorted n-grams and the counts that order uses
    for lang in langs:
        keys, counts = grams[lang]
        tables[lang, ORDER] = keys, counts.astype(float)
        for order in range(ORDER - 1, 0, -1):
            # each distinct longer n-gram counts once: the number of codes that precede
            keys, counts = np.unique(_last(tables[lang, order + 1][0], order), return_counts=True)
            tables[lang, order] = keys, counts.astype(float)
    every = [np.unique(np.concatenate([tables[lang, o][0] for lang in langs])) for o in range(1, ORDER + 1)]
    floor = 1.0 / (len(every[0]) + 1)
    probs, spared = [], []
    lower = np.full((1, len(langs)), floor)
    for order in range(1, ORDER + 1):
        keys = every[order - 1]
        table = np.zeros((len(keys), len(langs)))
        heads = np.unique(keys >> BITS) if order > 1 else np.zeros(1, np.uint64)
        weight = np.ones((len(heads), len(langs)))
        for i, lang in enumerate(langs):
            own, counts = tables[lang, order]
            head = np.searchsorted(heads, own >> BITS) if order > 1 else np.zeros(len(own), np.int64)
            total = np.bincount(head, counts, len(heads))
            kinds = np.bincount(head, minlength=len(heads))
            seen = total > 0
            weight[seen, i] = DISCOUNT * kinds[seen] / total[seen]
            table[np.searchsorted(keys, own), i] = (counts - DISCOUNT) / total[head]
        at = np.searchsorted(heads, keys >> BITS) if order > 1 else np.zeros(len(keys), np.int64)
        below = np.searchsorted(every[order - 2], _last(keys, order - 1)) if order > 1 else np.zeros(len(keys), np.int64)
        lower = table + weight[at] * lower[below]
        probs.append(lower)
        spared.append((heads, weight))
    model = Model(langs, [], [], [], [], float(np.log(floor)))
    for order in range(1, ORDER + 1):
        keys = mix64(every[order - 1], order)
        by = np.argsort(keys)
        model.keys.append(keys[by])
        model.logs.append(np.log(probs[order - 1])[by].astype(np.float32))
        heads, weight = spared[order - 1]
        heads = mix64(heads, order - 1) if order > 1 else heads
        by = np.argsort(heads)
        model.contexts.append(heads[by])
        model.backoffs.append(np.log(weight)[by].astype(np.float32))
    return model


def losses(model: Model, grams: np.ndarray) -> np.ndarray:
    """(place, language) negative log-probability of each place's code after the codes before it."""
    out = np.empty((len(grams), len(model.langs)), np.float32)
    passed = np.zeros_like(out)
    left = np.arange(len(grams))
    for order in range(ORDER, 0, -1):
        own = grams[left]
        at, found = _find(model.keys[order - 1], mix64(_last(own, order), order))
        hits = left[found]
        out[hits] = -(model.logs[order - 1][at[found]] + passed[hits])
        left, own = left[~found], own[~found]
        if not len(left):
            return out
        context = mix64(_last(own >> BITS, order - 1), order - 1) if order > 1 else np.zeros(len(own), np.uint64)
        at, seen = _find(model.contexts[order - 1], context)
        passed[left[seen]] += model.backoffs[order - 1][at[seen]]
    out[left] = -(model.floor + passed[left])
    return out


def _pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts cut into pieces that bound what a step holds, and the text of each piece."""
    pieces = [(i, t[a : a + PIECE_CHARS]) for i, t in enumerate(texts) for a in range(0, max(1, len(t)), PIECE_CHARS)]
    return [t for _, t in pieces], np.array([i for i, _ in pieces], np.int64)


def mean_losses(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, language) mean loss per code, and the number of letters of each text."""
    sums = np.zeros((len(texts), len(model.langs)))
    lengths, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    pieces, text_of = _pieces(texts)
    ends = np.cumsum([len(p) for p in pieces])
    for step in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff(ends // PIECE_CHARS)) + 1):
        if not len(step):
            continue
        codes, piece_of, n, l = encoded([pieces[i] for i in step])
        inside = piece_of >= 0
        loss = losses(model, packed(codes)[inside])
        for lang in range(len(model.langs)):
            sums[:, lang] += np.bincount(text_of[step][piece_of[inside]], loss[:, lang], len(texts))
        np.add.at(lengths, text_of[step], n)
        np.add.at(letters, text_of[step], l)
    return sums / np.maximum(lengths, 1)[:, None], letters


def length_class(letters: np.ndarray) -> np.ndarray:
    """0 for up to 3 letters, 1 up to 15, 2 up to 63, and so on to 5."""
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int) // 2, CLASSES - 1)


def limits(langs: np.ndarray, letters: np.ndarray, losses: np.ndarray, n_langs: int) -> np.ndarray:
    """(language, length class) worst mean loss a text of that language may have.

    It is the worst that a calibration text of that length or longer had, and MARGIN
    more. Without such texts it is the worst of all; texts of a few letters have none.
    """
    worst = np.full((n_langs, CLASSES), -np.inf)
    np.maximum.at(worst, (langs, length_class(letters)), losses)
    worst = np.maximum.accumulate(worst[:, ::-1], axis=1)[:, ::-1]
    worst[~np.isfinite(worst)] = worst.max(initial=0.0)
    worst[:, 0] = np.inf
    worst[:, 1] += SHORT_MARGIN
    return worst + MARGIN


def _unit(salt: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(labelled: DataFrame) -> Model:
    """Models and limits from ``labelled`` rows (doc_id, text, lang).

    Of each language about TRAINING_DOCS documents are fitted on and CALIBRATION_DOCS
    others set the limits, both chosen by a hash of doc_id. Rows without text or language
    are ignored; without any row there is no language to predict.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return Model([], [], [], [], [], 0.0)
    wanted = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, 1.0 / n)])
    place = _unit(1) / wanted[F.col("lang")]  # evenly over the documents of the language
    chosen = rows.withColumn("place", place).where(F.col("place") < TRAINING_DOCS + CALIBRATION_DOCS)
    # with few documents all of them train, and the same ones set the limits
    fits = F.col("place") < TRAINING_DOCS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = np.array(batch.column(0).to_pylist())
            texts = batch.column(1).to_pylist()
            for lang in np.unique(langs):
                pieces, _ = _pieces([texts[i] for i in np.flatnonzero(langs == lang)])
                for piece in pieces:
                    codes, piece_of, _, _ = encoded([piece])
                    grams, n = np.unique(packed(codes)[piece_of >= 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    counts = chosen.where(fits).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(table.column("lang").to_pylist(), object)
    grams = table.column("gram").to_numpy().view(np.uint64)
    n = table.column("n").to_numpy()
    own = {}
    for lang in totals:
        at = np.flatnonzero(langs == lang)
        if len(at):
            at = at[np.argsort(grams[at])]
            own[lang] = grams[at], n[at]
    if not own:
        return Model([], [], [], [], [], 0.0)
    model = fit(own)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            means, letters = mean_losses(shared.value, batch.column(0).to_pylist())
            best = means.argmin(axis=1)
            arrays = [pa.array(best.astype(np.int64)), pa.array(letters), pa.array(means.min(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "letters", "loss"])

    apart = chosen.where(~fits | (F.lit(float(TRAINING_DOCS)) >= 1.0 / wanted[F.col("lang")]))
    found = apart.select("text").mapInArrow(judge, "lang long, letters long, loss double").toArrow()
    columns = [found.column(c).to_numpy() for c in ("lang", "letters", "loss")]
    has = columns[1] > 0
    model.limits = limits(*[c[has] for c in columns], len(model.langs))
    return model


def predict(model: Model, texts: list[str | None]) -> dict[str, np.ndarray]:
    """lang_pred, score, loss and rejected of each text."""
    texts = [t or "" for t in texts]
    if model.langs:
        means, letters = mean_losses(model, texts)
    else:
        means, letters = np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64)
    best, loss = means.argmin(axis=1), means.min(axis=1)
    sure = np.exp(-(means - loss[:, None]) * np.minimum(letters, SCORE_LETTERS)[:, None])
    rejected = letters == 0
    if model.langs:
        rejected |= loss > model.limits[best, length_class(letters)]
    named = [model.langs[b] if n and model.langs else UNKNOWN for b, n in zip(best, letters)]
    score = np.where([n != UNKNOWN for n in named], np.round(1 / sure.sum(axis=1), 6), 0.0)
    return {"lang_pred": np.array(named, object), "score": score, "loss": loss, "rejected": rejected | (score == 0)}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, loss and rejected of every row of ``docs`` (doc_id, text).

    A text that is null or has no letter is ``und`` with score 0 and is rejected, as all
    texts are by a model without languages. Equal losses go to the first language by name.
    ``score`` is the share of the best language among all, from 0 to 1. Rows may repeat, no
    rows give no rows; other columns are ignored. A long text is scored in pieces by one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = predict(shared.value, batch.column(1).to_pylist())
            arrays = [batch.column(0), pa.array(found["lang_pred"], pa.string()), *(pa.array(found[c]) for c in ("score", "loss", "rejected"))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "loss", "rejected"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, loss double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is not rejected.

    Texts that are null or have no letter go; repeated rows and rows without doc_id are judged
    by their text alone; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = predict(shared.value, batch.column(text).to_pylist())
            yield batch.filter(pa.array(~found["rejected"]))

    return docs.mapInArrow(run, docs.schema)
