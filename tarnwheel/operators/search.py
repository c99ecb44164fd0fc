"""Term weights and ranked keyword search over a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.functions.text import tokens
from tarnwheel.operators.joins import heavy_keys, salted_join
from tarnwheel.operators.rowcounts import count_in_rows
from tarnwheel.session import scratch_path


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): how often each word occurs in each text, one text per row."""
    return count_in_rows(docs, [id_col], tokens(text_col), "term", "tf")


def tf_idf(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int | None = None
) -> DataFrame:
    """tf * ln(N / df) for every word of every text."""
    # every text is split once; document frequencies and common words come from the counts
    path = scratch_path(docs.sparkSession, "terms")
    counted = term_counts(docs, id_col, text_col)
    counted.write.parquet(path)
    counts = docs.sparkSession.read.schema(counted.schema).parquet(path)
    per_term = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # a common word is in nearly every text, so its rows are spread before the join
    heavy = heavy_keys(counts.select("term"), ["term"], rows_per_task)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return salted_join(counts, per_term, ["term"], [id_col], heavy).select(
        id_col, "term", "tf", "df", (F.col("tf") * F.log(n_docs / F.col("df"))).alias("weight")
    )


def _occurrences(words: str, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def bm25(
    docs: DataFrame,
    terms: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """(id, score) of every text that holds a search term.

    Lengths and term counts come from each row's own text and the corpus figures are
    one aggregate row, so nothing but that row crosses the network.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    words = docs.select(id_col, tokens(text_col).alias("_words"))
    hits = {f"_tf{i}": _occurrences("_words", term) for i, term in enumerate(terms)}
    counted = F.struct(F.size("_words").alias("_len"), *[h.alias(n) for n, h in hits.items()])
    # exploded, so that the filter below reads the counts and does not split the text again
    scored = words.select(id_col, F.inline(F.array(counted)))
    corpus = scored.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg("_len").alias("avg_len"),
            *[F.sum((F.col(n) > 0).cast("double")).alias(n) for n in hits],
        ).alias("c")
    ).scalar()
    score = F.lit(0.0)
    for name in hits:
        df, tf = corpus[name], F.col(name)
        idf = F.log(1 + (corpus["n"] - df + 0.5) / (df + 0.5))
        length = k1 * (1 - b + b * F.col("_len") / corpus["avg_len"])
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + length)).otherwise(0.0)
    found = F.lit(False)
    for name in hits:
        found = found | (F.col(name) > 0)
    return scored.where(found).select(id_col, score.alias("score"))
