"""Which spans of texts repeat word n-grams of a reference collection, such as a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.functions.text import tokens
from tarnwheel.operators import joins
from tarnwheel.sources.tables import stored

NGRAM = 8


def _places(n: int) -> Column:
    """Place and hash of every ``n`` words of the array column ``words``."""
    last = F.size("words") - n
    hashed = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get("words", i + k) for k in range(n)]).alias("hash")),
    )
    return F.when(last >= 0, hashed)


def _gram(place: Column, n: int) -> Column:
    return F.array_join(F.slice("words", place + 1, F.lit(n)), " ")


def ngram_hits(docs: DataFrame, reference: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place): every place of a text where ``n`` words stand that stand so in some text of ``reference``.

    Places count words from 0. A hash finds them and the words themselves decide. The n-grams
    of ``reference`` go to every task if they are small, and texts are then not moved at all;
    otherwise places are spread by hash, heavy hashes over salts, and only those that meet a
    hash go back to their text.
    """
    known = reference.select(tokens(text_col).alias("words")).select("words", F.inline(_places(n)))
    known = known.select("hash", _gram(F.col("place"), n).alias("gram")).groupBy("hash").agg(F.collect_set("gram").alias("grams"))
    known = stored(known, "known-ngrams")
    size = known.agg(F.sum(64 + F.octet_length(F.array_join("grams", "")))).first()[0] or 0

    words = docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("words"))
    same = F.array_contains("grams", _gram(F.col("place"), n))
    if size <= joins.BROADCAST_BYTES:
        placed = words.select("id", "words", F.inline(_places(n)))
        found = placed.join(F.broadcast(known), "hash").where(same)
    else:
        placed = words.select("id", F.inline(_places(n)))
        heavy = joins.heavy_keys(placed.select("hash"), ["hash"])
        met = joins.salted_join(placed, known, ["hash"], ["id", "place"], heavy)
        met = stored(met.select(F.col("id").alias("_id"), "place", "grams"), "met-ngrams")
        found = words.join(met, words["id"] == met["_id"]).where(same)
    return found.select(F.col("id").alias(id_col), "place").distinct()


def covered_spans(hits: DataFrame, n: int = NGRAM, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_words, hits): the words that hits cover, with hits that touch or overlap as one span."""
    by_place = Window.partitionBy(id_col).orderBy("place")
    begins = F.coalesce(F.col("place") > F.lag("place").over(by_place) + n, F.lit(True))
    numbered = hits.withColumn("_begins", begins.cast("int")).withColumn("_span", F.sum("_begins").over(by_place))
    spans = numbered.groupBy(id_col, "_span").agg(
        F.min("place").cast("long").alias("start"),
        (F.max("place") - F.min("place") + n).cast("long").alias("n_words"),
        F.count(F.lit(1)).alias("hits"),
    )
    return spans.drop("_span")


def coverage(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, covered, n_spans) of every text; one without words or spans has none covered."""
    sizes = docs.select(id_col, F.coalesce(F.size(tokens(text_col)), F.lit(0)).cast("long").alias("n_words"))
    per_text = spans.groupBy(F.col(id_col).alias("_id")).agg(F.sum("n_words").alias("covered"), F.count(F.lit(1)).alias("n_spans"))
    joined = sizes.join(per_text, sizes[id_col] == per_text["_id"], "left").drop("_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("covered", "n_spans")})
