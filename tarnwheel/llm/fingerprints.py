"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is hashed to a wide vector made of the bits of its SHA-256: LANES lanes of one
bit each and WORDS words of 32 bits. The fingerprint of a text is the number of its
paragraphs and the sum of their vectors, each lane and word modulo 2 ** 32. It does not
depend on the order of paragraphs, equal multisets have equal fingerprints, and a paragraph
is inserted or deleted by adding or subtracting its vector, without the rest of the text.

The words tell multisets apart. The lanes tell how much two multisets share: with a bit
read as +1 or -1 a lane is a random signed count, so the mean square of the difference of
two fingerprints estimates how many paragraphs the texts do not share.

A paragraph ends after a line break or the end of a sentence, and after MOST_CHARS characters
without either. All text belongs to some paragraph, white space included.

Everything is DataFrame expressions. A vector in work is an array of longs, of which each
holds two lanes or two words: sums cannot run over below 2 ** 31 paragraphs, more than a
string of Spark can hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.operators.ordered import CHUNK, arrange, cut_points

MOST_CHARS = 256
PARAGRAPH = rf"[^.!?\n]{{1,{MOST_CHARS}}}[.!?\n]*|[.!?\n]+"
LANES = 256
WORDS = 8
HALF = WORDS // 2
# documents in descending order of doc_id that are looked at together
ROWS_PER_CHUNK = 8192

_LOW = (1 << 32) - 1
_BOTH = (1 << 32) | 1


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text in order; joined they are the text. Null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))


def _packed(digest: Column, k: int) -> Column:
    """Words k (low half) and k + HALF (high half) of a hexadecimal digest."""
    low, high = (F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("long") for j in (k, k + HALF))
    return F.shiftleft(high, 32).bitwiseOR(low)


def vector(pieces: Column) -> Column:
    """The sum of the vectors of an array of paragraphs.

    Entry 0 is their number, then come the sums of WORDS words, then of LANES lanes in pairs.
    """
    zero = F.lit(0).cast("long")

    def summed(words: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(words, zero, lambda total, x: total + value(x))

    def lanes(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(31)), lambda bit: summed(words, lambda x: _shifted(x, bit).bitwiseAND(F.lit(_BOTH)))
        )

    def sums(columns: Column) -> Column:
        parts = [columns[f"w{k}"] for k in range(HALF)]
        low = [summed(w, lambda x: x.bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW)) for w in parts]
        high = [summed(w, lambda x: F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(_LOW)) for w in parts]
        head = F.array(F.size(parts[0]).cast("long"), *low, *high)
        return F.concat(head, *map(lanes, parts))

    def column(digests: Column, k: int) -> Column:
        return F.transform(digests, lambda digest: _packed(digest, k)).alias(f"w{k}")

    def columns(digests: Column) -> Column:
        return F.struct(*[column(digests, k) for k in range(HALF)])

    return _let(F.transform(pieces, lambda p: F.sha2(p, 256)), lambda digests: _let(columns(digests), sums))


def combined(one: Column, other: Column, sign: int = 1) -> Column:
    """The vector of two multisets together, or with sign -1 of ``one`` without ``other``, which it contains."""
    whole = F.zip_with(one, other, lambda a, b: a + F.lit(sign) * b)
    # words are kept modulo 2 ** 32; the other entries do not reach it
    return F.transform(whole, lambda x, i: F.when(i.between(1, WORDS), x.bitwiseAND(F.lit(_LOW))).otherwise(x))


def printed(v: Column) -> Column:
    """The fingerprint as hexadecimal digits: eight for the number of paragraphs, each word and each lane."""
    digits = F.transform(v, lambda x, i: F.lpad(F.hex(x), F.when(i <= WORDS, 8).otherwise(16), "0"))
    return F.lower(F.array_join(digits, ""))


def _signed_square(one: Column, other: Column) -> Column:
    """The sum over all lanes of (one - other) squared, with lanes as signed counts."""
    zero = F.lit(0.0)

    def squares(count: Column) -> Column:
        def add(total: Column, x: Column) -> Column:
            # both differences come out of one long: the low half may borrow from the high one
            low = x.bitwiseAND(F.lit(_LOW))
            low = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)
            high = F.shiftright(x - low, 32)
            a, b = ((2 * part - count).cast("double") for part in (low, high))
            return total + a * a + b * b

        lanes = F.zip_with(F.slice(one, WORDS + 2, LANES // 2), F.slice(other, WORDS + 2, LANES // 2), lambda a, b: a - b)
        return F.aggregate(lanes, zero, add)

    return _let(F.get(one, 0) - F.get(other, 0), squares)


def likeness(one: Column, other: Column) -> Column:
    """About the share of paragraphs that two vectors have in common, from 0 to 1.

    The estimate is twice the inner product of the multisets over the sum of their squares,
    with a standard error of about 1 / sqrt(LANES). Equal fingerprints have likeness 1; a text
    without paragraphs is like no text that has some.
    """
    nothing = F.transform(one, lambda x: F.lit(0).cast("long"))
    whole = _signed_square(one, nothing) + _signed_square(other, nothing)
    apart = _signed_square(one, other)
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - apart / whole))


def with_next(docs: DataFrame, made: dict[str, Column] | None = None, rows_per_chunk: int | None = None) -> DataFrame:
    """Add the columns ``made`` and ``next``, a struct of all columns of the next row: descending doc_id, after the last the first.

    Rows without doc_id come after all others; rows that share a doc_id follow each other
    by ascending text and meet in one task. The table is cut into chunks along that order;
    each chunk gets a copy of the first row of the chunk after it.
    """
    made = made or {}
    columns = [*docs.columns, *made]
    placed = docs.withColumns({
        "_none": F.col("doc_id").isNull().cast("int"),
        # descending without overflow
        "_down": F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(0).cast("long")),
    })
    order = ["_none", "_down"]
    cuts = cut_points(placed.select(*order), [], order, rows_per_chunk or ROWS_PER_CHUNK)

    def chunked(rows: DataFrame) -> DataFrame:
        found = arrange(rows, [], order, cuts).rows
        return found if cuts else found.withColumn(CHUNK, F.lit(0))

    # one row per chunk from here: its first place, and the chunk before it
    firsts = chunked(placed.select(*order)).groupBy(CHUNK).agg(F.min(F.struct(*order)).alias("_first"))
    by_chunk = Window.orderBy(CHUNK)
    before = F.coalesce(F.lag(CHUNK).over(by_chunk), F.max(CHUNK).over(Window.partitionBy(F.lit(0))))
    firsts = firsts.withColumn("_before", before)
    at = F.broadcast(firsts.select("_first", "_before"))
    edges = placed.join(at, F.struct(*order) == F.col("_first")).groupBy("_before")
    edges = edges.agg(F.min_by(F.struct(*docs.columns, *order), F.struct("text")).alias("_row"))
    # the columns are made of the few rows that are edges, not of all that are looked at for them
    edges = edges.select(F.lit(1).alias("_edge"), F.col("_before").cast("int").alias(CHUNK), "_row.*").withColumns(made)
    rows = chunked(placed).select(F.lit(0).alias("_edge"), CHUNK, *order, *docs.columns).withColumns(made)
    rows = rows.unionByName(edges)
    follows = Window.partitionBy(CHUNK).orderBy("_edge", *order, F.col("text"))
    found = rows.withColumn("next", F.lead(F.struct(*columns)).over(follows))
    return found.where("_edge = 0").select(*columns, "next")


def fingerprints(docs: DataFrame, rows_per_chunk: int | None = None) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its text after an edit.

    The edit replaces the last floor(n_chars / 2) characters by as many from the start of
    the next document's text (see ``with_next``), or all it has. Returns doc_id, n_chars
    (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next:
    the likeness of the fingerprint to that of the edited text and of the next document.

    Null text counts as empty; an empty text has no paragraph and fingerprint zero. The only
    row of a table is its own next. Repeated rows stay repeated, no rows give no rows, other
    columns are ignored. A text is one value of one row, whatever its length.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_chars = F.length("text").cast("long")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next.text", F.lit(1), half))
    rows = with_next(texts, {"vector": vector(paragraphs(F.col("text")))}, rows_per_chunk).withColumn("edited", edited)
    # as items of an array the edited text is put together, and hashed, once
    row = F.struct(F.col("edited"), vector(paragraphs(F.col("edited"))).alias("vector"))
    rows = rows.select("doc_id", n_chars.alias("n_chars"), "vector", F.col("next.vector").alias("next_vector"), F.inline(F.array(row)).alias("edited", "edited_vector"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("vector")).alias("fingerprint"),
        printed(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
