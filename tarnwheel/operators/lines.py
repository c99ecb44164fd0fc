"""Lines that texts repeat, in themselves and across a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.operators.joins import lookup_join
from tarnwheel.operators.rowcounts import count_in_rows
from tarnwheel.sources.tables import stored

# counters of the sketch: rows of it, and counters in each
DEPTH = 2
WIDTH = 1 << 20


def lines(text: str | Column) -> Column:
    return F.split(text, "\n")


def frequent_lines(
    docs: DataFrame, more_than: int, text_col: str = "text", width: int = WIDTH, depth: int = DEPTH
) -> DataFrame:
    """(line, occurrences, documents) of the lines that occur more than ``more_than`` times, empty ones aside.

    The first pass adds up how often lines occur in ``depth`` rows of ``width`` counters, to
    which a hash deals them. A counter is never below the count of any of its lines, so only
    lines whose counters all exceed the limit can be frequent; the second pass counts these
    exactly. The counters are bounded whatever the data: where they are too few, more lines
    are counted, with the same result.
    """
    counted = count_in_rows(docs, [], F.filter(lines(text_col), lambda x: x != ""), "line", "n")
    cells = [F.pmod(F.xxhash64("line", F.lit(row)), F.lit(width)) for row in range(depth)]
    dealt = counted.select("n", F.posexplode(F.array(*cells)).alias("row", "cell"))
    full = dealt.groupBy("row", "cell").agg(F.sum("n").alias("total")).where(F.col("total") > more_than)
    full = stored(full.select("row", "cell"), "full-counters")
    candidates = counted
    for row, cell in enumerate(cells):
        # at most ``width`` rows
        own = F.broadcast(full.where(F.col("row") == row).select(F.col("cell").alias("_cell")))
        candidates = candidates.join(own, cell == F.col("_cell"), "left_semi")
    totals = candidates.groupBy("line").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))
    return totals.where(F.col("occurrences") > more_than)


def _numbered(text: str | Column) -> Column:
    """Each line with its number where it is empty, so that empty lines differ from each other."""
    return F.transform(lines(text), lambda x, i: F.struct(x.alias("line"), F.when(x == "", i).otherwise(-1).alias("no")))


def without_repeated_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each line of a text only where it first stands in that text; empty lines stay."""
    first = F.array_distinct(_numbered(text_col))
    return docs.withColumn(text_col, F.array_join(F.transform(first, lambda x: x["line"]), "\n"))


def without_corpus_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, dropped): each line only where it first stands in the corpus, by id and then by place.

    Empty lines stay. A line is known by its SHA-256. Owners of lines are folded within each
    task before they meet, and lines that occur in one text only are not looked up again. A
    text keeps the order of its lines. Null text stays null; ids are meant to be unique.
    """
    first = F.array_distinct(_numbered(text_col))
    placed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.posexplode(first).alias("_place", "_line"))
    placed = placed.where(F.col("_line.line") != "").select("_id", "_place", F.unhex(F.sha2("_line.line", 256)).alias("_digest"))
    owners = placed.groupBy("_digest").agg(F.min("_id").alias("_owner"), F.max("_id").alias("_other"))
    owners = owners.where("_owner < _other").select("_digest", "_owner")
    again = lookup_join(placed, owners, ["_digest"], ["_id"], 64).where("_id <> _owner")
    # as many places as the text has lines at most
    gone = stored(again.groupBy("_id").agg(F.collect_list("_place").alias("_gone")), "repeated-lines")
    joined = docs.join(gone, docs[id_col] == gone["_id"], "left")
    kept = F.filter(first, lambda x, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False)))
    rebuilt = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    dropped = F.size(lines(text_col)) - F.size(kept)
    return joined.select(id_col, rebuilt.alias(text_col), F.coalesce(dropped, F.lit(0)).cast("long").alias("dropped"))
