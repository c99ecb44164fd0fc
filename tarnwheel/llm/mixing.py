"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get targets in words by weight. Whole blocks of equal size are allocated to the
sources by highest quotients, and each source's blocks in the same way to its shards,
which gives every shard an integer quota. Within a shard documents lie on one line in
seeded order, and the quota's blocks are spaced evenly over the line from a seeded start;
a quota above the number of blocks takes each of them once or twice. How many words of a
document the blocks cover follows from its place on the line, so no block becomes a row.

Everything is DataFrame expressions. A source of any size is cut into shards of about
SHARD_WORDS words, which are windowed one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwheel.llm.base import numbered, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
# keeps the ranking of one source's shards within a task; beyond it shards grow instead
MAX_SHARDS = 1 << 16
SEED = "mix-1"


@dataclass(frozen=True)
class Plan:
    """What to mix: weights that repeat over the sources in order, and the size of the mix."""

    weights: Sequence[int] = WEIGHTS
    share: float = SHARE
    block_words: int = BLOCK_WORDS
    shard_words: int = SHARD_WORDS
    seed: str = SEED


def seeded(seed: str, salt: str, *columns: str) -> Column:
    """A number in [0, 2^60) from a hash of the columns, the same on every run."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words; null text has none."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def with_targets(sources: DataFrame, plan: Plan) -> DataFrame:
    """Add ``target``: a share of all words by weight, at most MOST times the source's own.

    What targets above their limit leave over is shared again by weight. The level that
    words per unit of weight settle at rises until no more targets stop.
    """
    number = F.col("source_no") % len(plan.weights)
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), (number + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight), "mix-sources")
    limit = F.col("source_size") * MOST
    level, stopped = 0.0, -1
    while True:
        stops = limit < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.count(F.when(stops, 1)).alias("stopped"),
            F.sum(F.when(stops, limit)).alias("used"),
            F.sum(F.when(~stops, F.col("weight"))).alias("weights"),
        ).first()
        if row["stopped"] == stopped or not row["weights"]:
            break
        stopped = row["stopped"]
        level = (plan.share * (row["total"] or 0) - (row["used"] or 0)) / row["weights"]
    target = F.when(limit < F.lit(level) * F.col("weight"), limit.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target)


def sainte_lague(parties: DataFrame, group: Sequence[str], party: str, votes: str, seats: str) -> DataFrame:
    """``won``: how many of its group's ``seats`` each party gets by highest quotients.

    A party's quotients are votes / 1, votes / 3, votes / 5 and so on; ties go to the
    smaller ``party``. Seats that any divisor method gives are taken as won, and only the
    few quotients near the cut, about four per party, are ranked.
    """
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, count = F.sum(votes).over(own), F.count(F.lit(1)).over(own)
    share = F.when(F.col("_total") > 0, F.col(votes) / F.col("_total")).otherwise(F.lit(0.0))
    spread = F.col("_count") / 2
    low = F.floor(share * F.greatest(F.col(seats) - spread, F.lit(0.0)) + 0.5) - 1
    high = F.floor(share * (F.col(seats) + spread) + 0.5) + 1
    bounded = (
        parties.withColumns({"_total": total, "_count": count})
        .withColumns({"_low": F.greatest(low, F.lit(0)).cast("long"), "_high": high.cast("long")})
        .withColumn("_open", F.col(seats) - F.sum("_low").over(own))
    )
    # a party without votes has no quotient to win with
    next_seats = F.sequence(F.col("_low"), F.when(F.col(votes) > 0, F.col("_high")).otherwise(F.col("_low")))
    near = bounded.withColumn("_seat", F.explode(next_seats)).withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") + 1))
    ranked = near.withColumn("_rank", F.row_number().over(own.orderBy(F.col("_quotient").desc(), party, "_seat")))
    gained = F.count(F.when((F.col("_rank") <= F.col("_open")) & (F.col(votes) > 0), 1))
    return ranked.groupBy(*group, party).agg((F.first("_low") + gained).alias("won"))


def mix(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """How many words of each document of ``docs`` (doc_id, source, text) the mix takes.

    Returns doc_id, size, source_size, target and taken (repeats counted). Null text has
    size 0; null is a source of its own, the last; rows with a null doc_id are placed by
    their size. Repeated rows are documents of their own. A document is taken twice at
    most. No rows, or only empty texts, give targets and words of 0. Only the size of a text
    counts, whatever it is; other columns are ignored.
    """
    plan = plan or Plan()
    sized = stored(sizes(docs), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / plan.shard_words), F.lit(1)), F.lit(MAX_SHARDS))
    sources = with_targets(numbered(sources, [F.col("source").asc_nulls_last()], "source_no"), plan).withColumn("shards", shards)
    placed = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.select(
        "doc_id", "size", "source_size", "target", "source_no",
        F.pmod(seeded(plan.seed, "shard", "doc_id"), F.col("shards")).alias("shard"),
        seeded(plan.seed, "order", "doc_id").alias("place"),
    )
    placed = stored(placed, "mix-placed")
    words = F.sum("size").alias("words")
    lines = placed.groupBy("source_no", "shard").agg(words, F.first("target").alias("target"))
    lines = stored(lines.where("words > 0"), "mix-lines")
    lines = _quotas(lines, plan)

    own = Window.partitionBy("source_no", "shard")
    before = own.orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0))
    found = placed.withColumn("start", start).join(lines, ["source_no", "shard"], "left")
    taken = _covered(F.col("start") + F.col("size")) - _covered(F.col("start"))
    return found.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def _quotas(lines: DataFrame, plan: Plan) -> DataFrame:
    """Blocks and quota of every shard: first by source over all blocks, then within the source."""
    blocks = F.greatest(F.round(F.col("words") / plan.block_words), F.lit(1)).cast("long")
    lines = lines.withColumn("blocks", blocks)
    parties = lines.groupBy("source_no").agg(F.first("target").alias("target"))
    wanted = parties.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / plan.block_words).cast("long"))
    by_source = sainte_lague(wanted, [], "source_no", "target", "seats").withColumnRenamed("won", "seats")
    by_shard = sainte_lague(lines.join(by_source, "source_no"), ["source_no"], "shard", "words", "seats")
    first = F.pmod(seeded(plan.seed, "start", "source_no", "shard"), F.col("blocks"))
    return lines.join(by_shard, ["source_no", "shard"]).select(
        "source_no", "shard", "words", "blocks",
        F.least(F.col("won"), F.col("blocks") * MOST).alias("quota"),
        first.alias("first"),
    )


def _covered(x: Column) -> Column:
    """Words that the quota's blocks take of the first ``x`` words of a shard's line.

    Block i covers words from i * words / blocks on; (i * quota + first) div blocks copies
    lie before it. All in whole numbers.
    """
    words, blocks, quota = F.col("words"), F.col("blocks"), F.col("quota")

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    block = div(x * blocks, words)
    copies = div(block * quota + F.col("first"), blocks)
    here = div((block + 1) * quota + F.col("first"), blocks) - copies
    return div(copies * words + here * (x * blocks - block * words), blocks)


def mixed(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The documents of the mix as whole rows: none, one or two of each, with all columns.

    A document is repeated as often as its words are taken; what is left over is rounded
    up or down by a seeded draw, so a source keeps its words on average. Rows that share
    a doc_id are repeated alike.
    """
    plan = plan or Plan()
    drawn = seeded(plan.seed, "copy", "doc_id") / F.lit(float(1 << 60))
    share = F.col("taken") / F.col("size")
    copies = F.when(F.col("size") > 0, F.floor(share) + (drawn < share - F.floor(share)).cast("long")).otherwise(F.lit(1))
    counted = mix(docs, plan).select("doc_id", copies.alias("copies")).groupBy("doc_id").agg(F.min("copies").alias("copies"))
    counted = stored(counted.where("copies > 0"), "mix-copies")
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("id"))
    joined = rows.join(counted.hint("merge"), rows["id"].eqNullSafe(counted["doc_id"]))
    return joined.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")
