"""Chat formatting: conversations as training windows of whole turns within a token budget.

Prefix sums of turn tokens lay a conversation on one line, which is cut into slots of the
budget's free part. The turns that lie inside a slot make one window, and a turn that
crosses into the next slot makes one of its own, so no window's new turns exceed a slot
unless one turn alone does. A window repeats the conversation's system turn and as many of
the turns just before it as fit the history budget; loss is taken on the assistant's texts
among its new turns only, so each of them is a target once.

The template marks where a turn begins, where its text begins and where it ends. Control
strings inside roles and texts are broken by a backslash after their first character, and
backslashes are doubled, which can be undone without loss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import stored
from tarnwheel.operators.ordered import ordered, running_sum

BEGIN, HEAD, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (BEGIN, HEAD, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and how many of them repeated turns may take."""

    tokens: int = 1024
    history: int = 256
    # what new turns may take at least, however long the system turn is
    least: int = 128


def escape(text: Column) -> Column:
    tails = "|".join(f"\\Q{c[1:]}\\E" for c in CONTROL)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"([<\\[])(?={tails})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), escape(role), F.lit(HEAD), escape(text), F.lit(END))


def quarter_bytes(turn: Column) -> Column:
    """Tokens of a rendered turn, at four bytes a token."""
    return F.ceil(F.octet_length(turn) / 4)


def _turns(rows: DataFrame, tokens: Column | None) -> DataFrame:
    """Turns with their place on the conversation's line, in tokens and in characters."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNull().alias("unplaced"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.xxhash64(role, text).alias("tie"),
        role.alias("role"),
        rendered(role, text).alias("rendered"),
        F.length(escape(text)).alias("text_chars"),
        *([] if tokens is None else [tokens.alias("tokens")]),
    )
    if tokens is None:
        turns = turns.withColumn("tokens", quarter_bytes(F.col("rendered")))
    turns = turns.withColumn("chars", F.length("rendered").cast("long"))
    line = {"nth": F.lit(1), "to_token": F.col("tokens"), "to_char": F.col("chars")}
    placed = running_sum(ordered(turns, ["conv_id"], ["unplaced", "turn", "tie"]), line)
    return stored(
        placed.select(
            "conv_id", "nth", "role", "rendered", "tokens", "chars", "text_chars",
            (F.col("to_token") - F.col("tokens")).alias("token"),
            (F.col("to_char") - F.col("chars")).alias("char"),
        ),
        "chat-turns",
    )


def windows(rows: DataFrame, budget: Budget | None = None, tokens: Column | None = None) -> DataFrame:
    """Training windows of the conversations in ``rows`` (conv_id, turn, role, text).

    Returns conv_id, window (ascending within a conversation), formatted, repeated (how
    many turns at its start have been in an earlier window) and loss: the places in
    ``formatted`` that are targets, as start (from 0) and length in characters.

    Turns are ordered by ``turn``, null last; rows of the same turn by a hash of role and
    text, and equal rows are turns of their own. Null role and text are empty. Null is a
    conversation of its own. ``tokens`` counts a turn (of at least 1), by default by bytes.
    A turn longer than the budget is a window of its own, uncut. No rows give no rows; other
    columns are ignored.
    """
    budget = budget or Budget()
    turns = _turns(rows, tokens)
    system = turns.where("nth = 1 and role = 'system'").select(
        F.col("conv_id").alias("_conv"), F.col("rendered").alias("system"), F.col("tokens").alias("_taken")
    )
    turns = turns.join(system, turns["conv_id"].eqNullSafe(system["_conv"]), "left").drop("_conv")
    room = F.greatest(F.lit(budget.tokens - budget.history) - F.coalesce("_taken", F.lit(0)), F.lit(budget.least))
    turns = turns.withColumn("room", room)

    def slot(at: Column) -> Column:
        return F.floor(at / F.col("room"))

    first, last = slot(F.col("token")), slot(F.col("token") + F.col("tokens") - 1)
    own = 2 * first + (last > first).cast("long")
    # later windows that may begin within the history budget of this turn
    reach = F.greatest(2 * slot(F.col("token") + budget.history) + 1, own)
    placed = turns.withColumn("own", own).withColumn("window", F.explode(F.sequence(own, reach)))
    member = F.struct(
        "nth", "token", "char", (F.col("window") == F.col("own")).alias("new"),
        (F.col("role") == "assistant").alias("target"), "chars", "text_chars", "rendered",
    )
    grouped = placed.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(member)).alias("turns"), F.first("system").alias("system"))
    begin = F.array_min(F.transform(F.filter("turns", lambda t: t["new"]), lambda t: t["token"]))
    near = F.filter("turns", lambda t: t["new"] | (t["token"] >= F.col("begin") - budget.history) & (t["token"] < F.col("begin")))
    kept = grouped.withColumn("begin", begin).where("begin is not null").withColumn("turns", near)
    # where the turns reach back to the first one, the system turn is among them
    lead = F.when(F.col("turns")[0]["nth"] > 1, F.coalesce("system", F.lit(""))).otherwise(F.lit(""))
    kept = kept.withColumn("lead", lead)
    shift = F.length("lead") - F.col("turns")[0]["char"]
    targets = F.filter("turns", lambda t: t["new"] & t["target"])
    end = F.lit(len(END))
    return kept.select(
        "conv_id",
        "window",
        F.concat("lead", F.array_join(F.transform("turns", lambda t: t["rendered"]), "")).alias("formatted"),
        (F.size(F.filter("turns", lambda t: ~t["new"])) + (F.length("lead") > 0).cast("int")).alias("repeated"),
        F.transform(
            targets,
            lambda t: F.struct(
                (t["char"] + t["chars"] - end - t["text_chars"] + shift).cast("int").alias("start"),
                t["text_chars"].cast("int").alias("length"),
            ),
        ).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The new turns and the target texts of each window, unescaped, from its formatted text.

    Columns: conv_id, window, chars (of the formatted text), turns (array of role and
    text), targets (array of text).
    """
    parts = F.split("formatted", f"\\Q{END}\\E", -1)
    new = F.slice(parts, F.col("repeated") + 1, F.size(parts) - 1 - F.col("repeated"))

    def turn(part: Column) -> Column:
        halves = F.split(part, f"\\Q{HEAD}\\E", 2)
        return F.struct(
            unescape(F.substr(halves[0], F.lit(len(BEGIN) + 1))).alias("role"), unescape(halves[1]).alias("text")
        )

    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", F.length("formatted").alias("chars"), F.transform(new, turn).alias("turns"), targets.alias("targets"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, loss_chars, formatted_chars and digests.

    A digest covers a whole conversation, so its text is put together in one row here.
    """
    back = read_back(formatted)
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    part = F.struct("window", F.array_join(said, "").alias("said"), F.array_join("targets", "").alias("targets"))
    whole = back.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )

    def joined(field: str) -> Column:
        return F.array_join(F.transform("parts", lambda p: p[field]), "")

    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("targets")).cast("long").alias("loss_chars"),
        F.sha2(joined("targets"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
