"""Personal data in texts: spans by kind with a precedence, redaction, and a map that undoes it.

Kinds are looked for one after the other. What a kind has found is written over, character by
character, with characters of a private block of Unicode that stand for the kind and for the
character itself. So no later kind can find any part of it, places stay what they are, and
the found text can be read back. The first character of a span is from another block than
the rest, which tells spans apart that touch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASCII = "".join(map(chr, range(0x20, 0x7F)))
# of the second private plane; blocks of 256 characters, two for each kind
BLOCK, BLOCK_SIZE = 0x100000, 0x100
ALL_BLOCKS = r"[\x{100000}-\x{100FFF}]"


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number, a string of digits of even length, is right."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda x: x.cast("int") <= 255)


@dataclass(frozen=True)
class Kind:
    """What to look for; ``valid`` may refuse a match, which then is open to later kinds."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None


# a boundary of ASCII words; patterns match printable ASCII only
_BEFORE, _AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
KINDS = (
    Kind("EMAIL", r"[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+"),
    Kind("CARD", _BEFORE + r"(?:[0-9][ -]?){15}[0-9]" + _AFTER, lambda found: luhn(F.regexp_replace(found, "[ -]", ""))),
    Kind("PHONE", r"\+[0-9][0-9 ()-]{7,}[0-9]"),
    Kind("IP", _BEFORE + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _AFTER, _octets),
)


def blocks(number: int) -> tuple[str, str]:
    """The characters that stand for ASCII in spans of a kind: as their first one, and after it."""
    first = BLOCK + 2 * number * BLOCK_SIZE
    return tuple("".join(chr(start + ord(c)) for c in ASCII) for start in (first, first + BLOCK_SIZE))


def _span_pattern(number: int) -> str:
    start = BLOCK + 2 * number * BLOCK_SIZE
    return rf"[\x{{{start:x}}}-\x{{{start + 0xFF:x}}}][\x{{{start + 0x100:x}}}-\x{{{start + 0x1FF:x}}}]*"


def covered(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The text with all spans written over; characters of the private block become U+FFFD first."""
    text = F.regexp_replace(text, ALL_BLOCKS, "�")
    for number, kind in enumerate(kinds):
        # as items of an array what goes before is put together once, not at each use
        text = F.get(F.transform(F.array(text), _cover(kind, *blocks(number))), 0)
    return text


def _cover(kind: Kind, first: str, rest: str) -> Callable[[Column], Column]:
    def over(found: Column) -> Column:
        written = F.concat(F.translate(F.left(found, F.lit(1)), ASCII, first), F.translate(F.substring(found, F.lit(2), F.length(found)), ASCII, rest))
        return written if kind.valid is None else F.when(kind.valid(found), written).otherwise(found)

    def cover(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        between = F.split(text, kind.pattern, -1)
        return F.array_join(F.zip_with(between, found, lambda part, x: F.concat(part, F.coalesce(over(x), F.lit("")))), "")

    return cover


def redacted(covered_text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """A covered text with each span as the name of its kind in brackets."""
    for number, kind in enumerate(kinds):
        covered_text = F.regexp_replace(covered_text, _span_pattern(number), f"[{kind.name}]")
    return covered_text


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with redacted texts and ``n_spans``, the number of spans. Null text stays null, with none."""
    hidden = docs.withColumn("_covered", covered(F.col(text_col), kinds))
    counts = [F.regexp_count("_covered", F.lit(_span_pattern(number))) for number in range(len(kinds))]
    n_spans = F.coalesce(sum(counts[1:], counts[0]), F.lit(0)).cast("long")
    return hidden.withColumns({text_col: redacted(F.col("_covered"), kinds), "n_spans": n_spans}).drop("_covered")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The map: (id, kind, start, length, found) of every span, with places in characters of the original text.

    Only texts with a span are taken apart; the running length of their pieces gives the places.
    """
    hidden = docs.select(F.col(id_col).alias("_id"), covered(F.col(text_col), kinds).alias("_covered"))
    hidden = hidden.where(F.col("_covered").rlike(ALL_BLOCKS)).withColumn("_row", F.monotonically_increasing_id())
    pattern = "|".join([*map(_span_pattern, range(len(kinds))), ALL_BLOCKS.replace("[", "[^", 1) + "+"])
    pieces = hidden.select("_id", "_row", F.posexplode(F.regexp_extract_all("_covered", F.lit(pattern), F.lit(0))).alias("_nth", "_piece"))
    before = Window.partitionBy("_row").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)))
    kind, found = F.lit(None).cast("string"), F.col("_piece")
    for number, one in enumerate(kinds):
        first, rest = blocks(number)
        kind = F.when(F.col("_piece").rlike("^" + _span_pattern(number)), one.name).otherwise(kind)
        found = F.translate(F.translate(found, first, ASCII), rest, ASCII)
    named = placed.withColumns({"kind": kind, "found": found}).where("kind is not null")
    return named.select(F.col("_id").alias(id_col), "kind", F.col("start").cast("long").alias("start"), F.length("found").cast("long").alias("length"), "found")


def restored(text: str, found: list[tuple[int, str, str]]) -> str:
    """The original of one redacted text, given its spans as (start, kind, found)."""
    out, at, length = [], 0, 0
    for start, kind, original in sorted(found):
        plain = text[at : at + start - length]
        out += [plain, original]
        at += len(plain) + len(kind) + 2
        length = start + len(original)
    return "".join(out) + text[at:]
