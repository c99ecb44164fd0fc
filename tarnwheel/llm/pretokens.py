"""Splitting texts into the pieces that byte-level merges work on, one by one.

Long texts are first cut where a blank follows a visible character: a piece never reaches
across such a place and what comes after does not depend on what lies before it, so every
part can be split by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import regex

PART_CHARS = 1 << 16

_CUT = regex.compile(r"(?<=\S)(?=\s)")
# tokenizers agree below this code point and may know other Unicode versions above it
_FIRST_UNSURE = 0x530
_LAST_ASSIGNED = 0x40000
_UNSURE = re.compile(f"[{chr(_FIRST_UNSURE)}-\U0010ffff]")
_CLASSES = {"letter": regex.compile(r"\p{L}"), "number": regex.compile(r"\p{N}"), "blank": regex.compile(r"\s")}
# a character of each class to stand in for others; the letter is in no contraction, and
# the blank is not the space that a piece may begin with
STAND_INS = {"letter": "é", "number": "1", "blank": "\n", "other": "!"}


def cut(text: str, at_least: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``at_least`` characters, cut only where pieces end."""
    start = 0
    while len(text) - start > at_least:
        found = _CUT.search(text, start + at_least)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def class_fixes(joined: Callable[[str], bool]) -> dict[int, str]:
    """Characters that a tokenizer puts in another class than ``regex`` does, with a stand-in.

    ``joined`` tells whether the tokenizer keeps a two-character text in one piece.
    """
    fixes = {}
    for code in range(_FIRST_UNSURE, _LAST_ASSIGNED):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        own = next((name for name, has in _CLASSES.items() if has.match(ch)), "other")
        if not joined(STAND_INS[own] + ch):
            fixes[code] = next(s for s in STAND_INS.values() if joined(s + ch))
    return fixes


# how byte-level tokenizers split: contractions, then letters, numbers and signs with one
# space before them, then blanks
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranges(name: str) -> str:
    """The sure characters of a class, for a character set."""
    own = [c for c in range(_FIRST_UNSURE) if _CLASSES[name].match(chr(c))]
    starts = [c for c in own if c - 1 not in own]
    ends = [c for c in own if c + 1 not in own]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def _plain_byte_level() -> re.Pattern:
    """BYTE_LEVEL for texts of sure characters only: sets spelled out, likely pieces first.

    Letters and numbers may go before contractions, as no piece of theirs begins alike.
    """
    letter, number, blank = map(_ranges, ("letter", "number", "blank"))
    sign = f"[^{blank}{letter}{number}]"
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?{sign}+|[{blank}]+(?![^{blank}])|[{blank}]+")


class Splitter:
    """Pieces of a text by ``pattern``, with the character classes of the tokenizer it stands for."""

    def __init__(self, pattern: str = BYTE_LEVEL, fixes: dict[int, str] | None = None):
        self.find = regex.compile(pattern)
        self.plain = _plain_byte_level() if pattern == BYTE_LEVEL else None
        self.fixes = fixes or {}

    def pieces(self, text: str) -> list[str]:
        if not _UNSURE.search(text):
            return (self.plain or self.find).findall(text)
        stand_in = text.translate(self.fixes) if self.fixes else text
        if stand_in == text:
            return self.find.findall(text)
        return [text[m.start() : m.end()] for m in self.find.finditer(stand_in)]
