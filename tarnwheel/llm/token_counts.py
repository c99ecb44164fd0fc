"""Token counts by a tokenizer compiled to a finite-state transducer.

Within a piece (a word with its blank, a number, a run of signs) the transducer reads one
byte per step, and each transition carries by how many tokens the encoding of what has been
read so far changes. A state holds what later bytes can depend on: the places at which a
longer token may still begin, the token that ends there, and how many tokens lie between
there and here. It is deterministic, because only one token can end the encoding of a
prefix: the one that is compatible with the token that ends where it begins. States and
transitions are compiled when a text first needs them and then kept.

A text is cut into chunks at any character. A chunk's effect on the scan is a map from the
piece open at its start to the count and the piece open at its end. After the first place
where every piece must end the map no longer depends on its argument, so it is kept as the
text before that place, the count up to the last such place, and the text after it. Maps
compose associatively and are combined by a prefix scan in pairs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tarnwheel.llm.base import slices
from tarnwheel.llm.merges import Merges
from tarnwheel.llm.pretokens import BYTE_LEVEL, Splitter, class_fixes

CHUNK_CHARS = 1 << 16
MAX_STATES = 1 << 16
KNOWN_PIECES = 1 << 18
LONG_PIECE = 64
_PIECE_ENDS = regex.compile(r"(?<=\S)(?=\s)")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """A deterministic automaton over the bytes of a piece whose transitions emit token counts."""

    def __init__(self, merges: Merges):
        self.merges = merges
        # proper prefixes of tokens: where one is open, a token may still end later
        self.open = {t[:n] for i, t in enumerate(merges.tokens) if merges.usable[i] for n in range(len(t))}
        self.clear()

    def clear(self) -> None:
        # at the start a token may begin here, after no token
        self.states: dict[tuple, int] = {(b"", ((0, -1, 0),)): 0}
        self.meaning: list[tuple] = [(b"", ((0, -1, 0),))]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def count(self, data: bytes) -> int:
        """Tokens of one piece."""
        state = total = 0
        steps = self.steps
        for byte in data:
            step = steps[state].get(byte)
            if step is None:
                step = self._compile(state, byte)
            state, emitted = step
            total += emitted
        if len(self.steps) > MAX_STATES:
            self.clear()
        return total

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of ``state`` under ``byte``, as (next state, emitted tokens)."""
        tail, starts = self.meaning[state]
        tail += bytes([byte])
        merges = self.merges
        for back, token, behind in starts:
            i = merges.ids.get(tail[len(tail) - back - 1 :], -1)
            if i >= 0 and merges.usable[i] and (token < 0 or merges.compatible(token, i)):
                break
        else:
            raise ValueError("the vocabulary lacks a token for a byte")
        # as many tokens as where it begins, and itself
        emitted = behind + 1
        still = [(b + 1, t, n - emitted) for b, t, n in starts if tail[len(tail) - b - 1 :] in self.open]
        still.append((0, i, 0))
        longest = still[0][0]
        key = tail[len(tail) - longest :], tuple(still)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.steps)
            self.meaning.append(key)
            self.steps.append({})
        self.steps[state][byte] = found, emitted
        return found, emitted


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to the scan: ``head`` ends the open piece, ``tail`` opens one.

    Without ``settled`` no place in the chunk ends every piece, and ``head`` is all of it.
    """

    head: str
    count: int = 0
    tail: str = ""
    settled: bool = False


class Known(dict):
    """Counts of pieces seen before; a new one runs through the transducer and is remembered."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> int:
        n = self.transducer.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONG_PIECE:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Token counts of whole texts for one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        vocabulary = spec["model"]["vocab"]
        order = [raw(t) for t, _ in sorted(vocabulary.items(), key=lambda item: item[1])]
        merged = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in merged]
        # by merge order: bytes first, then what each merge makes
        tokens = [t for t in order if len(t) == 1] + [a + b for a, b in pairs]
        if len(tokens) != len(set(tokens)) or set(tokens) != set(order):
            raise ValueError(f"{path}: every token must be a byte or made by exactly one merge")
        ids = {t: i for i, t in enumerate(tokens)}
        made_by = {ids[a + b]: (ids[a], ids[b]) for a, b in pairs}
        self.transducer = Transducer(Merges(tokens, made_by))
        self.splitter = Splitter(BYTE_LEVEL, _byte_level_fixes())
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known = Known(self.transducer)

    def _pieces(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.splitter.pieces(text)))

    def between(self, text: str) -> int:
        """Tokens of a text at whose ends pieces end; a special string is one token."""
        if self.special is None or not self.special.search(text):
            return self._pieces(text)
        plain = self.special.split(text)
        return sum(map(self._pieces, plain)) + len(plain) - 1

    def chunk(self, text: str) -> ChunkMap:
        first = _PIECE_ENDS.search(text)
        if not first:
            return ChunkMap(text)
        # words are short, so the last such place is looked for from near the end
        reach, ends = 64, []
        while not ends:
            start = max(first.start(), len(text) - reach)
            ends = [m.start() for m in _PIECE_ENDS.finditer(text, start)]
            reach *= 8
        settled = self.between(text[first.start() : ends[-1]])
        return ChunkMap(text[: first.start()], settled, text[ends[-1] :], True)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks."""
        if not a.settled and not b.settled:
            return self.chunk(a.head + b.head)
        if not a.settled:
            joined = self.chunk(a.head + b.head)
            if joined.settled:
                return ChunkMap(joined.head, joined.count + self.between(joined.tail) + b.count, b.tail, True)
            return ChunkMap(a.head + b.head, b.count, b.tail, True)
        if not b.settled:
            joined = self.chunk(a.tail + b.head)
            if joined.settled:
                # the open piece began at a sure place, so it ends surely too
                return ChunkMap(a.head, a.count + self.between(joined.head) + joined.count, joined.tail, True)
            return ChunkMap(a.head, a.count, a.tail + b.head, True)
        return ChunkMap(a.head, a.count + self.between(a.tail + b.head) + b.count, b.tail, True)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed, neighbours first, in rounds of half as many."""
        while len(maps) > 1:
            pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        return maps[0]

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text."""
        if len(text) <= chunk_chars:
            return self.between(text)
        whole = self.scan([self.chunk(text[a : a + chunk_chars]) for a in range(0, len(text), chunk_chars)])
        return self.between(whole.head) + whole.count + self.between(whole.tail)


@cache
def _byte_level_fixes() -> dict[int, str]:
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return class_fixes(lambda pair: len(splitter.pre_tokenize_str(pair)) == 1)


@cache
def counter(path: str) -> Counter:
    """One compiled tokenizer per worker process and file."""
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Null text counts as empty, which has no tokens. Special strings inside a text are one
    token each. Rows may repeat, no rows give no rows, other columns are ignored. A long text
    is cut into chunks that one task counts. ``path`` is a tokenizer file that workers can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = counter(path)
        for batch in slices(batches):
            counts = [compiled.count(t) for t in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
