"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a piece become Latin-1 characters, in which one Aho-Corasick pass finds the
longest token that starts at every byte. The piece is then covered from the left: the
longest token that is compatible with its left neighbour is taken; where none is, the last
token is given up for the next shorter one, and a place found to lead nowhere is not tried
again, so a piece takes time in proportion to its length. The result is exactly what
applying the merges in order gives, without applying any.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cache


import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.llm.base import slices
from tarnwheel.llm.merges import Merges
from tarnwheel.llm.pretokens import Splitter, class_fixes, cut

KNOWN_PIECES = 1 << 18
LONG_PIECE = 64


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a rank file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"ranks in {path} do not run from 0 without gaps")
    return [token for _, token in ranked]


class Pieces(dict):
    """The packed ids of pieces seen before; a new one is encoded and remembered."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encode(piece)).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Token ids of texts and bytes of ids, by the ranks of ``tokens``."""

    def __init__(self, tokens: list[bytes], pattern: str, fixes: dict[int, str] | None = None):
        self.merges = Merges(tokens)
        self.splitter = Splitter(pattern, fixes)
        self.longest = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            if self.merges.usable[i]:
                self.longest.add_word(token.decode("latin-1"), i)
        self.longest.make_automaton()
        self.pieces = Pieces(self._piece)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, piece after piece."""
        known = self.pieces.__getitem__
        return np.frombuffer(b"".join([b"".join(map(known, self.splitter.pieces(part))) for part in cut(text)]), np.int32)

    def forget(self) -> None:
        """Drop what was remembered of the texts encoded so far; ids do not depend on it."""
        self.pieces.clear()
        self.merges.agreed.clear()

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.merges.ids.get(data)
        return [whole] if whole is not None else self._cover(data)

    def _cover(self, data: bytes) -> list[int]:
        merges = self.merges
        sizes, shorter, agreed = merges.sizes, merges.next_usable, merges.agreed
        n = len(data)
        longest = [-1] * (n + 1)
        # of the matches that start at a byte the longest is found last
        for end, i in self.longest.iter(data.decode("latin-1")):
            longest[end + 1 - sizes[i]] = i
        taken = [longest[0]]
        dead = set()
        at = sizes[longest[0]]
        token = longest[at]
        while at < n:
            left = taken[-1] << 32 if taken else -1
            while token >= 0:
                end = at + sizes[token]
                if (left < 0 or agreed[left | token]) and end not in dead:
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at, token = end, longest[end]
            else:
                # nothing fits here: shorten what led here
                dead.add(at)
                token = taken.pop()
                at -= sizes[token]
                token = shorter[token]
        return taken


def decoded(vocabulary: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The bytes of each list of ids, by the tokens in ``vocabulary``."""
    if len(ids) and not (0 <= ids.min() and ids.max() < len(vocabulary)):
        raise ValueError("an id is outside the vocabulary")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), vocabulary.take(pa.array(ids))), b"")


@cache
def _vocabulary(path: str) -> pa.Array:
    """The tokens alone, which is all that decoding needs."""
    return pa.array(read_ranks(path), pa.binary())


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(read_ranks(path), pattern, _tiktoken_fixes(pattern))


@cache
def _tiktoken_fixes(pattern: str) -> dict[int, str]:
    """Character classes in which tiktoken's patterns differ, seen from a probe vocabulary.

    The probe's only merges join a class's stand-in to the first byte of what follows,
    which shows whether both are in one piece.
    """
    heads = sorted({s.encode()[-1:] for s in "é1\n!"})
    ranks = {bytes([b]): b for b in range(256)}
    for head in heads:
        for lead in range(0xC2, 0xF5):
            ranks[head + bytes([lead])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return class_fixes(lambda pair: any(i > 255 for i in probe.encode_ordinary(pair)))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text).

    Null text counts as empty and has no ids. ``path`` is a rank file that workers can
    read. Rows may repeat, no rows give no rows, other columns are ignored. A long text is
    split in parts that one task encodes; its ids are one value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        try:
            for batch in slices(batches):
                ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], ["doc_id", "ids"])
        finally:
            # the worker lives on in other work, which needs the memory
            encoder.forget()

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``, to every row of ``encoded`` (doc_id, ids).

    Null ids give null bytes; an id outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in slices(batches):
            ids = batch.column(1)
            offsets = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]
            data = decoded(vocabulary, offsets, ids.flatten().to_numpy())
            arrays = [batch.column(0), ids, pc.if_else(ids.is_valid(), data, pa.scalar(None, pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def digests() -> list[Column]:
    """n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of what ``decode`` gives."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
