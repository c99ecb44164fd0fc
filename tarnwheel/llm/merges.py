"""Byte-pair merges as a relation between neighbouring tokens.

Every token longer than a byte is made by one merge of two shorter tokens, and merges are
applied in the order of token ids. A sequence of tokens is what merging its bytes gives
exactly when each two neighbours are compatible: undoing their merges step by step along
the seam never shows a pair that would have been merged earlier across it. Published work
on byte-pair encoding as a finite-state process builds on the same fact.
"""

from __future__ import annotations

from collections.abc import Callable

MEMO = 1 << 18


class Agreed(dict):
    """Compatibility of pairs of tokens (left << 32 | right) asked before."""

    def __init__(self, agree: Callable[[int, int], bool]):
        super().__init__()
        self.agree = agree

    def __missing__(self, pair: int) -> bool:
        if len(self) >= MEMO:
            self.clear()
        found = self[pair] = self.agree(pair >> 32, pair & 0xFFFFFFFF)
        return found


class Merges:
    """Tokens by id, the merge that makes each, and the compatibility of neighbours."""

    def __init__(self, tokens: list[bytes], made_by: dict[int, tuple[int, int]] | None = None):
        """``tokens`` by id in merge order. Without ``made_by`` the merges follow from the tokens."""
        self.tokens = tokens
        self.sizes = [len(t) for t in tokens]
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.agreed = Agreed(self._agree)
        self.shorter = self._prefixes()
        for i, token in enumerate(tokens):
            pair = made_by.get(i) if made_by is not None else self._merge_of(i)
            if pair:
                self.made[pair] = i
                self.parts[i] = pair
        self.agreed.clear()
        # ids that merging can give; others are only found by a piece that is the whole token
        self.usable = [len(t) == 1 or i in self.parts for i, t in enumerate(tokens)]
        # for each token the longest usable one it begins with; -1 for none
        self.next_usable = []
        for i in self.shorter:
            while i >= 0 and not self.usable[i]:
                i = self.shorter[i]
            self.next_usable.append(i)

    def _prefixes(self) -> list[int]:
        """For each token the longest other token it begins with; -1 for none."""
        out = []
        for token in self.tokens:
            n = len(token) - 1
            while n and token[:n] not in self.ids:
                n -= 1
            out.append(self.ids[token[:n]] if n else -1)
        return out

    def _merge_of(self, i: int) -> tuple[int, int] | None:
        left = self.shorter[i]
        while left >= 0:
            right = self.ids.get(self.tokens[i][len(self.tokens[left]) :], -1)
            if 0 <= right < i and left < i and self._agree(left, right):
                return left, right
            left = self.shorter[left]
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in the result of merging; remembered."""
        return self.agreed[left << 32 | right]

    def _agree(self, left: int, right: int) -> bool:
        """Undo merges at the seam from the latest back; fail if a pair there merges before that."""
        before = len(self.tokens)
        while True:
            if self.made.get((left, right), before) < before:
                return False
            # the later merge is undone first; what was at the seam then lasted until it
            on_left = left > right
            if (left if on_left else right) not in self.parts:
                on_left = not on_left
            if on_left:
                if left not in self.parts:
                    return True
                before, left = left, self.parts[left][1]
            else:
                if right not in self.parts:
                    return True
                # of equal merges the one on the left comes first
                before, right = right + 1, self.parts[right][0]
