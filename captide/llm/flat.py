"""Words of many texts as one flat array of codes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

from captide.llm.encode import ragged

#: Different tokens kept with their codes, per worker.
KEPT_TOKENS = 1_000_000


class Tokens(dict):
    """Maps blank-separated tokens to numbers; ``expand`` gives a token's codes the first time it is met."""

    def __init__(self, expand: Callable[[str], list[int]]):
        super().__init__()
        self.expand = expand
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.codes: list[int] = []
        self.at: list[int] = [0]
        self._array = np.zeros(0, np.int32)
        self._starts = np.zeros(1, np.int64)

    def __missing__(self, token: str) -> int:
        self.codes.extend(self.expand(token))
        self.at.append(len(self.codes))
        n = self[token] = len(self.at) - 2
        return n

    def flat(self, texts: Iterable[str], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts, each followed by ``pad`` zeros, and where each text begins (one more
        entry marks the end)."""
        if len(self) > KEPT_TOKENS:
            self.reset()
        get = self.__getitem__
        tokens = [t.split() for t in texts]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.fromiter(map(get, chain.from_iterable(tokens)), np.int64, int(counts.sum()))
        if len(self._array) != len(self.codes) or len(self._starts) != len(self.at):
            self._array = np.array(self.codes, np.int32)
            self._starts = np.array(self.at, np.int64)
        first = self._starts[ids]
        size = self._starts[ids + 1] - first
        flat = self._array[ragged(first, size)]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        if pad:
            n = np.diff(ends)
            out = np.zeros(len(flat) + pad * len(tokens), np.int32)
            out[np.arange(len(flat)) + np.repeat(np.arange(len(tokens)) * pad, n)] = flat
            return out, ends + pad * np.arange(len(tokens) + 1)
        return flat, ends
