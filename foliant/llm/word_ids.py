"""A bounded cache of the ids of words, kept in arrays, and the ids of texts put together from it by gathering."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa


class WordIds:
    """Subclasses say in learn() what ids a word has. Words are strings or bytes, whichever Arrow lists of them give."""

    LIMIT: int  # words in the cache
    EMPTY: str | bytes = ""  # a word without ids

    def __init__(self):
        self.clear()

    def learn(self, words: list) -> None:
        """put() the ids of words that the cache doesn't have."""
        raise NotImplementedError

    def clear(self) -> None:
        self.number: dict = {}
        self.flat, self.start, self.size = np.empty(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)  # since the cache was last full
        self.used = 0
        self.put([self.EMPTY], np.empty(0, np.uint32), np.zeros(1, np.int64))

    def make_room(self) -> None:
        """Keep the words that were used most, half of what fits at most."""
        n, least = len(self.number), 2
        while (self.uses[1:n] >= least).sum() > self.LIMIT // 2:
            least *= 2
        keep = np.flatnonzero(self.uses[1:n] >= least) + 1
        names, size, start, flat = list(self.number), self.size[keep], self.start[keep], self.flat
        self.clear()
        flat = flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        self.put([names[i] for i in keep.tolist()], flat, size)

    def put(self, words: list, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Words with their ids, one after another, and how many each has."""
        n = len(self.number)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(words) > len(self.size):
            self.size, self.start, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start, self.uses))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))

    def joined(self, lists: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all words of lists, one list after another, and where lists begin and end."""
        ends = lists.offsets.to_numpy()
        coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        at = coded.indices.to_numpy()
        counts = np.bincount(at, minlength=len(coded.dictionary))
        numbers = self._numbers(coded.dictionary.to_pylist(), counts)[at]
        size = self.size[numbers]
        after = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[numbers] - after + size, size) + np.arange(int(after[-1]) if len(after) else 0)]
        return flat, np.concatenate([[0], after])[ends - ends[0]].tolist()

    def _numbers(self, words: list, counts: np.ndarray) -> np.ndarray:
        """Numbers of different words, which occur so often."""
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        fresh = [words[i] for i in np.flatnonzero(at < 0).tolist()]
        if len(self.number) + len(fresh) > self.LIMIT:
            self.make_room()  # which numbers the words anew
            self.learn([w for w in words if w not in self.number])
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        elif fresh:
            self.learn(fresh)
            at[at < 0] = [self.number[w] for w in fresh]
        self.uses[at] += counts
        return at
