"""What is known of distinct words, found for whole arrays of words at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from waypath.llm.common import span_hashes


def spread(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all spans' bytes, span after span."""
    return np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())


def differing(a: np.ndarray, a_starts: np.ndarray, a_length: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """Numbers of the spans of a that aren't byte for byte those of b."""
    same = a_length == b_length
    n = np.where(same, a_length, 0)
    bad = np.flatnonzero(a[spread(a_starts, n)] != b[spread(b_starts, n)])
    return np.union1d(np.flatnonzero(~same), np.searchsorted(np.cumsum(n), bad, "right"))


class Memo:
    """Numbers distinct byte strings from 0 in the order in which they are first seen.

    They are found by a 64-bit hash and confirmed by their bytes, which are kept end to end. A string whose hash is another's is kept aside.
    """

    def __init__(self) -> None:
        self.size, self.known, self.slot = 0, np.empty(0, np.uint64), np.empty(0, np.int64)
        self.bytes, self.starts, self.length = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        self.aside: dict[bytes, int] = {}

    def _add(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        self.starts = np.concatenate([self.starts, len(self.bytes) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.bytes = np.concatenate([self.bytes, data[spread(starts, length)]])
        self.size += len(starts)
        return np.arange(self.size - len(starts), self.size)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Each span's number, and the strings that are new, in the order of their numbers."""
        length, before = ends - starts, self.size
        hashes, at, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, hashes)
        held = self.known[np.minimum(place, len(self.known) - 1)] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~held)
        self.slot = np.insert(self.slot, place[new], self._add(data, starts[at[new]], length[at[new]]))
        self.known = np.insert(self.known, place[new], hashes[new])
        number = self.slot[np.searchsorted(self.known, hashes)][which]
        for i in differing(data, starts, length, self.bytes, self.starts[number], self.length[number]).tolist():
            own = data[starts[i] : ends[i]].tobytes()
            if own not in self.aside:
                self.aside[own] = int(self._add(data, starts[i : i + 1], length[i : i + 1])[0])
            number[i] = self.aside[own]
        raw = self.bytes[self.starts[before] :].tobytes() if self.size > before else b""
        cut = self.starts[before:] - (self.starts[before] if self.size > before else 0)
        return number, [raw[a : a + n] for a, n in zip(cut.tolist(), self.length[before:].tolist())]


class WordTable:
    """Numbers that `judge` gives to distinct words, remembered for up to about `most` of them."""

    def __init__(self, judge: Callable[[list[str]], list[int]], most: int = 1_000_000):
        self.judge, self.most = judge, most
        self.memo, self.value = Memo(), np.empty(0, np.int64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.memo.size > self.most:
            self.memo, self.value = Memo(), np.empty(0, np.int64)
        number, new = self.memo(data, starts, ends)
        if new:
            self.value = np.concatenate([self.value, np.array(self.judge([w.decode() for w in new]), np.int64)])
        return self.value[number]
