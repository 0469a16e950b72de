"""What both BPE operators share: a table of token pairs that numpy looks up by the
array, and a bounded cache of matches whose misses are encoded together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Above every rank, and the value of a pair that never merges.
NONE = np.int64(1 << 40)
_EMPTY = np.int64(-1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Value of a pair of ids, by open addressing in arrays (at most half full)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> None:
        keys = self._keys(left, right)
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY)
        self.values = np.full(1 << bits, NONE)
        todo, at = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = keys[todo[free]]
            mine = self.keys[at] == keys[todo]
            self.values[at[mine]] = value[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & self.mask

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (np.asarray(left, np.int64) << 31) | np.asarray(right, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' values, NONE for a pair that is not in the table."""
        keys = self._keys(left, right).ravel()
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != _EMPTY)]
        return out.reshape(np.shape(left))


def sliced(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The little-endian int32 bytes of consecutive runs of ``counts`` ids."""
    raw = flat.astype("<i4").tobytes()
    ends = (4 * np.cumsum(counts)).tolist()
    return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]


class MatchCache:
    """Ids (as bytes) of matches seen before, in two generations of bounded size.  What a
    group of texts lacks is given to ``encode_many`` at once, each distinct match once."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], entries: int, chars: int) -> None:
        self.encode_many, self.entries, self.chars = encode_many, entries, chars
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """The joined ids of each text's matches."""
        lacking = set().union(*texts) - self.young.keys()
        misses = []
        for m in lacking:
            ids = self.old.get(m)
            if ids is None:
                misses.append(m)
            else:
                self.young[m] = ids
        if misses:
            self.young.update(zip(misses, self.encode_many(misses)))
        out = [b"".join(map(self.young.__getitem__, t)) for t in texts]
        for m in misses:
            if len(m) > self.chars:
                del self.young[m]
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        return out


def groups(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in consecutive groups of about ``chars`` characters, one text at least."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
