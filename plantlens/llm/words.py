"""Word segmentation and rolling hashes of Arrow text columns, vectorised over bytes.

Words are runs of "word bytes" of the UTF-8 text.  Since every byte of a
non-ASCII character is >= 0x80, a class that holds all of those works on bytes
exactly as its regular expression works on characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer text is handled alone).
CHUNK = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def byte_class(chars: str) -> np.ndarray:
    """Lookup of the word bytes: the given ASCII characters and all of 0x80-0xFF."""
    lut = np.zeros(256, bool)
    lut[0x80:] = True
    for c in chars:
        lut[ord(c)] = True
    return lut


#: ``[^\x20\x09-\x0D]+``
NON_SPACE = byte_class("".join(chr(i) for i in range(128) if i != 0x20 and not 9 <= i <= 13))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = byte_class("0123456789abcdefghijklmnopqrstuvwxyz")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            out = []
            for b in (self.base, self.inv):
                p = np.full(self.n, b, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


class Words:
    """The words of consecutive texts: byte span of each, and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray) -> None:
        self.data, self.bounds = data, bounds
        is_word = word_bytes[data]
        before = np.empty_like(is_word)
        before[1:], before[:1] = is_word[:-1], False
        after = np.empty_like(is_word)
        after[:-1], after[-1:] = is_word[1:], False
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        before[inner] = False
        after[inner - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        up, down = _BYTES.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def doc(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()

    def byte_words(self, lo: int, hi: int) -> list[bytes]:
        """Words lo..hi-1 as byte strings."""
        if hi <= lo:
            return []
        at = int(self.start[lo])
        raw = self.data[at:int(self.end[hi - 1])].tobytes()
        s, e = (self.start[lo:hi] - at).tolist(), (self.end[lo:hi] - at).tolist()
        return [raw[a:b] for a, b in zip(s, e)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes (also across texts: mask those)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n - k + 1])


def starts_inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over the n-k+1 gram starts: those whose k words are of one text."""
    ok = np.ones(max(n - k + 1, 0), bool)
    for edge in np.unique(first[1:-1]):
        ok[max(edge - k + 1, 0):edge] = False
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    m, size = x, 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == w else np.minimum(m[:len(x) - w + 1], m[w - size:])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row bounds) of a string column without nulls, uncopied."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, limit: int = CHUNK):
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def segmented(col: pa.Array, word_bytes: np.ndarray, lower: bool = False, limit: int = CHUNK):
    """(row from, row to, Words) for the chunks of a text column."""
    data, bounds = text_buffers(col)
    for lo, hi in chunks(bounds, limit):
        part = data[bounds[lo]:bounds[hi]]
        yield lo, hi, Words(LOWER[part] if lower else part, bounds[lo:hi + 1] - bounds[lo], word_bytes)


def one_text(text: str, word_bytes: np.ndarray, lower: bool = False) -> Words:
    """The words of a single text."""
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(LOWER[data] if lower else data, np.array([0, len(data)]), word_bytes)
