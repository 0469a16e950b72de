"""A bidirectional FM-index over a delimited list of words, in numpy, and the search scheme
for one error on one side of a pattern.  Many patterns take each step together.

The words w0 < w1 < .. stand as ``$w0$w1$..$``.  One index holds the suffixes of this
text, sorted to their next delimiter and then by position; the other the same for the
reversed words.  A pattern inside ``$word$`` is an interval in both, of one
size: extending it on the left by a symbol maps the first interval (as a backward
search does) and moves the second past the smaller symbols that precede the
pattern; extending on the right is the same with the two exchanged.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0


class Ranks:
    """A wavelet matrix: counts of a symbol, and of smaller ones, in prefixes of a sequence."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.zeros: list[np.ndarray] = []   # zero bits of the level in each prefix
        self.split: list[int] = []          # zero bits of the level in all
        rest = symbols
        for shift in range(bits - 1, -1, -1):
            one = (rest >> shift) & 1 == 1
            count = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(~one, out=count[1:])
            self.zeros.append(count)
            self.split.append(int(count[-1]))
            rest = np.concatenate([rest[~one], rest[one]])
        values = np.arange(1 << bits)
        self.first = np.zeros(1 << bits, np.int64)  # where a symbol begins below the last level
        seen, begin = np.unique(rest, return_index=True)
        self.first[seen] = begin
        present = np.bincount(symbols, minlength=len(values))
        self.smaller = np.cumsum(present) - present

    def narrow(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each interval: how often its symbol comes before it and before its end, and how
        many symbols in it are smaller."""
        less = np.zeros(len(lo), np.int64)
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[lo], zeros[hi]
            less += np.where(one, b - a, 0)
            lo, hi = np.where(one, split + lo - a, a), np.where(one, split + hi - b, b)
        return lo - self.first[symbol], hi - self.first[symbol], less

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All symbols of the intervals: (interval, symbol, how often before it, before its end)."""
        which, symbol = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for zeros, split in zip(self.zeros, self.split):
            a, b = zeros[lo], zeros[hi]
            left, right = a < b, lo - a < hi - b
            which = np.concatenate([which[left], which[right]])
            symbol = np.concatenate([symbol[left] << 1, symbol[right] << 1 | 1])
            lo, hi = np.concatenate([a[left], (split + lo - a)[right]]), np.concatenate([b[left], (split + hi - b)[right]])
        return which, symbol, lo - self.first[symbol], hi - self.first[symbol]


def sorted_suffixes(text: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the text's suffixes, each sorted to its next delimiter, then by position."""
    n = len(text)
    width = 63 // bits
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(width):
        symbol = np.zeros(n, np.int64)
        symbol[:max(n - k, 0)] = text[k:]
        symbol[~alive] = DELIMITER
        key = key << bits | symbol
        alive &= symbol != DELIMITER
    order = np.argsort(key, kind="stable")
    while alive.any():  # some suffixes are equal as far as they are sorted, and go on
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        new |= ~alive[order]  # those that end are told apart by position
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        then = np.zeros(n, np.int64)
        then[:max(n - width, 0)] = rank[width:]
        key = np.where(alive, rank * (n + 1) + then, rank * (n + 1))
        alive[:max(n - width, 0)] &= alive[width:]
        alive[max(n - width, 0):] = False
        order = np.argsort(key, kind="stable")
        width *= 2
    return order


class Side:
    """The FM-index of one reading direction."""

    def __init__(self, words: list[np.ndarray], letters: int) -> None:
        self.bits = int(letters + 2).bit_length()
        gap = np.array([DELIMITER])
        text = np.concatenate([gap, *[x for w in words for x in (w, gap)]])
        order = sorted_suffixes(text, self.bits)
        before = text[order - 1]
        before[order == 0] = letters + 1  # nothing precedes the first delimiter
        self.ranks = Ranks(before, self.bits)
        count = np.bincount(text, minlength=1 << self.bits)
        self.first = np.cumsum(count) - count  # the first suffix that begins with a symbol
        self.n = len(text)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals with the symbol before them, and the smaller symbols there."""
        a, b, less = self.ranks.narrow(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b, less


class Index:
    """Both directions over sorted distinct words."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        size = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, symbols = np.unique(codes, return_inverse=True)
        ends = np.cumsum(size)
        spelled = np.split(symbols.astype(np.int64) + 1, ends[:-1]) if words else []
        backward = sorted(range(len(words)), key=lambda k: words[k][::-1])
        self.left = Side(spelled, len(self.alphabet))                       # extends a pattern on the left
        self.right = Side([spelled[k][::-1] for k in backward], len(self.alphabet))
        self.word_of = np.array(backward, np.int64)                         # of a row ``$reversed word$``

    def spell(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all patterns, each with a delimiter behind it, and where each begins; a
        letter that no word has gets a symbol that no index has."""
        codes = np.frombuffer("\0".join([*patterns, ""]).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[at] == codes, at + 1, len(self.alphabet) + 2)
        size = np.array([len(p) + 1 for p in patterns], np.int64)
        symbols[np.cumsum(size) - 1] = DELIMITER
        return symbols, np.cumsum(size) - size

    def exact_start(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals, in the right index, of ``$`` and the first ``size`` symbols: matched from
        the last of them leftwards to the delimiter."""
        n = len(begin)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.left.n)
        right_lo = np.zeros(n, np.int64)
        for k in range(int(size.max(initial=0)) + 1):
            on = np.flatnonzero((k <= size) & (lo < hi))
            if not len(on):
                break
            symbol = np.where(k < size[on], symbols[begin[on] + size[on] - 1 - np.minimum(k, size[on] - 1)], DELIMITER)
            a, b, less = self.left.extend(symbol, lo[on], hi[on])
            # the empty pattern is every row of the other index: there, skip what begins with smaller symbols
            right_lo[on] = self.right.first[symbol] if k == 0 else right_lo[on] + less
            lo[on], hi[on] = a, b
        return right_lo, right_lo + np.maximum(hi - lo, 0)

    def one_error(self, patterns: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) pairs: words that begin with the pattern's first ``size`` letters
        and differ from it by one letter inserted, deleted or replaced behind them."""
        symbols, begin = self.spell(patterns)
        lo, hi = self.exact_start(symbols, begin, size)
        q = np.flatnonzero(lo < hi)
        lo, hi, at = lo[q], hi[q], begin[q] + size[q]   # at: the next symbol; no error so far
        one = [np.zeros(0, np.int64)] * 4               # pattern, next symbol, interval: one error
        found = [(one[0], one[0])]
        while len(q) or len(one[0]):
            # patterns with an error go on exactly
            oq, oat, olo, ohi = one
            symbol = symbols[oat]
            olo, ohi, _ = self.right.extend(symbol, olo, ohi)
            there = olo < ohi
            done = there & (symbol == DELIMITER)
            found.append((oq[done], self.word_of[olo[done]]))
            there &= symbol != DELIMITER
            grown = [(oq[there], oat[there] + 1, olo[there], ohi[there])]
            # an error at the next symbol; of equal neighbours the last one is deleted, or inserted behind
            symbol = symbols[at]
            inside = symbol != DELIMITER
            drop = inside & (symbols[np.minimum(at + 1, len(symbols) - 1)] != symbol)
            grown.append((q[drop], at[drop] + 1, lo[drop], hi[drop]))
            which, other, a, b = self.right.ranks.symbols(lo, hi)
            letter = (other != DELIMITER) & (other <= len(self.alphabet)) & (other != symbol[which])
            which, other, a, b = which[letter], other[letter], a[letter] + self.right.first[other[letter]], b[letter] + self.right.first[other[letter]]
            grown.append((q[which], at[which], a, b))
            replaced = inside[which]
            grown.append((q[which][replaced], at[which][replaced] + 1, a[replaced], b[replaced]))
            one = [np.concatenate(x) for x in zip(*grown)]
            # no error: the next symbol
            lo, hi, _ = self.right.extend(symbol, lo, hi)
            on = inside & (lo < hi)
            q, at, lo, hi = q[on], at[on] + 1, lo[on], hi[on]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
