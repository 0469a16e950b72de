"""Operator 8, byte-level BPE encoding and decoding by a segment tree.

A text is split by the vocabulary's pattern; each match is encoded alone.  A
match that is a token is that token.  Else its bytes are the leaves of a
segment tree: a node stores the smallest (rank, position) key of the pairs
below it, so the root is the leftmost pair of minimum rank.  A merge joins a
segment with its live right neighbour and updates the three pairs it touches,
each in O(log n), so a match of n bytes costs O(n log n) however long it is.

The new matches of a group of texts are merged together, a row of an array of
trees each, with the pairs' ranks in a table by (left id, right id); a match of
more than ``BATCHED`` bytes has a tree of its own.

Workers keep the encodings of matches they have seen in a two-generation cache
of bounded size.  Ranks are sent to the tasks as the bytes of the rank file
(its path is a parameter); nothing is shuffled.

Defined cases: null and empty texts have no tokens and decode to the empty
byte string.  Repeated rows give repeated results.  ``encode`` returns all
columns of its input; only a column named as its output is replaced.  An id
outside the vocabulary raises in ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.llm.common import clean_text, enter, query, small_batches, table
from plantlens.llm.pairs import NONE, MatchCache, PairTable, groups, sliced

#: Entries of one cache generation of a worker, and the longest match it keeps.
CACHE_ENTRIES = 150_000
CACHE_CHARS = 64
#: Bytes of a match whose tree is one of an array of trees, trees of an array, and
#: characters of texts whose new matches are merged together.
BATCHED = 64
TREES = 4096
GROUP_CHARS = 1_000_000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of ``base64(token) rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none = 1 << 62  # above any rank * n + position
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))   # start of the next live segment
    before = list(range(-1, n))     # start of the previous one
    while tree[1] != none:
        i = tree[1] % n
        j = after[i]
        end = after[j]
        after[i] = end
        updates = [(j, none)]
        if end < n:
            before[end] = i
            r = get(piece[i:after[end]])
            updates.append((i, none if r is None else r * n + i))
        else:
            updates.append((i, none))
        p = before[i]
        if p >= 0:
            r = get(piece[p:end])
            updates.append((p, none if r is None else r * n + p))
        for leaf, key in updates:
            k = size + leaf
            if tree[k] == key:
                continue
            tree[k] = key
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Trees:
    """Encodes distinct short matches together.  Matches of one power-of-two size share an
    array of trees (node by match); at each step every tree that still has a pair reads its
    root, merges there, and updates the three leaves that the merge touches, level by level."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        cuts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(cuts, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)

    def encode_many(self, matches: list[str]) -> list[bytes]:
        """Ids of the matches, as little-endian int32 bytes."""
        raw = [m.encode() for m in matches]
        out: list[bytes] = [b""] * len(raw)
        size = np.zeros(len(raw), np.int64)  # leaves of the match's tree
        for k, r in enumerate(raw):
            whole = self.ranks.get(r)
            if whole is not None or len(r) > BATCHED:
                out[k] = np.array([whole] if whole is not None else merge(r, self.ranks), "<i4").tobytes()
            else:
                size[k] = 1 << (len(r) - 1).bit_length()
        for s in np.unique(size[size > 0]).tolist():
            same = np.flatnonzero(size == s)
            for lo in range(0, len(same), TREES):
                part = same[lo:lo + TREES].tolist()
                for k, ids in zip(part, self._merge([raw[k] for k in part], s)):
                    out[k] = ids
        return out

    def _merge(self, raw: list[bytes], s: int) -> list[bytes]:
        m, n = len(raw), np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join([r.ljust(s, b"\0") for r in raw]), np.uint8).reshape(m, s).T
        place = np.arange(s)[:, None]
        ids = self.byte[data]                                   # id of the live segment that starts here
        live = place < n
        after = np.broadcast_to(place + 1, (s, m)).copy()       # start of the next live segment
        before = np.broadcast_to(np.arange(-1, s)[:, None], (s + 1, m)).copy()
        tree = np.full((2 * s, m), NONE)
        tree[s:2 * s - 1] = np.where(place[1:] < n, self.pairs.get(ids[:-1], ids[1:]) * s + place[:-1], NONE)
        tree[s:] = np.minimum(tree[s:], NONE)
        for k in range(s - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        flat = tree.reshape(-1)
        act = np.arange(m)
        while True:
            root = tree[1, act]
            on = root < NONE
            if not on.all():
                act, root = act[on], root[on]
            if not len(act):
                break
            i, rank = root % s, root // s
            j = after[i, act]
            end = after[j, act]
            p = before[i, act]
            after[i, act] = end
            before[end, act] = i
            ids[i, act] = rank
            live[j, act] = False
            right = self._keys(rank, ids[np.minimum(end, s - 1), act], i, s, end < n[act])
            left = self._keys(ids[np.maximum(p, 0), act], rank, p, s, p >= 0)
            node = np.concatenate([j, i, np.where(p >= 0, p, j)]) + s
            col = np.concatenate([act, act, act])
            flat[node * m + col] = np.concatenate([np.full(len(act), NONE), right, np.where(p >= 0, left, NONE)])
            while node[0] > 1:
                node >>= 1
                child = 2 * node * m + col
                flat[node * m + col] = np.minimum(flat[child], flat[child + m])
        return sliced(ids.T[live.T], live.sum(axis=0))

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, s: int, there: np.ndarray) -> np.ndarray:
        rank = self.pairs.get(left, right)
        return np.where(there & (rank < NONE), rank * s + at, NONE)


class Encoder:
    """Encodes texts; the ids of short matches are kept, as little-endian int32 bytes."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        self.split = regex.compile(pattern).findall
        self.cache = MatchCache(Trees(parse_ranks(raw)).encode_many, CACHE_ENTRIES, CACHE_CHARS)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; what a group of texts lacks is merged together."""
        for part in groups(texts, GROUP_CHARS):
            yield from self.cache.encode([self.split(t) for t in part])


class Decoder:
    """Token bytes by id, as one table."""

    def __init__(self, raw: bytes) -> None:
        ranks = parse_ranks(raw)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        decimals = [f"{i} ".encode().ljust(8, b"\0") for i in range(len(tokens))]
        self.decimal = np.frombuffer(b"".join(decimals), np.uint64)

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> bytes:
        """The bytes of the ids, one table lookup per byte."""
        parts = []
        for lo in range(0, len(ids), step):
            part = ids[lo:lo + step]
            size = self.size[part]
            if not size.all():
                raise ValueError("an id is outside the vocabulary")
            shift = self.start[part] - (np.cumsum(size) - size)
            parts.append(self.table[np.arange(size.sum()) + np.repeat(shift, size)].tobytes())
        return b"".join(parts)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space (ids of at most seven digits)."""
        raw = self.decimal[ids].view(np.uint8)
        return raw[raw != 0][:-1].tobytes()


def _encoder(raw: bytes, pattern: str) -> Encoder:
    held = enter("bpe")
    if held.get("encoder for") != (raw, pattern):
        held["encoder for"], held["encoder"] = (raw, pattern), Encoder(raw, pattern)
    return held["encoder"]


def _decoder(raw: bytes) -> Decoder:
    held = enter("bpe")
    if held.get("decoder for") != raw:
        held["decoder for"], held["decoder"] = raw, Decoder(raw)
    return held["decoder"]


def _ranks(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the vocabulary's size, whatever the corpus


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
           text_col: str = "text", out: str = "ids") -> DataFrame:
    """The rows with the token ids of their texts (array of int)."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = _ranks(spark, path)
    others = [c for c in docs.columns if c != out]
    rows = docs.select(*others, clean_text(text_col).alias(out))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in rows.schema.fields[:-1]],
                           T.StructField(out, T.ArrayType(T.IntegerType()), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value, pattern)
        for batch in batches:
            coded = list(encoder.encode(batch.column(len(others)).to_pylist()))
            bounds = np.cumsum([0, *(len(c) // 4 for c in coded)])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """The rows with the decoded bytes of their ids in place of the ids."""
    raw = _ranks(rows.sparkSession, path)
    others = [c for c in rows.columns if c not in (ids_col, out)]
    front = rows.select(*others, ids_col)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in front.schema.fields[:-1]],
                           T.StructField(out, T.BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(raw.value)
        for batch in batches:
            lists = batch.column(len(others))
            lists = lists.fill_null([]) if lists.null_count else lists
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            data = [decoder.decode(values[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.binary())], names=[*others, out])

    return front.mapInArrow(run, schema)


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
               text_col: str = "text") -> DataFrame:
    """The rows with n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 (of the bytes that the ids decode to).  Encoding and decoding follow one
    another in one task, so that the ids do not travel and a task needs one worker."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = _ranks(spark, path)
    others = [c for c in docs.columns if c not in DIGESTS]
    rows = docs.select(*others, clean_text(text_col).alias(DIGESTS[0]))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in rows.schema.fields[:-1]],
                           *[T.StructField(c, t, True) for c, t in zip(DIGESTS, (T.LongType(), T.StringType(), T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(raw.value, pattern), _decoder(raw.value)
        for batch in batches:
            cols: list[list] = [[], [], []]
            for coded in encoder.encode(batch.column(len(others)).to_pylist()):
                ids = np.frombuffer(coded, "<i4")
                cols[0].append(len(ids))
                cols[1].append(hashlib.sha256(decoder.decimals(ids)).hexdigest())
                cols[2].append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, cols, (pa.int64(), pa.string(), pa.string()))], names=[*others, *DIGESTS])

    return rows.mapInArrow(run, schema)


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
