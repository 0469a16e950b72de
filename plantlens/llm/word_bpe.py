"""Operator 13, BPE encoding and decoding with word ends, by a contiguous rank array.

The vocabulary file is a JSON tokenizer: a text is cut at its special tokens, each
section is put in normal form C, its white space runs become one space, it is
lower-cased, and the file's pattern gives the words; white space is dropped.
Letters and digits are those of the installed Unicode tables, which agree with the
tokenizers library on every code point up to Unicode 15.1.  A
word's UTF-8 bytes are its first parts, the last one with the word-end mark.

A word holds, side by side, the boundaries of its parts, the parts' ids and the
ranks of adjacent parts.  Each step scans the ranks for the leftmost minimum, deletes the boundary
between the two parts, and refreshes the ranks to its left and right, until no
pair has a rank.  The distinct words of a group of texts that have equally
many bytes take their steps together, as rows of arrays: after a step every row
has one part less, so the arrays stay contiguous and shrink.  A word of more than
``SHORT`` bytes does the same with its ranks in blocks: it scans the blocks'
minima, then one block, so that a step costs about the root of its length.

Workers keep the ids of words they have met in a two-generation cache of bounded
size.  The vocabulary is sent to the tasks as the bytes of its file (its path is
a parameter); nothing is shuffled.

Defined cases: null and empty texts (and texts of white space only) have no
tokens and decode to the empty string.  A special token's string inside a text
becomes its id.  Decoding joins the tokens by one space, as the file names no
decoder; ids outside the vocabulary are left out.  Repeated rows give repeated
results.  ``encode`` and ``decode`` return the other columns of their input; only
a column named as the output is replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
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

#: Words of at most so many bytes take their steps as rows of one array.
SHORT = 48
#: Rows that take their steps together (arrays of this size stay in the processor's cache).
ROWS = 8192
#: Words of one cache generation, the longest word it keeps, and characters of a group of texts.
CACHE_WORDS = 150_000
CACHE_CHARS = 48
GROUP_CHARS = 4_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves,
    the others for the characters from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, pair ranks and splitting rules of a tokenizer file."""

    def __init__(self, raw: bytes) -> None:
        file = json.loads(raw)
        model = file["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[side]] for m in merges], np.int64) for side in (0, 1))
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.ranks = PairTable(left, right, np.arange(len(merges)))
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + end] for s in symbols], np.int64)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = {s: np.array([i], "<i4").tobytes() for s, i in special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split
        pattern = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in {**ids, **special}.items()}

    def normal(self, section: str) -> str:
        """Lower case letter by letter: a capital sigma at a word's end is no final sigma."""
        return unicodedata.normalize("NFC", section).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """The words and special tokens of a text."""
        out = []
        for section in self.at_special(text):
            if section in self.special:
                out.append(section)
            elif section:
                out.extend(self.words(self.normal(section)))
        return out

    def merge_rows(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of equally many bytes (rows of first parts) to (rows, ids, boundaries), each
        group of rows with equally many tokens."""
        rows = np.arange(len(parts))
        bounds = np.tile(np.arange(parts.shape[1] + 1, dtype=np.int16), (len(parts), 1))
        ranks = self.ranks.get(parts[:, :-1], parts[:, 1:])
        while parts.shape[1] > 1:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            on = least < NONE
            if not on.all():
                yield rows[~on], parts[~on], bounds[~on]
                rows, parts, bounds, ranks, at, least = (x[on] for x in (rows, parts, bounds, ranks, at, least))
                if not len(rows):
                    return
            n, width = parts.shape
            row = np.arange(n)
            parts[row, at] = self.made[least]
            keep = np.ones((n, width), bool)
            keep[row, at + 1] = False  # the right part, the boundary before it and the pair's rank go
            parts = parts[keep].reshape(n, width - 1)
            bounds = bounds[np.concatenate([keep, np.ones((n, 1), bool)], axis=1)].reshape(n, width)
            keep = np.ones((n, width - 1), bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            for near in (at - 1, at):  # the pairs that hold the new part
                there = np.flatnonzero((near >= 0) & (near < width - 2))
                k = near[there]
                ranks[there, k] = self.ranks.get(parts[there, k], parts[there, k + 1])
        if len(rows):
            yield rows, parts, bounds

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word; ranks lie in blocks whose minima are scanned first."""
        parts = self._first(np.frombuffer(word, np.uint8)[None, :])[0]
        ranks = np.append(self.ranks.get(parts[:-1], parts[1:]), NONE)  # of a part and its successor
        size = max(16, int(len(parts) ** 0.5))
        blocks = [[parts[k:k + size], ranks[k:k + size]] for k in range(0, len(parts), size)]
        least = np.array([b[1].min() for b in blocks])
        while True:
            b = int(least.argmin())
            if least[b] >= NONE:
                return np.concatenate([x[0] for x in blocks])
            ids, ranks = blocks[b]
            k = int(ranks.argmin())
            ids[k] = self.made[ranks[k]]
            gone = b if k + 1 < len(ids) else b + 1  # the block of the right part; empty blocks are dropped
            j = k + 1 if gone == b else 0
            after = blocks[gone][1][j]
            blocks[gone] = [np.delete(blocks[gone][0], j), np.delete(blocks[gone][1], j)]
            blocks[b][1][k] = after
            if not len(blocks[gone][0]):
                del blocks[gone]
                least = np.delete(least, gone)
                gone = b
            self._refresh(blocks, b, k)
            if k:
                self._refresh(blocks, b, k - 1)
            elif b:
                self._refresh(blocks, b - 1, len(blocks[b - 1][0]) - 1)
                least[b - 1] = blocks[b - 1][1].min()
            least[b] = blocks[b][1].min()
            least[gone] = blocks[gone][1].min()

    def _refresh(self, blocks: list, b: int, k: int) -> None:
        ids, ranks = blocks[b]
        following = ids[k + 1] if k + 1 < len(ids) else blocks[b + 1][0][0] if b + 1 < len(blocks) else None
        ranks[k] = NONE if following is None else self.ranks.get(ids[k:k + 1], np.array([following]))[0]

    def _first(self, raw: np.ndarray) -> np.ndarray:
        """First parts of words of equally many bytes."""
        parts = self.inner[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        return parts

    def encode_many(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian int32 bytes."""
        out: list[bytes] = [self.special.get(w, b"") for w in words]
        raw = [b"" if ids else w.encode() for w, ids in zip(words, out)]
        size = np.array([len(r) for r in raw])
        for n in np.unique(size[size > 0]).tolist():
            same = np.flatnonzero(size == n)
            if n > SHORT:
                for w in same.tolist():
                    out[w] = self.merge_long(raw[w]).astype("<i4").tobytes()
                continue
            for lo in range(0, len(same), ROWS):
                part = same[lo:lo + ROWS]
                data = np.frombuffer(b"".join([raw[w] for w in part.tolist()]), np.uint8).reshape(len(part), n)
                for rows, ids, _ in self.merge_rows(self._first(data)):
                    for w, coded in zip(part[rows].tolist(), sliced(ids.ravel(), np.full(len(ids), ids.shape[1]))):
                        out[w] = coded
        return out


class Coder:
    """Encodes and decodes groups of texts."""

    def __init__(self, raw: bytes) -> None:
        self.vocabulary = Vocabulary(raw)
        self.cache = MatchCache(self.vocabulary.encode_many, CACHE_WORDS, CACHE_CHARS)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for part in groups(texts, GROUP_CHARS):
            yield from self.cache.encode([self.vocabulary.split(t) for t in part])

    def decode(self, ids: np.ndarray) -> str:
        tokens = map(self.vocabulary.tokens.get, ids.tolist())
        return " ".join([t for t in tokens if t is not None])


def _coder(raw: bytes) -> Coder:
    held = enter("word_bpe")
    if held.get("coder for") != raw:
        held["coder for"], held["coder"] = raw, Coder(raw)
    return held["coder"]


def _file(spark: SparkSession, path: str | None):
    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the vocabulary's size, whatever the corpus


def _schema(front: DataFrame, added: dict[str, T.DataType]) -> T.StructType:
    """The frame's columns but its last, then the added ones."""
    return T.StructType([*[T.StructField(f.name, f.dataType, True) for f in front.schema.fields[:-1]],
                         *[T.StructField(c, t, True) for c, t in added.items()]])


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """The rows with the token ids of their texts (array of int)."""
    small_batches(docs.sparkSession)
    raw = _file(docs.sparkSession, path)
    others = [c for c in docs.columns if c != out]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], clean_text(f"`{text_col}`").alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value)
        for batch in batches:
            coded = list(coder.encode(batch.column(len(others)).to_pylist()))
            bounds = np.cumsum([0, *(len(c) // 4 for c in coded)])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*others, out])

    return rows.mapInArrow(run, _schema(rows, {out: T.ArrayType(T.IntegerType())}))


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the decoded text of their ids in place of the ids; null ids count as none."""
    raw = _file(rows.sparkSession, path)
    others = [c for c in rows.columns if c not in (ids_col, out)]
    front = rows.select(*[F.col(f"`{c}`") for c in [*others, ids_col]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value)
        for batch in batches:
            texts = [coder.decode(np.array([i for i in ids or [] if i is not None], np.int64))
                     for ids in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, out])

    return front.mapInArrow(run, _schema(front, {out: T.StringType()}))


DIGESTS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def round_trip(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows with n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the text that the ids decode to, in UTF-8).  Encoding and
    decoding follow one another in one task, so that the ids do not travel."""
    small_batches(docs.sparkSession)
    raw = _file(docs.sparkSession, path)
    others = [c for c in docs.columns if c not in DIGESTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], clean_text(f"`{text_col}`").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(raw.value)
        for batch in batches:
            cols: list[list] = [[], [], []]
            for ids in coder.encode(batch.column(len(others)).to_pylist()):
                cols[0].append(len(ids) // 4)
                cols[1].append(hashlib.sha256(ids).hexdigest())
                cols[2].append(hashlib.sha256(coder.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, cols, (pa.int64(), pa.string(), pa.string()))], names=[*others, *DIGESTS])

    return rows.mapInArrow(run, _schema(rows, DIGESTS))


@query("op13_word_bpe")
def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
