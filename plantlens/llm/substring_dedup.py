"""Operator 7, substring dedup: matching statistics against suffix automata of reference shards.

A passage of ``WINDOW`` words stays in the document of smallest id that holds
it and is removed from every other.  Steps:

1. Anchors.  The anchor of a window is the least hash of its ``GRAM``-word
   grams, so equal windows have equal anchors wherever they stand.  Per anchor,
   the smallest document that has it is its reference; an anchor of one document
   cannot hold a shared window.
2. Matching.  Each document meets the references of its anchors.  A reference's
   words form suffix automata (shards of ``SHARD_WORDS`` words, overlapping by a
   window less one word, so a long reference is never one large automaton);
   streaming the document gives its matching statistics, and a matching length
   of ``WINDOW`` or more marks the words it spans.  References of many documents
   are dealt to salted groups (``common.meet``).
3. Rest.  A window may share its anchor with the reference but not the rest of
   its words; such windows are keyed by the hash of all their words, the
   smallest document of each key becomes their reference, and step 2 is
   repeated for them.  Every document that holds such a window, its first one
   included, is among these rows: one that matched an earlier reference is
   removed already, and the first one can match nothing.

Hashes only route; what is removed was matched word by word.  Nothing is
compared pairwise, and group sizes are bounded by salts, not by caps.

Defined cases: null and wordless texts have no words; texts of fewer than
``WINDOW`` words are never cut nor used.  Rows that share a doc_id (repeated
rows too) never cut one another; each is cut by smaller ids.  Rows with a null
doc_id are neither cut nor used.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.automaton import SuffixAutomaton
from plantlens.llm.common import clean_text, enter, meet, query, rebatched, small_batches, table, table_rows, written
from plantlens.llm.words import NON_SPACE, Words, grams, one_text, segmented, sliding_min, starts_inside

WINDOW = 50
GRAM = 25
SHARD_WORDS = 50_000


def window_keys(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of the window that starts at each word."""
    return sliding_min(grams(h, gram), window - gram + 1)


def _anchors(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, words in segmented(batch.column(1), NON_SPACE):
                keys = window_keys(words.hashes(), window, gram)
                inside = starts_inside(words.first, window, len(words))
                doc = words.doc()[:len(keys)]
                fresh = inside.copy()
                fresh[1:] &= (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
                at = np.flatnonzero(fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at].view(np.int64)), pa.array(ids[lo + doc[at]])], names=["key", "doc_id"])

    return run


def _pairs(keys: DataFrame) -> DataFrame:
    """(member, leader): documents and the smallest document of one of their shared keys."""
    first = (keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"))
             .where("leader < last").select("key", "leader"))
    return keys.join(first, "key").where("doc_id > leader").select(F.col("doc_id").alias("member"), "leader").distinct()


class Reference:
    """The automata of a reference's texts, and the hashes of their grams."""

    def __init__(self, texts: list[str], window: int, gram: int) -> None:
        self.window = window
        self.parts: list[list[int]] = []
        self.vocabulary: dict[bytes, int] = {}
        found = []
        for text in texts:
            words = one_text(text, NON_SPACE)
            coded = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words.byte_words(0, len(words))]
            step = SHARD_WORDS - window + 1
            self.parts += [coded[k:k + SHARD_WORDS] for k in range(0, max(len(coded) - window + 1, 0), step)]
            found.append(grams(words.hashes(), gram))
        self.grams = np.unique(np.concatenate(found))
        self.built: SuffixAutomaton | None = None
        self.built_for = -1

    def automaton(self, k: int) -> SuffixAutomaton:
        """Shard k's automaton; one is held at a time."""
        if self.built_for != k:
            self.built, self.built_for = SuffixAutomaton([self.parts[k]]), k
        return self.built

    def ends(self, members: list[list[bytes]]) -> list[np.ndarray]:
        """For each member's words, the mask of positions where a shared window ends."""
        coded = [[self.vocabulary.get(w, -1) for w in m] for m in members]
        out = [np.zeros(len(m), bool) for m in members]
        for k in range(len(self.parts)):
            sam = self.automaton(k)
            for seq, mask in zip(coded, out):
                mask |= np.fromiter((n >= self.window for _, n in sam.states(seq)), bool, len(seq))
        return out

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which gram hashes occur in the reference."""
        at = np.minimum(np.searchsorted(self.grams, keys), max(len(self.grams) - 1, 0))
        return self.grams[at] == keys if len(self.grams) else np.zeros(len(keys), bool)


def covered_words(ends: np.ndarray, window: int) -> np.ndarray:
    """The words inside windows that end at the marked positions."""
    delta = np.zeros(len(ends) + 1, np.int64)
    at = np.flatnonzero(ends)
    np.add.at(delta, at + 1, -1)
    np.add.at(delta, at - window + 1, 1)
    return np.cumsum(delta[:-1]) > 0


def spans_of(mask: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


_MATCHED = "uid long, h long, text string, spans array<struct<start:int,end:int>>, rest array<long>"
_MATCHED_ARROW = pa.schema([
    ("uid", pa.int64()), ("h", pa.int64()), ("text", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("rest", pa.list_(pa.int64()))])


def _match(window: int, gram: int, with_rest: bool, block: int = 64) -> Callable:
    """Groups of a reference's rows, then its members': spans (with the text they are of), and
    the rest's window hashes."""

    def one_block(ref: Reference, rows: list[dict]) -> Iterator[dict]:
        words = [one_text(r["text"], NON_SPACE) for r in rows]
        for row, own, ends in zip(rows, words, ref.ends([w.byte_words(0, len(w)) for w in words])):
            rest: list[int] = []
            if with_rest:
                h = own.hashes()
                keys = window_keys(h, window, gram)
                open_ = ref.holds(keys) & ~ends[window - 1:] if len(keys) else np.zeros(0, bool)
                rest = grams(h, window)[open_].view(np.int64).tolist() if open_.any() else []
            spans = spans_of(covered_words(ends, window))
            if spans or rest:
                yield {"uid": row["uid"], "h": row["h"], "text": row["text"] if spans else None, "spans": spans, "rest": rest}

    def each(rows: Iterator[dict]) -> Iterator[dict]:
        group, texts, ref, held = None, [], None, []
        for row in rows:
            if (row["leader"], row["salt"]) != group:
                if held:
                    yield from one_block(ref, held)
                group, texts, ref, held = (row["leader"], row["salt"]), [], None, []
            if row["role"] == 0:
                texts.append(row["text"])
                continue
            if ref is None:
                ref = Reference(sorted(set(texts)), window, gram)
            held.append(row)
            if len(held) >= block:
                yield from one_block(ref, held)
                held = []
        if held:
            yield from one_block(ref, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        yield from rebatched(each(table_rows(batches)), _MATCHED_ARROW, 64)

    return run


def _merge(window: int) -> Callable:
    """Rows (.., text, spans): the spans of all references as disjoint ascending spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        for batch in batches:
            merged = []
            for spans in batch.column("spans").to_pylist():
                out: list[dict] = []
                for s in sorted(spans, key=lambda s: s["start"]):
                    if out and s["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append(s)
                merged.append(out)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(merged, batch.schema.field("spans").type)], names=batch.schema.names)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, text, spans) of the documents that repeat a passage of an earlier one;
    h is xxhash64(text), spans are the word ranges to remove, ascending and disjoint."""
    small_batches(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("uid"), clean_text().alias("text"))
    rows = rows.select("uid", F.xxhash64("text").alias("h"), "text")
    anchors = written(rows.select("uid", "text").mapInArrow(_anchors(window, gram), "key long, doc_id long"), "anchors")
    pairs = written(_pairs(anchors), "anchor-pairs")
    found = written(meet(rows, pairs, _match(window, gram, True), _MATCHED), "matched")
    rest = found.select(F.col("uid").alias("doc_id"), F.explode("rest").alias("key")).distinct()
    more = written(_pairs(rest), "rest-pairs")
    again = meet(rows, more, _match(window, gram, False), _MATCHED)
    spans = found.where(F.size("spans") > 0).unionByName(again).groupBy("uid", "h").agg(
        F.first("text").alias("text"), F.flatten(F.collect_list("spans")).alias("spans"))
    kind = "doc_id long, h long, text string, spans array<struct<start:int,end:int>>"
    return spans.select(F.col("uid").alias("doc_id"), "h", "text", "spans").mapInArrow(_merge(window), kind)


def _kept(digests: bool, with_spans: bool) -> Callable:
    """Rows (doc_id, h, text[, spans]): the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring_dedup")
        for batch in batches:
            cut = batch.column(3).to_pylist() if with_spans else None
            n_words, n_removed, kept = [], [], []
            for lo, hi, words in segmented(batch.column(2), NON_SPACE):
                for i in range(hi - lo):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    own, removed = [], 0
                    for s in cut[lo + i] if cut else ():
                        own += words.byte_words(a, int(words.first[i]) + s["start"])
                        a = int(words.first[i]) + s["end"]
                        removed += s["end"] - s["start"]
                    own += words.byte_words(a, b)
                    joined = b" ".join(own)
                    n_words.append(int(words.first[i + 1] - words.first[i]))
                    n_removed.append(removed)
                    kept.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["doc_id", "h", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept, the remaining words joined by one space
    (their SHA-256 with ``digests``, so that texts are not shuffled once more)."""
    kind = "doc_id long, h long, n_words long, n_removed long, kept string"
    cut = repeated_spans(docs, window, gram).mapInArrow(_kept(digests, True), kind)
    text = clean_text()
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    whole = whole.mapInArrow(_kept(digests, False), kind)
    cut = cut.select("doc_id", "h", F.col("n_removed").alias("cut_removed"), F.col("kept").alias("cut_kept"))
    return whole.join(cut, ["doc_id", "h"], "left").select(
        "doc_id", "n_words", F.coalesce("cut_removed", "n_removed").alias("n_removed"), F.coalesce("cut_kept", "kept").alias("kept"))


@query("op7_substring_dedup", oracle=r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
        FROM d, unnest(range(1, len(w) - 48)) AS r(i) WHERE len(w) >= 50),
firsts AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (g) WHERE first_id < doc_id),
cut AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, digests=True).select(
        "doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
