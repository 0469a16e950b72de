"""Operator 6, benchmark decontamination: generalised suffix automaton of the test items.

The items' normalised words (A-Z lower-cased, runs of digits, a-z and
non-ASCII characters) go into one generalised suffix automaton, whose states
know the items they occur in.  Documents are streamed through it as words; the
longest matching length at each word says which windows occur there.  A window
is ``WINDOW`` consecutive words of an item, or a shorter item whole.

The automaton is walked in Python, so each task first keeps only the runs of
words whose every neighbouring pair occurs in some item: exactly the paths on
which the automaton stays two levels deep.  That test is a bitmap lookup over
all words of a batch (false positives only cost a walk).

Items are dealt to shards of about ``SHARD_BYTES`` of text, one automaton each,
so what a task gets is bounded; with more than one shard the documents are
streamed once per shard, each shard's spans are written by text digest before the
next one is collected, and merged by a group-by.

Defined cases: null or wordless texts and items have no words and match
nothing; an empty benchmark matches nothing.  Items with equal words both
match.  An item without an id still marks words but is not listed.  Repeated
document rows give repeated result rows.  Columns beside the id and the text
are not read by ``matches``, and ``clean`` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.automaton import SuffixAutomaton
from plantlens.llm.common import clean_text, enter, fresh, query, small_batches, table, written
from plantlens.llm.words import ALNUM, LOWER, Words, grams, mix, segmented

#: Words of a window.
WINDOW = 10
#: Bytes of item text in one automaton.
SHARD_BYTES = 4 << 20
#: A document is dropped when more than this share of its words lies in removed spans.
MAX_COVERAGE = 0.5
_BITS = 20


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    w = Words(data, np.array([0, len(data)]), ALNUM)
    return w.byte_words(0, len(w))


class ItemAutomaton:
    """The automaton of one shard of items, with the items of each window state."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.window = window
        seqs = [(None if i is None else str(i), w) for i, t in items if (w := item_words(t))]
        self.sam = SuffixAutomaton()
        for _, w in seqs:
            self.sam.add(w)
        self.owners: dict[int, set] = {}   # window state -> items
        self.short: dict[int, list] = {}   # state -> [(words of the short item, item)]
        for ident, w in seqs:
            for i, (state, _) in enumerate(self.sam.states(w)):
                if i + 1 >= window:
                    self.owners.setdefault(self._at(state, window), set()).add(ident)
            if len(w) < window:
                self.short.setdefault(self._at(state, len(w)), []).append((len(w), ident))
        self.least = min((min(len(w), window) for _, w in seqs), default=0)
        self._bitmaps([w for _, w in seqs])

    def _at(self, state: int, n: int) -> int:
        """The state of the last n words read."""
        while self.sam.length[self.sam.link[state]] >= n and state:
            state = self.sam.link[state]
        return state

    def _bitmaps(self, seqs: list[list[bytes]]) -> None:
        """Which hashed words (``least`` 1) or pairs of neighbouring words occur in items."""
        self.hit = np.zeros(1 << _BITS, bool)
        for w in seqs:
            data = np.frombuffer(b" ".join(w), np.uint8)
            h = Words(data, np.array([0, len(data)]), ALNUM).hashes()
            keys = mix(h) if self.least < 2 else grams(h, 2)
            self.hit[keys >> np.uint64(64 - _BITS)] = True

    def runs(self, words: Words) -> list[tuple[int, int]]:
        """Word ranges, each inside one text, that may hold a window."""
        h, n = words.hashes(), len(words)
        pairs = self.least >= 2
        if not self.least or n < self.least:
            return []
        ok = self.hit[(grams(h, 2) if pairs else mix(h)) >> np.uint64(64 - _BITS)].copy()
        if pairs:
            inner = words.first[1:-1]
            ok[inner[(inner > 0) & (inner < n)] - 1] = False
        flags = np.zeros(len(ok) + 2, np.int8)
        flags[1:-1] = ok
        edge = np.diff(flags)
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + pairs
        long = hi - lo >= self.least
        out = []
        for a, b in zip(lo[long].tolist(), hi[long].tolist()):
            cuts = words.first[(words.first > a) & (words.first < b)].tolist() if not pairs else []
            for c, d in zip([a, *cuts], [*cuts, b]):
                out.append((c, d))
        return out

    def walk(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans (from, to) of the words inside windows, and the items whose windows occur."""
        spans: list[list[int]] = []
        found: set = set()
        link, length = self.sam.link, self.sam.length

        def mark(a: int, b: int) -> None:
            while spans and a <= spans[-1][1]:
                last = spans.pop()
                a, b = min(a, last[0]), max(b, last[1])
            spans.append([a, b])

        for i, (state, matched) in enumerate(self.sam.states(seq)):
            if matched >= self.window:
                mark(i + 1 - matched, i + 1)
                found |= self.owners[self._at(state, self.window)]
            if self.short:
                v = state
                while v > 0:
                    for n, ident in self.short.get(v, ()):
                        if n <= matched and length[link[v]] < n:
                            mark(i + 1 - n, i + 1)
                            found.add(ident)
                    v = link[v]
        return [tuple(s) for s in spans], found


def _scan(automaton, schema: pa.Schema, others: int) -> Callable:
    """Texts in column 0: adds n_words, spans (word and byte positions) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontaminate")
        own: ItemAutomaton = automaton.value
        for batch in batches:
            n_words: list = [0] * batch.num_rows
            spans: list = [[] for _ in range(batch.num_rows)]
            items: list = [set() for _ in range(batch.num_rows)]
            for lo, hi, words in segmented(batch.column(0), ALNUM, lower=True):
                n_words[lo:hi] = np.diff(words.first).tolist()
                for a, b in own.runs(words):
                    found, idents = own.walk(words.byte_words(a, b))
                    if found:
                        row = int(np.searchsorted(words.first, a, "right")) - 1
                        base, at = int(words.first[row]), int(words.bounds[row])
                        spans[lo + row] += [{
                            "start": a + s - base, "end": a + e - base,
                            "from_byte": int(words.start[a + s]) - at, "to_byte": int(words.end[a + e - 1]) - at}
                            for s, e in found]
                        items[lo + row] |= idents
            named = [sorted(x for x in s if x is not None) for s in items]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:others], *(pa.array(v, f.type) for v, f in zip((n_words, spans, named), list(schema)[others:]))],
                schema=schema)

    return run


SPANS = "array<struct<start:int,end:int,from_byte:int,to_byte:int>>"


def _shard(benchmark: DataFrame, k: int, n: int) -> list[tuple]:
    """The items of one of ``n`` shards: a bounded number of bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), clean_text().alias("text"))
    part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
    return [(r.item_id, r.text) for r in part.collect()]


def _matched(front: DataFrame, automaton) -> DataFrame:
    """The frame (texts in column 0) with n_words, spans and items under one automaton."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = front.limit(0).selectExpr("*", "0L AS n_words", f"CAST(NULL AS {SPANS}) AS spans", "array('') AS items").schema
    for f in kind:
        f.nullable = True
    return front.mapInArrow(_scan(automaton, to_arrow_schema(kind), len(front.columns)), kind)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
            text_col: str = "text") -> DataFrame:
    """The documents' columns with n_words (long), spans (words of each text inside windows,
    ascending, disjoint, with their byte positions) and items (ids whose windows occur,
    sorted as strings).  Added columns replace columns of the same names."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.drop("n_words", "spans", "items")
    front = base.select(clean_text(text_col).alias(text_col), *[c for c in base.columns if c != text_col])
    size = benchmark.agg(F.sum(F.octet_length(clean_text()))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    if n == 1:
        return _matched(front, spark.sparkContext.broadcast(ItemAutomaton(_shard(benchmark, 0, 1), window)))
    # what a shard finds in a text is written, and its automaton given up before the next one
    key = fresh(base.columns, "text_key")
    digest = F.unhex(F.md5(F.col(text_col).cast("binary")))
    found = []
    for k in range(n):
        automaton = spark.sparkContext.broadcast(ItemAutomaton(_shard(benchmark, k, n), window))
        hits = _matched(front.select(text_col), automaton).where(F.size("spans") > 0).select(digest.alias(key), "spans", "items")
        found.append(written(hits.groupBy(key).agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "shard-spans"))
        automaton.destroy()
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    both = both.groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))  # one row a shard
    both = written(both.select(key, merged("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")), "spans")
    counted = front.withColumns({key: digest, "n_words": F.regexp_count(text_col, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")})
    return counted.join(both, key, "left").select(
        *front.columns, "n_words", F.coalesce("spans", F.expr(f"CAST(array() AS {SPANS})")).alias("spans"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def merged(spans: str):
    """An array of spans as disjoint ascending spans."""
    return F.expr(f"""aggregate(array_sort({spans}), CAST(array() AS {SPANS}), (acc, x) ->
        IF(size(acc) > 0 AND element_at(acc, -1).end >= x.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct(
               'start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end),
               'from_byte', element_at(acc, -1).from_byte, 'to_byte', greatest(element_at(acc, -1).to_byte, x.to_byte)))),
           concat(acc, array(x))))""")


def covered(spans: str = "spans"):
    """Words inside the spans."""
    return F.expr(f"aggregate({spans}, 0L, (acc, x) -> acc + x.end - x.start)")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("decontaminate")
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if spans:
                raw, at, parts = text.encode(), 0, []
                for s in spans:
                    parts.append(raw[at:s["from_byte"]])
                    at = s["to_byte"]
                text = b"".join([*parts, raw[at:]]).decode()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=batch.schema.names)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents without the spans that benchmark windows cover; a document of which they
    cover more than ``max_coverage`` of the words goes.  n_chars, when there, is recounted."""
    found = matches(docs, benchmark, window).where(covered() <= F.col("n_words") * max_coverage)
    others = [c for c in found.columns if c not in ("text", "spans")]
    cut = found.select("text", "spans", *others)
    cut = cut.mapInArrow(_cut, cut.schema)
    changed = F.size("spans") > 0
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


@query("op6_decontaminate", oracle=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
        FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
occ AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
