"""Operator 4, exact dedup: Patricia-trie owners.

Texts are dealt to partitions by (length, content hash) and inserted, whole
byte strings, into compressed radix tries.  A terminal node stands for one
distinct text and stores the smallest (or largest) identifier and the number
of rows.  Every task first inserts its own input rows into a local trie, so a
text copied millions of times leaves each task as one row; the owner of the
text's partition merges those.

Memory: owners read their rows sorted by (length, hash), the top of the trie.
Once the held bytes pass ``SPILL_BYTES``, the subtrees of all earlier prefixes
are complete and are emitted and freed.  A local trie that grows too large is
emitted whole: what it emits are partial groups, which the owner merges.

Defined cases: null text equals the empty text.  A null identifier ranks below
every other (it is kept only if the group has no other).  Rows with the same
identifier and the same text are one document: each is marked kept when its
identifier is; ``survivors`` returns one of them.  An empty table gives no
rows.  Other columns, of any name, are not read by ``memberships`` and are
returned unchanged by ``survivors``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.llm.common import clean_text, enter, fresh, query, small_batches, table

#: Bytes of text a trie may hold before finished subtrees are emitted.
SPILL_BYTES = 24 << 20


class RadixTrie:
    """A compressed trie over byte strings; a node is [children by first byte, payload]."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.root: list = [{}, None]
        self.held = 0

    @staticmethod
    def _common(label: bytes, key: bytes, at: int) -> int:
        """Length of the longest common prefix of label and key[at:], by bisection."""
        lo, hi = 1, min(len(label), len(key) - at)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if label[:mid] == key[at:at + mid]:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def terminal(self, key: bytes) -> list:
        """The node of the key, added when absent; its payload is the caller's."""
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                leaf: list = [{}, None]
                node[0][key[at]] = (key[at:], leaf)
                self.held += len(key) - at + 200
                return leaf
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = self._common(label, key, at)
            middle: list = [{label[n]: (label[n:], child)}, None]
            node[0][label[0]] = (label[:n], middle)
            self.held += 200
            node, at = middle, at + n
        return node

    def items(self):
        """(key, payload) of every terminal, in byte order."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            if node[1] is not None:
                yield prefix, node[1]
            for _, (label, child) in sorted(node[0].items(), reverse=True):
                stack.append((child, prefix + label))


def _prefix(n_bytes: int, key_hash: int) -> bytes:
    return n_bytes.to_bytes(8, "big") + (key_hash & (1 << 64) - 1).to_bytes(8, "big")


def _absorb(payload: list | None, ident: int | None, n: int, rest: object, largest: bool) -> list:
    if payload is None:
        return [ident, n, rest]
    payload[1] += n
    best = payload[0]
    if ident is not None and (best is None or (ident > best if largest else ident < best)):
        payload[0], payload[2] = ident, rest
    return payload


def _tries(schema: pa.Schema, largest: bool, is_owner: bool, limit: int) -> Callable:
    """Rows (n_bytes, key_hash, text, ident, n, rest) in; one row per terminal out."""

    def flush(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in schema]
        size = 0
        for key, (ident, n, rest) in trie.items():
            values = (int.from_bytes(key[:8], "big"), int.from_bytes(key[8:16], "big", signed=True), key[16:], ident, n, rest)
            for col, v in zip(cols, values):
                col.append(v)
            size += len(key)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                cols, size = [[] for _ in schema], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        trie.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("exact_dedup")
        trie, previous = RadixTrie(), None
        for batch in batches:
            for n_bytes, key_hash, text, ident, n, rest in zip(*(c.to_pylist() for c in batch.columns)):
                prefix = _prefix(n_bytes, key_hash)
                if trie.held > limit and (not is_owner or prefix != previous):
                    yield from flush(trie)
                previous = prefix
                node = trie.terminal(prefix + text)
                node[1] = _absorb(node[1], ident, n, rest, largest)
        yield from flush(trie)

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
           carry: tuple[str, ...] = (), limit: int = SPILL_BYTES) -> DataFrame:
    """One row per distinct text: n_bytes, key_hash, text (binary), ident (kept), n (rows),
    rest (struct of the ``carry`` columns of a kept row; a null boolean without any)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    small_batches(docs.sparkSession)
    text = clean_text(text_col)
    rest = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = docs.select(
        F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("key_hash"),
        text.cast("binary").alias("text"), F.col(id_col).cast("long").alias("ident"),
        F.lit(1).cast("long").alias("n"), rest.alias("rest"))
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)
    largest = keep == "largest"
    local = rows.mapInArrow(_tries(arrow, largest, False, limit), out)
    return (local.repartition("n_bytes", "key_hash").sortWithinPartitions("n_bytes", "key_hash")
            .mapInArrow(_tries(arrow, largest, True, limit), out))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The row that stays of each distinct text, with all its columns."""
    # the text itself is the trie's key; of a kept row only whether it was null is carried
    null = fresh(docs.columns, "text_is_null")
    others = [c for c in docs.columns if c != text_col]
    own = owners(docs.withColumn(null, F.col(text_col).isNull()), id_col, text_col, keep, carry=(*others, null))
    rest = F.col("rest").getField
    text = F.when(~rest(null), F.col("text").cast("string"))
    return own.select(*[(text if c == text_col else rest(c)).alias(c) for c in docs.columns])


def memberships(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256."""
    own = owners(docs, id_col, text_col, keep).select(
        F.sha2("text", 256).alias("own_sha"), F.col("ident").alias("keep_id"), F.col("n").alias("group_size"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(clean_text(text_col).cast("binary"), 256).alias("text_sha256"))
    return rows.join(own, F.col("text_sha256") == F.col("own_sha")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


@query("op4_exact_dedup", oracle="""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships(table(spark, sf_dir, "documents"), keep="largest")
