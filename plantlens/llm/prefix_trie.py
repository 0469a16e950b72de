"""Operator 12, the prefix trie of rebuilt conversations by composable fingerprints.

Conversations are rebuilt from the head of a base conversation and their own
turns after as many (``head_of`` and ``base_of`` say how many, and which base).  A
sequence of turns has a fingerprint in a monoid: (number of turns, value), with
(n, v) * (m, w) = (n + m, v * B^m + w) modulo four primes.  So:

1. Turns are ordered by a range partitioning; each partition computes the products of
   its turns' prefixes, and one row per partition (the product of its last, unfinished
   conversation) is composed along the partitions.  No conversation lies in one task.
2. A rebuilt prefix is the base head's product times the quotient of two own products:
   v(own k) + (v(head) - v(own h)) * B^(k - h).  Texts are never rebuilt or moved: a
   rebuilt turn is a fingerprint and a reference (conversation, turn) to an original one.
3. Rebuilt prefixes of one depth and fingerprint are a node.  The turns its members refer
   to last must be equal: turns of one content hash are compared by their whole roles and
   texts, and a node's members must refer to one content.  By induction from the root all
   members' prefixes are then equal.  If a collision shows, everything is computed again
   with another seed.
4. Sums over subtrees need no descent.  A node is represented by its smallest member; on
   a conversation's path the nodes that it represents are the last ones.  Hence the
   saved bytes below a node are what its members hold from that depth down to where each
   represents its own nodes, and the leaves are members that represent a childless node.
5. The ids that end in a node are sorted over all partitions, joined in pieces, and the
   pieces are hashed one after the other.

Long conversations are dealt out in stretches of ``STRETCH`` turns where they meet a row
per conversation; parents of many children (at most ``HOT`` nodes can have a
``HOT``-th of all) are broadcast, the others joined by key.

Defined cases: rows without a conversation id are left out; turns of equal
number are ordered by role, then by the first 64 characters, then by a hash of role and
text (null before all numbers); repeated rows are turns of their own; null or missing
role and text are empty; a conversation may rebuild to no turn (it ends in the root); an
empty table has no node.  Division is that of SQL (truncated) for negative ids.  Columns
beside the four are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import query, table, written

#: The largest primes below 2^31; a fingerprint has one lane for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
#: Turns of one conversation that meet its row in one task.
STRETCH = 4096
#: At most so many nodes are broadcast as parents of many children.
HOT = 1000
#: Ids that are joined to one string before they are hashed.
PIECE = 4096
#: Heads have fewer turns than this; and the ids with a common base.
HEADS = 9
FAMILY = 5
#: Seeds that are tried before a collision is an error.
SEEDS = 5

KEY = ["depth", "f1", "f2"]
_LOW = (1 << 31) - 1


def head_of(conv: Column) -> Column:
    """How many turns a conversation takes from its base, and leaves out of its own."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("long")


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


class Lanes:
    """The monoid's values: arrays of four rows, one lane for each prime."""

    def __init__(self, seed: int) -> None:
        rng = random.Random(seed)
        self.p = np.array(PRIMES, np.int64)[:, None]
        self.base = [rng.randrange(2, p) for p in PRIMES]
        self.inverse = [pow(b, -1, p) for b, p in zip(self.base, PRIMES)]

    def powers(self, exponents: np.ndarray, bases: list[int] | None = None) -> np.ndarray:
        """B^n of every exponent, by squaring."""
        out = np.ones((4, len(exponents)), np.int64)
        square = np.array(bases or self.base, np.int64)[:, None] % self.p
        for bit in range(int(exponents.max(initial=0)).bit_length()):
            odd = (exponents >> bit) & 1 == 1
            out[:, odd] = out[:, odd] * square % self.p
            square = square * square % self.p
        return out

    def turns(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The values of single turns, from the two halves of their content hash."""
        return np.mod(np.stack([a, a, b, b]), self.p)

    def prefixes(self, t: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Products of each row's stretch up to the row; ``start`` is the index of the first."""
        at = np.arange(t.shape[1])
        total = np.cumsum(t * self.powers(at, self.inverse) % self.p, axis=1)
        below = np.concatenate([np.zeros((4, 1), np.int64), total], axis=1)[:, start]
        return (total - below) % self.p * self.powers(at) % self.p

    def shifted(self, value: np.ndarray, by: np.ndarray) -> np.ndarray:
        return value * self.powers(by) % self.p

    @staticmethod
    def pack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[0] << 31 | v[1], v[2] << 31 | v[3]

    @staticmethod
    def unpack(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
        return np.stack([f1 >> 31, f1 & _LOW, f2 >> 31, f2 & _LOW])

    def parent(self) -> tuple[Column, Column]:
        """The fingerprint without the last turn (columns f1, f2, a, b)."""
        def lane(k: int) -> Column:
            f, h = F.col("f1" if k < 2 else "f2"), F.col("a" if k < 2 else "b")
            v = F.shiftright(f, 31) if k % 2 == 0 else f.bitwiseAND(F.lit(_LOW))
            p = F.lit(PRIMES[k])
            return F.pmod((v - F.pmod(h, p)) * F.lit(self.inverse[k]), p)
        return tuple(F.shiftleft(lane(k), 31).bitwiseOR(lane(k + 1)) for k in (0, 2))


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


#: A turn in its conversation: the product, and the bytes, of the conversation up to it.
OWN = "part int, conv_id long, k long, f1 long, f2 long, a long, b long, bytes long, pb long"
#: A turn in a rebuilt conversation.
REBUILT = "conv_id long, depth long, f1 long, f2 long, a long, b long, bytes long, pb long, last boolean"


def _hashed(conversations: DataFrame, seed: int) -> DataFrame:
    """Turns with the two halves of their content's hash."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return rows.where(F.col("conv_id").isNotNull()).select(
        "*", *[F.xxhash64(F.lit(2 * seed + k), "role", "text").alias(c) for k, c in enumerate("ab")])


def _products(turns: DataFrame, lanes: Lanes) -> DataFrame:
    """``OWN`` rows: a scan of the ordered turns in two passes."""
    spark = turns.sparkSession
    first = [F.substring(c, 1, 64).alias(f"{c}64") for c in ("role", "text")]
    rows = turns.select("conv_id", "turn", *first, "a", "b", F.octet_length("text").cast("long").alias("bytes"),
                        F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role64"), F.col("text64"), F.col("a"), F.col("b"), F.col("row")]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        conv_before, k_before, pb_before, v_before = None, 0, 0, np.zeros((4, 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, a, b, size = _arrays(batch)
            at = np.arange(len(conv))
            new = np.concatenate([[conv[0] != conv_before], conv[1:] != conv[:-1]])
            start = np.maximum.accumulate(np.where(new, at, 0))
            v = lanes.prefixes(lanes.turns(a, b), start)
            total = np.cumsum(size)
            k, pb = at - start + 1, total - (total - size)[start]
            if not new[0]:  # goes on from the batch before
                on = np.flatnonzero(start == 0) if not new.any() else at[:int(np.argmax(new))]
                v[:, on] = (v[:, on] + lanes.shifted(v_before, on + 1)) % lanes.p
                k[on] += k_before
                pb[on] += pb_before
            conv_before, k_before, pb_before, v_before = conv[-1], k[-1], pb[-1], v[:, -1:]
            yield _batch(OWN, np.full(len(conv), part, np.int32), conv, k, *lanes.pack(v), a, b, size, pb)

    scan = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "bytes")
                   .mapInArrow(local, OWN), "trie-scan")
    # one row per partition: which conversation it begins with, and the product that it ends with
    ends = (scan.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "k", "f1", "f2", "pb")).alias("end"))
            .orderBy("part").collect())
    carried = {}
    open_ = None  # conversation, turns, value and bytes at the end of the partitions so far
    for r in ends:
        e = r["end"]
        k, pb, v = e.k, e.pb, lanes.unpack(*(np.array([x]) for x in (e.f1, e.f2)))
        if open_ is not None and open_[0] == r["first"]:
            carried[r["part"]] = open_
            if e.conv_id == r["first"]:
                v = (v + lanes.shifted(open_[2], np.array([k]))) % lanes.p
                k, pb = k + open_[1], pb + open_[3]
        open_ = (e.conv_id, k, v, pb)
    before = spark.sparkContext.broadcast(carried)  # at most one entry per partition

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, conv, k, f1, f2, a, b, size, pb = (x.copy() for x in _arrays(batch))
            v = lanes.unpack(f1, f2)
            for p in np.unique(part).tolist():
                if p in before.value:
                    c, n, value, sofar = before.value[p]
                    on = np.flatnonzero((part == p) & (conv == c))
                    v[:, on] = (v[:, on] + lanes.shifted(value, k[on])) % lanes.p
                    k[on] += n
                    pb[on] += sofar
            yield _batch(OWN, part, conv, k, *lanes.pack(v), a, b, size, pb)

    return scan.mapInArrow(lift, OWN)


def _plan(own: DataFrame) -> DataFrame:
    """One row per conversation: its base's head, and the products and bytes where they meet."""
    turn = F.struct("k", "f1", "f2", "a", "b", "bytes", "pb")
    info = own.groupBy("conv_id").agg(F.max("k").alias("n"), F.max("pb").alias("all_bytes"),
                                      F.sort_array(F.collect_list(F.when(F.col("k") < HEADS, turn))).alias("head"))
    base = info.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))

    def at(turns: str, n: str, field: str) -> Column:
        return F.when(F.col(n) > 0, F.expr(f"{turns}[int({n}) - 1].{field}")).otherwise(F.lit(0)).cast("long")

    both = (info.withColumns({"h": head_of(F.col("conv_id")), "base": base_of(F.col("conv_id"))}).join(base, "base", "left")
            .withColumn("n_head", F.least("h", F.coalesce("base_n", F.lit(0))))
            .withColumn("n_gone", F.least("h", "n")))
    return both.select(
        "conv_id", "n", "h", "n_head", F.slice(F.coalesce("base_head", F.array().cast(info.schema["head"].dataType)), F.lit(1),
                                               F.col("n_head").cast("int")).alias("turns"),
        at("base_head", "n_head", "f1").alias("h1"), at("base_head", "n_head", "f2").alias("h2"),
        at("head", "n_gone", "f1").alias("g1"), at("head", "n_gone", "f2").alias("g2"),
        (at("base_head", "n_head", "pb") - at("head", "n_gone", "pb")).alias("more_bytes"),
        (F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
        (F.col("all_bytes") - at("head", "n_gone", "pb") + at("base_head", "n_head", "pb")).alias("total_bytes"))


def _rebuilt(own: DataFrame, plan: DataFrame, lanes: Lanes) -> DataFrame:
    """``REBUILT`` rows, one per turn of each rebuilt conversation."""
    heads = plan.select("conv_id", "total", F.explode("turns").alias("t")).select(
        "conv_id", F.col("t.k").alias("depth"), "t.f1", "t.f2", "t.a", "t.b", "t.bytes", "t.pb", (F.col("t.k") == F.col("total")).alias("last"))
    stretches = plan.where("n > h").select(
        "conv_id", "n", "n_head", "h1", "h2", "g1", "g2", "more_bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / STRETCH))).alias("stretch"))
    tails = (own.withColumns({"h": head_of(F.col("conv_id")), "stretch": F.floor(F.col("k") / STRETCH)})
             .where("k > h").join(stretches, ["conv_id", "stretch"])
             .select("conv_id", "k", "f1", "f2", "a", "b", "bytes", F.col("pb") + F.col("more_bytes"), "n", "h", "n_head", "h1", "h2", "g1", "g2"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, k, f1, f2, a, b, size, pb, n, h, n_head, h1, h2, g1, g2 = _arrays(batch)
            change = (lanes.unpack(h1, h2) - lanes.unpack(g1, g2)) % lanes.p
            v = (lanes.unpack(f1, f2) + lanes.shifted(change, k - h)) % lanes.p
            yield _batch(REBUILT, conv, n_head + k - h, *lanes.pack(v), a, b, size, pb, k == n)

    return heads.unionByName(tails.mapInArrow(compose, REBUILT))


def _ends(ends: DataFrame) -> DataFrame:
    """Per node the digest of the ids that end there: (depth, f1, f2, ends_sha256)."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        names = [*KEY, "first", "piece"]

        def piece():
            return pa.RecordBatch.from_pylist([dict(zip(names, [*key, ids[0], ",".join(map(str, ids))]))],
                                              pa.schema([*[(c, pa.int64()) for c in names[:4]], ("piece", pa.string())]))
        for batch in batches:
            for *now, conv in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if ids and (now != key or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = now
                ids.append(conv)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        schema = pa.schema([*[(c, pa.int64()) for c in KEY], ("ends_sha256", pa.string())])
        for batch in batches:
            for *now, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if now != key:
                    if key is not None:
                        done.append(dict(zip(schema.names, [*key, digest.hexdigest()])))
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, [*key, digest.hexdigest()]))], schema)

    order = [*KEY, "conv_id"]
    pieces = (ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(joined, "depth long, f1 long, f2 long, first long, piece string"))
    return (pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "piece")
            .mapInArrow(hashed, "depth long, f1 long, f2 long, ends_sha256 string"))


def _equal_contents(turns: DataFrame) -> bool:
    """Whether turns of one hash have one role and one text."""
    return (turns.groupBy("a", "b").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)])
            .where("min_role <> max_role OR min_text <> max_text").isEmpty())


def trie(conversations: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes), ends_sha256; and bytes (of the node's last text)."""
    for seed in range(SEEDS):
        nodes = _trie(conversations, seed)
        if nodes is not None:
            return nodes
    raise RuntimeError(f"fingerprints collide under each of {SEEDS} seeds")


def _trie(conversations: DataFrame, seed: int) -> DataFrame | None:
    lanes = Lanes(seed)
    turns = _hashed(conversations, seed)
    if not _equal_contents(turns):
        return None
    own = written(_products(turns, lanes), "trie-own")
    plan = written(_plan(own), "trie-plan")
    rebuilt = written(_rebuilt(own, plan, lanes), "trie-rebuilt")
    groups = rebuilt.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("pb").alias("pb"),
        *[F.max(c).alias(c) for c in "ab"], *[F.min(c).alias(f"min_{c}") for c in "ab"])
    root = plan.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").selectExpr(
        "0L AS depth", "0L AS f1", "0L AS f2", "n_convs", "conv_id", "0L AS bytes", "0L AS pb", "0L AS a", "0L AS b", "0L AS min_a", "0L AS min_b")
    p1, p2 = lanes.parent()
    nodes = written(groups.unionByName(root).withColumns({"p0": F.col("depth") - 1, "p1": p1, "p2": p2}), "trie-nodes")
    n_nodes, mixed = nodes.agg(F.count("*"), F.count(F.when((F.col("a") != F.col("min_a")) | (F.col("b") != F.col("min_b")), 1))).first()
    if mixed:
        return None
    children = nodes.where("depth > 0").groupBy(*[F.col(f"p{k}").alias(c) for k, c in enumerate(KEY)]).agg(F.count("*").alias("n_children"))
    linked = written(nodes.join(children, KEY, "left").fillna(0, ["n_children"]).drop("a", "b", "min_a", "min_b"), "trie-linked")

    # the parent's smallest member; at most HOT nodes have a HOT-th of all nodes as children
    parents = linked.where("n_children > 0").select(*[F.col(c).alias(f"p{k}") for k, c in enumerate(KEY)],
                                                    F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") >= max(64, n_nodes // HOT + 1)
    up = ["p0", "p1", "p2"]
    near = linked.join(F.broadcast(parents.where(many).drop("n_children")), up, "left")
    found = near.where("parent_conv_id IS NOT NULL OR depth = 0").unionByName(
        near.where("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id").join(parents.where(~many).drop("n_children"), up))

    # what each conversation holds above the nodes that it represents, and whether its last node is a leaf
    own_nodes = linked.groupBy("conv_id").agg(F.min(F.col("pb") - F.col("bytes")).alias("from_byte"),
                                              F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    stats = written(plan.select("conv_id", "total", "total_bytes").join(own_nodes, "conv_id", "left").select(
        "conv_id", "total", F.coalesce("from_byte", "total_bytes").alias("until"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")), "trie-stats")
    above = F.col("pb") - F.col("bytes")
    dealt = stats.where("total > 0").select("conv_id", "until", "leaf",
                                            F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / STRETCH))).alias("stretch"))
    sums = (rebuilt.withColumn("stretch", F.floor(F.col("depth") / STRETCH)).join(dealt, ["conv_id", "stretch"]).groupBy(*KEY)
            .agg(F.sum(F.greatest(F.col("until") - above, F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
            .unionByName(stats.agg(F.sum("until").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
                         .selectExpr("0L AS depth", "0L AS f1", "0L AS f2", "saved_tokens", "n_leaves")))
    ends = _ends(rebuilt.where("last").select(*KEY, "conv_id").unionByName(
        stats.where("total = 0").selectExpr("0L AS depth", "0L AS f1", "0L AS f2", "conv_id")))
    none = hashlib.sha256(b"").hexdigest()
    return (found.join(sums, KEY).join(ends, KEY, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "bytes"))


def node_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with the reference (turn_conv_id, turn_number, from 1) of their last turn, as
    their smallest member holds it."""
    sizes = conversations.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("base")).agg(F.count("*").alias("base_n"))
    h = head_of(F.col("conv_id"))
    n_head = F.least(h, F.coalesce("base_n", F.lit(0)))
    return (nodes.withColumn("base", base_of(F.col("conv_id"))).join(sizes, "base", "left")
            .withColumns({"turn_conv_id": F.when(F.col("depth") > 0, F.when(F.col("depth") <= n_head, F.col("base")).otherwise(F.col("conv_id"))),
                          "turn_number": F.when(F.col("depth") > 0, F.when(F.col("depth") <= n_head, F.col("depth")).otherwise(F.col("depth") - n_head + h))})
            .drop("base", "base_n"))


#: CRC-32 by its polynomial, byte by byte; then the definitions, one by one: nodes by the
#: list of turns, subtrees by the prefixes of each node's smallest member.
ORACLE = """
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda s, x: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END) AS c
    FROM range(256) r(i))),
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         md5(role) || md5(text) AS t, strlen(text) AS bytes
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda s, x: xor(s // 256, t[xor(s, x) % 256 + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc),
rebuilt AS (
  SELECT c.conv_id, o.k AS p, o.t, o.bytes FROM heads c JOIN own o ON o.conv_id = c.base AND o.k <= c.h
  UNION ALL
  SELECT c.conv_id, o.k + 1000000, o.t, o.bytes FROM heads c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list(t) OVER w AS path, list(t) OVER w AS up, bytes
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY p)
  UNION ALL SELECT conv_id, 0, [], [], 0 FROM heads),
members AS (SELECT conv_id, depth, md5(path::VARCHAR) AS node, md5(path[:depth - 1]::VARCHAR) AS parent, bytes FROM paths),
ended AS (
  SELECT depth, node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM members) WHERE depth = last GROUP BY ALL),
nodes AS (
  SELECT depth, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes
  FROM members GROUP BY depth, node),
children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT m.depth, m.node, sum((v.n_convs - 1) * v.bytes) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes v JOIN members m ON m.conv_id = v.conv_id AND m.depth <= v.depth
  LEFT JOIN children c ON c.depth = v.depth AND c.node = v.node GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves,
       b.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent AND n.depth > 0
LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
LEFT JOIN ended e ON e.depth = n.depth AND e.node = n.node
"""


@query("op12_prefix_trie", ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("bytes")
