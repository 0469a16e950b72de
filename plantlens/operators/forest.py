"""W2 on many rows: a random forest grown level by level over packed rows.

Spark ML's forest keeps a row's count in, and its node of, every tree (about 1,000 bytes a row with
100 trees), and those copies go to disk.  Here a row is kept once, as its features' bins, its level and
a random key (16 bytes with 11 features), and both are computed anew in every scan:

* the row's count in a tree is a Poisson(1) draw from a hash of the row's key and the tree;
* its node is found by walking the tree as far as it is grown.

The trees are those of Spark ML's method: candidate splits of every feature at ``BINS`` - 1 thresholds
(midpoints between neighbouring values, by their weights), per node the best Gini gain over a random
subset of ceil(sqrt(d)) features, no split without a gain, pure nodes and the last level are leaves,
leaves of one prediction are merged; the votes of a tree are its leaf's shares of the levels.

A scan grows one level of as many trees as have their counts in ``CELLS`` cells, so a task's memory does
not grow with the rows.  Counts leave a task in pieces of ``PIECE`` nodes, are shuffled by piece and
added up one after the other; the driver gets one short record per node.  The files of a scan's
shuffle are given free after it.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, as in Spark ML; ranks that its thresholds are chosen from.
BINS, RANKS = 32, 4000
#: Counts that a task holds (of 4 bytes), nodes of a piece of them.
CELLS, PIECE = 1 << 24, 16
#: Rows of a packed block, rows that walk a tree at a time, rows of a task.
BLOCK, ROWS, TASK_ROWS = 128, 1 << 17, 4_000_000
#: Bytes of a packed row before its bins: the key and the level.
HEAD = 5


def _poisson() -> list[int]:
    """The least of 2^32 hashes that give a count of 1, 2, ... under a mean of one."""
    out, p, below = [], math.exp(-1.0), 0.0
    for n in range(1, 14):
        below += p
        out.append(min(round(below * 2 ** 32), 2 ** 32 - 1))
        p /= n
    return out


POISSON = _poisson()


def mixed(h: np.ndarray) -> np.ndarray:
    """32-bit hashes (the finish of Murmur3)."""
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def in_bag(keys: np.ndarray, tree_seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a tree draws, and how often."""
    u = mixed(keys ^ np.uint32(tree_seed))
    rows = np.flatnonzero(u >= np.uint32(POISSON[0]))
    u = u.take(rows)
    times = np.ones(len(rows), np.int32)
    often = np.flatnonzero(u >= np.uint32(POISSON[1]))
    u = u.take(often)
    for n, least in enumerate(POISSON[2:], start=2):
        times[often] = n
        more = np.flatnonzero(u >= np.uint32(least))
        often, u = often.take(more), u.take(more)
    times[often] = len(POISSON)
    return rows, times


def split_points(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> list[float]:
    """Spark ML's thresholds of a column with these distinct values (ascending)."""
    mid = [(float(a) + float(b)) / 2.0 for a, b in zip(values[:-1], values[1:])]
    if len(mid) < bins:
        return mid
    stride = float(weights.sum()) / bins
    out, upto, target = [], float(weights[0]), stride
    for i in range(1, len(values)):
        before, upto = upto, upto + float(weights[i])
        if abs(before - target) < abs(upto - target):
            out.append(mid[i - 1])
            target += stride
    return out


def thresholds(rows: DataFrame, features: Sequence[str], label: str) -> tuple[list[np.ndarray], int]:
    """Per feature its thresholds, from its approximate ranks over all rows, and the number of classes; one scan."""
    probs = F.array(*[F.lit(i / RANKS) for i in range(RANKS + 1)])
    ranks = [F.percentile_approx(F.col(f).cast("double"), probs, 10_000).alias(f"x{k}") for k, f in enumerate(features)]
    *got, most = rows.agg(*ranks, F.max(label).alias("most")).first()
    return [np.array(split_points(*np.unique(np.array(v, np.float64), return_counts=True)), np.float64) for v in got], int(most) + 1


def _column(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


def binned(batch: pa.RecordBatch, cuts: Sequence[np.ndarray], first: int = 0) -> Iterator[np.ndarray]:
    """Per feature the number of its thresholds below every row's value."""
    for f, cut in enumerate(cuts):
        v = _column(batch, first + f).astype(np.float64, copy=False)
        if np.isnan(v).any():
            raise ValueError("a feature is NaN")
        yield np.searchsorted(cut, v).astype(np.uint8)


def packed(rows: DataFrame, features: Sequence[str], label: str, cuts: Sequence[np.ndarray], seed: int) -> DataFrame:
    """``BLOCK`` rows to a binary value; a row is its key, level and bins."""
    stride = HEAD + len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        start = mixed(np.array([(seed + 7919 * TaskContext.get().partitionId()) % 2 ** 32], np.uint32))[0]
        at = 0
        for batch in batches:
            n = batch.num_rows
            out = np.empty((n, stride), np.uint8)
            out[:, :4] = mixed(mixed(np.arange(at, at + n).astype(np.uint32)) ^ start).view(np.uint8).reshape(n, 4)
            out[:, 4] = _column(batch, 0)
            for f, b in enumerate(binned(batch, cuts, 1)):
                out[:, HEAD + f] = b
            at += n
            yield pa.RecordBatch.from_arrays([pa.array([out[i:i + BLOCK].tobytes() for i in range(0, n, BLOCK)], pa.binary())], names=["block"])

    return rows.select(label, *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)]).mapInArrow(pack, "block binary")


def _chunks(batch: pa.RecordBatch, stride: int) -> Iterator[np.ndarray]:
    """The packed rows of a batch, ``ROWS`` at a time: its blocks lie one after the other."""
    blocks = batch.column(0)
    if not len(blocks):
        return
    _, offsets, values = blocks.buffers()
    at = np.frombuffer(offsets, np.int32)[blocks.offset:blocks.offset + len(blocks) + 1]
    x = np.frombuffer(values, np.uint8, int(at[-1]) - int(at[0]), int(at[0])).reshape(-1, stride)
    yield from (x[i:i + ROWS] for i in range(0, len(x), ROWS))


def walked(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, bound: np.ndarray, levels: int) -> np.ndarray:
    """The node (number in the heap) of rows that begin at ``base`` after ``levels`` steps.  A leaf's
    bound is above all bins: its rows go on to its left."""
    node = np.zeros(len(base), np.int64)
    for _ in range(levels):
        at = feature.take(node)
        at += base
        right = flat.take(at) > bound.take(node)
        node *= 2
        node += 1
        node += right
    return node


@dataclass
class Open:
    """A tree with its nodes to be split in a scan: their numbers, and the features tried in each."""

    tree: int
    seed: int
    nodes: np.ndarray
    tried: np.ndarray
    feature: np.ndarray
    bound: np.ndarray


def _counted(blocks: DataFrame, opened: Sequence[Open], level: int, stride: int, classes: int) -> DataFrame:
    """(tree, piece, counts): every task's counts by node, tried feature, bin and class."""
    tried = opened[0].tried.shape[1]
    cell = tried * BINS * classes
    first = 2 ** level - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(o.nodes) * cell, np.int32) for o in opened]
        plans = []
        for o in opened:
            slot = np.full(2 ** level, -1, np.int64)
            slot[o.nodes - first] = np.arange(len(o.nodes))
            plans.append((slot, bool((slot < 0).any()), o.feature.astype(np.int64), [np.ascontiguousarray(o.tried[:, k]).astype(np.int64) for k in range(tried)]))
        for x in (x for batch in batches for x in _chunks(batch, stride)):
            flat, level_of = np.ascontiguousarray(x).ravel(), x[:, 4].astype(np.int64)
            keys = np.ascontiguousarray(x[:, :4]).view(np.uint32).ravel()
            for o, counts, (slot, some, feature, tries) in zip(opened, total, plans):
                rows, times = in_bag(keys, o.seed)
                y = level_of.take(rows)
                rows *= stride
                rows += HEAD
                at = walked(flat, rows, feature, o.bound, level)
                at -= first
                at = slot.take(at)
                if some:
                    kept = np.flatnonzero(at >= 0)
                    at, rows, y, times = at.take(kept), rows.take(kept), y.take(kept), times.take(kept)
                y += at * cell
                for k, tries_k in enumerate(tries):
                    place = tries_k.take(at)
                    place += rows
                    place = flat.take(place) * np.int64(classes)
                    place += y
                    np.add.at(counts[k * BINS * classes:], place, times)
        for o, counts in zip(opened, total):
            parts = [counts[i:i + PIECE * cell] for i in range(0, len(counts), PIECE * cell)]
            parts = [(p, c.astype(np.min_scalar_type(int(c.max())))) for p, c in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([o.tree] * len(parts), pa.int32()), pa.array([p for p, _ in parts], pa.int32()),
                                              pa.array([c.dtype.itemsize for _, c in parts], pa.int32()), pa.array([c.tobytes() for _, c in parts], pa.binary())],
                                             names=["tree", "piece", "width", "counts"])

    return blocks.mapInArrow(count, "tree int, piece int, width int, counts binary")


def gini(counts: np.ndarray) -> np.ndarray:
    """Gini impurity over the last axis; 0 without rows."""
    n = counts.sum(axis=-1, keepdims=True)
    share = counts / np.where(n > 0, n, 1.0)
    return np.where(n[..., 0] > 0, 1.0 - (share * share).sum(axis=-1), 0.0)


def best_splits(counts: np.ndarray) -> np.ndarray:
    """Per node of counts (nodes, tried, bins, classes): number of the tried feature, last bin on the left,
    gain (negative: none), the node's counts by class, and those on the left."""
    left = counts.cumsum(axis=2)
    total = left[:, :, -1]
    nodes = total[:, 0]
    left = left[:, :, :-1]
    right = total[:, :, None] - left
    n, nl, nr = nodes.sum(axis=-1), left.sum(axis=-1), right.sum(axis=-1)
    n = np.where(n > 0, n, 1.0)[:, None, None]
    gain = gini(nodes)[:, None, None] - nl / n * gini(left) - nr / n * gini(right)
    gain = np.where((nl > 0) & (nr > 0), gain, -1.0).reshape(len(counts), -1)
    best, at = gain.argmax(axis=1), np.arange(len(counts))
    tried, last = np.divmod(best, counts.shape[2] - 1)
    return np.column_stack([tried, last, gain[at, best], nodes, left[at, tried, last]])


def _split(counted: DataFrame, tried: int, classes: int) -> dict[tuple[int, int], np.ndarray]:
    """Per (tree, piece) the best splits of its nodes, from all tasks' counts."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, total):
            found = best_splits(total.reshape(-1, tried, BINS, classes).astype(np.float64))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([found.tobytes()], pa.binary())],
                                              names=["tree", "piece", "splits"])
        key, total = None, None
        for batch in batches:
            for tree, piece, width, counts in zip(*(batch.column(k) for k in range(4))):
                now = tree.as_py(), piece.as_py()
                part = np.frombuffer(counts.as_buffer(), f"u{width.as_py()}")
                if now != key:
                    if key is not None:
                        yield row(key, total)
                    key, total = now, part.astype(np.int64)
                else:
                    total += part
        if key is not None:
            yield row(key, total)

    keys = ["tree", "piece"]
    got = counted.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, "tree int, piece int, splits binary").collect()
    return {(r["tree"], r["piece"]): np.frombuffer(r["splits"], np.float64).reshape(-1, 3 + 2 * classes) for r in got}


def _batches(opened: Sequence[Open], classes: int, cells: int) -> Iterator[list[Open]]:
    """As many trees at a time as have their counts in ``cells`` (one at least)."""
    batch, used = [], 0
    for o in opened:
        size = o.tried.size * BINS * classes
        if batch and used + size > cells:
            yield batch
            batch, used = [], 0
        batch.append(o)
        used += size
    if batch:
        yield batch


@dataclass
class Forest:
    """Trees in heaps: per tree and inner node its feature and bound, its gain, the counts by class of all nodes."""

    features: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    bound: np.ndarray
    gain: np.ndarray
    counts: np.ndarray

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 1

    def prune(self) -> None:
        """Two leaves that predict the same become one, as in Spark ML."""
        inner, same = self.gain.shape[1], self.counts.argmax(axis=2)
        for i in range(inner - 1, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            leaves = (self.gain[:, a] <= 0) & (self.gain[:, b] <= 0) if b < inner else True
            gone = (self.gain[:, i] > 0) & leaves & (same[:, a] == same[:, b])
            self.gain[gone, i], self.feature[gone, i], self.bound[gone, i] = 0.0, 0, 255

    def importances(self) -> np.ndarray:
        """Every tree's gains by feature, times the rows of the node, as shares; their mean over the trees."""
        total = np.zeros(len(self.features))
        for t in range(len(self.feature)):
            gains = np.maximum(self.gain[t], 0.0) * self.counts[t, :self.gain.shape[1]].sum(axis=1)
            own = np.bincount(self.feature[t], gains, len(self.features))
            total += own / own.sum() if own.sum() > 0 else 0.0
        return total / total.sum() if total.sum() > 0 else total

    def votes(self) -> np.ndarray:
        """Per tree and node of the last level the class shares of the leaf that holds it."""
        own, depth = self.counts.copy(), self.depth
        for i in range(self.gain.shape[1]):
            leaf = ~(self.gain[:, i] > 0)
            for child in (2 * i + 1, 2 * i + 2):
                own[leaf, child] = own[leaf, i]
        last = own[:, 2 ** depth - 1:]
        return last / np.maximum(last.sum(axis=2, keepdims=True), 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction``: the class of most votes, the first of equals."""
        names, cuts, depth = [f"_x{k}" for k in range(len(self.features))], self.cuts, self.depth
        feature, bound, votes = self.feature, self.bound, self.votes()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide = feature.astype(np.int64)
            for batch in batches:
                own = batch.num_columns - len(names)
                flat = np.stack(list(binned(batch, cuts, own)), axis=1).ravel()
                base = np.arange(batch.num_rows) * len(names)
                total = np.zeros((batch.num_rows, votes.shape[2]))
                for t in range(len(wide)):
                    total += votes[t].take(walked(flat, base, wide[t], bound[t], depth) - (2 ** depth - 1), axis=0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(total.argmax(axis=1).astype(np.float64))], names=[*batch.schema.names[:own], "prediction"])

        from pyspark.sql.types import StructType
        rows = df.select("*", *[F.col(f).cast("double").alias(n) for f, n in zip(self.features, names)])
        return rows.mapInArrow(score, StructType([*df.schema.fields]).add("prediction", "double"))


def fit(rows: DataFrame, features: Sequence[str], label: str, n_rows: int, trees: int = 100, depth: int = 12, seed: int = 42, cells: int = CELLS) -> Forest:
    """A forest on rows without missing values; ``label`` is a class number from 0."""
    features = list(features)
    session = rows.sparkSession
    cores = session.sparkContext.defaultParallelism
    cuts, classes = thresholds(rows, features, label)
    d, stride, tried = len(features), HEAD + len(features), math.ceil(math.sqrt(len(features)))
    draw = np.random.default_rng(seed)
    seeds = draw.integers(0, 2 ** 32, trees)
    inner = 2 ** depth - 1
    forest = Forest(features, cuts, np.zeros((trees, inner), np.uint8), np.full((trees, inner), 255, np.uint8),
                    np.zeros((trees, inner)), np.zeros((trees, 2 * inner + 1, classes)))
    blocks = packed(rows, features, label, cuts, seed).repartition(cores * math.ceil(n_rows / (cores * TASK_ROWS))).persist()
    nodes = {t: np.zeros(1, np.int64) for t in range(trees)}
    try:
        for level in range(depth):
            opened = [Open(t, int(seeds[t]), own, draw.random((len(own), d)).argsort(axis=1)[:, :tried].astype(np.uint8), forest.feature[t, :2 ** level - 1], forest.bound[t, :2 ** level - 1])
                      for t, own in nodes.items() if len(own)]
            nodes = {}
            for batch in _batches(opened, classes, cells):
                found = _split(_counted(blocks, batch, level, stride, classes), tried, classes)
                for o in batch:
                    got = np.concatenate([found[o.tree, p] for p in range(math.ceil(len(o.nodes) / PIECE))])
                    total, left, gain = got[:, 3:3 + classes], got[:, 3 + classes:], got[:, 2]
                    forest.counts[o.tree, o.nodes] = total
                    ok = gain > 0
                    own = o.nodes[ok]
                    forest.feature[o.tree, own] = o.tried[ok, got[ok, 0].astype(np.int64)]
                    forest.bound[o.tree, own] = got[ok, 1].astype(np.uint8)
                    forest.gain[o.tree, own] = gain[ok]
                    children = np.concatenate([2 * own + 1, 2 * own + 2])
                    forest.counts[o.tree, children] = np.concatenate([left[ok], (total - left)[ok]])
                    nodes[o.tree] = np.sort(children[(forest.counts[o.tree, children] > 0).sum(axis=1) > 1])
                # frees the files of the scan's shuffle: Spark removes those of plans that nobody holds any more
                gc.collect()
                session.sparkContext._jvm.System.gc()
    finally:
        blocks.unpersist()
    forest.prune()
    return forest
