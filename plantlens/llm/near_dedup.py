"""Operator 2, MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (ASCII lower-cased, runs of digits, letters
and non-ASCII characters; a text of fewer words is one shingle).  A shingle's
weight is its count in the text times its inverse document frequency, which is
read from a table of ``DF_BUCKETS`` hashed counts over all documents: rare
shingles share the table's floor, frequent ones stand out, and since it holds
shares of the corpus it means the same at every size.  ``FLAT`` is added to every idf:
the wording of a large group of copies has an idf near 0, and would else weigh
so little against a changed word that the group's near copies were lost.

Two texts are near copies when their weighted Jaccard similarity is at least ``THRESHOLD``.

``SAMPLES`` consistent weighted samples per text (Ioffe's scheme: two texts
have an equal sample with probability exactly their weighted Jaccard
similarity) are cut into ``BANDS`` bands.  Texts with an equal band are a
bucket.  Equal texts are one node from the start, so copies cost no pairs.

Linking, without pairs inside a bucket:

1. every member of a bucket is compared with the bucket's smallest member by
   exact similarity (``common.meet``: salted groups);
   verified links give components;
2. what a bucket's members of *different* components might still share is
   checked in blocks of ``BLOCK`` members (``meetings``): the members of a bucket's
   largest component meet those of the others, not one another, and texts meet only
   if their total weights allow a link.  A task compares members of different
   components only, and emits verified links only.

Components are found by label propagation with pointer jumping over written
tables.  Nothing is collected but the fixed-size count table.

Defined cases: null equals the empty text; texts without words are classed by
equality only.  A null doc_id ranks below all others.  Rows with the same
doc_id and text are one document.  An empty table gives no rows.  Columns other
than doc_id and text are not read by ``classes`` and are returned unchanged by
``survivors``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import (
    clean_text, consumed, enter, fresh, meet, probably_in, query, rebatched, small_batches, table, table_rows, written)
from plantlens.llm.words import ALNUM, Words, grams, mix, one_text, segmented, starts_inside

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS_PER_BAND = 12, 3
SAMPLES = BANDS * ROWS_PER_BAND
DF_BITS = 20
DF_BUCKETS = 1 << DF_BITS
DF_BLOCK = 1 << 13
#: Added to every idf (that of a rare shingle is about ln(1 + DF_BUCKETS / 300) = 8.2): a rare
#: shingle weighs a twenty-fifth more than a frequent one, not twelve times.  With less, texts of a
#: large group of copies with a plain Jaccard similarity just above the threshold fall below it.
FLAT = 200.0
#: Members of a block: two blocks of the longest texts of the corpus are well within a task.
BLOCK = 256
SEED = 11
#: A null doc_id inside keys.
NO_ID = -(1 << 63)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle occurrence, texts ascending."""
    h, n = words.hashes(), len(words)
    g = grams(h, SHINGLE)
    inside = starts_inside(words.first, SHINGLE, n)
    doc = words.doc()
    g, at = g[inside], doc[:len(inside)][inside]
    sizes = np.diff(words.first)
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        g = np.append(g, grams(h[words.first[i]:words.first[i + 1]], int(sizes[i])))
        at = np.append(at, i)
    if len(at) and (at[1:] < at[:-1]).any():
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
    return g, at


def occurrences(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each shingle occurred in its text before: 0, 1, ..."""
    key = g ^ mix(at.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    out = np.zeros(len(g), np.int64)
    if same.any():
        run = np.arange(len(s))
        start = np.maximum.accumulate(np.where(same, 0, run))
        out[order] = run - start
    return out


def elements(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element hash, shingle hash, text number, occurrence).  The j-th occurrence of a shingle
    is an element of its own, so that weights tf * idf become sets of weight idf: the sum of
    common elements' weights is exactly the sum of the smaller tf * idf."""
    g, at = shingles(words)
    nth = occurrences(g, at)
    return np.where(nth > 0, mix(g + mix(nth.astype(np.uint64))), g), g, at, nth


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's documents by hashed shingle, as blocks of counts; block -1 counts texts."""
    enter("near_dedup")
    counts, texts = np.zeros(DF_BUCKETS, np.int64), 0
    for batch in batches:
        for lo, hi, words in segmented(batch.column(0), ALNUM, lower=True):
            g, at = shingles(words)
            texts += int((np.diff(words.first) > 0).sum())
            np.add.at(counts, _bucket(g[occurrences(g, at) == 0]), 1)
    blocks = counts.reshape(-1, DF_BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *used.tolist()], pa.int32()),
         pa.array([np.array([texts]).tobytes(), *(blocks[k].astype("<i4").tobytes() for k in used)], pa.binary())],
        names=["block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks; rows come sorted by block."""
    enter("near_dedup")
    def total(block: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["block", "counts"])

    block, sums = None, None
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(raw, "<i8" if b < 0 else "<i4").astype(np.int64)
            if b == block:
                sums = sums + part
                continue
            if sums is not None:
                yield total(block, sums)
            block, sums = b, part
    if sums is not None:
        yield total(block, sums)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every hashed shingle (DF_BUCKETS floats, whatever the corpus)."""
    parts = (docs.select(clean_text().alias("text")).mapInArrow(_count, "block int, counts binary")
             .repartition("block").sortWithinPartitions("block").mapInArrow(_add, "block int, counts binary").collect())
    counts, texts = np.zeros(DF_BUCKETS, np.int64), 0
    for p in parts:
        sums = np.frombuffer(p.counts, np.int64)
        if p.block < 0:
            texts += int(sums[0])
        else:
            counts[p.block * DF_BLOCK:(p.block + 1) * DF_BLOCK] += sums
    return np.log1p(texts / (1.0 + counts)).astype(np.float32)


def _gamma2(p: np.ndarray) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution."""
    x = np.linspace(0, 40, 400_001)
    return np.interp(p, 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    """Consistent weighted samples; the random variates of an element are table lookups by
    bits of its hash, so all tasks draw the same ones."""

    BITS = 12

    def __init__(self, samples: int = SAMPLES) -> None:
        p = (np.arange(1 << self.BITS) + 0.5) / (1 << self.BITS)
        self.r = _gamma2(p).astype(np.float32)
        self.per_r = (1 / self.r).astype(np.float32)
        self.log_c = np.log(_gamma2(p)).astype(np.float32)
        self.beta = p.astype(np.float32)
        rng = np.random.default_rng(SEED)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, e: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, samples) values; equal values are equal samples.  The least of
        ln c - r (t - beta + 1) over a text's elements, t = floor(ln w / r + beta), is a
        function of the element drawn and of t, and stands for both."""
        out = np.empty((len(starts), len(self.odd)), np.float32)
        mask = np.int64((1 << self.BITS) - 1)
        for k, odd in enumerate(self.odd):
            z = (e * odd).view(np.int64)
            r = np.right_shift(z.view(np.uint64), np.uint64(64 - self.BITS)).view(np.int64)
            beta = self.beta[(z >> 28) & mask]
            t = np.floor(log_w * self.per_r[r] + beta)
            t -= beta
            t += 1
            t *= self.r[r]
            out[:, k] = np.minimum.reduceat(self.log_c[(z >> 40) & mask] - t, starts)
        return out


def log_weights(idf: np.ndarray) -> np.ndarray:
    """ln of the weights, rounded so that every machine has the same bits."""
    return (np.round(np.log(idf + FLAT) * 1024) / 1024).astype(np.float32)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each text."""
    bits = samples.view(np.uint32).astype(np.uint64).reshape(len(samples), BANDS, ROWS_PER_BAND)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]
    for j in range(ROWS_PER_BAND):
        key = mix(key ^ bits[:, :, j])
    return key


def _sketch(idf) -> Callable:
    """Rows (doc_id, h, t, text): the band keys and the total weight of the text instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dedup")
        log_idf, sampler = log_weights(idf.value), Sampler()
        for batch in batches:
            bands: list = [[] for _ in range(batch.num_rows)]
            total = np.zeros(batch.num_rows)
            for lo, _, words in segmented(batch.column(3), ALNUM, lower=True, limit=1 << 17):
                e, g, at, _ = elements(words)
                if not len(e):
                    continue
                texts, starts = np.unique(at, return_index=True)
                keys = band_keys(sampler.samples(e, log_idf[_bucket(g)], starts)).view(np.int64)
                total[lo + texts] = np.add.reduceat(idf.value[_bucket(g)].astype(np.float64) + FLAT, starts)
                for i, row in zip(texts.tolist(), keys):
                    bands[lo + i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bands, pa.list_(pa.int64())), pa.array(total)],
                                             names=["doc_id", "h", "t", "bands", "total"])

    return run


class Weighted:
    """A text's elements, ascending, with their weights."""

    def __init__(self, text: str, idf: np.ndarray) -> None:
        e, g, _, _ = elements(one_text(text, ALNUM, lower=True))
        order = np.argsort(e)
        self.e, self.w = e[order], idf[_bucket(g)][order].astype(np.float64) + FLAT
        self.total = float(self.w.sum())

    def similarity(self, other: Weighted, least: float = 0.0, plain: bool = False) -> float:
        """Weighted Jaccard similarity (if ``plain``, the plain one if that is larger); 0 when the
        totals alone keep it below ``least``."""
        n, m = len(self.e), len(other.e)
        low, high = sorted((self.total, other.total))
        if not low or low < least * high and not (plain and min(n, m) >= least * max(n, m)):
            return 0.0
        same = other.e[np.minimum(np.searchsorted(other.e, self.e), m - 1)] == self.e
        common = float(self.w[same].sum())
        weighted = common / (self.total + other.total - common)
        shared = int(same.sum())
        return max(weighted, shared / (n + m - shared)) if plain else weighted


def similarities(texts: list[Weighted], plain: bool = False, step: int = 4096) -> np.ndarray:
    """Similarities of all pairs of a block, by products of 0/1 matrices (texts by elements) over
    the elements that several texts have, ``step`` of them at a time."""
    n = len(texts)
    member = np.repeat(np.arange(n), [len(t.e) for t in texts])
    _, first, place, many = np.unique(np.concatenate([t.e for t in texts]), return_index=True, return_inverse=True, return_counts=True)
    weight = np.concatenate([t.w for t in texts])[first]
    kept = np.flatnonzero(many > 1)
    at = np.full(len(many), -1)
    at[kept] = np.arange(len(kept))
    place = at[place]
    common, shared = np.zeros((n, n)), np.zeros((n, n))
    for lo in range(0, len(kept), step):
        there = (place >= lo) & (place < lo + step)
        has = np.zeros((n, min(step, len(kept) - lo)))
        has[member[there], place[there] - lo] = 1.0
        common += (has * weight[kept[lo:lo + step]]) @ has.T
        if plain:
            shared += has @ has.T
    total, size = np.array([t.total for t in texts]), np.array([len(t.e) for t in texts])
    with np.errstate(invalid="ignore", divide="ignore"):
        out = common / (total[:, None] + total[None, :] - common)
        if plain:
            out = np.maximum(out, shared / (size[:, None] + size[None, :] - shared))
    return np.nan_to_num(out)


_LINK = pa.schema([("a", pa.struct([("id", pa.int64()), ("h", pa.int64())])), ("b", pa.struct([("id", pa.int64()), ("h", pa.int64())]))])
_LINK_KIND = "a struct<id:long,h:long>, b struct<id:long,h:long>"


def _verify(idf, threshold: float, plain: bool) -> Callable:
    """Groups of a leader's row, then its members': the links of similarity >= threshold."""

    def links(rows: Iterator[dict]) -> Iterator[dict]:
        group, leader, last = None, None, None
        for row in rows:
            key = (row["leader"], row["salt"])
            if key != group:
                group, leader, last = (dict(row["leader"]), row["salt"]), None, None
            if row["uid"] == last:
                continue  # the same document again
            last = row["uid"]
            if row["role"] == 0:
                leader = Weighted(row["text"], idf.value)
            elif Weighted(row["text"], idf.value).similarity(leader, threshold, plain) >= threshold:
                yield {"a": row["uid"], "b": row["leader"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dedup")
        yield from rebatched(links(table_rows(batches)), _LINK)

    return run


def _verify_block(idf, threshold: float, plain: bool) -> Callable:
    """Groups (bucket, i, j) of the members of blocks i and j, with their components: links
    between those components that similar members have, until they are joined."""

    def close(members: list[dict]) -> Iterator[dict]:
        comps = [tuple(m["comp"].values()) for m in members]
        if len(set(comps)) < 2:
            return
        parent: dict[tuple, tuple] = {}

        def top(c: tuple) -> tuple:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        similar = np.argwhere(np.triu(similarities([Weighted(m["text"], idf.value) for m in members], plain) >= threshold, 1))
        for i, j in similar.tolist():
            if top(comps[i]) != top(comps[j]):
                parent[top(comps[j])] = top(comps[i])
                yield {"a": members[j]["comp"], "b": members[i]["comp"]}

    def links(rows: Iterator[dict]) -> Iterator[dict]:
        group, members = None, []
        for row in rows:
            key = (row["band"], row["i"], row["j"])
            if key != group:
                yield from close(members)
                group, members = key, []
            if not members or members[-1]["uid"] != row["uid"]:
                members.append(row)
        yield from close(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dedup")
        yield from rebatched(links(table_rows(batches)), _LINK)

    return run


def components(links: DataFrame) -> DataFrame:
    """(uid, comp) of the links' ends: comp is the smallest uid connected with uid."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "uid"), "labels")
    while True:
        near = (both.join(labels.select("uid", "comp"), F.col("b") == F.col("uid")).groupBy("a").agg(F.min("comp").alias("near")))
        step = labels.select("uid", "comp").join(near, F.col("uid") == F.col("a")).select(
            "uid", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("uid").alias("via"), F.col("comp").alias("far"))
        step = written(step.join(jump, F.col("next") == F.col("via")).select(
            "uid", F.least("next", "far").alias("comp"), "was"), "labels")
        consumed(labels)
        labels = step
        if step.where("comp <> was").isEmpty():
            consumed(both)
            return labels.select("uid", "comp")


def _sized(bands: DataFrame) -> DataFrame:
    return bands.groupBy("band").agg(F.min("uid").alias("leader"), F.max("uid").alias("last")).where("leader <> last")


def meetings(bands: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """(band, i, j, uid, comp): groups in which all members of different components of a bucket meet,
    unless their total weights alone keep them below ``threshold``.

    The members of a bucket's largest component meet those of the others, but not
    one another.  Members are dealt to cells by the logarithm of their total: totals of
    two similar texts are in the same cell or in neighbouring ones.  A cell has blocks
    of about ``BLOCK`` members, and a group is a pair of blocks, so a large component
    beside a few other texts makes about as many rows as it has members."""
    step = -math.log(min(threshold, 0.999) * 0.9999) if threshold > 0 else math.inf  # one cell
    named = (bands.where("total > 0").join(comps, "uid", "left")
             .select("band", "uid", F.coalesce("comp", "uid").alias("comp"), F.floor(F.log("total") / F.lit(step)).alias("cell")))
    # the largest component of each bucket of several
    open_ = (named.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band")
             .agg(F.sum("n").alias("n"), F.count("*").alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("most"))
             .where("comps > 1 AND n > 2").select("band", "most"))
    named = written(named.join(open_, "band").select("band", "uid", "comp", F.struct((F.col("comp") == F.col("most")).alias("large"), "cell").alias("own")),
                    "open-members")
    # a bucket's cells with their blocks: as many as totals have orders of magnitude, twice
    cells = (named.groupBy("band", "own").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
             .groupBy("band").agg(F.collect_list(F.struct(F.col("own").alias("cell"), "blocks")).alias("cells")))
    near = F.filter("cells", lambda c: (F.abs(c["cell"]["cell"] - F.col("own")["cell"]) <= 1) & ~(c["cell"]["large"] & F.col("own")["large"]))
    mine = F.filter("cells", lambda c: c["cell"] == F.col("own"))[0]["blocks"]
    met = named.join(cells, "band").select("band", "uid", "comp", "own", F.pmod(F.xxhash64("uid", "band"), mine).cast("int").alias("k"),
                                           F.explode(near).alias("other"))
    met = met.select("band", "uid", "comp", "own", "k", F.col("other.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("other.blocks") - 1)).alias("o"))
    # the two sides of a meeting name it alike: by the lower cell and its block first
    me, they = F.struct("own", "k"), F.struct(F.col("cell").alias("own"), F.col("o").alias("k"))
    low, high = F.least(me, they), F.greatest(me, they)
    return met.select("band", *[F.xxhash64(x["own"]["large"], x["own"]["cell"], x["k"]).alias(c) for x, c in ((low, "i"), (high, "j"))], "uid", "comp")


def classes(docs: DataFrame, threshold: float = THRESHOLD, plain: bool = False) -> DataFrame:
    """Per row (``plain``: a plain Jaccard similarity of the threshold links as well): doc_id, class_id (the smallest doc_id of the rows its text is linked with),
    class_rows, kept (the row that stays for the class), and h = xxhash64(text)."""
    spark = docs.sparkSession
    small_batches(spark)
    idf = spark.sparkContext.broadcast(idf_table(docs))  # DF_BUCKETS floats
    text = clean_text()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"),
                       F.unhex(F.md5(text.cast("binary"))).alias("t"), text.alias("text"))
    sketches = written(rows.mapInArrow(_sketch(idf), "doc_id long, h long, t binary, bands array<long>, total double"), "sketches")
    # one node per text: the smallest row that has it
    nodes = sketches.groupBy("t").agg(F.min(F.struct(F.col("doc_id").alias("id"), "h")).alias("uid"), F.first("bands").alias("bands"), F.first("total").alias("total"))
    nodes = written(nodes, "nodes")
    bands = nodes.select("uid", "total", F.explode("bands").alias("band"))
    # members of buckets of two or more: all that the steps below look at
    bands = written(bands.join(_sized(bands).select("band", "leader"), "band").select("band", "uid", "total", "leader"), "buckets")
    pairs = written(bands.where("uid <> leader").select(F.col("uid").alias("member"), "leader").distinct(), "candidates")
    # the texts of candidates; the others are not shuffled
    wanted = written(bands.select("uid").distinct(), "wanted")
    texts = rows.select(F.struct(F.col("doc_id").alias("id"), "h").alias("uid"), "text")
    # an inner join (wanted has every uid once): Spark would pull a semi join below the bitmap
    texts = written(probably_in(texts, wanted).join(wanted, "uid"), "candidate-texts")
    links = written(meet(texts, pairs, _verify(idf, threshold, plain), _LINK_KIND), "links")
    comps = components(links)
    # what members of different components of a bucket may still share
    met = written(meetings(bands, comps, 0.0 if plain else threshold), "open")
    rest = texts.join(met, "uid").select("band", "i", "j", "uid", "comp", "text")
    more = (rest.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "uid")
            .mapInArrow(_verify_block(idf, threshold, plain), _LINK_KIND))
    more = written(more, "more-links")
    named = nodes.join(comps, "uid", "left").select("t", F.coalesce("comp", "uid").alias("comp"), F.col("uid"))
    if not more.isEmpty():  # components of components: few, as most links are known before
        joined = components(more).select(F.col("uid").alias("comp"), F.col("comp").alias("low"))
        named = named.join(joined, "comp", "left").select("t", F.coalesce("low", "comp").alias("comp"), "uid")
    sizes = (sketches.groupBy("t").agg(F.count("*").alias("n")).join(named, "t").groupBy("comp").agg(F.sum("n").alias("class_rows")))
    sizes = written(sizes, "class-rows")  # a table: Spark can then split a large class in the join below
    placed = sketches.select("doc_id", "h", "t").join(named, "t").join(sizes, "comp")
    return placed.select(
        F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), F.expr(f"nullif(comp.id, {NO_ID})").alias("class_id"), "class_rows",
        ((F.col("doc_id") == F.col("comp.id")) & (F.col("h") == F.col("comp.h"))).alias("kept"), "h")


def survivors(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that are not kept in their class, all columns unchanged."""
    ident, h = (fresh(docs.columns, c) for c in ("gone_id", "gone_h"))
    gone = classes(docs, threshold).where("NOT kept").select(F.col("doc_id").alias(ident), F.col("h").alias(h)).distinct()
    gone = written(gone, "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(gone[ident]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[h])
    return docs.join(gone, same, "left_anti")


@query("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_rows", "kept")
