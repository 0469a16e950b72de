"""Operator 9, toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed rows (two tables of ``BUCKETS``
rows), so two words share an embedding only if both hashes collide.  Filters of
widths 1 to 3 slide over the embeddings; the rectified maximum of each over the
whole text is one feature of a logistic output.

Training runs on the driver over a bounded sample: the ``TRAIN_ROWS`` labelled
documents of smallest hash among those whose crc32(doc_id) mod 3 is not 1.
One embedding dimension starts from the smoothed log-odds of the word in that
sample, the others at random; all parameters are then learned by AdaGrad on the
log loss.  Rows of words in fewer than ``MIN_DOCS`` training texts stay zero:
unseen and rare words say nothing.

Thresholds are calibrated by language.  The language is guessed from the text
by its function words, never read from a column: for each guessed language the
logit that best separates the classes in a calibration fold becomes score 0.7.

Defined cases: null and empty texts have no words; every feature is 0 and the
score is that of an empty text.  Without labels, or with one class only, every
score is the rate of the labels (0 without any).  Rows with a null id are
scored, and not held out.  Several labels of one id: the largest counts.
Columns other than the text are returned unchanged by ``predictions``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.llm.common import clean_text, enter, query, small_batches, table
from plantlens.llm.words import ALNUM, Words, grams, mix, segmented

TRAIN_ROWS = 8_000
BUCKETS = 1 << 18
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
#: Training texts (copies count once) that must have a word before it gets an embedding.
MIN_DOCS = 3
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.15, 7
CUT = 0.7
#: What a false alarm rate costs against recall when thresholds are calibrated.
CLEAN_COST = 8

#: Common function words, from which the language of a text is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on be by this are from or an",
    "de": "der die und das den von zu mit des dem nicht ein eine sich auf für im als auch ist",
    "fr": "le la les de des et un une que qui dans pour par sur avec est pas du au en",
    "es": "el la los de y que en las del por con para una se no un su lo al como",
}


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words, ascending, and the languages (bits) of each."""
    bits: dict[int, int] = {}
    for k, text in enumerate(FUNCTION_WORDS.values()):
        data = np.frombuffer(text.encode(), np.uint8)
        for h in Words(data, np.array([0, len(data)]), ALNUM).hashes().tolist():
            bits[h] = bits.get(h, 0) | 1 << k
    keys = np.array(sorted(bits), np.uint64)
    return keys, np.array([bits[int(k)] for k in keys])


_FUNCTION = _function_words()


def guess_language(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The language number of each text: most function words; len(FUNCTION_WORDS) if none."""
    keys, bits = _FUNCTION
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    own = np.where(keys[at] == h, bits[at], 0)
    hits = np.stack([np.concatenate([[0], np.cumsum(own >> k & 1)]) for k in range(len(FUNCTION_WORDS))])
    per_text = hits[:, first[1:]] - hits[:, first[:-1]]
    return np.where(per_text.max(axis=0) > 0, per_text.argmax(axis=0), len(FUNCTION_WORDS))


def buckets(h: np.ndarray) -> np.ndarray:
    """The two embedding rows of each word, as one column pair."""
    a = h >> np.uint64(46)
    b = mix(h ^ np.uint64(0x51_7C_C1_B7_27_22_0A_95)) >> np.uint64(46)
    return np.stack([a.astype(np.int32), b.astype(np.int32) + BUCKETS], axis=1)


@dataclass
class Model:
    rows: np.ndarray                  # (2 * BUCKETS, DIM) embeddings
    kernel: dict[int, np.ndarray]     # width -> (width, DIM, FILTERS)
    bias: np.ndarray                  # of all filters, widths in order
    weight: np.ndarray
    offset: float
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    slope: float = 1.0

    def convolved(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Filter values at each word (zero embeddings after a text's last word)."""
        n = len(e)
        out = np.empty((n, len(self.bias)), np.float32)
        last = np.repeat(first[1:], np.diff(first))
        for k, w in enumerate(WIDTHS):
            z = e @ self.kernel[w][0]
            for o in range(1, w):
                more = e[o:] @ self.kernel[w][o]
                more[np.arange(o, n) >= last[:n - o]] = 0
                z[:n - o] += more
            out[:, k * FILTERS:(k + 1) * FILTERS] = z
        return out + self.bias

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(first) - 1, len(self.bias)), np.float32)
        full = np.flatnonzero(np.diff(first))
        if len(h):
            b = buckets(h)
            z = self.convolved(self.rows[b[:, 0]] + self.rows[b[:, 1]], first)
            pooled[full] = np.maximum(np.maximum.reduceat(z, first[full], axis=0), 0)
        return pooled @ self.weight + self.offset

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """0 to 1; CUT exactly at the calibrated logit of the guessed language."""
        x = (self.logits(h, first) - self.cuts[guess_language(h, first)]) * self.slope + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def copy_shares(texts: list[np.ndarray], keys: int = 4, k: int = 5) -> np.ndarray:
    """1 / size of each text's group of copies: texts with an equal minimum hash of their
    5-word shingles under one of a few hash functions are one group."""
    parent = list(range(len(texts)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict = {}
    for i, h in enumerate(texts):
        g = grams(h, k) if len(h) >= k else mix(h[:1])
        for f in range(keys if len(g) else 0):
            j = seen.setdefault((f, int(mix(g ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (1 << 64) - 1)).min())), i)
            parent[top(i)] = top(j)
    tops = np.array([top(i) for i in range(len(texts))])
    return 1 / np.bincount(tops, minlength=len(texts))[tops]


def train(texts: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on texts given as word hashes; the copies of a text count together as one."""
    rng = np.random.default_rng(SEED)
    n = len(texts)
    share = copy_shares(texts)
    rows = np.zeros((2 * BUCKETS, DIM), np.float32)
    pos = np.zeros(2 * BUCKETS)
    neg = np.zeros(2 * BUCKETS)
    coded = [buckets(h) for h in texts]
    for b, y, part in zip(coded, labels, share):
        np.add.at(pos if y else neg, np.unique(b), part)
    seen = np.flatnonzero(pos + neg >= MIN_DOCS)
    n_pos, n_neg = float(share[labels > 0].sum()), float(share[labels == 0].sum())
    odds = np.log((pos[seen] + 1) / (n_pos + 2)) - np.log((neg[seen] + 1) / (n_neg + 2))
    trust = (pos + neg)[seen] / ((pos + neg)[seen] + 5)
    rows[seen] = rng.normal(0, 0.02, (len(seen), DIM))
    rows[seen, 0] += 0.1 * odds * trust
    kernel = {w: rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        kernel[w][0, 0, :FILTERS // 2] += 1
    model = Model(rows, kernel, np.zeros(len(WIDTHS) * FILTERS, np.float32),
                  np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -2.0)
    squares = {"rows": np.full(2 * BUCKETS, 1e-3, np.float32), "kernel": {w: np.full_like(k, 1e-2) for w, k in kernel.items()},
               "bias": np.full_like(model.bias, 1e-2), "weight": np.full_like(model.weight, 1e-2), "offset": 1e-2}
    squares["rows"][pos + neg < MIN_DOCS] = np.inf  # rare words stay zero: no memorising of single texts
    balance = share * np.where(labels > 0, 0.5 * n / max(n_pos, 1), 0.5 * n / max(n_neg, 1))

    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            part = order[lo:lo + BATCH]
            _step(model, squares, [coded[i] for i in part], labels[part], balance[part] / len(part))
    return model


def _step(model: Model, squares: dict, coded: list[np.ndarray], y: np.ndarray, share: np.ndarray) -> None:
    """One AdaGrad step; only the words at the pooled maxima have gradients."""
    first = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    if not first[-1]:
        return
    b = np.concatenate(coded)
    e = model.rows[b[:, 0]] + model.rows[b[:, 1]]
    z = model.convolved(e, first)
    at = np.zeros((len(coded), z.shape[1]), np.int64)
    pooled = np.zeros((len(coded), z.shape[1]), np.float32)
    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        if hi > lo:
            at[i] = lo + z[lo:hi].argmax(axis=0)
            pooled[i] = np.maximum(z[at[i], np.arange(z.shape[1])], 0)
    logit = pooled @ model.weight + model.offset
    d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * share).astype(np.float32)
    d_pool = np.outer(d, model.weight) * (pooled > 0)
    g_weight = pooled.T @ d + 1e-4 * model.weight
    touched, grads = [], []
    g_kernel = {w: np.zeros_like(k) for w, k in model.kernel.items()}
    doc, col = np.nonzero(d_pool)
    for k, w in enumerate(WIDTHS):
        sel = (col >= k * FILTERS) & (col < (k + 1) * FILTERS)
        f, word, g, end = col[sel] - k * FILTERS, at[doc[sel], col[sel]], d_pool[doc[sel], col[sel]], first[doc[sel] + 1]
        for o in range(w):
            ok = word + o < end
            pos, ff, gg = word[ok] + o, f[ok], g[ok]
            np.add.at(g_kernel[w][o].T, ff, gg[:, None] * e[pos])
            ge = gg[:, None] * model.kernel[w][o][:, ff].T
            touched += [b[pos, 0], b[pos, 1]]
            grads += [ge, ge]
    for w in WIDTHS:
        squares["kernel"][w] += g_kernel[w] ** 2
        model.kernel[w] -= RATE * g_kernel[w] / np.sqrt(squares["kernel"][w])
    g_bias = d_pool.sum(axis=0)
    for name, g in (("weight", g_weight), ("bias", g_bias)):
        squares[name] += g ** 2
        setattr(model, name, (getattr(model, name) - RATE * g / np.sqrt(squares[name])).astype(np.float32))
    squares["offset"] += float(d.sum()) ** 2
    model.offset -= RATE * float(d.sum()) / squares["offset"] ** 0.5
    ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    g_rows = np.zeros((len(ids), DIM), np.float32)
    np.add.at(g_rows, inverse, np.concatenate(grads))
    squares["rows"][ids] += (g_rows ** 2).mean(axis=1)
    model.rows[ids] -= RATE * g_rows / np.sqrt(squares["rows"][ids])[:, None]


def best_cut(logits: np.ndarray, y: np.ndarray) -> float | None:
    """The middle of the widest logit gap with the best recall less CLEAN_COST times the
    false alarm rate; None without both classes."""
    if not 0 < y.sum() < len(y):
        return None
    order = np.argsort(logits)
    x, t = logits[order], y[order]
    below_pos = np.concatenate([[0], np.cumsum(t)])
    below_neg = np.concatenate([[0], np.cumsum(1 - t)])
    good = CLEAN_COST * below_neg / (len(y) - y.sum()) - below_pos / y.sum()
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    top = np.flatnonzero(good >= good.max() - 1e-12)
    gaps = np.concatenate([[1], np.diff(x), [1]])[top]
    return float(edges[top[gaps.argmax()]])


def fit(texts: list[np.ndarray], labels: np.ndarray) -> Model | float:
    """A calibrated model, or the constant score when the labels have one class."""
    if not 0 < labels.sum() < len(labels):
        return float(labels.mean()) if len(labels) else 0.0
    fold = np.arange(len(labels)) % 5 == 0  # rows come in hash order
    if not 0 < labels[~fold].sum() < (~fold).sum():
        fold[:] = False
    model = train([t for t, f in zip(texts, fold) if not f], labels[~fold])
    held = fold if 0 < labels[fold].sum() < fold.sum() else ~fold
    judged = [t for t, f in zip(texts, held) if f]
    parts = []
    for lo in range(0, len(judged), BATCH):  # few texts at once: filter values are 100 bytes a word
        first = np.concatenate([[0], np.cumsum([len(t) for t in judged[lo:lo + BATCH]])])
        h = np.concatenate(judged[lo:lo + BATCH])
        parts.append((model.logits(h, first), guess_language(h, first)))
    logits, lang, y = *(np.concatenate(p) for p in zip(*parts)), labels[held]
    whole = best_cut(logits, y)
    for k in range(len(model.cuts)):
        own = lang == k
        cut = best_cut(logits[own], y[own]) if y[own].sum() >= 10 else None
        model.cuts[k] = whole if cut is None else cut
    spread = np.std(logits - model.cuts[lang])
    model.slope = float(3 / max(spread, 1e-6))
    return model


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("toxicity")
    for batch in batches:
        out: list = [None] * batch.num_rows
        for lo, _, words in segmented(batch.column(1), ALNUM, lower=True):
            h = words.hashes().view(np.int64)
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                out[lo + i] = h[a:b]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["toxic", "words"])


def _bucket():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | float:
    """The classifier of the labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    sample = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_bucket() != 1))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    own = docs.select("doc_id", clean_text().alias("text")).join(F.broadcast(sample), "doc_id")  # at most TRAIN_ROWS ids
    got = (own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
           .select("toxic", "text").mapInArrow(_hashed, "toxic int, words array<long>").toArrow())
    words = got.column("words").combine_chunks()
    if isinstance(words, pa.ChunkedArray):
        words = words.chunk(0) if words.num_chunks else pa.array([], pa.list_(pa.int64()))
    flat, bounds = words.values.to_numpy().view(np.uint64), words.offsets.to_numpy()
    texts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return fit(texts, np.array(got.column("toxic").to_pylist(), np.float32))


def predictions(docs: DataFrame, model: Model | float, text_col: str = "text") -> DataFrame:
    """The rows with score and predicted (columns of these names are replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # two tables of BUCKETS rows, whatever the corpus
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*others, clean_text(text_col).alias("score"))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in rows.schema.fields[:-1]],
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        own = sent.value
        for batch in batches:
            score = np.full(batch.num_rows, own if isinstance(own, float) else 0.0)
            if not isinstance(own, float):
                for lo, hi, words in segmented(batch.column(len(others)), ALNUM, lower=True, limit=1 << 17):
                    score[lo:hi] = own.scores(words.hashes(), words.first)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=[*others, "score", "predicted"])

    return rows.mapInArrow(run, schema)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return predictions(docs, model).select("doc_id", (_bucket() == 1).alias("held_out"), "score", "predicted")
