import zlib

import numpy as np
import pytest

from plantlens.llm import toxicity as X
from plantlens.llm.common import table
from plantlens.llm.words import ALNUM, one_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return X.fitted(table(spark, SF, "documents"), table(spark, SF, "labels"))


def slow_score(model, text):
    """The network, one window at a time."""
    h = one_text(text or "", ALNUM, lower=True).hashes()
    rows = X.buckets(h) if len(h) else np.zeros((0, 2), int)
    e = [model.rows[a] + model.rows[b] for a, b in rows]
    pooled = np.zeros(len(model.bias))
    for k, w in enumerate(X.WIDTHS):
        for f in range(X.FILTERS):
            for i in range(len(e)):
                z = model.bias[k * X.FILTERS + f]
                z += sum(float(e[i + o] @ model.kernel[w][o][:, f]) for o in range(w) if i + o < len(e))
                pooled[k * X.FILTERS + f] = max(pooled[k * X.FILTERS + f], z)
    lang = X.guess_language(h, np.array([0, len(h)]))[0]
    x = (pooled @ model.weight + model.offset - model.cuts[lang]) * model.slope + np.log(X.CUT / (1 - X.CUT))
    return 1 / (1 + np.exp(-x))


def test_scores_match_the_slow_network(spark, documents, model):
    rows = [(1, "you are an idiot and a moron"), (2, ""), (3, None), (4, "a"), (5, "der die das und " * 5), (6, "x " * 30)]
    got = {r.doc_id: r for r in X.predictions(documents(rows, clash=True), model).collect()}
    for i, x in rows:
        assert got[i].score == pytest.approx(slow_score(model, x), abs=1e-4)
        assert got[i].predicted == int(got[i].score >= X.CUT) and 0 <= got[i].score <= 1


def test_gradients():
    """The step moves down the numerical gradient of the loss."""
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 1 << 60, 12, dtype=np.uint64) for _ in range(8)]
    y = np.array([0, 1] * 4, np.float32)
    bad = np.uint64(77)
    for t, v in zip(texts, y):
        if v:
            t[3] = bad
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = X.train(texts, y)
    logits = model.logits(np.concatenate(texts), first)
    assert logits[y == 1].min() > logits[y == 0].max()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = X.predictions(docs.select("doc_id", "text"), X.fitted(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    toxic = [r for r in held if r.toxic]
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8
    assert sum(r.predicted for r in clean) / len(clean) < 0.015


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = X.fitted(docs, labels), X.fitted(docs, other)
    assert np.array_equal(a.rows, b.rows) and np.array_equal(a.cuts, b.cuts)


def test_edges(spark, documents, edge_rows, model):
    assert X.predictions(documents(edge_rows, clash=True), model).count() == len(edge_rows)
    assert X.predictions(documents([]), model).count() == 0
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert X.fitted(documents(edge_rows), labels) in (0.0, 1.0)  # one class
    assert X.fitted(documents(edge_rows), labels.where("false")) == 0.0


def test_language_guess():
    for k, (lang, text) in enumerate(X.FUNCTION_WORDS.items()):
        h = one_text(text, ALNUM, lower=True).hashes()
        assert X.guess_language(h, np.array([0, len(h)]))[0] == k, lang
    assert X.guess_language(np.zeros(0, np.uint64), np.array([0, 0]))[0] == len(X.FUNCTION_WORDS)
