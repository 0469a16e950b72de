import re
import tempfile
from collections import Counter

import pytest

from plantlens.llm import token_rollup as R
from plantlens.session import scratch_path

ROW = "doc_id long, source string, lang string, text string"
PATTERNS = {"words_v1": r"[^ \t\n\x0B\f\r]+", "pieces_v2": r"[^\W\d_]+|\d+|[^\w \t\n\x0B\f\r]|_"}


def recount(rows):
    out = {}
    for _, source, lang, text in rows:
        for name, pattern in PATTERNS.items():
            c = out.setdefault((source, lang, name), [0, 0])
            c[0] += 1
            c[1] += len(re.findall(pattern, text or ""))
    return {k: tuple(v) for k, v in out.items()}


def state(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


@pytest.fixture
def rollup(spark):
    return R.Rollup(spark, scratch_path(spark, "test-rollup"))


def test_deltas_equal_a_recount(spark, rollup):
    df = lambda rows: R.counted(spark.createDataFrame(rows, ROW).selectExpr("*", "'x' AS counts", "'x' AS n_docs"))
    a = [(k, f"s{k % 3}", "en" if k % 2 else "de", f"word{k} zwei, drei 42 " * k) for k in range(12)]
    a += [(20, None, None, None), (21, "s0", "en", ""), (22, "s0", None, "x_y ß"), (22, "s0", None, "x_y ß")]
    assert rollup.totals().count() == 0
    assert rollup.commit(1, R.signed(df(a), 1))
    assert state(rollup) == recount(a)
    gone, old, new = a[3:5], a[6], (6, "s9", "fr", "un deux")
    assert rollup.commit(2, R.signed(df(gone), -1))
    assert rollup.commit(3, R.revised(df([old]), df([new])))
    now = [x for x in a if x not in gone and x != old] + [new]
    assert state(rollup) == recount(now)
    # replays change nothing, in any order and after a compaction
    assert not rollup.commit(2, R.signed(df(gone), -1))
    rollup.compact()
    assert not rollup.commit(1, R.signed(df(a), 1))
    assert state(rollup) == recount(now)
    assert rollup.commit(4, R.signed(df(now), -1))
    assert state(rollup) == {}
    rollup.compact()
    rollup.compact()
    assert state(rollup) == {}


def test_interrupted_batch_is_not_seen(spark, rollup):
    rows = R.counted(spark.createDataFrame([(1, "s", "en", "a b")], ROW))
    bad = R.signed(rows, 1).selectExpr("source", "lang", "tokenizer", "n_docs", "CAST(raise_error('lost') AS LONG) AS n_tokens")
    with pytest.raises(Exception):
        rollup.commit(1, bad)
    assert state(rollup) == {}
    assert rollup.commit(1, R.signed(rows, 1))
    assert state(rollup)[("s", "en", "words_v1")] == (1, 2)


def one(spark, tokens):
    return R.signed(R.counted(spark.createDataFrame([(1, "s", "en", "w " * tokens)], ROW)), 1)


def test_two_writers_of_one_batch(spark, rollup):
    """Both have looked and found nothing; one folder counts, once."""
    other = R.Rollup(spark, rollup.root)
    real = rollup._fs.create

    class Slow:
        """The other writer's commit falls between this one's look and its marker."""
        def __getattr__(self, name):
            return getattr(real.__self__ if hasattr(real, "__self__") else other._fs, name)

        def create(self, path, over):
            assert other.commit(1, one(spark, 3))
            return other._fs.create(path, over)
    rollup._fs = Slow()
    assert not rollup.commit(1, one(spark, 3))
    rollup._fs = other._fs
    assert state(rollup)[("s", "en", "words_v1")] == (1, 3)
    assert not other.commit(1, one(spark, 3)) and rollup._numbers("batches") == [1]
    assert len([p for p in rollup._fs.listStatus(rollup._path(f"{rollup.root}/data"))]) == 1


def test_a_late_batch_is_added_after_a_snapshot(spark, rollup):
    assert rollup.commit(1, one(spark, 1)) and rollup.commit(5, one(spark, 2))
    rollup.compact()
    assert rollup.commit(3, one(spark, 4))  # below the snapshot's last, never seen
    assert state(rollup)[("s", "en", "words_v1")] == (3, 7)
    assert not rollup.commit(3, one(spark, 4)) and not rollup.commit(5, one(spark, 2))
    rollup.compact()
    assert not rollup.commit(3, one(spark, 4)) and rollup._snapshot()[2] == {1, 3, 5}
    rollup.vacuum()
    assert rollup._numbers("batches") == [] and len(rollup._numbers("snapshots")) == 1
    assert not rollup.commit(1, one(spark, 1)) and state(rollup)[("s", "en", "words_v1")] == (3, 7)


def test_a_marker_without_content_is_no_commit(spark, rollup):
    assert rollup.commit(1, one(spark, 1))
    rollup._fs.create(rollup._marker("batches", 2), False).close()  # its writer was lost
    assert state(rollup)[("s", "en", "words_v1")] == (1, 1)
    assert rollup.commit(2, one(spark, 2)) and state(rollup)[("s", "en", "words_v1")] == (2, 3)


def test_empty_batch(spark, rollup):
    assert rollup.commit(1, R.signed(R.counted(spark.createDataFrame([], ROW)), 1))
    assert state(rollup) == {}


def test_query_keeps_one_row_of_repeated_texts_and_null_ids(spark, tmp_path):
    rows = [(1, "s", "en", "a ### b"), (1, "s", "en", "a ### b"), (1, "s", "en", "a ### b"), (2, "t", "en", "a ### b"),
            (None, "n", "de", "c $$$ d e"), (None, "n", "de", "c $$$ d e"), (None, "o", "en", "f g"), (3, "p", "en", "f g"),
            (None, "q", "fr", None), (None, "q", "fr", ""), (4, "s", "en", "plain"), (4, "s", "en", "plain")]
    spark.createDataFrame(rows, ROW).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in R.op3_token_rollup(spark, str(tmp_path)).collect()}
    assert got == recount([(1, "s", "en", "a  b"), (None, "n", "de", "c  d e"), (3, "p", "en", "f g"), (None, "q", "fr", ""), (4, "s", "en", "plain")])
