import random
import re

import pytest

from plantlens.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(x):
    return WORD.findall((x or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text, items, window=D.WINDOW):
    own, hit, found = words(text), set(), set()
    for ident, item in items:
        w = words(item)
        n = min(window, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(ident)
    return len(own), sorted(hit), sorted(str(f) for f in found if f is not None)


def make_items(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_matches_brute_force(spark, documents, edge_rows, short, shard_bytes):
    rng = random.Random(3)
    vocabulary = ["aa", "bb", "cc", "Dd", "é"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(12)), (2, text(30)), (10, "AA-bb cc, dd: é aa bb; cc dd é aa"), (11, None), (12, "..."), (None, text(11)), (3, text(12)), (3, text(14))]
    if short:
        items += [(20, "zz"), (21, "one"), (22, text(4)), (23, "words here")]
    rows = edge_rows + [(100 + k, text(rng.randint(0, 80))) for k in range(60)]
    rows += [(200 + k, text(5) + " " + items[k % 3][1] + " " + text(5)) for k in range(9)]
    got = D.matches(documents(rows, clash=True), make_items(spark, items), shard_bytes=shard_bytes)
    expect = sorted(repr((i, *brute(x, items))) for i, x in rows)
    assert sorted(repr((r.doc_id, r.n_words, sorted(p for s in r.spans for p in range(s.start, s.end)), r.items)) for r in got.collect()) == expect


def test_clean_cuts_spans_and_drops_covered(spark, documents):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    plain = "nothing of this kind occurs in the benchmark and so it stays"
    docs = documents([(1, f"{plain}\n{plain} {item}. {plain}"), (2, item), (3, plain), (4, None)], clash=True)
    got = {r.doc_id: r for r in D.clean(docs, make_items(spark, [(1, item)])).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == f"{plain}\n{plain} . {plain}" and got[1].n_chars == len(got[1].text)
    assert got[3].text == plain and got[3].ids == "x"


def test_empty_tables(spark, documents):
    none = make_items(spark, [])
    assert D.matches(documents([]), make_items(spark, [(1, "a b c")])).count() == 0
    assert [r.spans for r in D.matches(documents([(1, "a b c")]), none).collect()] == [[]]
