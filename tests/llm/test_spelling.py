import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plantlens.llm import fm_index, spelling
from verify import duck

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    out, form = [], {}
    for w, n in count.items():
        close = [u for u in count if near(w, u)]
        best = min(close, key=lambda u: (-count[u], u), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None
        out.append([w, form[w], None, n, len(close), count[best] if form[w] else None])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row[2] = root
    return sorted(map(tuple, out))


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def noisy(seed, n_words, alphabet="abcdeé", docs=30):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 11))) for _ in range(n_words)]
    weights = [1 / (k + 1) for k in range(n_words)]
    rows = []
    for d in range(docs):
        words = []
        for w in rng.choices(stems, weights, k=400):
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,n_words,alphabet", [(1, 60, "abcdeé"), (2, 40, "ab"), (3, 25, "aÀÿz")])
def test_variants_match_brute_force(spark, documents, monkeypatch, seed, n_words, alphabet):
    monkeypatch.setattr(spelling, "SHARD_CHARS", 500)
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rows = noisy(seed, n_words, alphabet)
    got = rows_of(spelling.variants(documents(rows, clash=True)))
    assert got == brute(rows)
    assert any(r[1] for r in got)


def test_edge_rows(documents, edge_rows):
    rows = edge_rows + [(20, "x" * 30_000 + " " + "x" * 29_999), (21, "x" * 30_000 + " " + "x" * 29_999), (22, "naïveté NAÏVETÉ naïvet×é Naïvetés naïvetés"),
                        (23, "abcdefgh " * 20 + "abcdefg abcdefg"), (None, "abcdefgh abcdefghi abcdefghi")]
    assert rows_of(spelling.variants(documents(rows, clash=True))) == brute(rows)


def test_empty_table(documents):
    assert spelling.variants(documents([])).count() == 0
    assert spelling.variants(documents([(1, None), (2, "few words")])).count() == 0


def test_forms_are_followed_to_the_last(spark, documents):
    rows = [(1, "abcdefgh " * 600 + "abcdefg " * 50 + "abcdef_ " + "xabcdefg " * 4)]
    got = {r.word: r for r in spelling.variants(documents(rows)).collect()}
    assert sorted(got) == sorted(r[0] for r in brute(rows)) and rows_of(spelling.variants(documents(rows))) == brute(rows)


def test_a_form_of_many_variants(spark, monkeypatch):
    words = [(f"w{k:05d}xx", "middles" if k % 3 else f"w{k + 1:05d}xx") for k in range(900)] + [("middles", "highest"), ("highest", None)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(words, "word string, form string")).collect()}
    form = dict(words)
    for w in form:
        root = w
        while form.get(root):
            root = form[root]
        assert got[w] == root


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_every_near_word_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    index = fm_index.Index(words)
    asked = words[::3] + ["zzz", "abz", "a", "aaaaaaaaaaaa"]
    for cut in (lambda p: len(p) // 2, lambda p: len(p) - len(p) // 2, lambda p: 0):
        q, u = index.one_error(asked, np.array([cut(p) for p in asked]))
        got = list(zip(q.tolist(), u.tolist()))
        assert len(set(got)) == len(got)
        want = {(a, b) for a, p in enumerate(asked) for b, w in enumerate(words)
                if w[:cut(p)] == p[:cut(p)] and (near(p[cut(p):], w[cut(p):]))}
        assert set(got) == want


def test_intervals_of_both_directions(seed=7):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(200)})
    index = fm_index.Index(words)
    beginnings = [w[:rng.randint(1, len(w))] for w in words] + ["zz", "abcdabcdabcd"]
    symbols, begin = index.spell(beginnings)
    lo, hi = index.exact_start(symbols, begin, np.array([len(b) for b in beginnings]))
    assert (hi - lo).tolist() == [sum(w.startswith(b) for w in words) for b in beginnings]
    text = "$" + "$".join(w[::-1] for w in sorted(words, key=lambda w: w[::-1])) + "$"
    rows = sorted(range(len(text)), key=lambda k: (text[k:text.find("$", k) + 1] if text[k] != "$" else "$", k))
    for b, x, y in zip(beginnings, lo.tolist(), hi.tolist()):
        assert [r for r in range(len(rows)) if text.startswith(b[::-1] + "$", rows[r])] == list(range(x, y))


def test_oracle_equals_brute_force_on_the_table(sf):
    con = duck(sf)
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    cur = con.execute(spelling.ORACLE)
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall()) == brute(rows)
