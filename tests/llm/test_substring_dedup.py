import random
import re
from collections import Counter

import pytest

from plantlens.llm import substring_dedup as S

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window):
    split = [(i, WORD.findall(x or "")) for i, x in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in split:
        cut = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    cut |= set(range(k, k + window))
        out[(i, len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut))] += 1
    return out


def make_rows(rng, window, n=60):
    vocabulary = [f"v{k}" for k in range(6)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(rng.randint(window - 3, 3 * window)) for _ in range(5)]
    rows = []
    for k in range(n):
        own = text(rng.randint(0, 2 * window))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            own += p[a:len(p) - rng.randint(0, 4)] + text(rng.randint(0, 5))
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize("window,gram", [(8, 4), (8, 8), (8, 2)])
def test_matches_brute_force(documents, window, gram, monkeypatch):
    monkeypatch.setattr(S, "SHARD_WORDS", 3 * window)
    rows = make_rows(random.Random(window * gram), window)
    rng = random.Random(1)
    rows += [(rng.randrange(60), x) for _, x in rng.sample(rows, 10)]  # ids that repeat with other texts
    rows += [(None, rows[0][1]), (200, rows[3][1]), (200, rows[3][1])]
    got = S.without_repeats(documents(rows, clash=True), window, gram)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute(rows, window)


def test_edges(documents, edge_rows):
    got = S.without_repeats(documents(edge_rows, clash=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute(edge_rows, S.WINDOW)
    assert S.without_repeats(documents([])).count() == 0


def test_spans_of_a_hot_passage(documents):
    """One passage in many documents: every copy but the first goes, whatever the group's size."""
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, f"own{k} words{k} {passage} tail{k}") for k in range(300)]
    got = S.repeated_spans(documents(rows)).collect()
    assert {r.doc_id for r in got} == set(range(1, 300))
    assert all([tuple(s) for s in r.spans] == [(2, 72)] for r in got)
