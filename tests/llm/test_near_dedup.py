import random

import numpy as np
import pytest

from plantlens.llm import near_dedup as N
from plantlens.llm.words import ALNUM, one_text


def brute(rows, idf):
    """Classes by all pairs of distinct texts."""
    texts = {}
    for i, x in rows:
        key = N.NO_ID if i is None else i
        texts[x or ""] = min(texts.get(x or "", key), key)
    names = list(texts)
    weighted = [N.Weighted(x, idf) for x in names]
    parent = list(range(len(names)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(names)):
        for b in range(a):
            if weighted[a].total and weighted[a].similarity(weighted[b]) >= N.THRESHOLD:
                parent[top(a)] = top(b)
    least = {}
    for k, x in enumerate(names):
        least[top(k)] = min(least.get(top(k), texts[x]), texts[x])
    return {x: least[top(k)] for k, x in enumerate(names)}


def make_rows(edge_rows):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = list(edge_rows)
    ident = 100
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6, 20])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((ident, " ".join(own)))
            ident += 1
    chain = [rng.choice(vocabulary) for _ in range(300)]
    for k in range(30):  # a chain: neighbours are near, the ends are not
        rows.append((ident, " ".join(chain[k * 4:k * 4 + 160])))
        ident += 1
    return rows


def test_classes_match_all_pairs(documents, edge_rows):
    rows = make_rows(edge_rows)
    docs = documents(rows, clash=True)
    expect = brute(rows, N.idf_table(docs))
    text = {}
    got = N.classes(docs).collect()
    assert len(got) == len(rows)
    by_row = {(i, x or "") for i, x in rows}
    for i, x in by_row:
        text.setdefault(i, []).append(x)
    for r in got:
        want = {expect[x] for x in text[r.doc_id]}
        assert (N.NO_ID if r.class_id is None else r.class_id) in want
    assert len({r.class_id for r in got}) == len(set(expect.values()))


def test_blocks_find_what_leaders_miss(documents, monkeypatch):
    """Members unlike their bucket's leader, but like each other, are linked, in small blocks too."""
    monkeypatch.setattr(N, "BLOCK", 2)
    monkeypatch.setattr(N, "BANDS", 24)
    monkeypatch.setattr(N, "ROWS_PER_BAND", 1)
    monkeypatch.setattr(N, "SAMPLES", 24)
    rng = random.Random(9)
    common = [f"c{k}" for k in range(60)]
    rows, ident = [], 0
    for family in range(8):
        base = common + [f"f{family}_{k}" for k in range(60)]
        for _ in range(4):
            own = list(base)
            own[rng.randrange(70, 118)] = "changed"
            rows.append((ident, " ".join(own)))
            ident += 1
    docs = documents(rows)
    expect = brute(rows, N.idf_table(docs))
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    assert got == {i: expect[x] for i, x in rows}


def lopsided(n):
    """n near copies of one text, and 40 texts that share 60% of it: a bucket of one large
    component and some single texts."""
    rng = random.Random(31)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(n):
        own = list(base)
        own[rng.randrange(240, 300)] = f"n{k}"
        rows.append((k, " ".join(own)))
    for k in range(40):
        own = list(base)
        for at in range(200, 300):
            own[at] = f"v{k}_{at}"
        rows.append((100_000 + k, " ".join(own)))
    return rows


def test_a_large_component_does_not_meet_itself(documents, monkeypatch):
    """Rows grow in proportion with the large component, and no link is lost."""
    monkeypatch.setattr(N, "BANDS", 24)
    monkeypatch.setattr(N, "ROWS_PER_BAND", 1)
    monkeypatch.setattr(N, "SAMPLES", 24)
    seen, real = [], N.meetings
    monkeypatch.setattr(N, "meetings", lambda *a: seen.append(real(*a)) or seen[-1])
    counts = {}
    for n in (150, 600):
        rows = lopsided(n)
        docs = documents(rows)
        got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
        counts[n] = seen[-1].count()
        if n == 150:
            expect = brute(rows, N.idf_table(docs))
            assert got == {i: expect[x] for i, x in rows}
        assert sum(c == 0 for c in got.values()) >= n
    print(counts)
    assert counts[150] > 0 and counts[600] <= 5 * counts[150]


def test_survivors(documents, edge_rows):
    rows = make_rows(edge_rows)
    docs = documents(rows, clash=True)
    kept = N.survivors(docs).collect()
    classes = {r.class_id for r in N.classes(docs).collect()}
    assert {r.doc_id for r in kept} == classes
    assert N.survivors(docs).columns == docs.columns


def test_samples_estimate_weighted_jaccard():
    idf = np.random.default_rng(1).uniform(1, 8, N.DF_BUCKETS).astype(np.float32)
    words = [f"w{k}" for k in range(400)]
    a, b = " ".join(words[:300]), " ".join(words[60:360])
    sampler, got = N.Sampler(2000), []
    for x in (a, b):
        e, g, _, _ = N.elements(one_text(x, ALNUM, lower=True))
        got.append(sampler.samples(e, N.log_weights(idf)[N._bucket(g)], np.array([0]))[0])
    true = N.Weighted(a, idf).similarity(N.Weighted(b, idf))
    assert np.mean(got[0] == got[1]) == pytest.approx(true, abs=0.05)


@pytest.mark.parametrize("plain", [False, True])
def test_block_similarities_equal_those_of_pairs(plain):
    rng = random.Random(8)
    idf = np.random.default_rng(1).uniform(1, 8, N.DF_BUCKETS).astype(np.float32)
    base = [f"w{k}" for k in range(80)]
    texts = [N.Weighted(" ".join(w if rng.random() < 0.9 else f"x{k}" for w in base[:rng.randint(3, 80)]), idf) for k in range(40)] + [N.Weighted("", idf)]
    got = N.similarities(texts, plain, step=17)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert i == j or got[i, j] == pytest.approx(a.similarity(b, 0.0, plain) if a.total and b.total else 0.0, abs=1e-12)


def test_counted_shingles():
    w = one_text("a b c d e a b c d e a b c d e", ALNUM)
    e, g, at, nth = N.elements(w)
    assert sorted(nth.tolist()) == sorted([0] * 5 + [1] * 5 + [2] * 1) and len(set(e.tolist())) == 11
    assert len(N.shingles(one_text("a b", ALNUM))[0]) == 1 and len(N.shingles(one_text("", ALNUM))[0]) == 0


def test_idf_counts_documents(documents):
    idf = N.idf_table(documents([(k, "a b c d e") for k in range(8)] + [(9, "a b c d e a b c d e"), (10, None)]))
    g = N.shingles(one_text("a b c d e", ALNUM))[0]
    assert idf[N._bucket(g)][0] == pytest.approx(np.log1p(9 / 10))


def test_empty_table(documents):
    assert N.classes(documents([])).count() == 0


def plain(a, b):
    """Jaccard similarity of the sets of five consecutive words."""
    a, b = ({tuple(x.split()[k:k + 5]) for k in range(len(x.split()) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def hot_group():
    """3,000 rows: a third of them copies of one text, 240 of those with some words changed."""
    rng = random.Random(21)
    vocabulary = [f"v{k}" for k in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(204)]
    rows = [(k, " ".join(base)) for k in range(760)]
    for k in range(240):
        own = list(base)
        for at in rng.sample(range(204), 1 + k % 5):
            own[at] = f"changed{k}"
        rows.append((1000 + k, " ".join(own)))
    return rows + [(5000 + k, " ".join(rng.choice(vocabulary) for _ in range(204))) for k in range(2000)]


@pytest.mark.parametrize("also_plain,least,least_pairs", [(False, 0.95, 0.95), (True, 0.99, 0.98)])
def test_recall_in_a_hot_group(documents, also_plain, least, least_pairs):
    """Near copies by plain Jaccard >= 0.8 in a group that holds a third of the rows, found by
    the weights alone, and with plain links."""
    rows = hot_group()
    docs = documents(rows)
    got = {r.doc_id: r.class_id for r in N.classes(docs, plain=also_plain).collect()}
    near = {i: plain(x, rows[0][1]) for i, x in rows if 1000 <= i < 5000}
    near = {i: j for i, j in near.items() if j >= 0.8}
    found = sum(got[i] == 0 for i in near) / len(near)
    # pair by pair: every near copy against the group's text, without help of a third one
    idf = N.idf_table(docs)
    sampler, keys = N.Sampler(), {}
    text = dict(rows)
    for i in [0, *near]:
        e, g, _, _ = N.elements(one_text(text[i], ALNUM, lower=True))
        keys[i] = N.band_keys(sampler.samples(e, N.log_weights(idf)[N._bucket(g)], np.array([0])))[0]
    base = N.Weighted(text[0], idf)
    linked = sum((keys[i] == keys[0]).any() and N.Weighted(text[i], idf).similarity(base, 0.0, also_plain) >= N.THRESHOLD for i in near) / len(near)
    print(f"{len(near)} near copies, recall {found:.4f}, by pairs {linked:.4f}")
    assert len(near) > 150 and found >= least and linked >= least_pairs
    assert all(got[i] == i for i, _ in rows if i >= 5000)
