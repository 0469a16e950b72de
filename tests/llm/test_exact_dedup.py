import hashlib
import random
from collections import Counter, defaultdict

import pytest

from plantlens.llm import exact_dedup as X


def brute(rows, largest):
    groups = defaultdict(list)
    for i, x in rows:
        groups[x or ""].append(i)
    out = Counter()
    for i, x in rows:
        ids = [j for j in groups[x or ""] if j is not None]
        keep = (max if largest else min)(ids) if ids else None
        out[(i, keep, len(groups[x or ""]), i == keep, hashlib.sha256((x or "").encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_memberships_match_brute_force(documents, edge_rows, keep, limit, monkeypatch):
    rng = random.Random(5)
    rows = edge_rows + [(100 + i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))) for i in range(400)]
    full = X.owners
    monkeypatch.setattr(X, "owners", lambda *a, **k: full(*a, **{**k, "limit": limit}))
    got = X.memberships(documents(rows, clash=True), keep=keep)
    assert Counter(map(tuple, got.collect())) == brute(rows, keep == "largest")


def test_survivors_keep_all_columns(documents, edge_rows):
    docs = documents(edge_rows, clash=True)
    got = X.survivors(docs, keep="largest")
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.text or "") for r in rows) == sorted({x or "" for _, x in edge_rows})
    assert {r.doc_id for r in rows if r.text == "one"} == {5}


def test_empty_table(documents):
    assert X.memberships(documents([])).count() == 0
    assert X.survivors(documents([])).count() == 0


def test_trie_holds_prefixes_and_splits():
    trie, rng = X.RadixTrie(), random.Random(1)
    keys = {bytes(rng.choice(b"xy") for _ in range(rng.randint(0, 9))) for _ in range(300)} | {b"", b"x" * 5000}
    for k in keys:
        trie.terminal(k)[1] = k
    assert [k for k, _ in trie.items()] == sorted(keys)
    assert all(trie.terminal(k)[1] == k for k in keys)


def test_keep_is_checked(documents):
    with pytest.raises(ValueError):
        X.owners(documents([]), keep="first")
