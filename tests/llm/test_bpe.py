import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from plantlens.llm import bpe


@pytest.fixture(scope="module")
def raw():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(raw):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(raw), special_tokens={})


def test_encode_and_decode_as_the_library(documents, edge_rows, library):
    rng = random.Random(2)
    alphabet = "aab thn  \n\t'sdé1!?.ß日🙂 \x1c"
    rows = edge_rows + [(100 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    docs = documents(rows, clash=True)
    coded = bpe.encode(docs)
    assert sorted(coded.columns) == sorted(docs.columns)
    got = bpe.decode(coded.select("doc_id", "text", "ids"))
    for r in got.collect():
        assert bytes(r.bytes) == (r.text or "").encode()
    for r in coded.select("text", "ids").collect():
        assert r.ids == library.encode_ordinary(r.text or "")


def test_digests(documents, library):
    rows = [(1, "hello world 12"), (2, None), (3, ""), (4, "ünï 日本語 🙂 " * 50)]
    got = {r.doc_id: r for r in bpe.round_trip(documents(rows, clash=True)).collect()}
    assert got[1].ids == "x"
    for i, x in rows:
        ids = library.encode_ordinary(x or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()


def test_leftmost_minimum_wins():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258}
    assert bpe.merge(b"aaab", ranks) == [256, 257]
    assert bpe.merge(b"aaa", ranks) == [258]
    assert bpe.merge(b"aaaaa", ranks) == [256, 258]


def test_merge_matches_quadratic(raw):
    ranks, rng = bpe.parse_ranks(raw), random.Random(4)

    def plain(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(500):
        piece = "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 70))).encode()
        assert bpe.merge(piece, ranks) == plain(piece)


def test_trees_in_arrays_match_the_single_tree(raw):
    ranks, rng = bpe.parse_ranks(raw), random.Random(6)
    trees = bpe.Trees(ranks)
    matches = ["".join(rng.choice("abcdehinorsté日 ") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    matches += ["a" * n for n in range(1, 80)] + ["\0" * 9, "x\0y", "the" * 21]
    got = [np.frombuffer(x, "<i4").tolist() for x in trees.encode_many(matches)]
    assert got == [bpe.merge(m.encode(), ranks) for m in matches]
    assert trees.encode_many([]) == []


def test_cache_generations(raw, monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    encoder = bpe.Encoder(raw, public_tokenizers.PATTERN)
    for text in ["a b c d e f g h i j", "h i j a b zz yy", "a" * 300] * 3:
        assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode([text])] == [library.encode_ordinary(text)]
        assert len(encoder.cache.young) <= 5


def test_empty_table(documents):
    assert bpe.decode(bpe.encode(documents([])).select("doc_id", "ids")).count() == 0
    assert bpe.round_trip(documents([])).count() == 0
