import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plantlens.llm import pairs, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return word_bpe.Coder(f.read())


def ids(coded):
    return [np.frombuffer(c, "<u4").tolist() for c in coded]


def test_encode_and_decode_as_the_library(documents, edge_rows, library):
    rng = random.Random(3)
    alphabet = "aAb thn  \n\t'sdéÉ́ÑΣσİß!?.12一日🙂\x1c "
    rows = edge_rows + [(100 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(500, "x<|endoftext|>y <|startoftext|><|endoftext|"), (501, "a<|ENDOFTEXT|>"), (502, "İ ΣΑΣ é")]
    docs = documents(rows, clash=True)
    coded = word_bpe.encode(docs)
    assert sorted(coded.columns) == sorted(docs.columns)
    got = word_bpe.decode(coded.select("doc_id", "text", "ids"), out="back").collect()
    whole = {r.text: r.ids for r in coded.select("text", "ids").collect()}
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert whole[r.text] == want
        assert r.back == library.decode(want, skip_special_tokens=False)


def test_digests(documents, library):
    rows = [(1, "Hello world's 12"), (2, None), (3, ""), (4, "ünï 日本語 🙂 " * 50), (None, "x"), (1, "Hello world's 12")]
    got = word_bpe.round_trip(documents(rows, clash=True)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows) and got[0].ids == "x"
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_every_code_point_of_the_basic_plane_that_python_names(library, coder):
    import unicodedata
    points = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = [f"a{c}b {c}1{c}'s" for c in points]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids(coder.encode(texts)) == want


def test_long_words_in_blocks(library, coder):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(40, 400))) for _ in range(60)]
    words += ["a" * 333, "一" * 100, "hello" * 40, "thethe" * 300]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert ids(coder.encode(words)) == want
    assert [coder.vocabulary.merge_long(w.encode()).tolist() for w in words] == want
    short = [w[:n] for w in words for n in (1, 2, 3, 17, word_bpe.SHORT)]
    assert [coder.vocabulary.merge_long(w.encode()).tolist() for w in short if len(w.encode()) > 1] == [
        library.encode(w, add_special_tokens=False).ids for w in short if len(w.encode()) > 1]


def test_boundaries_tile_the_word(coder):
    raw = np.array([list(b"unbelievably"), list(b"qqqqqqqqqqqq")], np.uint8)
    seen = 0
    for rows, parts, bounds in coder.vocabulary.merge_rows(coder.vocabulary._first(raw)):
        assert bounds.shape[1] == parts.shape[1] + 1
        for row, p, b in zip(rows, parts, bounds):
            tokens = [coder.vocabulary.tokens[i].removesuffix("</w>") for i in p.tolist()]
            assert [len(t) for t in tokens] == np.diff(b).tolist() and "".join(tokens).encode() == raw[row].tobytes()
            seen += 1
    assert seen == 2


def test_cache_keeps_two_bounded_generations(library, coder, monkeypatch):
    cache = pairs.MatchCache(coder.vocabulary.encode_many, 5, 4)
    for text in ["a b c d e f g h i j", "h i j a b zz yy abcdefgh", "k"] * 3:
        words = coder.vocabulary.split(text)
        assert ids(cache.encode([words, []])) == [library.encode(text, add_special_tokens=False).ids, []]
        assert len(cache.young) <= 5 and "abcdefgh" not in cache.young


def test_pair_table():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 3000, (2, 5000)), axis=1)
    table = pairs.PairTable(a, b, np.arange(len(a)))
    assert table.get(a, b).tolist() == list(range(len(a)))
    assert (table.get(a, b + 4000) == pairs.NONE).all()
    assert pairs.PairTable(a[:0], b[:0], a[:0]).get(a, b).min() == pairs.NONE


def test_ids_outside_the_vocabulary_and_null_ids(spark):
    rows = spark.createDataFrame([(1, [3306, 99999999, -1]), (2, None), (3, [])], "k long, ids array<int>")
    assert {r.k: r.decoded for r in word_bpe.decode(rows).collect()} == {1: "hello</w>", 2: "", 3: ""}


def test_empty_table(documents):
    assert word_bpe.decode(word_bpe.encode(documents([])).select("doc_id", "ids")).count() == 0
    assert word_bpe.round_trip(documents([])).count() == 0
