import sys
import os

import tiktoken
import public_tokenizers

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from plantlens.llm import bpe, decontaminate, near_dedup, toxicity  # noqa: E402
from plantlens.llm.common import table  # noqa: E402
import test_decontaminate  # noqa: E402
import test_near_dedup  # noqa: E402
import test_toxicity  # noqa: E402


def test_pipeline_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents").collect()
    model = toxicity.fitted(table(spark, sf, "documents"), table(spark, sf, "labels"))
    clean = [r for r in docs if test_toxicity.slow_score(model, r.text) < toxicity.CUT]
    last = {r.text: r.doc_id for r in sorted(clean, key=lambda r: r.doc_id)}
    unique = [r for r in clean if last[r.text] == r.doc_id]
    own = spark.createDataFrame(unique, table(spark, sf, "documents").schema)
    classes = test_near_dedup.brute([(r.doc_id, r.text) for r in unique], near_dedup.idf_table(own))
    kept = [r for r in unique if classes[r.text] == r.doc_id]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    expect = {}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    for r in kept:
        n, hit, _ = test_decontaminate.brute(r.text, items)
        if len(hit) > decontaminate.MAX_COVERAGE * n:
            continue
        text = r.text
        places = [m.span() for m in test_decontaminate.WORD.finditer(text.translate({i: i + 32 for i in range(65, 91)}))]
        runs = []
        for p in hit:
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        for a, b in reversed(runs):
            text = text[:places[a][0]] + text[places[b][1]:]
        expect[r.doc_id] = (text, len(library.encode_ordinary(text)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.text, r.n_tokens) for r in got} == expect
    assert len(got) == len(expect)


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_take_edge_frames(spark, documents, edge_rows, sf):
    for rows in (edge_rows, []):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, documents(rows, clash=True), sf).count() <= len(rows)
