import re
import textwrap

import pytest

from plantlens.llm import licenses as L
from plantlens.llm.common import table


@pytest.fixture(scope="module")
def model(spark):
    return L.fitted(table(spark, "/root/testdata/sf0.01", "documents"))


def found(documents, model, rows):
    return {r.doc_id: [(n.paragraph, n.family) for n in r.notices] for r in L.scan(documents(rows, clash=True), model).collect()}


def test_templates_are_found_wherever_they_stand(documents, model):
    rows, expect = [], {}
    for k, family in enumerate(L.FAMILIES):
        for j, t in enumerate(L.TEMPLATES[family]):
            ident = 10 * k + j
            rows.append((ident, f"First line of text.\n\n{t.upper() if j % 2 else t}\nLast line."))
            expect[ident] = [(2, family)]
    assert found(documents, model, rows) == expect


def test_held_out_wordings(documents, model):
    rows = [(1, "Copyright 2020 A. Person. Licensed under the MIT License."), (2, "You may use this under the Apache License, Version 2.0."),
            (3, "This text may be copied under some licence of the author."), (4, "The committee granted permission to build the bridge."),
            (5, "He lost his driving license on the public road."), (6, "Copyright 2001, all rights reserved, The Publisher")]
    got = found(documents, model, rows)
    assert got[1] == [(0, "mit")] and got[2] == [(0, "apache")] and got[6] == [(0, "reserved")]
    assert all(f == "unknown" for i in (3, 4, 5) for _, f in got[i])


def test_planted_lines(spark, model):
    """Against a plain search for the corpus' own notices."""
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
             "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "reserved"}
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: [(n.paragraph, n.family) for n in r.notices] for r in L.scan(docs, model).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == [(k, lines[x]) for k, x in enumerate(r.text.split("\n")) if x in lines]


def test_the_query_counts_notices(spark, tmp_path):
    """The query's own columns against a plain search, with an unfamiliar notice and null texts."""
    lines = {"Released under the MIT License.": "mit", "All rights reserved.": "reserved", "License: Artistic-2.0": "unknown"}
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    rows += [(900_000 + k, f"{a}\nplain words\n\n{b}\n{a}") for k, (a, b) in enumerate((a, b) for a in lines for b in lines)] + [(910_000, None), (910_001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
               "Licensed under the Apache License, Version 2.0.": "apache", **lines}
    got = {r.doc_id: (r.licenses, r.n_notices, r.n_unknown) for r in L.op1_licenses(spark, str(tmp_path)).collect()}
    for i, text in rows:
        own = [planted[x] for x in (text or "").split("\n") if x in planted]
        assert got[i] == (",".join(sorted(set(own) - {"unknown"})), len(own), own.count("unknown")), text


def test_edges(spark, documents, edge_rows, model):
    got = L.scan(documents(edge_rows, clash=True), model)
    assert got.count() == len(edge_rows) and all(not r.notices for r in got.collect())
    assert L.scan(documents([]), model).count() == 0
    alone = L.fitted(documents([]))
    assert found(documents, alone, [(1, "Released under the MIT License.")]) == {1: [(0, "mit")]}
    many = "\n".join(["some plain words here"] * 2000 + ["Licensed under CC BY-NC 4.0."] * 3)
    assert found(documents, model, [(1, many)]) == {1: [(2000 + k, "cc-by-nc") for k in range(3)]}


def test_probabilities_are_calibrated(model):
    p = model.probabilities(L.features(L._words("Released under the MIT License.").hashes()))
    assert p.sum() == pytest.approx(1, abs=1e-5) and p[L.FAMILIES.index("mit")] > 0.9
    assert re.fullmatch(r"[a-z0-9-]+", L.FAMILIES[int(p.argmax())])


def test_short_and_unfamiliar_notices(documents, model):
    """Notices that share no word pair with a template, or are one word."""
    texts = {"License: MIT": "mit", "SPDX-License-Identifier: MIT": "mit", "GPLv3": "gpl", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl",
             "License: Apache-2.0": "apache", "// SPDX-License-Identifier: BSD-3-Clause": "bsd", "AGPLv3": "agpl"}
    got = found(documents, model, list(enumerate(f"Some text.\n{x}\nMore text." for x in texts)))
    assert [got[k] for k in range(len(texts))] == [[(1, f)] for f in texts.values()]
    other = ["SPDX-License-Identifier: EUPL-1.2", "License: Artistic-2.0"]
    got = found(documents, model, list(enumerate(other)))
    assert [got[k] for k in range(len(other))] == [[(0, "unknown")]] * len(other)


def test_candidates_are_what_judge_takes(spark, model):
    """The batch's choice against every paragraph of the corpus, one by one."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(200).collect()
    for r in docs:
        lines = [x for x in r.text.split("\n") if len(L._words(x))]
        hashes = [L._words(x).hashes() for x in lines]
        edges = L.np.cumsum([0, *map(len, hashes)])
        taken = set(model.candidates(L.np.concatenate(hashes), edges).tolist()) if hashes else set()
        for k, h in enumerate(hashes):
            at = L.np.searchsorted(model.vocabulary, L.features(h))
            at = at[at < len(model.vocabulary)]
            speaks = model.speaks[at[L.np.isin(model.vocabulary[at], L.features(h))]].any()
            assert k in taken or not speaks or model.judge(h) is None


@pytest.mark.parametrize("width", [40, 60, 66, 72, 80])
def test_wrapped_templates(documents, model, width):
    """Templates broken at the usual widths, in a text and behind a copyright line."""
    rows, expect = [], {}
    for k, family in enumerate(L.FAMILIES):
        for j, t in enumerate(L.TEMPLATES[family]):
            rows.append((10 * k + j, "First line of text.\n\n" + "\n".join(textwrap.wrap(t, width)) + "\n\nLast line."))
            expect[10 * k + j] = [(2, family)]
    assert found(documents, model, rows) == expect


def test_wrapped_isc(documents, model):
    text = ("Permission to use, copy, modify, and/or distribute this software for any\n"
            "purpose with or without fee is hereby granted, provided that the above\n"
            "copyright notice and this permission notice appear in all copies.\n")
    assert ("isc" in [f for _, f in found(documents, model, [(1, text)])[1]])
    apart = text.replace("\n", "\n\n")
    assert "isc" not in [f for _, f in found(documents, model, [(1, apart)])[1]]
