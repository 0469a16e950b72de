from collections import Counter
from itertools import combinations

import pytest

from plantlens.llm import url_rules as U

ROW = "page_id long, url string"
URLS = [
    "http://com/", "http://a.com/x", "https://example.com/en/1", "http://blog.Example.COM/en/2?x=1", "http://www.example.com/en/3", "http://m.www.example.com/en/",
    "http://example.com/en", "http://example.com", "http://a.net/es/4", "http://net/fr/", "http://b.net/de/5#top", "http://notcom/x", "http://xexample.com/en/1",
    None, "", "no scheme", "http://", "http:///path", "http://h?q=http://com/", "ftp://h#/en/", "http://a.org/en/7.html?page=2&ref=x", "http://a.com?x/en/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r), r, v) for v, r in U.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_explicit_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), ROW).selectExpr("*", "'x' AS host", "'x' AS path", "'x' AS tokens", "'x' AS rule", "'x' AS verdict", "'x' AS own")
    got = U.judge(df).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def mine_by_hand(labelled, min_support, min_confidence):
    count, total = Counter(), Counter()
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                total[c] += 1
                count[c, verdict] += 1
    return {(c, v): (f / total[c], f) for (c, v), f in count.items() if f >= min_support * len(labelled) and f / total[c] >= min_confidence}


def test_mining_and_matching_match_brute_force(spark):
    labelled = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 5 + [(["b", "c", "d"], "block")] * 3 + [(["d"], "allow")] * 2 + [([], "allow")]
    df = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    rules = U.mined(df, 0.1, 0.6)
    by_hand = mine_by_hand(labelled, 0.1, 0.6)
    assert {(tuple(r.antecedent), r.verdict): (pytest.approx(r.confidence), r.freq) for r in rules.collect()} == by_hand
    sets = [["a"], ["a", "b"], ["a", "c", "x"], ["d"], ["b", "c"], ["x"], ["a", "b", "c", "d"]]
    got = {tuple(r.tokens): r.mined for r in U.matched(spark.createDataFrame([(s,) for s in sets], "tokens array<string>"), rules).collect()}
    for s in sets:
        own = sorted((-conf, -f, " ".join(c), v) for (c, v), (conf, f) in by_hand.items() if set(c) <= set(s))
        assert got.get(tuple(s)) == (own[0][3] if own else None)


def test_empty_and_unlabelled(spark):
    assert U.judge(spark.createDataFrame([], ROW)).count() == 0
    got = U.judge(spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x")], ROW)).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, U.DEFAULT)] * 2


def test_no_python_in_the_plan(spark, sf):
    plan = U.judge(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
