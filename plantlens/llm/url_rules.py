"""Operator 10, URL filters by association rules. DataFrame and SQL functions only.

Explicit rules (host, path) judge the URLs they fit: the host and all its
subdomains, when the path starts with the rule's; the longest rule wins.  Those
verdicts are the labels.  Spark's FP-growth mines the combinations of URL
tokens (host labels, path parts with digits generalised, query keys, fragment)
that go with a label; rules are pruned by support and confidence.  A URL that
no explicit rule fits gets the verdict of the best mined rule whose tokens it
all has (highest confidence, then largest support, then first in order), else
``DEFAULT``.

Matching: the mined rules are an inverted index (token -> rule).  Distinct token
sets are looked up in it once each, however many URLs share one, by an equi-join
on the token; a rule matches a set when all its tokens were found.

Defined cases: null URLs and URLs without ``://`` have empty host and path and
no tokens: the default verdict.  Without labelled URLs nothing is mined.
Repeated rows give repeated results.  Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import query, table, written
from plantlens.llm.urls import after_scheme, host, path

#: The contract's rules, in its order.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Share of the labelled URLs that a rule's tokens and label must be in, and of its tokens' URLs that the label must have.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
DEFAULT = "allow"


def explicit(rules=RULES) -> Column:
    """The longest fitting rule, as a struct (rule, verdict); null without one."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        own = (F.col("host") == name) | F.col("host").endswith(f".{name}")
        return own & F.col("path").startswith(f"/{rest}")

    chosen = [F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, rule in longest_first]
    return F.coalesce(*chosen)


def tokens() -> Column:
    """Distinct tokens of a URL in order: ``h=`` host labels, ``p=`` path parts (digits as #),
    ``q=`` query keys, ``f=`` a fragment."""
    rest = after_scheme()
    labels = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h="), x))
    parts = F.transform(F.filter(F.split("path", r"[/.]"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("p="), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(F.split(rest, "#").getItem(0), F.lit(r"[?&]([^=&]+)"), 1), lambda x: F.concat(F.lit("q="), x))
    mark = F.when(F.contains(rest, F.lit("#")), F.array(F.lit("f="))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(labels, parts, keys, mark)))


def mined(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent array, verdict, confidence, freq) of rows (tokens, verdict)."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    if items.isEmpty():
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, freq long")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(
        F.col("consequent")[0].startswith("verdict=") & ~F.exists("antecedent", lambda x: x.startswith("verdict=")))
    sizes = model.freqItemsets.select(F.array_sort("items").alias("whole"), F.col("freq"))
    return (found.select(F.array_sort("antecedent").alias("antecedent"), F.array_sort(F.concat("antecedent", "consequent")).alias("whole"),
                         F.substring(F.col("consequent")[0], len("verdict=") + 1, 100).alias("verdict"), "confidence")
            .join(sizes, "whole").select("antecedent", "verdict", "confidence", "freq"))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict): the best rule of each distinct token set, by inverted index."""
    rules = rules.select("antecedent", "verdict", "confidence", "freq", F.array_join("antecedent", " ").alias("name"))
    index = rules.select(F.explode("antecedent").alias("token"), "name", "verdict", "confidence", "freq", F.size("antecedent").alias("needed"))
    found = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
             .groupBy("tokens", "name", "verdict", "confidence", "freq", "needed").agg(F.count("*").alias("n")).where("n = needed"))
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("freq")).alias("f"), "name", "verdict")
    return found.groupBy("tokens").agg(F.min(rank).alias("top")).select("tokens", F.col("top.verdict").alias("mined"))


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    rows = pages.select("page_id", "url", host().alias("host"), path().alias("path")).withColumn("tokens", tokens())
    rows = rows.withColumn("own", explicit(rules))
    learned = mined(rows.where("own IS NOT NULL").select("tokens", F.col("own.verdict").alias("verdict")), min_support, min_confidence)
    sets = rows.where("own IS NULL").select("tokens").distinct()
    best = written(matched(sets, written(learned, "url-rules")), "url-sets")
    return rows.join(best, "tokens", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "mined", F.lit(DEFAULT)).alias("verdict"))


def _oracle() -> str:
    def fits(rule: str) -> str:
        name, _, rest = rule.partition("/")
        return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}'))"

    order = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in order)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in order)
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {rule} END AS rule, list_sort(list_distinct(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h=' || x),
      list_transform(list_filter(regexp_split_to_array(path, '[/.]'), lambda x: x <> ''), lambda x: 'p=' || regexp_replace(x, '[0-9]+', '#', 'g')),
      list_transform(regexp_extract_all(split_part(rest, '#', 1), '[?&]([^=&]+)', 1), lambda x: 'q=' || x),
      CASE WHEN contains(rest, '#') THEN ['f='] ELSE [] END))) AS t FROM b),
d AS (SELECT *, CASE rule {verdict} END AS v FROM c),
ts AS (SELECT DISTINCT t FROM d WHERE len(t) > 0),
subs AS (SELECT t, array_to_string(list_sort(list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1)), ' ') AS s
         FROM ts, unnest(range(1, 1 << len(t))) AS r(m)),
lab AS (SELECT s, v FROM d JOIN subs USING (t) WHERE v IS NOT NULL),
n AS (SELECT count(*) AS n FROM d WHERE v IS NOT NULL),
cnt AS (SELECT s, v, count(*) AS f, sum(count(*)) OVER (PARTITION BY s) AS of_s FROM lab GROUP BY s, v),
rules AS (SELECT s, v, f, f::DOUBLE / of_s::DOUBLE AS conf FROM cnt, n WHERE f >= ceil({MIN_SUPPORT} * n) AND f::DOUBLE / of_s::DOUBLE >= {MIN_CONFIDENCE}),
best AS (SELECT t, rules.v AS mined FROM subs JOIN rules USING (s)
         QUALIFY row_number() OVER (PARTITION BY t ORDER BY conf DESC, f DESC, s, rules.v) = 1)
SELECT page_id, host, path, rule, coalesce(v, mined, '{DEFAULT}') AS verdict FROM d LEFT JOIN best USING (t)"""


@query("op10_url_rules", oracle=_oracle())
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
