"""Operator 11, spelling variant grouping by bidirectional FM-index search schemes.

Words are counted over all documents.  Two words are near if one letter is inserted, deleted or
replaced.  Of a near pair, one half of either word (its first half, or the rest) stands
unchanged in the other.  So each word is searched twice: its first half exactly and
the rest with one error, and its second half exactly and the beginning with one
error; the second is the first on reversed words.

The vocabulary is sorted by a range partitioning and cut into shards of about
``SHARD_CHARS`` letters.  Words with a given beginning are neighbours, so a word is
sent only to the shards that hold its half: mostly one.  A shard's
task builds a bidirectional FM-index (``fm_index``) over its delimited words and searches the
words sent to it, in blocks.  Near words are counted in the shard; the counts, and the
near word of largest count, are added up by word.

The driver holds the first letters (``BOUND_CHARS``) of each shard, at most about
``MOST_SHARDS``: larger vocabularies have larger shards.  A word's root is found by
following forms; each is at least ten times as frequent as the one before, so
there are few rounds.  A form of many variants is looked up by broadcast.

Defined cases: a null text has no words; a null doc_id counts as the empty string in the
hash; repeated rows count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import lookup, query, small_batches, table, written
from plantlens.llm.fm_index import Index

#: Letters and digits of the contract.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_CHARS = 7
LEAST_COUNT = 2
DAMAGED = 31
#: A form is so many times as frequent.
RATIO = 10

SHARD_CHARS = 1 << 16
MOST_SHARDS = 100_000
BOUND_CHARS = 64
#: Words that are searched together.
BLOCK = 4096


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): the runs of all texts, lower-cased, some with one letter deleted by a hash."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = runs.where(F.length("run") >= LEAST_CHARS).select("doc", F.translate("run", upper, upper.lower()).alias("run"))
    hashed = lower.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def _bounds(words: DataFrame, shard_chars: int) -> list[str]:
    """First letters of the first word of each shard (column s)."""
    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = shard_chars
        for batch in batches:
            out = []
            for s in batch.column(0).to_pylist():
                if size >= shard_chars:
                    out.append(s[:BOUND_CHARS])
                    size = 0
                size += len(s) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["s"])

    return sorted({r.s for r in words.select("s").repartitionByRange("s").sortWithinPartitions("s").mapInArrow(starts, "s string").collect()})


NEAR = "word string, n_near long, best_n long, best string"


def _search(vocabulary: DataFrame, backward: bool, shard_chars: int) -> DataFrame:
    """``NEAR`` rows of the words with near words that share their first half and not, if
    ``backward``: their last half and not the first; at most one per word and shard."""
    spark = vocabulary.sparkSession
    words = vocabulary.select((F.reverse("word") if backward else F.col("word")).alias("s"), "n")
    bounds = spark.sparkContext.broadcast(_bounds(words, shard_chars))

    def half(s: str) -> int:
        return len(s) - len(s) // 2 if backward else len(s) // 2

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = bounds.value
        for batch in batches:
            out: list[tuple] = []
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = max(bisect.bisect_right(firsts, s) - 1, 0)
                beginning = s[:half(s)]
                lo = max(bisect.bisect_right(firsts, beginning) - 1, 0)
                hi = bisect.bisect_right(firsts, beginning + chr(0x10FFFF)) - 1
                out.append((own, s, n, lo <= own <= hi))
                out.extend((k, s, None, True) for k in range(lo, hi + 1) if k != own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.bool_()))]
                                             if out else [pa.array([], t) for t in (pa.int32(), pa.string(), pa.int64(), pa.bool_())],
                                             names=["shard", "s", "n", "ask"])

    def near(words: list[str], counts: list[int], patterns: list[str], index: Index) -> pa.RecordBatch:
        size = np.array([half(p) for p in patterns], np.int64)
        q, u = index.one_error(patterns, size)
        if backward:  # what the other search finds too
            first = [p[::-1][:len(p) // 2] for p in patterns]
            keep = np.array([not words[b][::-1].startswith(first[a]) for a, b in zip(q.tolist(), u.tolist())], bool)
            q, u = q[keep], u[keep]
        n = np.array(counts, np.int64)[u]
        real = [w[::-1] for w in words] if backward else words
        place = np.empty(len(real), np.int64)
        place[sorted(range(len(real)), key=real.__getitem__)] = np.arange(len(real))
        order = np.lexsort((place[u], -n, q))
        q, u, n = q[order], u[order], n[order]
        first_of, at, many = np.unique(q, return_index=True, return_counts=True)
        asked = [patterns[k] for k in first_of.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[::-1] for p in asked] if backward else asked, pa.string()), pa.array(many.astype(np.int64)), pa.array(n[at]),
             pa.array([real[k] for k in u[at].tolist()], pa.string())], names=["word", "n_near", "best_n", "best"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        words: list[str] = []
        counts: list[int] = []
        asking: list[str] = []

        def answer():
            nonlocal index, asking
            if words and asking:
                index = index or Index(words)
                yield near(words, counts, asking, index)
            asking = []

        for batch in batches:
            for k, s, n, ask in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if k != shard:
                    yield from answer()
                    shard, index, words, counts = k, None, [], []
                if n is not None:  # a shard's own words come first
                    words.append(s)
                    counts.append(n)
                if ask:
                    asking.append(s)
                if len(asking) >= BLOCK and n is None:
                    yield from answer()
        yield from answer()

    return (words.mapInArrow(route, "shard int, s string, n long, ask boolean").repartition("shard")
            .sortWithinPartitions("shard", F.col("n").isNull(), "s").mapInArrow(search, NEAR))


def near_words(vocabulary: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``vocabulary`` (word, n; distinct) that
    have near words; best is the one of largest n, of equals the smallest."""
    both = _search(vocabulary, False, shard_chars).unionByName(_search(vocabulary, True, shard_chars))
    return (both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("neg"), "best")).alias("b"))
            .select("word", "n_near", (-F.col("b.neg")).alias("best_n"), F.col("b.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form, ...) with root: the last of the forms that follow one another."""
    name = "spelling-roots"
    now = written(forms.withColumn("root", F.coalesce("form", "word")), name)
    steps = now.where("form IS NOT NULL").select(F.col("word").alias("root"), F.col("form").alias("further"))
    while not now.where("form IS NOT NULL").join(steps, "root", "left_semi").isEmpty():
        now = written(lookup(now, "root", steps).withColumn("root", F.coalesce("further", "root")).drop("further"), name)
    return now


def variants(docs: DataFrame) -> DataFrame:
    """Per word: form, root, n, n_near, form_n."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = written(counted_words(docs), "spelling-words")
    total = vocabulary.agg(F.sum(F.length("word"))).first()[0] or 0
    near = near_words(vocabulary, max(SHARD_CHARS, total // MOST_SHARDS))

    def if_form(c: str) -> Column:
        return F.when(F.col("best_n") >= RATIO * F.col("n"), F.col(c))
    forms = vocabulary.join(near, "word", "left").select(
        "word", if_form("best").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), if_form("best_n").alias("form_n"))
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")


#: CRC-32 by its polynomial; near words by what is left when one letter is deleted.
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda s, x: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END) AS c
    FROM range(256) r(i))),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
runs AS (
  SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x
  FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM found WHERE length(run) >= 7)),
hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
                              lambda s, b: xor(s // 256, t[xor(s, b) % 256 + 1])), 4294967295) AS h
  FROM runs, crc),
vocabulary AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT v.word, CASE WHEN other_n >= 10 * v.n THEN other END AS form, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
followed(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT f.word, g.form FROM followed f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN followed r USING (word) JOIN forms last ON last.word = r.root AND last.form IS NULL
"""


@query("op11_spelling", ORACLE)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
