"""Operator 3, token counts: delta-maintained rollups.

A rollup is a folder of committed batches.  A batch holds signed totals (rows
and tokens) by source, language and tokenizer version: inserted documents count
+, deleted ones -, and a revised document takes its old count off and adds the
new one.  Totals are additive, so the current rollup is the sum over committed
batches and costs nothing of the corpus itself.

A batch is written to a folder of its own, then committed by creating a marker file with
its number that names the folder.  A marker is created once and names one folder, so a
batch that is sent again (a retry, a replay, two writers at once) changes nothing.
``compact`` sums the batches into one snapshot that lists the batches it holds: those
are known when they are sent again, and others, however late, are still added.

Skew: the signed rows of a batch are summed per task before the shuffle, so a
source with a third of all rows is one row per task and key.

Defined cases: null text counts as empty (0 tokens); null source or language is
a key of its own.  Groups whose documents were all deleted have no row.  An
empty batch commits no rows.  Columns beyond source, lang and text are ignored.
The query keeps one row of each text, that of the smallest doc_id (a null one
counts as the largest), also of rows that are repeated as a whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm.common import clean_text, query, table, written
from plantlens.session import scratch_path

#: Tokenizer versions: the pattern whose matches are the tokens (the same for Java and RE2).
TOKENIZERS = {
    "words_v1": r"[^ \t\n\x0B\f\r]+",
    "pieces_v2": r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t\n\x0B\f\r]",
}
KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizers: Mapping[str, str] = TOKENIZERS, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """source, lang, the ``keep`` columns and counts: the tokens of the text by tokenizer version."""
    text = clean_text(text_col)
    counts = F.array(*[
        F.struct(F.lit(name).alias("tokenizer"), F.regexp_count(text, F.lit(pattern)).cast("long").alias("n"))
        for name, pattern in tokenizers.items()])
    return docs.select(*keep, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), counts.alias("counts"))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Signed totals of counted documents that come (+1) or go (-1)."""
    return (rows.select("source", "lang", F.explode("counts").alias("c"))
            .groupBy("source", "lang", F.col("c.tokenizer").alias("tokenizer"))
            .agg((F.lit(sign) * F.count("*")).alias("n_docs"), (F.lit(sign) * F.sum("c.n")).alias("n_tokens")))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed totals of counted documents whose text, source or language changed."""
    return added(signed(before, -1), signed(after, 1))


def added(*deltas: DataFrame) -> DataFrame:
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return out.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def ranges(numbers: set[int]) -> list[list[int]]:
    """Numbers as ascending [first, last] ranges."""
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return out


class Rollup:
    """Totals under ``root`` (a folder that all executors share): ``data`` has written folders,
    ``batches`` and ``snapshots`` have a marker file by number that names one of them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marker(self, kind: str, number: int):
        return self._path(f"{self.root}/{kind}/{number:012d}")

    def _read(self, kind: str, number: int) -> dict | None:
        """What a marker says; None if there is none, or its writer was lost before it wrote."""
        if not self._fs.exists(self._marker(kind, number)):
            return None
        stream = self._fs.open(self._marker(kind, number))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None

    def _publish(self, df: DataFrame, kind: str, number: int, more: dict) -> bool:
        """Write a folder aside, then create the marker that names it; the file system lets one
        creation through.  False when another's marker is there: its folder counts."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{name}")
        marker, text = self._marker(kind, number), json.dumps({**more, "data": name})
        try:
            # a marker without content was left by a lost writer: it is written over
            stream = self._fs.create(marker, self._fs.exists(marker) and self._read(kind, number) is None)
            stream.write(text.encode())
            stream.close()
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception) and "already exists" not in str(e.java_exception):
                raise
        won = (self._read(kind, number) or {}).get("data") == name
        if not won:
            self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
        return won

    def _numbers(self, kind: str) -> list[int]:
        place = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n) for n in names if n.isdigit())

    def _snapshot(self) -> tuple[int, str | None, set[int]]:
        """The newest snapshot: its number, its folder, and the batches that it holds."""
        for number in reversed(self._numbers("snapshots")):
            found = self._read("snapshots", number)
            if found:
                return number, found["data"], {n for lo, hi in found["batches"] for n in range(lo, hi + 1)}
        return -1, None, set()

    def _committed(self, held: set[int]) -> dict[int, str]:
        """Committed batches that the snapshot does not hold, with their folders."""
        found = {b: self._read("batches", b) for b in self._numbers("batches") if b not in held}
        return {b: m["data"] for b, m in found.items() if m}

    def commit(self, batch: int, deltas: DataFrame) -> bool:
        """Add a batch once; False, and no change, when it is committed already.  Batches may
        come in any order, also after a snapshot of later ones."""
        if batch in self._snapshot()[2] or self._read("batches", batch):
            return False
        return self._publish(deltas.select(*KEYS, "n_docs", "n_tokens"), "batches", batch, {})

    def _sum(self, folders: list[str]) -> DataFrame:
        places = [f"{self.root}/data/{f}" for f in folders]
        parts = self.spark.read.schema(TOTALS).parquet(*places) if places else self.spark.createDataFrame([], TOTALS)
        return added(parts).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """Current totals; groups without documents are left out."""
        _, folder, held = self._snapshot()
        return self._sum([*([folder] if folder else []), *self._committed(held).values()])

    def compact(self) -> None:
        """Sum what is committed into a snapshot, which lists the batches that it holds."""
        number, folder, held = self._snapshot()
        more = self._committed(held)
        if more:
            self._publish(self._sum([*([folder] if folder else []), *more.values()]), "snapshots", number + 1,
                          {"batches": ranges(held | set(more))})

    def vacuum(self) -> None:
        """Remove older snapshots, and the batches that the newest one holds; for times when no
        reader of an older state is at work."""
        last, _, held = self._snapshot()
        for kind, numbers in (("batches", held), ("snapshots", [n for n in self._numbers("snapshots") if n < last])):
            for n in sorted(set(self._numbers(kind)) & set(numbers)):
                found = self._read(kind, n)
                if found:
                    self._fs.delete(self._path(f"{self.root}/data/{found['data']}"), True)
                self._fs.delete(self._marker(kind, n), False)


#: Runs of the junk marks that revisions strip.
JUNK = "[#$%&*]{3}"


@query("op3_token_rollup", oracle=rf"""
WITH d AS (SELECT source, lang, regexp_replace(coalesce(text, ''), '{JUNK}', '', 'g') AS text FROM documents
           QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) = 1)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM (
  SELECT source, lang, 'words_v1' AS tokenizer, len(regexp_extract_all(text, '{TOKENIZERS["words_v1"]}')) AS n FROM d UNION ALL
  SELECT source, lang, 'pieces_v2', len(regexp_extract_all(text, '{TOKENIZERS["pieces_v2"]}')) FROM d)
GROUP BY ALL""")
def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents; delete the copies of texts (the smallest doc_id stays); revise
    those that remain and hold junk marks; send every batch twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", clean_text().alias("text"))
    rows = docs.withColumn("t", F.md5(F.col("text").cast("binary")))
    now = written(counted(rows, keep=("doc_id", "t")), "counts")
    later = counted(rows.where(F.col("text").rlike(JUNK)).withColumn("text", F.regexp_replace("text", JUNK, "")), keep=("doc_id", "t"))
    # one row of each text stays: of its smallest doc_id (null after all others, as SQL sorts)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang", "counts")
    first = written(now.groupBy("t").agg(F.min(own).alias("f")).select("t", "f.source", "f.lang", "f.counts"), "first-rows")
    revised_counts = later.groupBy("t").agg(F.min("counts").alias("revised"))  # the same in all rows of a text
    revisions = written(first.join(revised_counts, "t"), "revisions")
    root = scratch_path(spark, "llm-rollup")
    rollup = Rollup(spark, root)
    for _ in range(2):
        rollup.commit(1, signed(now, 1))
        rollup.commit(2, added(signed(now, -1), signed(first, 1)))  # a group's rows but its first
        rollup.commit(3, revised(revisions, revisions.drop("counts").withColumnRenamed("revised", "counts")))
    return rollup.totals()
