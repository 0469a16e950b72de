"""What every operator of this subpackage shares: query registry, table access,
written intermediate tables, and the salted meeting of groups with their leader.
"""

from __future__ import annotations

import gc
import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.session import drop_scratch, scratch_path

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

#: Rows a task gets in one Arrow batch; texts may be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 512


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    while name in columns:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a worker's memory is bounded by a few long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the cluster's shared folder, read again.

    Cuts lineage: a lost executor rereads files instead of recomputing, and
    later joins know the table's size.  The tables are removed by
    ``plantlens.session.release`` or when the driver ends.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def consumed(df: DataFrame) -> None:
    """Remove a table that ``written`` gave and that nothing reads any more."""
    drop_scratch(df.sparkSession, df._scratch)


def clean_text(col: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Bits of the hashed membership map that is broadcast (as 2^19 words of 64).
MAP_BITS = 25


def probably_in(rows: DataFrame, wanted: DataFrame, key: str = "uid") -> DataFrame:
    """The rows whose key may be among ``wanted`` (a column of that name), by a bitmap of
    hashed keys: never loses one, and keeps few others while ``wanted`` is small against the
    bitmap.  It goes before an exact join, so that long rows are shuffled only where they
    are needed.  The broadcast has at most 2^19 rows of two longs, however large both are."""
    word, bit, mask = (fresh(rows.columns, c) for c in ("map_word", "map_bit", "map_mask"))

    def placed(df: DataFrame) -> DataFrame:
        h = F.shiftrightunsigned(F.xxhash64(key), 64 - MAP_BITS)
        return df.withColumns({word: F.shiftright(h, 6), bit: h.bitwiseAND(F.lit(63)).cast("int")})

    words = placed(wanted.select(key)).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(mask))
    return (placed(rows).join(F.broadcast(words), word).where(F.getbit(mask, F.col(bit)) == 1)
            .select(*rows.columns))


def meet(rows: DataFrame, pairs: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
         schema: str, per_task: int = 100) -> DataFrame:
    """Bring each leader's rows together with its members' rows, in groups of bounded size.

    ``rows``: (uid, ...); ``pairs``: distinct (member, leader) uids.  A leader of
    many members is dealt to several salted groups of about ``per_task`` members,
    each with a copy of the leader's row, so no group is large however many
    members one leader has.  ``fn`` gets the groups sorted: the leader's rows
    (role 0) first, then its members' (role 1), with the columns leader, salt,
    role and those of ``rows``.
    """
    # a table: Spark knows its size, broadcasts it if small, and else can split a hot leader
    sizes = written(pairs.groupBy("leader").agg(F.ceil(F.count("*") / per_task).cast("int").alias("n_salts")), "sizes")
    members = pairs.join(sizes, "leader").select(
        F.col("member").alias("uid"), "leader",
        F.pmod(F.xxhash64("member"), F.col("n_salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    leaders = sizes.select(
        F.col("leader").alias("uid"), "leader",
        F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    parties = written(members.unionByName(leaders), "parties")
    placed = probably_in(rows, parties).join(parties, "uid")
    return (placed.select("leader", "salt", "role", *rows.columns)
            .repartition("leader", "salt")
            .sortWithinPartitions("leader", "salt", "role", "uid")
            .mapInArrow(fn, schema))


#: Keys that a lookup broadcasts at most.
HOT_KEYS = 1000


def lookup(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``rows`` (a written table) with the columns of ``found`` (distinct keys), null where the
    key is not there.  Keys that hold a ``HOT_KEYS``-th of the rows are at most so many and
    are broadcast, found or not, so that no task gets all rows of a frequent key."""
    hit = fresh([*rows.columns, *found.columns], "hit")
    least = max(64, rows.count() // HOT_KEYS + 1)
    frequent = rows.groupBy(key).count().where(F.col("count") >= least).select(key)
    near = rows.join(F.broadcast(frequent.join(found, key, "left").withColumn(hit, F.lit(True))), key, "left")
    return (near.where(F.col(hit)).drop(hit)
            .unionByName(near.where(F.col(hit).isNull()).select(*rows.columns).join(found, key, "left")))


def table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The batches' rows, one by one."""
    for batch in batches:
        yield from batch.to_pylist()


def rebatched(rows: Iterator[dict], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of ``size`` rows."""
    part: list[dict] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield pa.RecordBatch.from_pylist(part, schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=schema)


_HELD: dict = {}


def enter(operator: str) -> dict:
    """The state that a worker process holds for an operator (caches, tables).  Workers are
    reused by later stages: state of another operator is freed here, so that a worker never
    holds more than one operator's."""
    if _HELD.get("operator") != operator:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD["operator"] = operator
    return _HELD


#: Modules that register a query.
MODULES = ("exact_dedup", "decontaminate", "bpe", "toxicity", "substring_dedup", "near_dedup", "html_extract",
           "url_rules", "token_rollup", "licenses", "word_bpe", "prefix_trie",
           "spelling")


def load_all() -> None:
    """Import every operator module (each registers its query)."""
    for name in MODULES:
        importlib.import_module(f"plantlens.llm.{name}")
