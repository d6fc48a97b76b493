"""What the training-data operators share: durable intermediate tables, word patterns, small checks."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.session import share_code, shared_dir

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch, so that a Python worker's memory doesn't depend on text lengths.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable by workers and bound the Arrow batches they are sent."""
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


_tables = threading.local()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    The files are deleted when the scratch() it is written in ends, or else when the driver's JVM does. Shuffle files of the
    write are deleted at once: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowmill-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    where, files = _located(spark, path)
    files.deleteOnExit(where)
    if getattr(_tables, "open", None):
        _tables.open[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize writes inside are deleted at the end, but those of its results that are given to the function it yields.

    What leaves the block must not read a deleted table.
    """
    if not hasattr(_tables, "open"):
        _tables.open = []
    own: list[tuple[SparkSession, str]] = []
    kept: set[str] = set()
    _tables.open.append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written_at)
        return df

    try:
        yield keep
    finally:
        _tables.open.pop()
        for spark, path in own:
            if path not in kept:
                where, files = _located(spark, path)
                files.delete(where, True)
            elif _tables.open:
                _tables.open[-1].append((spark, path))


_FIXED = {"Project", "Filter", "Relation", "LogicalRDD", "LocalRelation", "SubqueryAlias"}


def fixed_rows(df: DataFrame) -> DataFrame:
    """The table with rows that two scans agree on, though not on their order or place: see numbered.

    Projections and filters of a scan do, whatever columns are pruned; anything with an exchange below is written first.
    """
    nodes = re.findall(r"(?m)^[\s:+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString())
    return df if set(nodes) <= _FIXED else materialize(df, "rows")


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """The table written with a number for each row, to be told apart by.

    A number drawn again in a second scan may name another row: it depends on the scan's splits, and those on the cores
    registered at that moment.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


#: Ids that may be broadcast: 8 bytes each, about 64 MB in a hash table.
BROADCAST_IDS = 1_000_000


def few_or_shuffled(ids: DataFrame, label: str = "ids", limit: int = BROADCAST_IDS) -> DataFrame:
    """A table of ids, written (if it isn't yet) and counted: marked for broadcast up to the limit, else joined by shuffle."""
    ids = ids if hasattr(ids, "_written_at") else materialize(ids, label)
    return F.broadcast(ids) if ids.count() <= limit else ids


#: Rows of one per key that may be broadcast, about 150 bytes each; copies of the rest, over which a key's rows are dealt.
BROADCAST_GROUPS, SALTS = 300_000, 8


def join_groups(rows: DataFrame, groups: DataFrame, key: str, rid: str = "rid", how: str = "inner", limit: int | None = None) -> DataFrame:
    """Rows joined with at most one row for their key, whatever share of them has the same one.

    `groups`, which must be stored and have unique keys, is counted: broadcast up to the limit, else each key's rows are dealt by
    `rid` over SALTS tasks, to which the key's group is copied.
    """
    if groups.count() <= (BROADCAST_GROUPS if limit is None else limit):
        return rows.join(F.broadcast(groups), key, how)
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(rid), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def free(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words (see WORD) as a long, by one regular-expression pass in the JVM."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo: the split rule of the training operators."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
