"""Batch sources and sinks by file format. Formats Spark reads are read by Spark; the others go through pandas in tasks."""

from __future__ import annotations

import io
import os
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 13 columns of a header-less flow export.
NETFLOW = (
    "timestamp string, duration double, src_ip string, dst_ip string, src_port long, dst_port long, protocol string, flags string, "
    "forwarding_status long, type_of_service long, packet long, num_of_bytes long, label string"
)
TRUTH = "label string, tool string, ip_src string, ip_dst string, dp string, ts long, te long"
_CSV = (".csv", ".flows", ".gz")
#: Rows that are sent to the driver as one packed table.
PACKED = 10_000


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = "|", header: bool = True) -> DataFrame:
    """Read by extension: csv, flows and gz as separated text, parquet, orc, json, feather, pickles, and as pickles with a
    warning any other. Folders are searched below."""
    reader = spark.read.option("recursiveFileLookup", "true")
    name = path.rstrip("/*")
    if schema is not None:
        reader = reader.schema(schema)
    if name.endswith(_CSV):
        return reader.option("sep", sep).option("header", header).csv(path)
    if name.endswith(".parquet"):
        return reader.parquet(path)
    if name.endswith(".orc"):
        return reader.orc(path)
    if name.endswith(".json"):
        return reader.json(path)
    if schema is None:
        raise ValueError(f"feather and pickle files, and such as have another extension, need a schema: {path}")
    if not name.endswith((".feather", ".pkl", ".pkl-zip")):
        warnings.warn(f"unknown extension, read as a pickle: {path}", stacklevel=2)
    return _by_pandas(spark, path, schema)


def _by_pandas(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole files, one per row, decoded in tasks. Pickles run code: read only files you trust."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                raw = io.BytesIO(content)
                if name.endswith(".feather"):
                    yield pd.read_feather(raw)
                else:
                    yield pd.read_pickle(raw, compression="zip" if name.endswith("zip") else None)

    return files.mapInPandas(decode, schema)


def save(df: DataFrame, path: str, kind: str, sep: str = "|", partition_by: list[str] | None = None, max_rows: int | None = None, mode: str = "overwrite") -> None:
    """Write as csv, flows, gz, parquet, orc or json; optional folders per value and rows per file. feather, pkl and pkl-zip are written by the
    tasks, a file each, to a folder that all of them can reach; a task holds its partition's rows."""
    if kind in _PANDAS:
        return _save_by_pandas(df, path, kind, mode)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if kind in ("csv", "flows", "gz", "arrow"):
        writer = writer.option("sep", sep).option("header", True)
        (writer if kind in ("csv", "flows") else writer.option("compression", "gzip")).csv(path)
    elif kind in ("parquet", "orc", "json"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"unknown format: {kind}")


_PANDAS = {"feather": pd.DataFrame.to_feather, "pkl": pd.DataFrame.to_pickle, "pkl-zip": lambda rows, out: rows.to_pickle(out, compression="zip")}


def _save_by_pandas(df: DataFrame, path: str, kind: str, mode: str) -> None:
    """One file a task, under a name that a repeated attempt writes again; the first task's is there even without rows."""
    from pyarrow import fs

    uri = path if "://" in path else f"file://{os.path.abspath(path)}"
    store, folder = fs.FileSystem.from_uri(uri)
    if store.get_file_info(folder).type != fs.FileType.NotFound:
        if mode != "overwrite":
            raise ValueError(f"{path} exists")
        store.delete_dir(folder)
    store.create_dir(folder)
    columns = df.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, parts = TaskContext.get().partitionId(), list(batches)
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
        if len(rows) or not number:
            raw = io.BytesIO()
            _PANDAS[kind](rows, raw)
            there, at = fs.FileSystem.from_uri(uri)
            with there.open_output_stream(f"{at}/part-{number:05d}.{kind}") as out:
                out.write(raw.getvalue())
        yield pd.DataFrame({"n": [len(rows)]})

    df.mapInPandas(write, "n long").agg(F.sum("n")).collect()


def save_buckets(df: DataFrame, path: str, buckets: int, *keys: str) -> None:
    """One folder per hash bucket of the keys."""
    df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def save_features(df: DataFrame, path: str, block_mb: int = 256) -> None:
    """Parquet with row groups of the given size, for batch readers of a feature array."""
    df.write.mode("overwrite").option("parquet.block.size", block_mb << 20).parquet(path)


def append_table(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def read_netflow(spark: SparkSession, path: str) -> DataFrame:
    """Header-less flow export; the time text becomes epoch seconds."""
    return spark.read.schema(NETFLOW).csv(path).withColumn("timestamp", F.unix_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).option("sep", "\\\\").option("escape", "\0").csv(path)


def with_path_hour(df: DataFrame) -> DataFrame:
    """date and hour from .../YYYY/MM/DD/HH/ in the file's path, which is added as `file`."""
    path = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(path, r"/(\d{4})/(\d{2})/(\d{2})/(\d{2})/[^/]*$", i)
    return df.select("*", path.alias("file"), F.try_to_date(F.concat_ws("-", part(1), part(2), part(3))).alias("date"), part(4).try_cast("int").alias("hour"))


def read_deny_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lists in dated folders *_YYYYMMDD/raw_ips.csv: ip, level, date, month, day."""
    rows = spark.read.schema("ip string, level int").option("recursiveFileLookup", "true").option("pathGlobFilter", "raw_ips.csv").csv(path)
    date = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"_(\d{8})/raw_ips\.csv$", 1), "yyyyMMdd")
    return rows.select("ip", "level", date.alias("date")).withColumn("month", F.month("date")).withColumn("day", F.dayofmonth("date"))


def read_ip_stats(spark: SparkSession, path: str) -> DataFrame:
    """Address and packet count from a text report; other lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    ip, n = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)).try_cast("long")
    return spark.read.text(path).select(ip.alias("ip"), n.alias("packets")).where(F.col("ip").rlike(r"^[0-9]+(\.[0-9]+){3}$|^[0-9a-fA-F]*:[0-9a-fA-F:]+$") & F.col("packets").isNotNull())


def training_batches(df: DataFrame, columns: list[str], least: int, label: str = "Label", background_only: bool = False, seed: int = 0) -> Iterator[tuple[pd.DataFrame, pd.Series]]:
    """Batches of at least `least` rows in shuffled order, as features and 0/1 labels (1: not background); rows that don't fill another
    batch join the last one. A table of fewer rows is one batch."""
    rows = df.where(F.col(label) == "background") if background_only else df
    mark = F.coalesce(F.col(label) != "background", F.lit(True)).cast("byte").alias("__mark")  # a byte a row instead of a text
    held = None
    for batch in batches(rows.select(*columns, mark), [*columns, "__mark"], least, seed):
        if held is not None and len(batch) == least:
            yield held[columns], held["__mark"].astype("uint8")
            held = None
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
    if held is not None:
        yield held[columns], held["__mark"].astype("uint8")


def batches(df: DataFrame, columns: list[str], size: int = 300, seed: int | None = None) -> Iterator[pd.DataFrame]:
    """Bounded batches on the driver for a trainer; with a seed in shuffled order. One partition is held at a time.

    Rows come in compressed columns, some PACKED at once.
    """
    rows = df.select(*columns)
    if seed is not None:
        rows = rows.orderBy(F.rand(seed))

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, PACKED):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part.slice(at, PACKED))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["packed"])

    held: list[pa.Table] = []
    for row in rows.mapInArrow(pack, "packed binary").toLocalIterator():
        held.append(pa.ipc.open_stream(row.packed).read_all())
        if sum(x.num_rows for x in held) >= size:
            found = pa.concat_tables(held).combine_chunks()
            whole = found.num_rows // size * size
            frame = found.slice(0, whole).to_pandas()
            for at in range(0, whole, size):
                yield frame.iloc[at : at + size].reset_index(drop=True)
            held = [found.slice(whole)]
    if sum(x.num_rows for x in held):
        yield pa.concat_tables(held).to_pandas()
