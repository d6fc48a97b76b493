"""Session factory and small helpers every other module may use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution re-plans joins and splits skewed partitions; results are compared in UTC.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "flowmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword arguments use `_` for `.` in setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


_shipped: set[str] = set()


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package: from its folder in local mode, else from an archive that Spark sends to them."""
    package, context = Path(__file__).resolve().parent, spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        env = context.environment
        if str(package.parent) not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (str(package.parent), env.get("PYTHONPATH", "")) if x)
    elif context.applicationId not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="flowmill-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))  # the driver's file server hands it out
        _shipped.add(context.applicationId)


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="flowmill-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back: all uses see the same rows, also after an executor is lost. Deleted when the
    driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowmill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, each: int = 3) -> DataFrame:
    """The same rows dealt evenly over a few tasks for each core: a file may be one row group, which one task reads."""
    return rows.repartition(each * rows.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; the scan stays lazy, so filters and columns reach it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
