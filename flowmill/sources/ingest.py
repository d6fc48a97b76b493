"""Normalising broker messages to typed flow rows, and schemas generated from a flow definition."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Definition types, with unsigned numbers one step wider, and the value of an unset field.
TYPES: dict[str, tuple[str, object]] = {
    "uint8": ("short", 0), "uint16": ("int", 0), "uint32": ("long", 0), "uint64": ("long", 0), "int": ("long", 0), "ipv4": ("string", "0.0.0.0"),
    "ipv6": ("string", "::"), "str": ("string", ""),
}
# NetFlow v9 field ids whose values are hexadecimal counters, and those that are uptimes.
HEX_FIELDS, UPTIME_FIELDS = (1, 2, 6, 89), (21, 22)


def camel_case(name: str) -> str:
    """IN_BYTES -> inBytes."""
    head, *rest = name.lower().split("_")
    return head + "".join(x.capitalize() for x in rest)


def snake_case(name: str) -> str:
    """inBytes -> IN_BYTES; the opposite of camel_case where a part doesn't begin with a digit."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).upper()


def flow_schema(definition: list[dict]) -> T.StructType:
    """Fields {id, name, type} as a struct, with flow_id in front."""
    return T.StructType.fromDDL(", ".join(["flow_id string", *[f"{f['name']} {TYPES[f['type']][0]}" for f in definition]]))


def table_ddl(definition: list[dict], name: str) -> str:
    """CREATE TABLE for the same fields, in camel case."""
    fields = ", ".join(["id STRING", *[f"{camel_case(f['name'])} {TYPES[f['type']][0].upper()}" for f in definition]])
    return f"CREATE TABLE {name} ({fields}) USING parquet"


def deployment_ddl(definition: list[dict], retention: str = "1 HOUR") -> list[str]:
    """Statements for what a deployment stores: flows by the hour they were stored in, detections, and the view that joins the
    detections with the flows of the last `retention`."""
    fields = ", ".join(["id STRING", *[f"{camel_case(f['name'])} {TYPES[f['type']][0].upper()}" for f in definition]])
    shown = [camel_case(n) for n in ("IPV4_SRC_ADDR", "IPV4_DST_ADDR", "PROTOCOL") if n in {f["name"] for f in definition}]
    return [
        f"CREATE TABLE IF NOT EXISTS flows ({fields}, stored_at TIMESTAMP, stored_hour STRING) USING parquet PARTITIONED BY (stored_hour)",
        "CREATE TABLE IF NOT EXISTS detections (flow_id STRING, detector STRING, event_name STRING, metric FLOAT, event_time TIMESTAMP) USING parquet",
        "CREATE OR REPLACE VIEW detections_flows AS SELECT f.id AS flow_id, " + "".join(f"f.{c}, " for c in shown) + "d.event_name, d.detector, d.metric, d.event_time "
        f"FROM detections d JOIN flows f ON f.id = d.flow_id WHERE f.stored_at > current_timestamp() - INTERVAL {retention}",
    ]


def store_flows(flows: DataFrame, table: str = "flows") -> None:
    """Append flows to the stored table, with the time they are stored at."""
    now = F.current_timestamp()
    flows.select("*", now.alias("stored_at"), F.date_format(now, "yyyy-MM-dd-HH").alias("stored_hour")).write.mode("append").insertInto(table)


def expire_flows(spark: SparkSession, hours: int = 1, table: str = "flows") -> list[str]:
    """Drop the stored hours that ended more than `hours` ago: whole partitions, without a rewrite. Returns them."""
    last = spark.range(1).select(F.date_format(F.current_timestamp() - F.make_interval(hours=F.lit(hours + 1)), "yyyy-MM-dd-HH")).first()[0]
    old = sorted(h for (p,) in spark.sql(f"SHOW PARTITIONS {table}").collect() if (h := p.partition("=")[2]) < last)
    for hour in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (stored_hour = '{hour}')")
    return old


def schema_json(definition: list[dict]) -> str:
    return flow_schema(definition).json()


@F.pandas_udf(T.StringType())
def inflate(messages: pd.Series) -> pd.Series:
    """Text of messages; a leading zero byte says that the rest is zlib data. Undecodable messages become null."""
    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else (zlib.decompress(raw[1:]) if raw[:1] == b"\0" else raw).decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None

    return messages.map(one)


@F.pandas_udf(T.BinaryType())
def deflate(messages: pd.Series) -> pd.Series:
    """Text as a message that inflate reads: a zero byte, then zlib data."""
    return messages.map(lambda text: None if text is None else b"\0" + zlib.compress(text.encode()))


def _typed(value: Column, kind: str) -> Column:
    spark_type, default = TYPES[kind]
    return F.coalesce(value if spark_type == "string" else value.try_cast(spark_type), F.lit(default).cast(spark_type))


def explode_ipfix(messages: DataFrame, definition: list[dict], column: str = "message", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON arrays of {field id: value} to one typed row per element; unknown ids are dropped, missing ones get defaults."""
    rows = messages.select(*keep, F.explode(F.from_json(column, "array<map<string,string>>")).alias("m"))
    return rows.select(*keep, F.expr("uuid()").alias("flow_id"), *[_typed(F.col("m")[str(f["id"])], f["type"]).alias(f["name"]) for f in definition])


def explode_netflow9(messages: DataFrame, definition: list[dict], column: str = "message") -> DataFrame:
    """{Header, DataSets: [[{I, V}]]} to one row per data set. NUL characters are removed; uptimes become epoch seconds."""
    schema = "Header struct<UNIXSecs:long,SysUpTime:long>, DataSets array<array<struct<I:int,V:string>>>"
    rows = messages.select(F.from_json(F.translate(column, "\0", ""), schema).alias("x")).select("x.Header", F.explode("x.DataSets").alias("d"))
    fields = F.map_from_entries(F.transform("d", lambda p: F.struct(p["I"], p["V"])))

    def value(f: dict) -> Column:
        raw = F.col("m")[f["id"]]
        if f["id"] in HEX_FIELDS:
            raw = F.conv(F.regexp_replace(raw, "^0x", ""), 16, 10)
        elif f["id"] in UPTIME_FIELDS:
            raw = (F.col("Header.UNIXSecs") - F.col("Header.SysUpTime") / 1000 + raw.try_cast("double") / 1000).cast("long").cast("string")
        return _typed(raw, f["type"]).alias(f["name"])

    return rows.withColumn("m", fields).select(F.expr("uuid()").alias("flow_id"), *[value(f) for f in definition])


def model_columns(flows: DataFrame, definition: list[dict]) -> DataFrame:
    """Stored flows (camel case) as the detector reads them: upper-case names, empty label, deny flags false."""
    return flows.select(
        F.col("id").alias("FLOW_ID"), *[F.col(camel_case(f["name"])).alias(f["name"]) for f in definition],
        F.lit("").alias("Label"), F.lit(False).alias("SRC_DENY"), F.lit(False).alias("DST_DENY"),
    )


def detections_json(detections: DataFrame) -> DataFrame:
    """The message a detector publishes."""
    return detections.select(F.to_json(F.struct("flow_id", "detector", "event_name", F.col("metric").cast("float").alias("metric"))).alias("value"))
