"""Adapters that give the driver's star-schema and event tables the shape of flow records. Pure projections.

Each expression is written once, in the SQL that Spark and DuckDB share; DIV, MILLIS and JSON_K stand for the three spellings
that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.session import table

SPARK = {"DIV": "div", "MILLIS": "unix_millis(cast(ts as timestamp))", "JSON_K": "cast(get_json_object(props, '$.k') as int)"}
DUCKDB = {"DIV": "//", "MILLIS": "(epoch_us(ts) // 1000)", "JSON_K": "cast(json_extract_string(props, '$.k') as int)"}

#: Flow columns from `events`.
EVENTS = {
    "arrival_seq": "event_id",
    "flow_id": "event_id",
    "time": "ts",
    "end_ms": "{MILLIS}",
    "start_ms": "{MILLIS} - (event_id * 37) % 5000",
    "ip_src": "concat('10.0.', cast(user_id {DIV} 256 as string), '.', cast(user_id % 256 as string))",
    "ip_dst": "concat('10.0.0.', cast((event_id * 7919) % 97 as string))",
    "protocol": "case event_type when 'click' then 6 when 'view' then 17 when 'error' then 1 when 'signup' then 132 else 47 end",
    "port_src": "cast(49100 + {JSON_K} as int)",
    "port_dst": "case {JSON_K} % 10 when 0 then 80 when 1 then 443 when 2 then 53 when 3 then 22 when 4 then 25 when 5 then 123 when 6 then 3389 when 7 then 50000 when 8 then 8080 else 0 end",
    "flags": "cast(({JSON_K} * 5) % 256 as int)",
    "ttl": "cast(32 + ({JSON_K} % 3) * 32 as int)",
    "in_bytes": "cast(floor(value * 100 + 0.5) as bigint)",
    "in_pkts": "cast(1 + {JSON_K} % 10 as bigint)",
    "out_bytes": "case when {JSON_K} % 3 = 0 then cast(0 as bigint) else cast(floor(value * 50) as bigint) end",
    "out_pkts": "cast({JSON_K} % 4 as bigint)",
    "duration_in": "cast((event_id * 37) % 5000 as bigint)",
    "duration_out": "case when {JSON_K} % 4 = 0 then cast(0 as bigint) else cast((event_id * 53) % 3000 as bigint) end",
    "icmp_type": "cast(({JSON_K} % 13) * 256 + {JSON_K} % 3 as int)",
    "label": "case when event_type = 'error' then 'attack' else 'background' end",
}


def spelled(dialect: dict[str, str]) -> dict[str, str]:
    return {name: text.format(**dialect) for name, text in EVENTS.items()}


def events_as_flows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`events` as flows; with column names only those are read."""
    exprs = spelled(SPARK)
    return table(spark, sf_dir, "events").select(*[F.expr(exprs[c]).alias(c) for c in columns or exprs])


def flows_cte(*columns: str) -> str:
    """The same projection as a DuckDB common table expression named flows."""
    exprs = {k: v.replace(" as string)", " as varchar)") for k, v in spelled(DUCKDB).items()}
    return "flows AS (SELECT " + ", ".join(f"{exprs[c]} AS {c}" for c in columns or exprs) + " FROM events)"
