"""Queries of ingest and streaming: messages made from the tables, run to the end of what is there, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions import scalars
from flowmill.plans.flows import SPARK, EVENTS, events_as_flows, flows_cte
from flowmill.plans import queries as plain
from flowmill.session import share_code, shared_dir, table
from flowmill.sources import files, ingest, pcap
from flowmill.streaming import pipelines

QUERIES: dict = {}
SQL: dict[str, str] = {}

DEFINITION = [
    {"id": 1, "name": "IN_BYTES", "type": "uint32"}, {"id": 4, "name": "PROTOCOL", "type": "uint8"}, {"id": 7, "name": "L4_SRC_PORT", "type": "uint16"},
    {"id": 8, "name": "IPV4_SRC_ADDR", "type": "ipv4"}, {"id": 27, "name": "IPV6_SRC_ADDR", "type": "ipv6"}, {"id": 9, "name": "FLOW_ID_SEEN", "type": "uint64"},
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {flows_cte("flow_id", "ip_src", "protocol", "port_src", "in_bytes")} SELECT flow_id AS "FLOW_ID_SEEN", in_bytes AS "IN_BYTES", CAST(protocol AS SMALLINT) AS "PROTOCOL",
    CASE WHEN flow_id % 5 = 0 THEN 0 ELSE port_src END AS "L4_SRC_PORT", ip_src AS "IPV4_SRC_ADDR", '::' AS "IPV6_SRC_ADDR" FROM flows""")
def ipfix_json_explode(spark, sf_dir):
    """ING1, ING2: zlib-packed JSON arrays of field maps; a missing field gets its default, an unknown one is dropped."""
    share_code(spark)
    rows = events_as_flows(spark, sf_dir, "flow_id", "ip_src", "protocol", "port_src", "in_bytes")
    text = lambda c: F.col(c).cast("string")
    port = F.when(F.col("flow_id") % 5 != 0, F.create_map(F.lit("7"), text("port_src"))).otherwise(F.create_map().cast("map<string,string>"))
    one = F.map_concat(F.create_map(F.lit("1"), text("in_bytes"), F.lit("4"), text("protocol"), F.lit("8"), F.col("ip_src"), F.lit("9"), text("flow_id"), F.lit("999"), F.lit("unknown")), port)
    messages = rows.groupBy((F.col("flow_id") % 50).alias("m")).agg(F.to_json(F.collect_list(one)).alias("text"))
    packed = messages.select(ingest.inflate(ingest.deflate("text")).alias("message"))
    return ingest.explode_ipfix(packed, DEFINITION).drop("flow_id")


@query("SELECT user_id AS \"IN_BYTES\", CAST(6 AS SMALLINT) AS \"PROTOCOL\", CAST(1704067200 - 100 + event_id % 1000 AS BIGINT) AS \"FIRST_SWITCHED\" FROM events")
def netflow9_explode(spark, sf_dir):
    """ING3: hexadecimal counters and uptimes."""
    definition = [{"id": 1, "name": "IN_BYTES", "type": "uint32"}, {"id": 4, "name": "PROTOCOL", "type": "uint8"}, {"id": 22, "name": "FIRST_SWITCHED", "type": "uint64"}]
    field = lambda i, v: F.struct(F.lit(i).alias("I"), v.alias("V"))
    header = F.struct(F.lit(1704067200).cast("long").alias("UNIXSecs"), F.lit(100_000).cast("long").alias("SysUpTime"))
    data = F.array(F.array(field(1, F.concat(F.lit("0x"), F.hex("user_id"))), field(4, F.lit("6")), field(22, (F.col("event_id") % 1000 * 1000).cast("string")), field(77, F.lit("x"))))
    messages = table(spark, sf_dir, "events").select(F.concat(F.to_json(F.struct(header.alias("Header"), data.alias("DataSets"))), F.lit("\0")).alias("message"))
    return ingest.explode_netflow9(messages, definition).drop("flow_id")


@query(f"""WITH {flows_cte("ip_src", "ip_dst", "port_src", "port_dst", "protocol", "start_ms", "label")} SELECT label, round(start_ms / 1000.0, 3) AS timestamp, ip_src AS src_ip, ip_dst AS dst_ip, CASE WHEN protocol IN (6, 17, 132) THEN port_src END AS src_port,
    CASE WHEN protocol IN (6, 17, 132) THEN port_dst END AS dst_port, protocol AS proto FROM flows""")
def pcap_round_trip(spark, sf_dir):
    """SRC14, SNK12: a packet for each flow, written to captures by label and read back.

    Sources are 10.0.(user div 256).(user mod 256), whose third part exceeds 255 from user 65,536 on. A packet holds the number it stands for,
    10.0.0.0 + user, and what is read is spelled as the flows spell it.
    """
    share_code(spark)
    folder = _folder(spark, "captures")
    rows = events_as_flows(spark, sf_dir, "ip_src", "ip_dst", "port_src", "port_dst", "protocol", "start_ms", "label")
    made = rows.select((F.col("start_ms") / 1000.0).alias("timestamp"), pcap.header_packet(*[scalars.ipv4_text(scalars.ipv4_number(F.col(c))) for c in ("ip_src", "ip_dst")], "port_src", "port_dst", "protocol").alias("packet"), "label")
    pcap.write_pcap(made, folder, "label")
    user = lambda c: scalars.ipv4_number(F.col(c)) - (10 << 24)
    spelt = lambda c: F.concat_ws(".", F.lit("10.0"), F.shiftright(user(c), 8).cast("string"), (user(c) % 256).cast("string")).alias(c)
    return pcap.read_pcap(spark, folder).select(
        F.regexp_extract("file", "label=([a-z]+)/", 1).alias("label"), scalars.rounded("timestamp", 3).alias("timestamp"), spelt("src_ip"), spelt("dst_ip"), "src_port", "dst_port", "proto"
    )


@query(f"""WITH {flows_cte("flow_id", "in_bytes")} SELECT CAST(make_date(2024, 1, 1 + CAST(flow_id % 3 AS INT)) AS VARCHAR) AS date, CAST(flow_id % 4 AS INT) AS hour, count(*) AS n, CAST(sum(in_bytes) AS BIGINT) AS in_bytes FROM flows GROUP BY 1, 2""")
def path_hours(spark, sf_dir):
    """SRC8, SNK7: flows written to a folder for each hour, and read back with the date and hour of their path."""
    folder = _folder(spark, "hours")
    rows = events_as_flows(spark, sf_dir, "flow_id", "in_bytes")
    for day in range(3):
        for hour in range(4):
            files.save(rows.where((F.col("flow_id") % 3 == day) & (F.col("flow_id") % 4 == hour)).coalesce(1), f"{folder}/2024/01/0{day + 1}/0{hour}", "gz")
    found = files.with_path_hour(spark.read.option("recursiveFileLookup", "true").option("sep", "|").option("header", True).schema("flow_id long, in_bytes long").csv(folder))
    return found.groupBy(F.col("date").cast("string").alias("date"), "hour").agg(F.count("*").alias("n"), F.sum("in_bytes").alias("in_bytes"))


def _event_stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """`events` as a stream of flows: the table's folder is watched for the one file."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(*[F.expr(EVENTS[c].format(**SPARK)).alias(c) for c in columns])


@query(f"WITH {flows_cte('time', 'protocol', 'in_bytes')} SELECT CAST(floor(epoch(time) / 3600) * 3600 AS BIGINT) AS time, protocol, count(*) AS n, CAST(sum(in_bytes) AS BIGINT) AS in_bytes FROM flows GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """ST1, ST4, ST6: a windowed aggregation over the stream, run over all that is there."""
    flows = _event_stream(spark, sf_dir, "time", "protocol", "in_bytes").withColumn("time", F.col("time").cast("timestamp"))
    out = pipelines.run_available(spark, pipelines.tumbling_counts(flows, "time", 3600), _folder(spark, "tumbling"), "complete")
    return out.withColumn("time", F.unix_seconds("time"))


@query(f"""WITH {flows_cte('flow_id', 'time', 'ip_src', 'ip_dst', 'protocol', 'label')} SELECT flow_id, ip_src, ip_dst, protocol, CAST(floor(epoch(time)) AS BIGINT) + 1 AS event_time FROM flows WHERE label = 'attack'""")
def stream_mv_join(spark, sf_dir):
    """ST6, ST7, J1, SRC5: the detections stream joined with the flows stream, state bounded by the retention."""
    columns = ("flow_id", "time", "ip_src", "ip_dst", "protocol", "label")
    flows = _event_stream(spark, sf_dir, *columns).withColumn("time", F.col("time").cast("timestamp"))
    detections = _event_stream(spark, sf_dir, *columns).where("label = 'attack'").select(
        "flow_id", F.lit("scan").alias("event_name"), F.lit("ai").alias("detector"), F.lit(0.9).alias("metric"), (F.col("time").cast("timestamp") + F.expr("interval 1 second")).alias("event_time")
    )
    out = pipelines.run_available(spark, pipelines.detections_with_flows(detections, flows), _folder(spark, "join"))
    return out.select("flow_id", "ip_src", "ip_dst", "protocol", F.unix_seconds("event_time").alias("event_time"))


_DAY = 86_400_000
_T0 = 1_704_067_200_000


@query(f"""WITH {flows_cte('ip_src', 'end_ms', 'in_bytes')}, w AS (SELECT ip_src, CAST(greatest(0, ceil((end_ms - {_T0}) / {_DAY}.0) - 1) AS BIGINT) AS window_id, count(*) AS flows, CAST(sum(in_bytes) AS BIGINT) AS bytes FROM flows GROUP BY 1, 2),
    o AS (SELECT * FROM w QUALIFY window_id < max(window_id) OVER (PARTITION BY ip_src)),
    p AS (SELECT o.ip_src, o.window_id, c.flows, c.bytes, row_number() OVER (PARTITION BY o.ip_src, o.window_id ORDER BY c.window_id DESC) AS r FROM o JOIN w c ON c.ip_src = o.ip_src AND c.flows >= 2 AND c.window_id BETWEEN o.window_id - 20 AND o.window_id - 1),
    s AS (SELECT ip_src, window_id, count(*) AS closed, avg(flows) AS mf, avg(bytes) AS mb FROM p WHERE r <= 8 GROUP BY 1, 2)
    SELECT o.ip_src, o.window_id, o.flows, o.bytes, coalesce(closed, 0) AS closed, round(coalesce(mf, 0), 5) AS mean_flows, round(coalesce(mb, 0), 4) AS mean_bytes FROM o LEFT JOIN s USING (ip_src, window_id)""")
def stream_windower(spark, sf_dir):
    """ST3, ST5, ST9: per-source windows with a history that is kept in state."""
    share_code(spark)
    flows = _event_stream(spark, sf_dir, "arrival_seq", "ip_src", "end_ms", "in_bytes")
    out = pipelines.run_available(spark, pipelines.stateful_windows(flows, _DAY, 2, 20, 8, _T0), _folder(spark, "windows"))
    return out.withColumn("mean_flows", scalars.rounded("mean_flows", 5)).withColumn("mean_bytes", scalars.rounded("mean_bytes", 4))


@query(plain.SQL["win_features_all"])
def stream_features(spark, sf_dir):
    """ST2, ST3: all 58 features of flows that come in four micro-batches, with the state kept between them."""
    folder = _folder(spark, "features")
    rows = plain.late_flows(spark, sf_dir)
    first, most = rows.agg(F.min("end_ms"), F.max("arrival_seq")).first()
    for i in range(4):  # one file after the other, in order of arrival
        rows.where(F.floor(F.col("arrival_seq") * 4 / F.lit(most + 1)) == i).coalesce(1).write.parquet(f"{folder}/in/{i}")
    flows = pipelines.read_stream(spark, f"{folder}/in/*", rows.schema)
    pipelines.start_each(flows, pipelines.feature_batches(folder, plain.SETTINGS, first), f"{folder}/checkpoint").awaitTermination()
    return plain.rounded_features(spark.read.parquet(f"{folder}/features").drop("batch"))
