"""One named query per operator over the driver's tables, with the SQL that DuckDB answers the same with.

Floats are rounded on both sides; times are epoch seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions import ports, scalars
from flowmill.operators import aggregates, joins, preprocess, profiles, sampling, scaling, windower
from flowmill.plans import dashboards
from flowmill.plans.flows import events_as_flows, flows_cte
from flowmill.session import share_code, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _flows(*columns: str) -> str:
    return "WITH " + flows_cte(*columns)


def _seconds(df: DataFrame, name: str = "time") -> DataFrame:
    return df.withColumn(name, F.unix_seconds(F.col(name).cast("timestamp")))


def _round(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.withColumns({f.name: scalars.rounded(f.name, digits) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def _rounded(columns, digits: int = 5) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# --- dashboards -----------------------------------------------------------------------------------------------------

DETECTIONS = "detections AS (SELECT *, CASE WHEN flow_id % 2 = 0 THEN 'ai' ELSE 'filter' END AS detector, CASE WHEN flow_id % 3 = 0 THEN 'scan' ELSE 'dos' END AS event_name FROM flows WHERE label = 'attack')"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_as_flows(spark, sf_dir, "flow_id", "time", "ip_src", "ip_dst", "protocol", "label").where("label = 'attack'")
    return rows.withColumn("detector", F.when(F.col("flow_id") % 2 == 0, "ai").otherwise("filter")).withColumn("event_name", F.when(F.col("flow_id") % 3 == 0, "scan").otherwise("dos"))


@query("""WITH s AS (SELECT date_trunc('day', ts) AS t, user_id, sum(value) AS volume FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY volume DESC, user_id) AS r FROM s)
    SELECT CAST(epoch(t) AS BIGINT) AS time, user_id, round(volume, 4) AS volume FROM r WHERE r <= 10""")
def topn_per_interval(spark, sf_dir):
    """The ten users with the greatest value of each day."""
    out = dashboards.top_per_interval(table(spark, sf_dir, "events"), "ts", 86400, "user_id", "value", 10)
    return _round(_seconds(out), 4)


@query(_flows() + f", {DETECTIONS} SELECT count(*) AS detections FROM detections WHERE time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-20'")
def detections_total(spark, sf_dir):
    """D1."""
    return dashboards.detections_total(dashboards.between(_detections(spark, sf_dir), "time", "2024-01-10", "2024-01-20"))


@query(_flows() + f", {DETECTIONS} SELECT CAST(floor(epoch(time) / 3600) * 3600 AS BIGINT) AS time, count(*) AS n FROM detections GROUP BY 1 ORDER BY 1 LIMIT 100")
def detections_per_interval(spark, sf_dir):
    """D2, O3."""
    return _seconds(dashboards.per_interval(_detections(spark, sf_dir), "time", 3600, limit=100))


@query(_flows() + f", {DETECTIONS} SELECT ip_src, count(*) AS n FROM detections GROUP BY 1 ORDER BY n DESC, ip_src LIMIT 100")
def top_sources(spark, sf_dir):
    """D3."""
    return dashboards.top(_detections(spark, sf_dir), "ip_src")


@query(_flows() + f", {DETECTIONS} SELECT ip_dst, count(*) AS n FROM detections GROUP BY 1 ORDER BY n DESC, ip_dst LIMIT 100")
def top_destinations(spark, sf_dir):
    """D7."""
    return dashboards.top(_detections(spark, sf_dir), "ip_dst")


@query(_flows() + f", {DETECTIONS} SELECT event_name, count(*) AS n FROM detections GROUP BY 1")
def count_by_event(spark, sf_dir):
    """D4, A28."""
    return dashboards.count_by(_detections(spark, sf_dir), "event_name")


@query(_flows() + f", {DETECTIONS} SELECT detector, count(*) AS n FROM detections GROUP BY 1")
def count_by_detector(spark, sf_dir):
    """D5."""
    return dashboards.count_by(_detections(spark, sf_dir), "detector")


@query(_flows() + f", {DETECTIONS} SELECT CAST(protocol AS VARCHAR) AS protocol, count(*) AS n FROM detections GROUP BY 1")
def count_by_protocol(spark, sf_dir):
    """D6."""
    return dashboards.count_by(_detections(spark, sf_dir).withColumn("protocol", F.col("protocol").cast("string")), "protocol")


@query(_flows("time", "protocol") + " SELECT CAST(floor(epoch(time) / 21600) * 21600 AS BIGINT) AS time, protocol, count(*) AS n FROM flows GROUP BY 1, 2")
def flows_per_interval_protocol(spark, sf_dir):
    """D8."""
    return _seconds(dashboards.per_interval(events_as_flows(spark, sf_dir, "time", "protocol"), "time", 21600, "protocol"))


@query(_flows("time", "ip_src") + " SELECT CAST(floor(epoch(time) / 60) * 60 AS BIGINT) AS time, round(count(*) / 60.0, 6) AS per_second FROM flows WHERE ip_src = '10.0.0.7' GROUP BY 1")
def flows_per_second(spark, sf_dir):
    """D10, FLT10: with an address filter and an empty one."""
    rows = dashboards.equals(events_as_flows(spark, sf_dir, "time", "ip_src", "ip_dst"), ip_src="10.0.0.7", ip_dst="")
    return _round(_seconds(dashboards.rate_per_minute(rows, "time")), 6)


@query(_flows("time", "protocol", "in_pkts") + " SELECT CAST(floor(epoch(time) / 60) * 60 AS BIGINT) AS time, protocol, round(sum(in_pkts) / 60.0, 6) AS per_second FROM flows GROUP BY 1, 2")
def packets_per_second(spark, sf_dir):
    """D11."""
    return _round(_seconds(dashboards.rate_per_minute(events_as_flows(spark, sf_dir, "time", "protocol", "in_pkts"), "time", F.col("in_pkts"), "protocol")), 6)


def _bytes_panel(name: str, ids: str, wanted: tuple[int, ...], negate: bool = False) -> None:
    test = f"protocol {'NOT ' if negate else ''}IN ({', '.join(map(str, wanted))})"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events_as_flows(spark, sf_dir, "time", "protocol", "in_bytes")
        return _round(_seconds(dashboards.bytes_per_second(rows, "time", "in_bytes", wanted, negate)), 4)

    run.__name__, run.__doc__ = name, ids
    query(_flows("time", "protocol", "in_bytes") + f" SELECT CAST(floor(epoch(time) / 60) * 60 AS BIGINT) AS time, round(sum(in_bytes) / 60.0, 4) AS per_second FROM flows WHERE {test} GROUP BY 1")(run)


_bytes_panel("tcp_bytes_per_second", "D12.", (6,))
_bytes_panel("udp_bytes_per_second", "D13.", (17,))
_bytes_panel("other_bytes_per_second", "D14.", (6, 17), True)


@query(_flows() + f""", {DETECTIONS} SELECT d.flow_id, d.event_name, d.detector, f.ip_src, f.ip_dst, f.protocol
    FROM detections d JOIN flows f ON d.flow_id = f.flow_id""")
def detections_with_flows(spark, sf_dir):
    """J1."""
    d = _detections(spark, sf_dir).select("flow_id", "event_name", "detector")
    return d.join(events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst", "protocol"), "flow_id")


# --- scalar functions -----------------------------------------------------------------------------------------------


def _bits(column: str, prefix: str = "") -> str:
    stem = f"{prefix}_" if prefix else ""
    return ", ".join(f"CAST(({column} >> {i}) & 1 AS TINYINT) AS {stem}{n}" for i, n in enumerate(ports.TCP_FLAGS))


@query(_flows("flow_id", "flags") + f" SELECT flow_id, {_bits('flags')}, {_bits('flags', 'CLIENT')}, (flags & 2) <> 0 AS has_syn, (flags & 16) <> 0 AS has_ack, (flags & 1) <> 0 AS has_fin FROM flows")
def tcp_flags(spark, sf_dir):
    """F9, F10."""
    c = F.col("flags")
    return events_as_flows(spark, sf_dir, "flow_id", "flags").select(
        "flow_id", *ports.flag_bits(c), *ports.flag_bits(c, "CLIENT"), ports.flag_set(c, 2).alias("has_syn"), ports.flag_set(c, 16).alias("has_ack"), ports.flag_set(c, 1).alias("has_fin")
    )


def _category_sql(column: str, names: dict | None = None) -> str:
    cases = " ".join(f"WHEN {column} IN ({', '.join(map(str, p))}) THEN {names[n] if names else repr(n)}" for n, p in ports.PORT_CATEGORIES.items())
    dynamic, other = (ports.CATEGORY_IDS["dynamic"], ports.CATEGORY_IDS["other"]) if names else ("'DYNAMIC'", "'OTHER'")
    return f"CASE {cases} WHEN {column} >= 49152 THEN {dynamic} ELSE {other} END"


_ID_BY_NAME = dict(zip(ports.PORT_CATEGORIES, range(len(ports.PORT_CATEGORIES))))


@query(_flows("flow_id", "port_src", "port_dst") + f" SELECT flow_id, {_category_sql('port_src')} AS src_category, {_category_sql('port_dst')} AS dst_category, {_category_sql('port_dst', _ID_BY_NAME)} AS dst_id FROM flows")
def port_category(spark, sf_dir):
    """F11, F12."""
    return events_as_flows(spark, sf_dir, "flow_id", "port_src", "port_dst").select(
        "flow_id", ports.port_category(F.col("port_src")).alias("src_category"), ports.port_category(F.col("port_dst")).alias("dst_category"),
        ports.port_category_id(F.col("port_dst")).alias("dst_id"),
    )


def _case(column: str, names: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'OTHER' END"


def _hot(column: str, values: tuple[str, ...], alias: str) -> str:
    return ", ".join(f"CAST({column} = '{v}' AS TINYINT) AS {alias}_{v}" for v in values)


@query(_flows("flow_id", "protocol", "port_src", "port_dst", "icmp_type") + f""", n AS (SELECT flow_id, {_case('protocol', ports.PROTOCOLS)} AS p, {_category_sql('port_src')} AS s,
    {_category_sql('port_dst')} AS d, {_case('icmp_type // 256', ports.ICMP_TYPES)} AS i FROM flows)
    SELECT flow_id, {_hot('p', ports.PROTOCOL_VALUES, 'PROTOCOL')}, {_hot('s', ports.PORT_VALUES, 'L4_SRC_PORT')}, {_hot('d', ports.PORT_VALUES, 'L4_DST_PORT')},
    {_hot('i', tuple(v for v in ports.ICMP_VALUES if v != 'ECHO_REPLY'), 'ICMP_TYPE')}, CAST(p = 'ICMP' AND i = 'ECHO_REPLY' AS TINYINT) AS ICMP_TYPE_ECHO_REPLY FROM n""")
def one_hot(spark, sf_dir):
    """38 columns; an echo reply counts only for ICMP."""
    rows = events_as_flows(spark, sf_dir, "flow_id", "protocol", "port_src", "port_dst", "icmp_type")
    p = ports.protocol_name(F.col("protocol"))
    named = rows.select("flow_id", p.alias("p"), ports.port_category(F.col("port_src")).alias("s"), ports.port_category(F.col("port_dst")).alias("d"), ports.icmp_type_name(F.col("icmp_type")).alias("i"))
    out = named.select(
        "flow_id", "p", *ports.one_hot(F.col("p"), "PROTOCOL", ports.PROTOCOL_VALUES), *ports.one_hot(F.col("s"), "L4_SRC_PORT", ports.PORT_VALUES),
        *ports.one_hot(F.col("d"), "L4_DST_PORT", ports.PORT_VALUES), *ports.one_hot(F.col("i"), "ICMP_TYPE", ports.ICMP_VALUES),
    )
    return out.withColumn("ICMP_TYPE_ECHO_REPLY", F.when(F.col("p") == "ICMP", F.col("ICMP_TYPE_ECHO_REPLY")).otherwise(F.lit(0).cast("byte"))).drop("p")


def _per(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / {b} WHEN {a} = 0 THEN 0.0 ELSE CAST('Infinity' AS DOUBLE) END"


def _side(ms: str) -> str:
    return f"(CASE WHEN {ms} > 0 THEN {ms} / 1000.0 ELSE 0.001 END)"


@query(_flows("flow_id", "in_bytes", "in_pkts", "out_bytes", "out_pkts", "duration_in", "duration_out") + ", r AS (SELECT flow_id, " + ", ".join(
    f"{_per(f'{x}_bytes', _side(f'duration_{x}'))} AS {x.upper()}_BPS, {_per(f'{x}_bytes', f'{x}_pkts')} AS {x.upper()}_BPP, {_per(f'{x}_pkts', _side(f'duration_{x}'))} AS {x.upper()}_PPS" for x in ("in", "out"))
    + f" FROM flows) SELECT flow_id, {_rounded([f'{s}_{x}' for s in ('IN', 'OUT') for x in ('BPS', 'BPP', 'PPS')])} FROM r")
def ratios(spark, sf_dir):
    """rates of both directions; 0/0 is 0, x/0 infinite."""
    names = ["in_bytes", "in_pkts", "out_bytes", "out_pkts", "duration_in", "duration_out"]
    rows = events_as_flows(spark, sf_dir, "flow_id", *names).withColumnsRenamed({n: n.upper() for n in names})
    return _round(rows.select("flow_id", *scalars.rates("IN"), *scalars.rates("OUT")))


_PRE = ["flow_id", "ip_src", "ip_dst", "protocol", "port_src", "port_dst", "icmp_type", "flags", "in_bytes", "in_pkts", "out_bytes", "out_pkts", "duration_in", "duration_out", "ttl", "label"]


@query(_flows(*_PRE) + f""" SELECT flow_id AS "Label", ip_src AS "IP_SRC", ip_dst AS "IP_DST", in_bytes AS "IN_BYTES", 0 AS "MAX_TTL", round({_per('in_bytes', _side('duration_in'))}, 5) AS "IN_BPS", round({_per('out_bytes', 'out_pkts')}, 5) AS "OUT_BPP",
    {', '.join(f'CAST((flags >> {i}) & 1 AS TINYINT) AS "CLIENT_{n}"' for i, n in enumerate(ports.TCP_FLAGS))}, CAST(protocol = 1 AS TINYINT) AS "PROTOCOL_ICMP", CAST(port_dst IN (80, 8080) AS TINYINT) AS "L4_DST_PORT_WEB_NOENC",
    CAST(protocol = 1 AND icmp_type // 256 = 0 AS TINYINT) AS "ICMP_TYPE_ECHO_REPLY", CAST(icmp_type // 256 = 8 AS TINYINT) AS "ICMP_TYPE_ECHO_REQUEST", 115 AS n_columns FROM flows""")
def preprocess_features(spark, sf_dir):
    """F1 to F16: the whole projection to 110 features (a choice of columns is compared)."""
    names = {"ip_src": "IPV4_SRC_ADDR", "ip_dst": "IPV4_DST_ADDR", "protocol": "PROTOCOL", "port_src": "L4_SRC_PORT", "port_dst": "L4_DST_PORT", "icmp_type": "ICMP_TYPE", "flags": "CLIENT_TCP_FLAGS",
             "in_bytes": "IN_BYTES", "in_pkts": "IN_PKTS", "out_bytes": "OUT_BYTES", "out_pkts": "OUT_PKTS", "duration_in": "DURATION_IN", "duration_out": "DURATION_OUT", "ttl": "MIN_TTL", "flow_id": "Label"}
    raw = events_as_flows(spark, sf_dir, *_PRE).drop("label").withColumnsRenamed(names).withColumn("IPV6_SRC_ADDR", F.lit("::")).withColumn("IPV6_DST_ADDR", F.lit("::"))
    out = preprocess.features(raw.withColumn("SRC_DENY", F.lit(False)).withColumn("DST_DENY", F.lit(False)))
    flags = [f"CLIENT_{n}" for n in ports.TCP_FLAGS]
    return _round(out.select("Label", "IP_SRC", "IP_DST", "IN_BYTES", "MAX_TTL", "IN_BPS", "OUT_BPP", *flags, "PROTOCOL_ICMP", "L4_DST_PORT_WEB_NOENC", "ICMP_TYPE_ECHO_REPLY", "ICMP_TYPE_ECHO_REQUEST", F.lit(len(out.columns)).alias("n_columns")))


_SWAP = ["in_bytes", "out_bytes", "in_pkts", "out_pkts"]


@query(_flows("flow_id", *_SWAP, "flags") + " SELECT flow_id, in_bytes AS OUT_BYTES, out_bytes AS IN_BYTES, in_pkts AS OUT_PKTS, out_pkts AS IN_PKTS, flags AS SERVER_TCP_FLAGS, 0 AS CLIENT_TCP_FLAGS FROM flows")
def swap_src_dst(spark, sf_dir):
    """F29."""
    rows = events_as_flows(spark, sf_dir, "flow_id", *_SWAP, "flags").withColumnsRenamed({c: c.upper() for c in _SWAP} | {"flags": "CLIENT_TCP_FLAGS"})
    return scalars.swap_sides(rows.withColumn("SERVER_TCP_FLAGS", F.lit(0)))


@query(_flows("flow_id", "start_ms", "end_ms", "in_bytes", "in_pkts", "protocol", "ip_src", "port_dst") + """, d AS (SELECT *, CASE WHEN end_ms = start_ms THEN 0.01 ELSE (end_ms - start_ms) / 1000.0 END AS s FROM flows)
    SELECT flow_id, round(s, 5) AS seconds, round(in_bytes / s, 5) AS bps, CASE protocol WHEN 6 THEN 1 WHEN 17 THEN 2 WHEN 1 THEN 4 ELSE 16 END AS bit,
    round(CASE WHEN in_bytes = 0 THEN CAST('Infinity' AS DOUBLE) ELSE (20 + CASE protocol WHEN 17 THEN 8 WHEN 1 THEN 8 ELSE 20 END) * in_pkts / in_bytes END, 5) AS hdr,
    CAST(dayofmonth(epoch_ms(start_ms)) AS INTEGER) AS day, CASE WHEN dayofweek(epoch_ms(start_ms)) IN (0, 6) THEN 'weekend' ELSE 'workday' END AS day_type,
    strftime(epoch_ms(CAST(end_ms - end_ms % 180000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS bucket FROM d""")
def flow_scalars(spark, sf_dir):
    """F2, F4, F8, F17, F19, F32, F33."""
    rows = events_as_flows(spark, sf_dir, "flow_id", "start_ms", "end_ms", "in_bytes", "in_pkts", "protocol", "ip_src")
    s = scalars.window_duration(F.col("start_ms"), F.col("end_ms"))
    return _round(rows.select(
        "flow_id", s.alias("seconds"), scalars.per(F.col("in_bytes"), s).alias("bps"), ports.protocol_bit(F.col("protocol")).alias("bit"),
        scalars.header_ratio(F.col("ip_src"), F.col("protocol"), F.col("in_pkts"), F.col("in_bytes")).alias("hdr"),
        scalars.day_of_month(F.col("start_ms")).alias("day"), scalars.day_type(F.timestamp_millis("start_ms")).alias("day_type"),
        scalars.time_bucket(F.floor(F.col("end_ms") / 1000), 180).alias("bucket"),
    ))


@query(f"SELECT n_nationkey, concat(trim(regexp_replace(concat('Friday morning ', n_name, ' - low aggresivity'), '{"|".join(scalars.LABEL_NOISE)}', '', 'g')), '_1') AS label FROM nation")
def clean_labels(spark, sf_dir):
    """F31."""
    raw = F.concat(F.lit("Friday morning "), "n_name", F.lit(" - low aggresivity"))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.clean_label(raw).alias("label"))


@query("SELECT event_id, round(epoch(ts), 3) AS seconds, epoch_us(ts) // 1000 AS ms, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS whole_ms, round((epoch_us(ts) // 1000) / 1000.0, 3) AS back, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS low_ms, CAST(ceil(epoch_us(ts) / 1000.0) AS BIGINT) AS high_ms FROM events")
def timestamp_strings(spark, sf_dir):
    """time text to epoch seconds, and to whole milliseconds either way; conversions of units."""
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    seconds = scalars.epoch_seconds(text)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.rounded(seconds, 3).alias("seconds"), scalars.micros_to_millis(micros).alias("ms"), scalars.seconds_to_millis(F.floor(seconds)).alias("whole_ms"), scalars.rounded(scalars.millis_to_seconds(scalars.micros_to_millis(micros)), 3).alias("back"), scalars.rounded(scalars.floor_millis(seconds) * 1000).cast("long").alias("low_ms"), scalars.rounded(scalars.ceil_millis(seconds) * 1000).cast("long").alias("high_ms")
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest((l_extendedprice - 2000.0) / 67999.0, 0.0), 1.0), 6) AS price, round(least(greatest(l_discount * 20 - 0.2, 0.0), 1.0), 6) AS discount FROM lineitem")
def clip01(spark, sf_dir):
    """F20, F26."""
    return _round(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", scalars.rescale(F.col("l_extendedprice"), 2000.0, 69999.0).alias("price"), scalars.clip01(F.col("l_discount") * 20 - 0.2).alias("discount")
    ), 6)


# --- scaling --------------------------------------------------------------------------------------------------------

MEASURED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_Q = {25: "q25", 50: "q50", 75: "q75", 90: "q90", 100: "q100"}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS feature, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max,
    {', '.join(f'round(quantile_cont(v, {p / 100}), 6) AS {n}' for p, n in _Q.items())} FROM (SELECT nullif({c}, 0) AS v FROM lineitem)""" for c in MEASURED))
def describe_nonzero(spark, sf_dir):
    """A26."""
    out = scaling.describe(table(spark, sf_dir, "lineitem"), MEASURED, nonzero=MEASURED)
    return _round(out.select("feature", "n", "mean", "std", "min", "max", *[F.col(f"`{scaling.percent_key(p)}`").alias(n) for p, n in _Q.items()]), 6)


_BY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"WITH b AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in MEASURED)} FROM lineitem) SELECT {_BY}, {', '.join(f'round(({c} - lo_{c}) / (hi_{c} - lo_{c}), 6) AS {c}' for c in MEASURED)} FROM lineitem, b")
def scale_minmax(spark, sf_dir):
    """A27, F25."""
    rows = table(spark, sf_dir, "lineitem").select(*_BY.split(", "), *MEASURED)
    return _round(scaling.apply_min_max(rows, scaling.min_max(rows, MEASURED)), 6)


@query(f"""WITH b AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, min(l_extendedprice) AS lo, quantile_cont(l_extendedprice, 0.9) AS q90, quantile_cont(l_tax, 0.5) AS q50,
    quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25) AS iqr, max(l_discount) AS hi FROM lineitem)
    SELECT {_BY}, round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_extendedprice - lo) / (q90 - lo), 6) AS l_extendedprice, round((l_tax - q50) / iqr, 6) AS l_tax, round(l_discount / hi, 6) AS l_discount FROM lineitem, b""")
def scalers(spark, sf_dir):
    """standard, minmax up to the 90th percentile, robust and absmax by a fitted config."""
    rows = table(spark, sf_dir, "lineitem").select(*_BY.split(", "), *MEASURED)
    config = scaling.to_config(scaling.describe(rows, MEASURED))
    for c, kind in (("l_quantity", "standard"), ("l_tax", "robust"), ("l_discount", "absmax")):
        config[c]["scaling_type"] = kind
    out = scaling.scale(rows, {c: config[c] for c in ("l_quantity", "l_tax", "l_discount")})
    return _round(scaling.scale(out, {"l_extendedprice": config["l_extendedprice"]}, top="90%"), 6)


@query(f"SELECT {_BY}, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 3) AS l_extendedprice FROM lineitem")
def unscale(spark, sf_dir):
    """Scaling and its opposite."""
    rows = table(spark, sf_dir, "lineitem").select(*_BY.split(", "), "l_quantity", "l_extendedprice")
    config = scaling.to_config(scaling.describe(rows, ["l_quantity", "l_extendedprice"]))
    return scaling.unscale(scaling.scale(rows, config), config).withColumn("l_quantity", scalars.rounded("l_quantity", 6)).withColumn("l_extendedprice", scalars.rounded("l_extendedprice", 3))


# --- grouped statistics ---------------------------------------------------------------------------------------------

_GEE = ["time", "ip_src", "ip_dst", "port_src", "port_dst", "protocol", "flags", "in_pkts", "in_bytes", "duration_in", "label"]


def _tumbling_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_as_flows(spark, sf_dir, *_GEE)
    return rows.select(
        F.unix_seconds(F.col("time").cast("timestamp")).alias("timestamp"), (F.col("duration_in") / 1000.0).alias("duration"), F.col("ip_src").alias("src_ip"), F.col("ip_dst").alias("dst_ip"),
        F.col("port_src").alias("src_port"), F.col("port_dst").alias("dst_port"), "protocol", "flags", F.col("in_pkts").alias("packet"), F.col("in_bytes").alias("num_of_bytes"), "label",
    )


_GEE_CTE = _flows(*_GEE) + """, g AS (SELECT strftime(make_timestamp((CAST(floor(epoch(time)) AS BIGINT) // 604800) * 604800 * 1000000), '%Y-%m-%d %H:%M:%S') AS time_window, ip_src AS src_ip,
    duration_in / 1000.0 AS duration, in_pkts AS packet, in_bytes AS num_of_bytes, CASE WHEN duration_in > 0 THEN in_pkts / (duration_in / 1000.0) END AS packet_rate,
    CASE WHEN duration_in > 0 THEN in_bytes / (duration_in / 1000.0) END AS byte_rate, protocol, ip_dst AS dst_ip, port_src AS src_port, port_dst AS dst_port, flags, label FROM flows)"""


def _entropy_cte(c: str) -> str:
    return f", e_{c} AS (SELECT time_window, src_ip, -sum(p * log2(p)) AS entropy_{c} FROM (SELECT time_window, src_ip, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY time_window, src_ip) AS p FROM g GROUP BY time_window, src_ip, {c}) GROUP BY 1, 2)"


_TUMBLING = [f"{k}_{m}" for k in ("mean", "std") for m in aggregates.MEASURES] + [f"entropy_{s}" for s in aggregates.SYMBOLS]
#: The shares in the order of the vector: sources' known ports and the rest, then destinations'.
_SHARES = {f"{side}_{p}": f"avg(CASE WHEN {side}_port {f'= {p}' if p != 'other' else 'NOT IN (' + ', '.join(map(str, aggregates.COMMON_PORTS)) + ')'} THEN 1.0 ELSE 0.0 END)" for side in ("src", "dst") for p in (*aggregates.COMMON_PORTS, "other")}
_TUMBLING_SQL = _GEE_CTE + "".join(_entropy_cte(c) for c in aggregates.SYMBOLS) + ", a AS (SELECT time_window, src_ip, " + ", ".join(f"coalesce(avg({m}), 0) AS mean_{m}, coalesce(stddev_samp({m}), 0) AS std_{m}" for m in aggregates.MEASURES) + ", " + ", ".join(
    f"{x} AS {n}" for n, x in _SHARES.items()
) + ", CASE WHEN sum(CASE WHEN label = 'background' THEN 1 ELSE 0 END) * 2 > count(*) THEN 'background' WHEN sum(CASE WHEN label = 'attack' THEN 1 ELSE 0 END) * 2 > count(*) THEN 'attack' END AS label FROM g GROUP BY 1, 2 HAVING count(*) >= 10), v AS (SELECT * FROM a " + " ".join(
    f"JOIN e_{c} USING (time_window, src_ip)" for c in aggregates.SYMBOLS
) + ")"


@query(_TUMBLING_SQL + f" SELECT time_window, src_ip, {_rounded(_TUMBLING, 4)}, {_rounded(_SHARES, 4)}, label FROM v")
def tumbling_features(spark, sf_dir):
    """A14 to A17, W6, F18, F19, FLT6: per week and source, all port shares."""
    out = aggregates.tumbling_features(_tumbling_input(spark, sf_dir), 604800)
    ports_of = [*aggregates.COMMON_PORTS, "other"]
    shares = [F.element_at(f"proportion_{side}_port", i + 1).alias(f"{side}_{p}") for side in ("src", "dst") for i, p in enumerate(ports_of)]
    return _round(out.select("time_window", "src_ip", *_TUMBLING, *shares, "label"), 4)


@query(_GEE_CTE.replace("604800", "180") + " SELECT time_window, src_ip, round(avg(packet), 5) AS mean_packet, round(avg(num_of_bytes), 5) AS mean_num_of_bytes, round(avg(CASE WHEN dst_port = 443 THEN 1.0 ELSE 0.0 END), 5) AS dst_443 FROM g GROUP BY 1, 2")
def tumbling_three_minutes(spark, sf_dir):
    """Windows of three minutes, however few flows they have."""
    out = aggregates.tumbling_features(_tumbling_input(spark, sf_dir), 180, least=1)
    return _round(out.select("time_window", "src_ip", "mean_packet", "mean_num_of_bytes", F.element_at("proportion_dst_port", aggregates.COMMON_PORTS.index(443) + 1).alias("dst_443")), 5)


def _unit_sql(feature: str) -> str:
    low, high = aggregates.FEATURE_RANGES[feature]
    return f"greatest(0.0, least(1.0, ({feature} - {low!r}) / ({high!r} - {low!r})))"


@query(_TUMBLING_SQL + " SELECT time_window, src_ip, 69 AS n, " + ", ".join(f"round({x}, 6) AS f{i}" for i, x in enumerate([*map(_unit_sql, aggregates.FEATURE_RANGES), *_SHARES], 1)) + " FROM v")
def composed_features(spark, sf_dir):
    """the vector of 69 normalised features, each compared."""
    out = aggregates.compose_features(aggregates.tumbling_features(_tumbling_input(spark, sf_dir), 604800))
    return _round(out.select("time_window", "src_ip", F.size("features").alias("n"), *[F.element_at("features", i).alias(f"f{i}") for i in range(1, 70)]), 6)


@query("SELECT l_returnflag, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT l_returnflag, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p FROM lineitem GROUP BY l_returnflag, l_quantity) GROUP BY 1")
def entropy(spark, sf_dir):
    """A15, A22."""
    return _round(aggregates.entropy(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), 6)


@query("SELECT user_id, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(event_type, n) END AS label FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def majority_label(spark, sf_dir):
    """A17."""
    return aggregates.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT l_returnflag, l_linestatus, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, round(stddev_samp(l_quantity), 6) AS l_quantity_std FROM lineitem GROUP BY 1, 2")
def stability(spark, sf_dir):
    """A29."""
    return _round(aggregates.stability(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"]), 6)


@query("SELECT 'l_tax' AS \"column\", count(*) - count(l_tax) AS nulls, count(DISTINCT l_tax) AS distinct_values FROM lineitem UNION ALL SELECT 'l_returnflag', count(*) - count(l_returnflag), count(DISTINCT l_returnflag) FROM lineitem")
def null_probe(spark, sf_dir):
    """FLT12."""
    return aggregates.null_probe(table(spark, sf_dir, "lineitem"), ["l_tax", "l_returnflag"])


@query("SELECT w, count(*) AS n FROM (SELECT CASE WHEN l_quantity >= l_tax * 600 AND l_quantity >= l_discount * 500 THEN 'l_quantity' WHEN l_tax * 600 >= l_discount * 500 THEN 'tax' ELSE 'discount' END AS w FROM lineitem) GROUP BY 1")
def widest_column(spark, sf_dir):
    """A32."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_tax") * 600).alias("tax"), (F.col("l_discount") * 500).alias("discount"))
    return aggregates.value_counts(rows.select(aggregates.widest(["l_quantity", "tax", "discount"]).alias("w")), "w")


@query("SELECT CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE CAST(floor(l_quantity / 5.0) AS INT) + 1 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    """A31."""
    out = aggregates.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 10)
    return out.withColumn("bin", F.col("bin").cast("int"))


@query("WITH b AS (SELECT stddev_samp(l_quantity) * pow(count(l_quantity), -0.2) AS h FROM lineitem), p AS (SELECT unnest([0.0, 12.5, 25.0, 40.0, 60.0]) AS place) SELECT place, round(avg(exp(-pow((l_quantity - place) / h, 2) / 2) / (h * sqrt(2 * pi()))), 8) AS density FROM lineitem, b, p GROUP BY 1")
def kernel_density(spark, sf_dir):
    """The density that loss plots show."""
    return _round(aggregates.kernel_density(table(spark, sf_dir, "lineitem"), "l_quantity", (0.0, 12.5, 25.0, 40.0, 60.0)), 8)


@query("SELECT user_id, value, round(cume_dist() OVER (PARTITION BY user_id ORDER BY value), 6) AS ecdf FROM events")
def ecdf(spark, sf_dir):
    """A31."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select("user_id", "value", scalars.rounded(F.cume_dist().over(Window.partitionBy("user_id").orderBy("value")), 6).alias("ecdf"))


# --- windower -------------------------------------------------------------------------------------------------------

DAY_MS = 86_400_000
SETTINGS = windower.Settings(window_ms=DAY_MS, min_flows=2, min_windows=3, timeout=20, max_windows=8, longest_flow_ms=4000)
_WIN = ["arrival_seq", "ip_src", "ip_dst", "start_ms", "end_ms", "protocol", "port_dst", "flags", "ttl", "in_bytes", "in_pkts"]


def _windower_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_as_flows(spark, sf_dir, *_WIN)
    raw = rows.select(
        "arrival_seq", F.col("ip_src").alias("IPV4_SRC_ADDR"), F.lit("::").alias("IPV6_SRC_ADDR"), F.col("ip_dst").alias("IPV4_DST_ADDR"), F.lit("::").alias("IPV6_DST_ADDR"),
        F.col("start_ms").alias("FLOW_START_MILLISECONDS"), F.col("end_ms").alias("FLOW_END_MILLISECONDS"), F.col("in_pkts").alias("IN_PKTS"), F.col("in_bytes").alias("IN_BYTES"),
        F.col("protocol").alias("PROTOCOL"), F.col("port_dst").alias("L4_DST_PORT"), F.col("ttl").alias("MIN_TTL"), F.col("flags").alias("CLIENT_TCP_FLAGS"),
    )
    return windower.flow_features(raw)


def _win_cte(name: str) -> str:
    return _flows(*_WIN) + f""", t AS (SELECT min(end_ms) AS t0 FROM flows),
    {name} AS (SELECT f.*, CAST(greatest(0, floor((end_ms - t0 - 1) / {DAY_MS}.0)) AS BIGINT) AS window_id, CASE WHEN end_ms = start_ms THEN 0.01 ELSE (end_ms - start_ms) / 1000.0 END AS dur,
      {_per('in_bytes', 'in_pkts')} AS bpp FROM flows f, t)"""


_WIN_CTE = _win_cte("w")


@query(_flows("arrival_seq", "end_ms") + f""", t AS (SELECT min(end_ms) AS t0 FROM flows), w AS (SELECT arrival_seq * 10 + CASE WHEN arrival_seq % 7 = 0 THEN 405 ELSE 0 END AS seq,
    CAST(greatest(0, floor((end_ms - t0 - 1) / 3600000.0)) AS BIGINT) AS own FROM flows, t) SELECT seq, max(own) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS window_id FROM w""")
def win_ids(spark, sf_dir):
    """W1, W2, O1, O2, ST5: right-closed ids with late flows kept in the current window."""
    rows = events_as_flows(spark, sf_dir, "arrival_seq", "end_ms").withColumn("arrival_seq", F.expr("arrival_seq * 10 + CASE WHEN arrival_seq % 7 = 0 THEN 405 ELSE 0 END"))
    return windower.assign_windows(rows, 3_600_000, chunk=1000).select(F.col("arrival_seq").alias("seq"), "window_id")


_STATS_SQL = f""", c AS (SELECT ip_src, window_id, max(n) AS flows_concurrent_max FROM (SELECT ip_src, window_id, sum(step) OVER (PARTITION BY ip_src, window_id ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS n
      FROM (SELECT ip_src, window_id, start_ms AS moment, 1 AS step FROM w UNION ALL SELECT ip_src, window_id, end_ms, -1 FROM w)) GROUP BY 1, 2),
    i AS (SELECT ip_src, window_id, coalesce(avg(gap), 0) AS flows_itimes_avg, coalesce(stddev_samp(gap), 0) AS flows_itimes_std, coalesce(min(gap), 0) AS flows_itimes_min, coalesce(max(gap), 0) AS flows_itimes_max
      FROM (SELECT ip_src, window_id, (start_ms - lag(start_ms) OVER (PARTITION BY ip_src, window_id ORDER BY start_ms, end_ms)) / 1000.0 AS gap FROM w WHERE end_ms - start_ms <= 4000) GROUP BY 1, 2),
    s AS (SELECT ip_src, window_id, count(*) AS flows_total, sum(dur) AS dur_total, avg(dur) AS dur_avg, coalesce(var_samp(dur), 0) AS dur_std, CAST(sum(in_pkts) AS BIGINT) AS pkt_total, avg(in_pkts) AS ppf_avg,
      coalesce(var_samp(in_pkts), 0) AS ppf_std, CAST(sum(in_bytes) AS BIGINT) AS bytes_total, avg(in_bytes) AS bpf_avg, coalesce(var_samp(in_bytes), 0) AS bpf_std, avg(bpp) AS bpp_avg, coalesce(var_samp(bpp), 0) AS bpp_std,
      avg(in_bytes / dur) AS bps_avg, coalesce(var_samp(in_bytes / dur), 0) AS bps_std, avg(in_pkts / dur) AS pps_avg, coalesce(var_samp(in_pkts / dur), 0) AS pps_std, count(DISTINCT port_dst) AS port_src_uniq_cnt,
      CAST(bit_or(CASE protocol WHEN 6 THEN 1 WHEN 17 THEN 2 WHEN 1 THEN 4 ELSE 16 END) AS BIGINT) AS proto_all_or, avg(CASE WHEN flags & 2 <> 0 THEN 1 ELSE 0 END) AS flag_syn_ratio,
      avg(CASE WHEN flags & 16 <> 0 THEN 1 ELSE 0 END) AS flag_ack_ratio, avg(CASE WHEN flags & 1 <> 0 THEN 1 ELSE 0 END) AS flag_fin_ratio, count(DISTINCT ip_dst) AS ip_dst_uniq,
      avg((20 + CASE protocol WHEN 17 THEN 8 WHEN 1 THEN 8 ELSE 20 END) * in_pkts / in_bytes) AS hdr_payload_ratio_avg, coalesce(var_samp(ttl), 0) AS ttl_std FROM w GROUP BY 1, 2),
    pn AS (SELECT ip_src, window_id, port_dst, count(*) AS n FROM w GROUP BY 1, 2, 3),
    pt AS (SELECT ip_src, window_id, sum(n) AS total FROM pn GROUP BY 1, 2),
    pz AS (SELECT ip_src, window_id, port_dst, sum(n) AS n FROM (SELECT * FROM pn UNION ALL SELECT ip_src, window_id, 0, 30 - total FROM pt WHERE total < 30) GROUP BY 1, 2, 3),
    h AS (SELECT ip_src, window_id, -sum(p * ln(p)) AS port_src_entropy FROM (SELECT ip_src, window_id, n * 1.0 / sum(n) OVER (PARTITION BY ip_src, window_id) AS p FROM pz) GROUP BY 1, 2),
    stats AS (SELECT s.*, c.flows_concurrent_max, coalesce(flows_itimes_avg, 0) AS flows_itimes_avg, coalesce(flows_itimes_std, 0) AS flows_itimes_std, coalesce(flows_itimes_min, 0) AS flows_itimes_min,
      coalesce(flows_itimes_max, 0) AS flows_itimes_max, h.port_src_entropy FROM s JOIN c USING (ip_src, window_id) JOIN h USING (ip_src, window_id) LEFT JOIN i USING (ip_src, window_id))"""
_REAL = [c for c in windower.WINDOW_COLUMNS if c not in windower.WHOLE]
#: Digits kept: variances of byte counts are large, gaps are whole milliseconds.
_DIGITS = {"dur_total": 6, "dur_avg": 8, "dur_std": 9, "flows_itimes_avg": 7, "bpf_std": -2, "bpp_std": -2, "bps_std": -2, "bps_avg": 1, "pps_std": 1}
_digits = lambda c: _DIGITS.get(c, 4)
_STATS_OUT = "ip_src, window_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in windower.WHOLE) + ", " + ", ".join(f"round({c}, {_digits(c)}) AS {c}" for c in _REAL)


@query(_WIN_CTE + _STATS_SQL + f" SELECT {_STATS_OUT} FROM stats")
def win_stats(spark, sf_dir):
    """A1 to A3, A5 to A11, F13, FLT8, FLT9, W3: statistics of each source and window."""
    placed = windower.assign_windows(_windower_input(spark, sf_dir), DAY_MS, late=False)
    out = windower.window_stats(placed, SETTINGS)
    return out.select("ip_src", "window_id", *[F.col(c).cast("long").alias(c) for c in windower.WHOLE], *[scalars.rounded(c, _digits(c)).alias(c) for c in _REAL])


_HISTORY_SQL = f""", closed AS (SELECT * FROM stats WHERE flows_total >= 2),
    past AS (SELECT s.ip_src, s.window_id AS wid, c.*, row_number() OVER (PARTITION BY s.ip_src, s.window_id ORDER BY c.window_id DESC) AS r FROM stats s JOIN closed c ON s.ip_src = c.ip_src AND c.window_id BETWEEN s.window_id - 20 AND s.window_id - 1),
    summed AS (SELECT ip_src, wid AS window_id, count(*) AS n, max(window_id) - min(window_id) + 1 AS span, avg(flows_total) AS flows_total, max(flows_concurrent_max) AS flows_concurrent_max, avg(bytes_total) AS bytes_total,
      min(flows_itimes_min) AS flows_itimes_min, max(flows_itimes_max) AS flows_itimes_max, bit_or(proto_all_or) AS proto_all_or, avg(dur_std) AS dur_std, avg(port_src_entropy) AS port_src_entropy, avg(ip_dst_uniq) AS ip_dst_uniq,
      stddev_pop(flows_total) AS flows_total_std, stddev_pop(bytes_total) AS bytes_total_std, stddev_pop(dur_std) AS dur_std_std, stddev_pop(ttl_std) AS ttl_std_std, stddev_pop(port_src_entropy) AS port_src_entropy_std FROM past WHERE r <= 8 GROUP BY 1, 2 HAVING count(*) > 3)"""
_H_WHOLE = ("flows_total", "flows_concurrent_max", "bytes_total", "proto_all_or", "ip_dst_uniq")
_H_REAL = ("flows_itimes_min", "flows_itimes_max", "dur_std", "port_src_entropy", "flows_total_std", "bytes_total_std", "dur_std_std", "ttl_std_std", "port_src_entropy_std")
_H_OUT = ", ".join(f"coalesce(CAST(trunc(h.{c}) AS BIGINT), 0) AS {c}" for c in _H_WHOLE) + ", " + ", ".join(f"round(coalesce(h.{c}, 0), 4) AS {c}" for c in _H_REAL)


@query(_WIN_CTE + _STATS_SQL + _HISTORY_SQL + f" SELECT s.ip_src, s.window_id, coalesce(n, 0) AS window_total, coalesce(span, 0) AS window_span, round(coalesce(n / span, 0.0), 6) AS window_active_ratio, {_H_OUT} FROM stats s LEFT JOIN summed h USING (ip_src, window_id)")
def win_history(spark, sf_dir):
    """A12, A13, W4, ST3: what each source's closed windows say before each window."""
    placed = windower.assign_windows(_windower_input(spark, sf_dir), DAY_MS, late=False)
    out = windower.history(windower.window_stats(placed, SETTINGS), SETTINGS, (*_H_WHOLE, *_H_REAL))
    return out.select("ip_src", "window_id", "window_total", "window_span", scalars.rounded("window_active_ratio", 6).alias("window_active_ratio"), *_H_WHOLE, *[scalars.rounded(c, 4).alias(c) for c in _H_REAL])


@query(_WIN_CTE + _STATS_SQL + _HISTORY_SQL + f" SELECT w.arrival_seq, w.ip_src, w.window_id, round(coalesce(n / span, 0.0), 6) AS window_active_ratio, {_H_OUT} FROM w LEFT JOIN summed h USING (ip_src, window_id)")
def win_features(spark, sf_dir):
    """Each flow with its history features (a choice of the 58 columns)."""
    out = windower.window_features(_windower_input(spark, sf_dir), SETTINGS, late=False, columns=(*_H_WHOLE, *_H_REAL))
    return out.select("arrival_seq", "ip_src", "window_id", scalars.rounded("window_active_ratio", 6).alias("window_active_ratio"), *_H_WHOLE, *[scalars.rounded(c, 4).alias(c) for c in _H_REAL])


#: Arrival order with late flows: every seventh comes some 40 places after its turn.
_LATE = "arrival_seq * 10 + CASE WHEN arrival_seq % 7 = 0 THEN 405 ELSE 0 END"
_CLOCK_CTE = _win_cte("u") + f", w AS (SELECT * EXCLUDE (arrival_seq, window_id), {_LATE} AS arrival_seq, max(window_id) OVER (ORDER BY {_LATE} ROWS UNBOUNDED PRECEDING) AS window_id FROM u)"
_FOLD = lambda c: f"{windower.SUMMARY.get(c, 'avg')}({c})"
_ALL_SQL = """, closed AS (SELECT * FROM stats WHERE flows_total >= 2),
    past AS (SELECT s.ip_src, s.window_id AS wid, c.*, row_number() OVER (PARTITION BY s.ip_src, s.window_id ORDER BY c.window_id DESC) AS r FROM stats s JOIN closed c ON s.ip_src = c.ip_src AND c.window_id BETWEEN s.window_id - 20 AND s.window_id - 1),
    summed AS (SELECT ip_src, wid AS window_id, count(*) / (max(window_id) - min(window_id) + 1) AS window_active_ratio, """ + ", ".join(
    [f"{_FOLD(c)} AS {c}" for c in windower.WINDOW_COLUMNS] + [f"stddev_pop({c}) AS {c}_std" for c in windower.DEVIATIONS]
) + " FROM past WHERE r <= 8 GROUP BY 1, 2 HAVING count(*) > 3)"
_far = lambda c: min(_digits(c) - 1, 5)
#: Means of a few windows often lie halfway between two roundings, where the last bit would decide: this takes them off.
_NUDGE = 1.000000001
_ALL_OUT = {c: f"coalesce(CAST(trunc(h.{c}) AS BIGINT), 0)" if c in windower.WHOLE else f"round(coalesce(h.{c}, 0) * {_NUDGE}, {_far(c)})" for c in windower.WINDOW_COLUMNS} | {f"{c}_std": f"round(coalesce(h.{c}_std, 0) * {_NUDGE}, {_far(c)})" for c in windower.DEVIATIONS}


@query(_CLOCK_CTE + _STATS_SQL + _ALL_SQL + " SELECT w.arrival_seq, w.ip_src, w.window_id, round(coalesce(h.window_active_ratio, 0), 6) AS window_active_ratio, " + ", ".join(f"{x} AS {c}" for c, x in _ALL_OUT.items()) + " FROM w LEFT JOIN summed h USING (ip_src, window_id)")
def win_features_all(spark, sf_dir):
    """W1 to W5 with late flows kept in the current window: all 58 features of each flow."""
    return rounded_features(windower.window_features(late_flows(spark, sf_dir), SETTINGS))


def late_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windower_input(spark, sf_dir).withColumn("arrival_seq", F.expr(_LATE))


def rounded_features(out: DataFrame) -> DataFrame:
    real = {c: scalars.rounded(F.col(c) * _NUDGE, _far(c)) for c in windower.WINDOW_COLUMNS if c not in windower.WHOLE} | {f"{c}_std": scalars.rounded(F.col(f"{c}_std") * _NUDGE, _far(c)) for c in windower.DEVIATIONS}
    return out.withColumns(real | {"window_active_ratio": scalars.rounded("window_active_ratio", 6)})


# --- joins ----------------------------------------------------------------------------------------------------------


@query(_flows("flow_id", "ip_src", "ip_dst") + ", l AS (SELECT concat('10.0.0.', CAST(n_nationkey * 4 AS VARCHAR)) AS ip FROM nation) SELECT flow_id FROM flows WHERE ip_src IN (SELECT ip FROM l) OR ip_dst IN (SELECT ip FROM l)")
def allow_list_semi(spark, sf_dir):
    """FLT1, J7, J13."""
    listed = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), (F.col("n_nationkey") * 4).cast("string")).alias("ip_address"))
    return joins.allow_list(events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst"), listed, ("ip_src", "ip_dst")).select("flow_id")


@query(_flows("flow_id") + " SELECT flow_id FROM flows WHERE flow_id % 50 IN (3, 40)")
def allow_list_ipv6(spark, sf_dir):
    """FLT1, F30: listed addresses are found however they are spelt."""
    listed = spark.createDataFrame([("2001:DB8::3",), ("2001:db8:0:0:0:0:0:28",), ("fe80::1",)], "ip_address string")
    h = F.lower(F.hex(F.col("flow_id") % 50))
    ip = F.when(F.col("flow_id") % 2 == 0, F.concat(F.lit("2001:db8::"), h)).otherwise(F.concat(F.lit("2001:0db8:0000:0:0:0:0:"), F.lpad(h, 4, "0")))
    return joins.allow_list(events_as_flows(spark, sf_dir, "flow_id").withColumn("ip", ip), listed, ("ip",)).select("flow_id")


@query(_flows("flow_id", "ip_src", "ip_dst") + """, l AS (SELECT concat('10.0.0.', CAST(n_nationkey * 3 AS VARCHAR)) AS ip, n_regionkey AS cluster_label FROM nation)
    SELECT flow_id, coalesce(s.cluster_label, d.cluster_label) AS cluster_label FROM flows LEFT JOIN l s ON ip_src = s.ip LEFT JOIN l d ON ip_dst = d.ip WHERE coalesce(s.cluster_label, d.cluster_label) IS NOT NULL""")
def cluster_label_coalesce(spark, sf_dir):
    """J3, SNK9."""
    clusters = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), (F.col("n_nationkey") * 3).cast("string")).alias("ip_address"), F.col("n_regionkey").alias("cluster_label"))
    return joins.cluster_label(events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst"), clusters).select("flow_id", "cluster_label")


@query(_flows("ip_src") + """, l AS (SELECT concat('10.0.0.', CAST(n_nationkey % 9 AS VARCHAR)) AS ip, min(n_name) AS type FROM nation GROUP BY 1)
    SELECT ip_src, coalesce(type, 'Unknown') AS type, count(*) AS n FROM flows LEFT JOIN l ON ip_src = ip GROUP BY 1, 2""")
def categorize_ip(spark, sf_dir):
    """Unlisted addresses are of type Unknown."""
    listed = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), (F.col("n_nationkey") % 9).cast("string")).alias("ip"), F.col("n_name").alias("type"))
    return aggregates.value_counts(joins.categorize(events_as_flows(spark, sf_dir, "ip_src"), listed, "ip_src"), "ip_src", "type")


@query(_flows("flow_id", "ip_src") + """, l AS (SELECT concat('10.0.0.', CAST(n_nationkey % 9 AS VARCHAR)) AS ip, min(n_name) AS type FROM nation GROUP BY 1) SELECT flow_id, type FROM flows JOIN l ON ip_src = ip""")
def known_addresses(spark, sf_dir):
    """Rows of unlisted addresses go."""
    listed = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), (F.col("n_nationkey") % 9).cast("string")).alias("ip"), F.col("n_name").alias("type"))
    return joins.categorize(events_as_flows(spark, sf_dir, "flow_id", "ip_src"), listed, "ip_src", unknown=None).select("flow_id", "type")


NETS = (("10.0.0.0/8", "all"), ("10.0.0.0/16", "site"), ("10.0.0.64/26", "lab"), ("10.0.0.96/27", "dmz"), ("10.0.0.100", "host"), ("192.168.0.0/16", "home"))


@query(_flows("flow_id", "ip_dst") + """, n AS (SELECT flow_id, CAST(split_part(ip_dst, '.', 4) AS INT) AS h FROM flows)
    SELECT flow_id, CASE WHEN h = 100 THEN 'host' WHEN h BETWEEN 96 AND 127 THEN 'dmz' WHEN h BETWEEN 64 AND 127 THEN 'lab' ELSE 'site' END AS type FROM n""")
def lpm_join(spark, sf_dir):
    """The longest matching prefix."""
    nets = joins.networks(spark.createDataFrame(NETS, "cidr string, type string"))
    return joins.longest_prefix(events_as_flows(spark, sf_dir, "flow_id", "ip_dst"), nets, "ip_dst").select("flow_id", "type")


NETS6 = (("2001:db8::/32", "all"), ("2001:db8:0:2::/63", "pair"), ("2001:DB8:0:3:0:0:0:0/64", "lab"), ("2001:db8:0:1::2a", "host"), ("fe80::/10", "link"))


@query(_flows("flow_id") + """, n AS (SELECT flow_id, flow_id % 5 AS s, flow_id % 97 AS h FROM flows) SELECT flow_id, CASE WHEN s = 4 AND h % 2 = 0 THEN 'link' WHEN s = 4 THEN NULL WHEN s = 1 AND h = 42 THEN 'host'
    WHEN s = 3 THEN 'lab' WHEN s = 2 THEN 'pair' ELSE 'all' END AS type FROM n""")
def lpm6_join(spark, sf_dir):
    """The longest matching prefix of IPv6 addresses, some shortened and some not."""
    s, h = F.col("flow_id") % 5, F.col("flow_id") % 97
    low = F.lower(F.hex(h))
    long = F.concat(F.lit("2001:0db8:0000:"), s.cast("string"), F.lit(":0:0:0:"), low)
    ip = F.when(s == 4, F.when(h % 2 == 0, F.concat(F.lit("febf::"), low)).otherwise(F.lit("fec0::1"))).when(h % 3 == 0, long).otherwise(F.concat(F.lit("2001:DB8:0:"), s.cast("string"), F.lit("::"), F.upper(low)))
    rows = events_as_flows(spark, sf_dir, "flow_id").withColumn("ip", ip)
    return joins.longest_prefix6(rows, spark.createDataFrame(NETS6, "cidr string, type string"), "ip").select("flow_id", "type")


@query("""SELECT * FROM (VALUES ('host', 32, 167772260)) AS t(type, bits, ip_number) UNION ALL SELECT 'dmz', 27, 167772256 + i FROM range(32) r(i)
    UNION ALL SELECT * FROM (VALUES ('all', 8, NULL), ('site', 16, NULL), ('lab', 26, NULL), ('home', 16, NULL)) AS t(type, bits, ip_number)""")
def expand_small_networks(spark, sf_dir):
    """J6, R5."""
    return joins.expand_small_networks(joins.networks(spark.createDataFrame(NETS, "cidr string, type string"))).select("type", "bits", "ip_number")


TRUTH = "(SELECT concat('10.0.0.', CAST(n_nationkey AS VARCHAR)) AS ip, n_name AS label, 1704067200 + n_nationkey * 40000 AS ts, 1704067200 + n_nationkey * 40000 + 600000 AS te FROM nation)"


@query(_flows("flow_id", "ip_src", "ip_dst", "start_ms", "end_ms") + f""", gt AS {TRUTH},
    hits AS (SELECT flow_id, label FROM flows JOIN gt ON ip_src = ip AND start_ms / 1000.0 <= te AND end_ms / 1000.0 >= ts UNION ALL SELECT flow_id, label FROM flows JOIN gt ON ip_dst = ip AND start_ms / 1000.0 <= te AND end_ms / 1000.0 >= ts)
    SELECT f.flow_id, coalesce(h.label, 'background') AS label FROM flows f LEFT JOIN hits h ON f.flow_id = h.flow_id""")
def interval_overlap(spark, sf_dir):
    """Attack intervals; multiplicity is kept."""
    start = F.lit(1704067200) + F.col("n_nationkey") * 40000
    truth = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip"), F.col("n_name").alias("label"), start.alias("ts"), (start + 600000).alias("te"))
    return joins.interval_labels(events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst", "start_ms", "end_ms"), truth).select("flow_id", "label")


@query(_flows("flow_id", "ip_src", "ip_dst", "label") + " SELECT flow_id, CASE WHEN ip_src = '10.0.0.9' OR ip_dst = '10.0.0.9' THEN 'C&C_2' WHEN ip_src = '10.0.0.7' OR ip_dst = '10.0.0.7' THEN 'C&C_1' ELSE label END AS label FROM flows")
def command_servers(spark, sf_dir):
    """Labels of known servers go before any other."""
    rows = events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst", "label")
    return joins.override_label(rows, {"10.0.0.7": "C&C_1", "10.0.0.9": "C&C_2"}).select("flow_id", "label")


@query(_flows("flow_id", "ip_src", "ip_dst", "start_ms") + """, l AS (SELECT concat('10.0.0.', CAST(n_nationkey AS VARCHAR)) AS ip, n_nationkey % 10 AS level, n_nationkey % 28 + 1 AS day FROM nation), k AS (SELECT DISTINCT ip, day FROM l WHERE level > 4),
    d AS (SELECT *, CAST(dayofmonth(epoch_ms(start_ms)) AS INT) AS dd FROM flows)
    SELECT flow_id, EXISTS (SELECT 1 FROM k WHERE ip = ip_src AND day = dd) AS src_deny, CASE WHEN ip_dst <> '0.0.0.0' THEN EXISTS (SELECT 1 FROM k WHERE ip = ip_dst AND day = dd) END AS dst_deny FROM d""")
def deny_list(spark, sf_dir):
    """J11, SRC16."""
    n = F.col("n_nationkey")
    denied = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), n.cast("string")).alias("ip"), (n % 10).alias("level"), (n % 28 + 1).alias("day"))
    return joins.deny_list(events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst", "start_ms"), denied).select("flow_id", "src_deny", "dst_deny")


_PKT = ("flow_id", "ip_src", "ip_dst", "port_src", "port_dst", "protocol", "start_ms", "end_ms")


@query(_flows(*_PKT) + """, p AS (SELECT flow_id AS packet, (start_ms + flow_id % 3 * 1500) / 1000.0 AS t, CASE WHEN flow_id % 2 = 0 THEN ip_src ELSE ip_dst END AS a, CASE WHEN flow_id % 2 = 0 THEN ip_dst ELSE ip_src END AS b,
      CASE WHEN flow_id % 2 = 0 THEN port_src ELSE port_dst END AS pa, CASE WHEN flow_id % 2 = 0 THEN port_dst ELSE port_src END AS pb, protocol FROM flows)
    SELECT packet FROM p WHERE EXISTS (SELECT 1 FROM flows f WHERE f.protocol = p.protocol AND p.t BETWEEN f.start_ms / 1000.0 AND f.end_ms / 1000.0 AND
      ((f.ip_src = a AND f.ip_dst = b AND f.port_src = pa AND f.port_dst = pb) OR (f.ip_src = b AND f.ip_dst = a AND f.port_src = pb AND f.port_dst = pa)))""")
def packet_in_flow(spark, sf_dir):
    """Packets by 5-tuple, either way, and time."""
    rows = events_as_flows(spark, sf_dir, *_PKT)
    even = F.col("flow_id") % 2 == 0
    side = lambda a, b, n: F.when(even, F.col(a)).otherwise(F.col(b)).alias(n)
    packets = rows.select(F.col("flow_id").alias("packet"), ((F.col("start_ms") + F.col("flow_id") % 3 * 1500) / 1000.0).alias("timestamp"), side("ip_src", "ip_dst", "src_ip"), side("ip_dst", "ip_src", "dst_ip"),
                          side("port_src", "port_dst", "src_port"), side("port_dst", "port_src", "dst_port"), F.col("protocol").alias("proto"))
    flows = rows.select(F.col("ip_src").alias("src_ip"), F.col("ip_dst").alias("dst_ip"), F.col("port_src").alias("src_port"), F.col("port_dst").alias("dst_port"), F.col("protocol").alias("proto"),
                        (F.col("start_ms") / 1000.0).alias("start_s"), (F.col("end_ms") / 1000.0).alias("end_s"))
    return joins.packets_in_flows(packets, flows).select("packet")


@query(_flows("flow_id", "ip_src", "ip_dst", "in_bytes", "out_bytes") + """, l AS (SELECT concat('10.0.0.', CAST(n_nationkey AS VARCHAR)) AS ip FROM nation), m AS (SELECT *, ip_src IN (SELECT ip FROM l) AS s, ip_dst IN (SELECT ip FROM l) AS d FROM flows)
    SELECT flow_id, ip_src, ip_dst, in_bytes AS "IN_BYTES", out_bytes AS "OUT_BYTES", false AS swapped FROM m WHERE s UNION ALL SELECT flow_id, ip_dst, ip_src, out_bytes, in_bytes, true FROM m WHERE d""")
def route_union(spark, sf_dir):
    """FLT5, U1: flows by inside address, those of both sides twice."""
    inside = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip_address"))
    rows = events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst", "in_bytes", "out_bytes").withColumnsRenamed({"in_bytes": "IN_BYTES", "out_bytes": "OUT_BYTES"})
    return joins.route(rows, inside)


@query(_flows("flow_id", "ip_src", "ip_dst", "in_bytes", "out_bytes") + """, l AS (SELECT concat('10.0.0.', CAST(n_nationkey AS VARCHAR)) AS ip FROM nation), m AS (SELECT *, ip_src IN (SELECT ip FROM l) AS s, ip_dst IN (SELECT ip FROM l) AS d, flow_id % 3 = 1 AS forward FROM flows)
    SELECT flow_id, ip_src, ip_dst, in_bytes AS "IN_BYTES", out_bytes AS "OUT_BYTES", false AS swapped FROM m WHERE (s AND d) OR ((s OR d) AND forward) UNION ALL SELECT flow_id, ip_dst, ip_src, out_bytes, in_bytes, true FROM m WHERE (s AND d) OR ((s OR d) AND NOT forward)""")
def route_by_direction(spark, sf_dir):
    """FLT5: flows of one inside side by their direction."""
    inside = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip_address"))
    rows = events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst", "in_bytes", "out_bytes").withColumnsRenamed({"in_bytes": "IN_BYTES", "out_bytes": "OUT_BYTES"})
    return joins.route(rows.withColumn("DIRECTION", (F.col("flow_id") % 3).cast("int")), inside, direction="DIRECTION").drop("DIRECTION")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def matching_parameters(spark, sf_dir):
    """J15."""
    return joins.matching_parameters(table(spark, sf_dir, "customer"), {"c_nationkey": 3, "c_mktsegment": "BUILDING"}).select("c_custkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def whole_row_dedup(spark, sf_dir):
    """O10, O11."""
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query(_flows("flow_id", "label", "out_bytes") + " SELECT flow_id FROM flows WHERE lower(label) = 'background' AND out_bytes <> 0 AND contains(label, 'back')")
def background_flows(spark, sf_dir):
    """FLT2, FLT3, FLT4."""
    return events_as_flows(spark, sf_dir, "flow_id", "label", "out_bytes").where((F.lower("label") == "background") & (F.col("out_bytes") != 0) & F.col("label").contains("back")).select("flow_id")


@query("SELECT a.event_id, n_name FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS r FROM events) a JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation) b ON a.r = b.r")
def positional_join(spark, sf_dir):
    """Rows paired by their place."""
    events = table(spark, sf_dir, "events").select("event_id", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("o"))
    return joins.by_position(events, table(spark, sf_dir, "nation").select("n_name"), ["o", "event_id"], ["n_name"]).select("event_id", "n_name")


# --- profiles -------------------------------------------------------------------------------------------------------

_PRO = ("ip_src", "ip_dst", "port_src", "port_dst", "start_ms", "in_bytes", "out_bytes")
_CATS = [f"sum(CASE WHEN {_category_sql(f'port_{s}', _ID_BY_NAME)} = {i} THEN 1 ELSE 0 END) AS num_{s}_ports_cat_{i}" for s in ("src", "dst") for i in range(13)]
# The five tuples whose distinct values are counted: ports together; destinations alone, with either category and with both.
_SRC_CAT, _DST_CAT = _category_sql("port_src", _ID_BY_NAME), _category_sql("port_dst", _ID_BY_NAME)
_TUPLES = {
    "num_uniques_src_port_dst_port": ("port_src", "port_dst"), "num_uniques_dst_ip": ("ip_dst",), "num_uniques_dst_ip_src_port_category": ("ip_dst", _SRC_CAT),
    "num_uniques_dst_ip_dst_port_category": ("ip_dst", _DST_CAT), "num_uniques_dst_ip_src_port_category_dst_port_category": ("ip_dst", _SRC_CAT, _DST_CAT),
}
_PROFILE_CTE = _flows(*_PRO) + f""", hp AS (SELECT ip_src, CAST(epoch_ms(start_ms) AS DATE) AS date, CAST(hour(epoch_ms(start_ms)) AS INT) AS hour, count(*) AS num_flows, CAST(sum(out_bytes) AS BIGINT) AS in_bytes, CAST(sum(in_bytes) AS BIGINT) AS out_bytes,
    {', '.join(_CATS)}, {', '.join(f"count(DISTINCT concat_ws('_', {', '.join(c)})) AS {n}" for n, c in _TUPLES.items())} FROM flows GROUP BY 1, 2, 3)"""


@query(_PROFILE_CTE + " SELECT ip_src, CAST(date AS VARCHAR) AS date, hour, num_flows, in_bytes, out_bytes, CAST(num_dst_ports_cat_1 AS BIGINT) AS num_dst_ports_cat_1, CAST(num_src_ports_cat_12 AS BIGINT) AS num_src_ports_cat_12, " + ", ".join(_TUPLES) + " FROM hp")
def hourly_stats(spark, sf_dir):
    """Hourly profiles with exact distinct counts of all five tuples."""
    out = profiles.hourly_profiles(events_as_flows(spark, sf_dir, *_PRO), exact=True)
    return out.select("ip_src", F.col("date").cast("string").alias("date"), "hour", "num_flows", "in_bytes", "out_bytes", "num_dst_ports_cat_1", "num_src_ports_cat_12", *_TUPLES)


@query()
def merged_sketches(spark, sf_dir):
    """Sketches of hours united per address (estimates: no SQL; tested within the error)."""
    return profiles.merge_profiles(profiles.hourly_profiles(events_as_flows(spark, sf_dir, *_PRO)))


@query(_flows("ip_src") + " SELECT ip_src, " + ", ".join(f"true AS {n}" for n in _TUPLES) + " FROM flows GROUP BY 1")
def sketch_errors(spark, sf_dir):
    """Whether each address's five united sketches are within 5 % (or one) of the exact counts."""
    flows = profiles.with_categories(events_as_flows(spark, sf_dir, *_PRO))
    exact = flows.groupBy("ip_src").agg(*[F.count_distinct(*c).alias(f"exact_{n}") for n, c in profiles.DISTINCT.items()])
    near = lambda n: (F.abs(F.col(n) - F.col(f"exact_{n}")) <= 0.05 * F.col(f"exact_{n}") + 1).alias(n)
    return merged_sketches(spark, sf_dir).join(exact, "ip_src").select("ip_src", *map(near, profiles.DISTINCT))


@query(_PROFILE_CTE + """, m AS (SELECT ip_src, sum(num_flows) AS n, sum(in_bytes) AS i, sum(out_bytes) AS o, """ + ", ".join(f"sum(num_{s}_ports_cat_{k}) AS {s}{k}" for s in ("src", "dst") for k in range(13)) + """ FROM hp GROUP BY 1)
    SELECT ip_src, """ + ", ".join(f"round({s}{k} / n, 6) AS {s}_port_probability_{k}" for s in ("src", "dst") for k in range(13)) + """, CAST(n AS BIGINT) AS num_flows, CAST(i + o AS BIGINT) AS num_total_bytes, round(i / (o + 1), 6) AS in_out_bytes_ratio, round(""" + " ".join(f"- CASE WHEN dst{k} > 0 THEN dst{k} / n * ln(dst{k} / n) ELSE 0 END" for k in range(13)) + ", 6) AS dst_ports_entropy FROM m")
def merge_stats(spark, sf_dir):
    """A21, A22, A24, R3."""
    merged = profiles.merge_profiles(profiles.hourly_profiles(events_as_flows(spark, sf_dir, *_PRO)))
    out = profiles.profile_features(profiles.whole_by_prefix(merged, "num_"))
    shares = [f"{s}_port_probability_{k}" for s in ("src", "dst") for k in range(profiles.CATEGORIES)]
    return _round(out.select("ip_src", *shares, "num_flows", "num_total_bytes", "in_out_bytes_ratio", "dst_ports_entropy"), 6)


@query(_PROFILE_CTE + " SELECT ip_src, " + ", ".join(f"CAST(sum(CASE WHEN dayofweek(date) {'IN' if k == 'weekend' else 'NOT IN'} (0, 6) AND hour = {h} THEN in_bytes + out_bytes ELSE 0 END) AS BIGINT) AS bytes_{k}_{h}" for k in ("workday", "weekend") for h in range(24)) + " FROM hp GROUP BY 1")
def pivot_hours(spark, sf_dir):
    """A23."""
    return profiles.bytes_by_hour(profiles.hourly_profiles(events_as_flows(spark, sf_dir, *_PRO), exact=True))


_RUNS = "runs AS (SELECT c_nationkey AS feature_set, c_custkey % 8 + 2 AS k, sum(c_acctbal) / (c_custkey % 8 + 2) AS inertia, 1.0 / (1 + count(*)) AS inv_entropy FROM customer GROUP BY 1, 2)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 8 + 2
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("feature_set"), k.alias("k")).agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n")).select("feature_set", "k", (F.col("s") / F.col("k")).alias("inertia"), (F.lit(1.0) / (F.col("n") + 1)).alias("inv_entropy"))


@query(f"""WITH {_RUNS}, d AS (SELECT *, CASE WHEN lag(inertia) OVER w IS NULL THEN lead(inertia) OVER w - inertia WHEN lead(inertia) OVER w IS NULL THEN inertia - lag(inertia) OVER w ELSE (lead(inertia) OVER w - lag(inertia) OVER w) / 2 END AS d1 FROM runs WINDOW w AS (PARTITION BY feature_set ORDER BY k)),
    e AS (SELECT *, CASE WHEN lag(d1) OVER w IS NULL THEN lead(d1) OVER w - d1 WHEN lead(d1) OVER w IS NULL THEN d1 - lag(d1) OVER w ELSE (lead(d1) OVER w - lag(d1) OVER w) / 2 END AS d2 FROM d WINDOW w AS (PARTITION BY feature_set ORDER BY k))
    SELECT feature_set, k AS best_k FROM e QUALIFY row_number() OVER (PARTITION BY feature_set ORDER BY d2 DESC NULLS LAST, k) = 1""")
def elbow(spark, sf_dir):
    """W9, O4."""
    return profiles.elbow(_runs(spark, sf_dir), partition=["feature_set"])


@query(f"""WITH {_RUNS}, c AS (SELECT * FROM runs WHERE k BETWEEN 5 AND 9 AND feature_set = 7), b AS (SELECT min(inertia) AS li, max(inertia) AS hi, min(inv_entropy) AS le, max(inv_entropy) AS he FROM c)
    SELECT k, round((coalesce((inertia - li) / nullif(hi - li, 0), 0) + 2 * coalesce((inv_entropy - le) / nullif(he - le, 0), 0)) / 2, 6) AS score FROM c, b ORDER BY score, k LIMIT 1""")
def best_run(spark, sf_dir):
    """The best clustering run by weighted score."""
    return _round(profiles.best_run(_runs(spark, sf_dir).withColumn("feature_set", F.col("feature_set").cast("string")), feature_set="7").select("k", "score"), 6)


@query("""WITH c AS (SELECT c_mktsegment AS t, c_nationkey % 4 AS f, count(*) * 1.0 AS n FROM customer GROUP BY 1, 2), s AS (SELECT sum(n) AS t FROM c),
    ht AS (SELECT -sum(n / s.t * ln(n / s.t)) AS h FROM (SELECT t AS k, sum(n) AS n FROM c GROUP BY 1), s), hf AS (SELECT -sum(n / s.t * ln(n / s.t)) AS h FROM (SELECT f AS k, sum(n) AS n FROM c GROUP BY 1), s), hj AS (SELECT -sum(n / s.t * ln(n / s.t)) AS h FROM c, s),
    v AS (SELECT 1 - (hj.h - hf.h) / ht.h AS homogeneity, 1 - (hj.h - ht.h) / hf.h AS completeness FROM ht, hf, hj)
    SELECT round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness, round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS v_measure FROM v""")
def vmeasure(spark, sf_dir):
    """ML10."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", (F.col("c_nationkey") % 4).alias("f"))
    return _round(profiles.v_measure(rows, "c_mktsegment", "f"), 6)


@query("SELECT l_returnflag, round(1.0 / -sum(p * ln(p)), 6) AS inv_entropy FROM (SELECT l_returnflag, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p FROM lineitem GROUP BY l_returnflag, l_linenumber) GROUP BY 1")
def cluster_entropy(spark, sf_dir):
    """ML11."""
    return _round(profiles.cluster_entropy(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber"), 6)


@query(_flows("start_ms", "ip_src", "in_bytes", "out_bytes", "in_pkts") + """, f AS (SELECT CAST(CAST(epoch_ms(start_ms) AS DATE) AS VARCHAR) AS file, * FROM flows), t AS (SELECT file, count(*) AS file_flows, CAST(sum(in_bytes) AS BIGINT) AS file_in_bytes, CAST(sum(out_bytes) AS BIGINT) AS file_out_bytes, CAST(sum(in_pkts) AS BIGINT) AS file_pkts FROM f GROUP BY 1)
    SELECT DISTINCT t.file, ip_src, file_flows, file_in_bytes, file_out_bytes, file_pkts FROM f JOIN t ON f.file = t.file""")
def file_counters(spark, sf_dir):
    """File totals beside each address (days stand for files)."""
    rows = events_as_flows(spark, sf_dir, "start_ms", "ip_src", "in_bytes", "out_bytes", "in_pkts").withColumn("file", F.to_date(F.timestamp_millis("start_ms")).cast("string"))
    return profiles.file_counters(rows)


# --- sampling -------------------------------------------------------------------------------------------------------


@query()
def split_rows(spark, sf_dir):
    """Seeded shares by hash draw."""
    rows = sampling.split(table(spark, sf_dir, "events").select("event_id"), {"train": 0.85, "valid": 0.05, "test": 0.1}, 7, "event_id")
    return aggregates.value_counts(rows, "part")


@query("SELECT event_type, least(count(*), 20) AS n FROM events GROUP BY 1")
def stratified_cap(spark, sf_dir):
    """At most 20 rows of each type (which rows is a draw; SQL checks the counts)."""
    return aggregates.value_counts(sampling.stratified_cap(table(spark, sf_dir, "events"), 20, 7, ["event_id"], ["event_type"]), "event_type")


@query("SELECT \"binary\", CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS \"binary\", CASE WHEN event_type = 'view' THEN 50 * (SELECT count(DISTINCT event_type) - 1 FROM events) ELSE 50 END AS n FROM events GROUP BY event_type) GROUP BY 1")
def bootstrap_balance(spark, sf_dir):
    """Draws with replacement (SQL checks the counts)."""
    rows = sampling.balanced(table(spark, sf_dir, "events"), 50, 7, ["event_id"], "event_type", "view")
    return aggregates.value_counts(rows, "binary")


@query("SELECT ip, packets, CASE WHEN row_number() OVER (ORDER BY packets DESC, ip) % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM (SELECT l_suppkey AS ip, count(*) AS packets FROM lineitem GROUP BY 1) WHERE packets BETWEEN 400 AND 700")
def split_addresses(spark, sf_dir):
    """O9."""
    activity = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ip")).agg(F.count("*").alias("packets"))
    return sampling.split_addresses(activity, 400, 700, "mostactive")


@query("SELECT ip, packets, CASE WHEN row_number() OVER (ORDER BY packets, ip) % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM (SELECT l_suppkey AS ip, count(*) AS packets FROM lineitem GROUP BY 1) WHERE packets BETWEEN 400 AND 700")
def split_least_active(spark, sf_dir):
    """The least active addresses first."""
    activity = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ip")).agg(F.count("*").alias("packets"))
    return sampling.split_addresses(activity, 400, 700, "leastactive")


@query("SELECT v AS part, true AS near FROM (VALUES ('train'), ('valid'), ('test')) t(v)")
def split_shares(spark, sf_dir):
    """Every part's size is within four deviations of its share."""
    shares = {"train": 0.85, "valid": 0.05, "test": 0.1}
    rows = sampling.split(table(spark, sf_dir, "events").select("event_id"), shares, 7, "event_id")
    counts = aggregates.value_counts(rows, "part").crossJoin(rows.agg(F.count("*").alias("total")))  # three rows and one
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("part")]
    return counts.select("part", (F.abs(F.col("n") - share * F.col("total")) <= 4 * F.sqrt(F.col("total") * share * (1 - share))).alias("near"))


@query("SELECT event_id, user_id FROM events")
def shuffled_rows(spark, sf_dir):
    """A seeded order of all rows."""
    return sampling.shuffled(table(spark, sf_dir, "events").select("event_id", "user_id"), 7, "event_id")
