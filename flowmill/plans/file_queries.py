"""Queries that write files of each kind below the shared folder and read them back: what was written must be there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions import scalars
from flowmill.operators import joins, profiles, scaling
from flowmill.plans.flows import events_as_flows, flows_cte
from flowmill.session import share_code, shared_dir, spread, table
from flowmill.sources import files, ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


FORMATS = ("csv", "flows", "gz", "arrow", "parquet", "orc", "json", "feather", "pkl", "pkl-zip")


@query(f"SELECT f AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 2) AS total, count(DISTINCT event_type) AS types FROM events, (VALUES {', '.join(f'({x!r})' for x in FORMATS)}) t(f) GROUP BY 1")
def saved_formats(spark, sf_dir):
    """SRC6, SRC11, SNK5, SNK15, SNK16, U2: the same rows in every format, all read as one table."""
    share_code(spark)
    rows, folder, found = table(spark, sf_dir, "events").select("event_id", "value", "event_type"), _folder(spark, "formats"), None
    for kind in FORMATS:
        path = f"{folder}/events.{kind}"
        files.save(rows, path, kind)
        # gzipped text with a header is read by the extension of its folder
        read = files.load(spark, path, rows.schema) if kind != "arrow" else spark.read.schema(rows.schema).option("sep", "|").option("header", True).csv(path)
        found = read.withColumn("kind", F.lit(kind)) if found is None else found.unionByName(read.withColumn("kind", F.lit(kind)))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), scalars.rounded(F.sum("value"), 2).alias("total"), F.count_distinct("event_type").alias("types"))


@query("SELECT event_type AS cluster_label, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def label_folders(spark, sf_dir):
    """SNK9, SRC7: a folder for each label, each found by its path."""
    folder = _folder(spark, "labels")
    files.save(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("cluster_label")), f"{folder}/all.parquet", "parquet", partition_by=["cluster_label"])
    rows = files.load(spark, f"{folder}/all.parquet", "event_id long")
    name = F.regexp_extract(F.col("_metadata.file_path"), "cluster_label=([^/]+)/", 1)
    return rows.select("event_id", name.alias("cluster_label")).groupBy("cluster_label").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT user_id, CAST(1 AS BIGINT) AS buckets, count(*) AS n FROM events GROUP BY 1")
def bucket_folders(spark, sf_dir):
    """SNK10, R7: all rows of a key lie in one bucket's folder."""
    folder = _folder(spark, "buckets")
    files.save_buckets(table(spark, sf_dir, "events").select("user_id", "event_id"), folder, 8, "user_id")
    return spark.read.parquet(folder).groupBy("user_id").agg(F.count_distinct("bucket").alias("buckets"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, true AS small, true AS headed FROM events")
def row_chunks(spark, sf_dir):
    """SNK11: files of at most 300 rows, each with the header."""
    folder = _folder(spark, "chunks")
    files.save(spread(table(spark, sf_dir, "events").select("event_id", "user_id")), folder, "csv", max_rows=300)
    return chunk_report(spark, folder)


def chunk_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all files, whether each has at most 300 and whether each has one header. Each file is read once, and many by one task."""
    lines = spark.read.schema("event_id string, user_id string").option("sep", "|").csv(folder).select("*", F.col("_metadata.file_name").alias("file"))
    lines = lines.coalesce(4 * spark.sparkContext.defaultParallelism)
    head = F.coalesce((F.col("event_id") == "event_id") & (F.col("user_id") == "user_id"), F.lit(False))
    per = lines.groupBy("file").agg(F.count_if(~head).alias("n"), F.count_if(head).alias("heads"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n") <= 300, F.lit(True)).alias("small"), F.coalesce((F.min("heads") == 1) & (F.max("heads") == 1), F.lit(True)).alias("headed"))


@query(f"""WITH {flows_cte("flow_id", "start_ms", "ip_src", "ip_dst", "port_src", "port_dst", "protocol", "in_pkts", "in_bytes", "label")} SELECT CAST(start_ms // 1000 AS BIGINT) AS timestamp, ip_src AS src_ip, ip_dst AS dst_ip, CAST(port_src AS BIGINT) AS src_port,
    CAST(port_dst AS BIGINT) AS dst_port, CAST(protocol AS VARCHAR) AS protocol, in_pkts AS packet, in_bytes AS num_of_bytes, label FROM flows""")
def netflow_export(spark, sf_dir):
    """SRC9, SRC10: flows as a header-less export with time text, and read with its columns and epoch seconds."""
    folder = _folder(spark, "netflow")
    rows = events_as_flows(spark, sf_dir, "start_ms", "ip_src", "ip_dst", "port_src", "port_dst", "protocol", "in_pkts", "in_bytes", "label")
    time = F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd HH:mm:ss")
    rows.select(time.alias("t"), F.lit(0.5).alias("d"), "ip_src", "ip_dst", "port_src", "port_dst", "protocol", F.lit(".AP.").alias("f"), F.lit(0).alias("w"), F.lit(0).alias("s"), "in_pkts", "in_bytes", "label").write.csv(folder)
    return files.read_netflow(spark, folder).select("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet", "num_of_bytes", "label")


@query("SELECT n_name AS label, concat('10.0.0.', CAST(n_nationkey AS VARCHAR)) AS ip_src, CAST(1704067200 + n_nationkey AS BIGINT) AS ts, CAST(1704067260 + n_nationkey AS BIGINT) AS te FROM nation")
def ground_truth_text(spark, sf_dir):
    """SRC15: the list of attacks as text with its separator."""
    folder, n = _folder(spark, "truth"), F.col("n_nationkey")
    ip = F.concat(F.lit("10.0.0."), n.cast("string"))
    table(spark, sf_dir, "nation").select(F.concat_ws("\\", "n_name", F.lit("map"), ip, F.lit("2.2.2.2"), F.lit("80"), (n + 1704067200).cast("string"), (n + 1704067260).cast("string"))).write.text(folder)
    return files.read_ground_truth(spark, folder).select("label", "ip_src", "ts", "te")


def _rename(spark: SparkSession, folder: str, name: str) -> None:
    """Give the one part file of a folder a name."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in store.listStatus(where) if x.getPath().getName().startswith("part-"))
    store.rename(part, jvm.org.apache.hadoop.fs.Path(where, name))


@query(f"""WITH {flows_cte("flow_id", "ip_src", "ip_dst", "start_ms")}, l AS (SELECT concat('10.0.0.', CAST(n_nationkey AS VARCHAR)) AS ip, n_nationkey % 10 AS level, n_nationkey % 3 + 5 AS day FROM nation), k AS (SELECT DISTINCT ip, day FROM l WHERE level > 4),
    d AS (SELECT *, CAST(dayofmonth(epoch_ms(start_ms)) AS INT) AS dd FROM flows) SELECT flow_id, EXISTS (SELECT 1 FROM k WHERE ip = ip_src AND day = dd) AS src_deny, EXISTS (SELECT 1 FROM k WHERE ip = ip_dst AND day = dd) AS dst_deny FROM d""")
def dated_deny_lists(spark, sf_dir):
    """SRC16, J11, R19: lists in dated folders, read together and held against the flows of their day."""
    folder, n = _folder(spark, "deny"), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.0.0."), n.cast("string")), (n % 10).cast("int"), n)
    for day in range(3):
        one = f"{folder}/ipsum_2024010{day + 5}"
        rows.where(n % 3 == day).drop("n_nationkey").coalesce(1).write.csv(one)
        _rename(spark, one, "raw_ips.csv")
    denied = files.read_deny_lists(spark, f"{folder}/ipsum_*")
    return joins.deny_list(events_as_flows(spark, sf_dir, "flow_id", "ip_src", "ip_dst", "start_ms"), denied).select("flow_id", "src_deny", "dst_deny")


@query("SELECT concat('10.1.', CAST(s_suppkey // 256 AS VARCHAR), '.', CAST(s_suppkey % 256 AS VARCHAR)) AS ip, CAST(s_nationkey * 1000 AS BIGINT) AS packets FROM supplier")
def ip_stats_report(spark, sf_dir):
    """SRC17: addresses and packet counts from a text report with other lines."""
    folder = _folder(spark, "stats")
    ip = F.concat(F.lit("10.1."), F.floor(F.col("s_suppkey") / 256).cast("string"), F.lit("."), (F.col("s_suppkey") % 256).cast("string"))
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), ip, F.lit("    "), (F.col("s_nationkey") * 1000).cast("string"), F.lit("  0.01  12%")).alias("value"))
    lines.unionByName(spark.createDataFrame([("=====",), ("IP Statistics:",), ("All Addresses 12",), ("",)], "value string")).write.text(folder)
    return files.read_ip_stats(spark, folder)


_INPUT = ("in_bytes", "in_pkts", "ttl")


@query(f"WITH {flows_cte('flow_id', 'in_bytes', 'in_pkts', 'ttl', 'label')} SELECT flow_id, label, 3 AS width, round(CASE WHEN flow_id % 4 = 0 THEN 0 ELSE in_bytes END + in_pkts + ttl, 2) AS total FROM flows WHERE flow_id % 5 <> 0")
def model_input(spark, sf_dir):
    """F27, F28, SNK7, X7: labelled rows without nulls as a feature array, written in large row groups for a trainer's reader."""
    folder = _folder(spark, "input")
    rows = events_as_flows(spark, sf_dir, "flow_id", *_INPUT, "label")
    rows = rows.withColumn("in_bytes", F.when(F.col("flow_id") % 4 != 0, F.col("in_bytes"))).withColumn("label", F.when(F.col("flow_id") % 5 != 0, F.col("label")))
    files.save_features(scaling.assemble(scaling.drop_unlabelled(rows, "label"), _INPUT, ("flow_id", "label")), folder, 100)
    total = F.aggregate("feature", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(folder).select("flow_id", "label", F.size("feature").alias("width"), scalars.rounded(total, 2).alias("total"))


@query(f"WITH {flows_cte('flow_id', 'label')} SELECT count(*) AS n, CAST(sum(CASE WHEN label = 'background' THEN 0 ELSE 1 END) AS BIGINT) AS attacks, CAST(greatest(count(*) // 64, 1) AS BIGINT) AS batches FROM flows")
def trainer_batches(spark, sf_dir):
    """SRC12, SRC13: all rows go to the trainer in batches of 64 at least."""
    rows = events_as_flows(spark, sf_dir, "flow_id", "label")
    got = [(len(x), int(y.sum())) for x, y in files.training_batches(rows, ["flow_id"], 64, "label")]
    return spark.createDataFrame([(sum(n for n, _ in got), sum(y for _, y in got), len(got))], "n long, attacks long, batches long")


_DEFINITION = [{"id": 1, "name": "IN_BYTES", "type": "uint32"}, {"id": 8, "name": "IPV4_SRC_ADDR", "type": "ipv4"}]


@query(f"WITH {flows_cte('flow_id', 'in_bytes', 'ip_src')} SELECT CAST(flow_id AS VARCHAR) AS \"FLOW_ID\", in_bytes AS \"IN_BYTES\", ip_src AS \"IPV4_SRC_ADDR\", '' AS \"Label\", false AS \"SRC_DENY\", false AS \"DST_DENY\" FROM flows")
def stored_flows(spark, sf_dir):
    """ING5, ING6, SNK8: flows under their stored names in a table, as a detector reads them."""
    name = f"flows_{uuid.uuid4().hex}"
    rows = events_as_flows(spark, sf_dir, "flow_id", "in_bytes", "ip_src").select(F.col("flow_id").cast("string").alias("id"), F.col("in_bytes").alias(ingest.camel_case("IN_BYTES")), F.col("ip_src").alias(ingest.camel_case("IPV4_SRC_ADDR")))
    for half in (0, 1):
        files.append_table(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half), name)
    kept = _folder(spark, "stored")
    ingest.model_columns(spark.table(name), _DEFINITION).write.parquet(kept)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(kept)


@query(f"WITH {flows_cte('ip_src', 'start_ms', 'in_bytes', 'out_bytes')} SELECT ip_src, CAST(CAST(epoch_ms(start_ms) AS DATE) AS VARCHAR) AS date, CAST(hour(epoch_ms(start_ms)) AS INT) AS hour, CAST(sum(out_bytes) AS BIGINT) AS in_bytes, CAST(sum(in_bytes) AS BIGINT) AS out_bytes FROM flows GROUP BY 1, 2, 3")
def plain_profiles(spark, sf_dir):
    """R2: profiles without their counts, by the prefix of the names."""
    rows = profiles.hourly_profiles(events_as_flows(spark, sf_dir, "ip_src", "ip_dst", "port_src", "port_dst", "start_ms", "in_bytes", "out_bytes"), exact=True)
    return profiles.drop_by_prefix(rows, "num_").withColumn("date", F.col("date").cast("string"))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer")
    features = customers.select(F.col("c_custkey").cast("string").alias("ip_address"), F.col("c_acctbal").alias("num_total_bytes"))
    return features, customers.where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("ip_address"), (F.col("c_nationkey") % 4).cast("int").alias("cluster_label"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS ip_address, round(c_acctbal, 2) AS num_total_bytes, CAST(c_nationkey % 4 AS INT) AS cluster_label FROM customer WHERE c_custkey % 3 <> 0")
def clustered_addresses(spark, sf_dir):
    """Each address's features with its cluster of the best run, saved as separated text."""
    features, labels = _labelled(spark, sf_dir)
    path = f"{_folder(spark, 'clusters')}/best.csv"
    files.save(profiles.with_clusters(features, labels), path, "csv")
    return files.load(spark, path, "ip_address string, num_total_bytes double, cluster_label int").withColumn("num_total_bytes", scalars.rounded("num_total_bytes", 2))
