import gzip
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowmill.operators import joins, ml, sampling
from flowmill.session import share_code
from flowmill.sources import files, ingest, pcap


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "id long, s string, x double")
    share_code(spark)
    for kind in ("csv", "flows", "gz", "parquet", "orc", "json", "feather", "pkl", "pkl-zip"):
        files.save(df, f"{tmp_path}/t.{kind}", kind)
        assert sorted(files.load(spark, f"{tmp_path}/t.{kind}", df.schema).collect()) == sorted(df.collect()), kind
    df.toPandas().to_feather(f"{tmp_path}/one.feather")
    df.toPandas().to_pickle(f"{tmp_path}/one.pkl")
    for kind in ("feather", "pkl"):
        assert sorted(files.load(spark, f"{tmp_path}/one.{kind}", df.schema).collect()) == sorted(df.collect())
    files.save(df.limit(0), f"{tmp_path}/none.feather", "feather")
    assert files.load(spark, f"{tmp_path}/none.feather", df.schema).count() == 0
    files.save(df, f"{tmp_path}/parts", "parquet", partition_by=["id"])
    assert {p.name for p in (tmp_path / "parts").glob("id=*")} == {"id=1", "id=2"}
    files.save(spark.range(25).coalesce(1), f"{tmp_path}/chunks", "csv", max_rows=10)
    assert len(list((tmp_path / "chunks").glob("part-*"))) == 3
    files.save_buckets(df, f"{tmp_path}/buckets", 4, "id")
    assert spark.read.parquet(f"{tmp_path}/buckets").count() == 2
    with pytest.raises(ValueError):
        files.save(df, f"{tmp_path}/x", "xlsx")
    with pytest.raises(ValueError):
        files.load(spark, f"{tmp_path}/x.xlsx")
    df.toPandas().to_pickle(f"{tmp_path}/t.other")
    with pytest.warns(UserWarning, match="unknown extension"):
        assert sorted(files.load(spark, f"{tmp_path}/t.other", df.schema).collect()) == sorted(df.collect())
    labelled = spark.createDataFrame([(i, float(i), "background" if i % 2 else "scan") for i in range(23)], "id long, x double, Label string")
    got = list(files.training_batches(labelled, ["id", "x"], 5))
    assert [len(x) for x, _ in got] == [5, 5, 5, 8] and sorted(i for x, _ in got for i in x["id"]) == list(range(23)) and sum(y.sum() for _, y in got) == 12
    assert [y.tolist() for _, y in files.training_batches(labelled, ["x"], 50, background_only=True)] == [[0] * 11]
    got = list(files.batches(spark.range(7).toDF("id"), ["id"], 3, seed=1))
    assert [len(b) for b in got] == [3, 3, 1] and sorted(pd.concat(got)["id"]) == list(range(7))


def test_flow_readers(spark, tmp_path):
    hour = tmp_path / "2024" / "03" / "01" / "07"
    hour.mkdir(parents=True)
    with gzip.open(hour / "a.flows.gz", "wt") as out:
        out.write("id|x\n1|2\n")
    rows = files.with_path_hour(files.load(spark, str(tmp_path / "2024/03/01/07/a.flows.gz"), "id long, x long")).first()
    assert (str(rows.date), rows.hour) == ("2024-03-01", 7)
    (tmp_path / "n.csv").write_text("2024-01-01 00:00:05,0.5,1.1.1.1,2.2.2.2,80,443,TCP,.AP.S.,0,0,3,99,bg\n")
    assert files.read_netflow(spark, str(tmp_path / "n.csv")).first().timestamp == 1704067205
    (tmp_path / "gt.txt").write_text("Friday morning scan\\nmap\\1.1.1.1\\2.2.2.2\\80\\100\\200\n")
    assert files.read_ground_truth(spark, str(tmp_path / "gt.txt")).first().te == 200
    deny = tmp_path / "ipsum_20240305"
    deny.mkdir()
    (deny / "raw_ips.csv").write_text("9.9.9.9,7\n")
    got = files.read_deny_lists(spark, str(tmp_path / "ipsum_*")).first()
    assert (got.ip, got.level, got.month, got.day) == ("9.9.9.9", 7, 3, 5)
    (tmp_path / "stats.txt").write_text("====\nIP Statistics\n 10.0.0.1  17 0.5\n fe80::1 3\nAll 20\n")
    assert sorted((r.ip, r.packets) for r in files.read_ip_stats(spark, str(tmp_path / "stats.txt")).collect()) == [("10.0.0.1", 17), ("fe80::1", 3)]


def test_schemas(spark):
    definition = [{"id": 1, "name": "IN_BYTES", "type": "uint32"}, {"id": 8, "name": "IPV4_SRC_ADDR", "type": "ipv4"}]
    assert ingest.camel_case("IPV4_SRC_ADDR") == "ipv4SrcAddr" and ingest.snake_case("inBytes") == "IN_BYTES"
    assert ingest.flow_schema(definition).simpleString() == "struct<flow_id:string,IN_BYTES:bigint,IPV4_SRC_ADDR:string>"
    assert ingest.table_ddl(definition, "flows") == "CREATE TABLE flows (id STRING, inBytes LONG, ipv4SrcAddr STRING) USING parquet"
    ips = spark.createDataFrame([("1.2.3.4",), ("2001:DB8::0:1",), ("x",), (None,)], "a string").select(joins.address_key(F.col("a")).alias("a"))
    assert [r.a for r in ips.collect()] == ["1.2.3.4", "20010db8" + "0" * 23 + "1", "x", None]
    bad = spark.createDataFrame([(bytearray(b"\0broken"),), (None,)], "a binary").select(ingest.inflate("a").alias("a"))
    assert [r.a for r in bad.collect()] == [None, None]
    one = spark.createDataFrame([("f", "ai", "scan", 0.5)], "flow_id string, detector string, event_name string, metric double")
    assert ingest.detections_json(one).first().value == '{"flow_id":"f","detector":"ai","event_name":"scan","metric":0.5}'
    stored = spark.createDataFrame([("u", 5, "1.1.1.1")], "id string, inBytes long, ipv4SrcAddr string")
    assert ingest.model_columns(stored, definition).columns == ["FLOW_ID", "IN_BYTES", "IPV4_SRC_ADDR", "Label", "SRC_DENY", "DST_DENY"]


def test_captures(spark, tmp_path):
    ip6 = bytes([0x60, 0, 0, 0, 0, 4, 17, 64]) + bytes(15) + b"\1" + bytes(15) + b"\2" + struct.pack("!HH", 53, 4000)
    tagged = bytes(12) + struct.pack("!HHHH", 0x8100, 5, 0x8100, 6) + struct.pack("!H", 0x86DD) + ip6
    fragment = bytes(12) + b"\x08\x00" + struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28, 0, 100, 64, 6, 0, bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8])) + bytes(8)
    for order, magic, ticks in (("<", pcap.MICROS, 10**6), (">", pcap.NANOS, 10**9)):
        raw = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
        for i, packet in enumerate((tagged, fragment, b"short", bytes(12) + b"\x08\x06" + bytes(30))):
            raw += struct.pack(order + "IIII", 100 + i, ticks // 4, len(packet), len(packet) + 7) + packet
        (tmp_path / "a.pcap").write_bytes(raw + struct.pack(order + "IIII", 1, 1, 99, 99) + b"cut")
        rows = pcap.read_pcap(spark, str(tmp_path / "a.pcap")).orderBy("number").collect()
        assert [(r.timestamp, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.proto) for r in rows] == [
            (100.25, "::1", "::2", 53, 4000, 17), (101.25, "1.2.3.4", "5.6.7.8", None, None, 6), (102.25, *[None] * 5), (103.25, *[None] * 5),
        ]
        assert rows[0].length == len(tagged) + 7 and bytes(rows[0].packet) == tagged
    assert pcap.addresses(ip6, pcap.RAW) == ("::1", "::2", 53, 4000, 17) and pcap.addresses(b"", pcap.RAW) is None
    with pytest.raises(ValueError):
        list(pcap.packets_of(b"no capture at all, but long enough"))
    again = pcap.read_pcap(spark, str(tmp_path / "a.pcap"))
    pcap.write_pcap(again, f"{tmp_path}/out")
    assert sorted((r.timestamp, bytes(r.packet)) for r in pcap.read_pcap(spark, f"{tmp_path}/out").collect()) == sorted((r.timestamp, bytes(r.packet)) for r in again.collect())


def test_stored_tables(spark):
    definition = [{"id": 1, "name": "IN_BYTES", "type": "uint32"}, {"id": 8, "name": "IPV4_SRC_ADDR", "type": "ipv4"}]
    for statement in ingest.deployment_ddl(definition):
        spark.sql(statement)
    try:
        ingest.store_flows(spark.createDataFrame([("a", 5, "1.1.1.1"), ("b", 6, "2.2.2.2")], "id string, inBytes long, ipv4SrcAddr string"))
        spark.sql("INSERT INTO detections VALUES ('a', 'ai', 'scan', 0.5, current_timestamp()), ('old', 'ai', 'scan', 0.5, current_timestamp())")
        spark.sql("INSERT INTO flows VALUES ('old', 1, '3.3.3.3', timestamp'2020-01-01 00:00:00', '2020-01-01-00')")
        assert [(r.flow_id, r.ipv4SrcAddr, r.event_name) for r in spark.table("detections_flows").collect()] == [("a", "1.1.1.1", "scan")]
        assert ingest.expire_flows(spark) == ["2020-01-01-00"] and spark.table("flows").count() == 2
    finally:
        for drop in ("VIEW detections_flows", "TABLE detections", "TABLE flows"):
            spark.sql(f"DROP {drop}")


def test_zlib_messages(spark):
    text = b'[{"1": "5", "4": "6"}, {"1": "7"}]'
    packed = spark.createDataFrame([(b"\0" + zlib.compress(text),), (text,), (b"\0broken",), (None,)], "m binary")
    definition = [{"id": 1, "name": "IN_BYTES", "type": "uint32"}, {"id": 4, "name": "PROTOCOL", "type": "uint8"}]
    rows = ingest.explode_ipfix(packed.select(ingest.inflate("m").alias("message")), definition).collect()
    assert sorted((r.IN_BYTES, r.PROTOCOL) for r in rows) == [(5, 6), (5, 6), (7, 0), (7, 0)]


def test_samples_repeat(spark):
    rows = spark.range(2000).withColumn("s", F.col("id") % 3)
    a, b = (sampling.split(rows.repartition(n), {"a": 0.7, "b": 0.3}, 1, "id") for n in (1, 9))
    assert sorted(a.collect()) == sorted(b.collect()) and 0.65 < a.where("part = 'a'").count() / 2000 < 0.75
    with pytest.raises(ValueError):
        sampling.split(rows, {"a": 0.7, "b": 0.4}, 1, "id")


def test_numpy_models():
    rng = np.random.default_rng(0)
    x = np.clip(rng.normal(0.5, 0.02, (400, 6)), 0, 1)
    model = ml.Autoencoder(6).fit(x, epochs=30)
    odd = np.vstack([x[:50], 1 - np.eye(6)])
    mse, bce, kd = model.losses(odd)
    assert mse[50:].min() > mse[:50].max() and np.isfinite(bce).all() and kd >= 0
    y, _ = model.forward(odd)
    assert model.attribution(odd) == pytest.approx(2 * (y - odd) / 6)
    blobs = np.vstack([rng.normal(c, 0.05, (30, 2)) for c in (0, 5, 10)] + [[[50, 50]]])
    label = ml.dbscan(blobs, 0.5, 4)
    assert label[-1] == -1 and [len(set(label[i * 30 : i * 30 + 30])) for i in range(3)] == [1, 1, 1] and len(set(label)) == 4
    label, medoids = ml.k_medoids(blobs[:90], 3, seed=1)
    assert len(medoids) == 3 and len(label) == 90


def test_clusters_of_many_rows_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((400, 2)), 3)
    near = ((x[:, None] - x[None]) ** 2).sum(2)
    for eps in (0.02, 0.04, 0.2):
        core, label = (near <= eps * eps).sum(1) >= 5, ml.dbscan(x, eps, 5)
        linked = (near <= eps * eps) & core[:, None] & core[None]
        assert (label[np.nonzero(linked)[0]] == label[np.nonzero(linked)[1]]).all()
        assert ((label < 0) == ~((near <= eps * eps) & core[None]).any(1)).all()
        assert (np.diff([np.flatnonzero((label == c) & core)[0] for c in range(label.max() + 1)]) > 0).all()
    assert ml.medoid(x) == np.sqrt(near).sum(1).argmin()
    many = ml.few_rows(spark.range(30_000).selectExpr("id % 173 / 173.0 AS a", "id % 179 / 179.0 AS b"), ("a", "b"))
    assert len(many) == 30_000 and ml.dbscan(many, 0.1, 5).max() == 0 and set(ml.k_medoids(many, 3)[0]) == {0, 1, 2}


def test_pcap_of_many_users_in_several_files(spark, tmp_path):
    """User 70,000 has no address of four bytes as the flows spell it; captures are cut at a number of packets."""
    from pyspark.sql import functions as F

    from flowmill.plans import catalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.col("user_id") + 70_000)
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["pcap_round_trip"](spark, str(tmp_path))
    want = events.select(F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.col("user_id") % 256).alias("ip"))
    assert sorted(r.src_ip for r in got.collect()) == sorted(r.ip for r in want.collect())
    made = spark.range(10).coalesce(1).select((10 - F.col("id")).cast("double").alias("timestamp"), F.col("id").cast("string").cast("binary").alias("packet"))
    pcap.write_pcap(made, f"{tmp_path}/cut", most=4)
    rows = pcap.read_pcap(spark, f"{tmp_path}/cut").collect()
    assert sorted(r.timestamp for r in rows) == list(map(float, range(1, 11))) and len({r.file for r in rows}) == 3


def test_batches_come_packed(spark, monkeypatch):
    sent, read = [], files.pa.ipc.open_stream
    monkeypatch.setattr(files.pa.ipc, "open_stream", lambda packed: sent.append(len(packed)) or read(packed))
    rows = spark.range(20_000).selectExpr("id", "if(id % 4 = 0, 'a long name of an attack', 'background') AS Label").coalesce(2)
    got = list(files.training_batches(rows, ["id"], 64))
    assert sorted(i for x, _ in got for i in x["id"]) == list(range(20_000)) and sum(int(y.sum()) for _, y in got) == 5_000
    assert len(got) == 312 and {len(x) for x, _ in got[:-1]} == {64} and 0 < sum(sent) < 16 * 20_000
