import json

import pytest

from flowmill import cli
from flowmill.plans import registry
from flowmill.session import share_code
from flowmill.sources import broker
from flowmill.streaming import pipelines


def test_broker_stream(spark, tmp_path):
    share_code(spark)
    log = tmp_path / "log"
    log.write_text("flow.a\tone\nother\ttwo\nflow.b\tthree\n")
    broker.register(spark)

    def run():
        stream = spark.readStream.format("broker").option("client", "flowmill.sources.broker:LogFile").option("path", str(log)).option("topic", "flow").option("rows", 2).load()
        pipelines.start_each(stream, lambda batch, _: batch.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r.offset, bytes(r.payload).decode()) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(0, "one"), (2, "three")]
    with log.open("a") as out:
        out.write("flow.c\tfour\n")
    assert run() == [(0, "one"), (2, "three"), (3, "four")]


def test_code_goes_to_the_workers_of_a_cluster(monkeypatch):
    import zipfile
    from types import SimpleNamespace

    sent = []
    context = SimpleNamespace(master="spark://host:7077", applicationId="app-1", addPyFile=sent.append)
    for _ in range(2):
        share_code(SimpleNamespace(sparkContext=context))
    assert len(sent) == 1 and "flowmill/sources/broker.py" in zipfile.ZipFile(sent[0]).namelist()


def test_registry_and_settings(tmp_path):
    @registry.register("detector", "mine")
    class Mine(registry.Detector):
        name = "mine"

    assert registry.find("detector", "mine") is Mine and registry.find("scaler", "flowmill.operators.scaling.scale").__name__ == "scale"
    for kind, parts in registry._BUILT_IN.items():
        assert all(callable(registry.find(kind, name)) for name in parts)
    with pytest.raises(KeyError):
        registry.find("detector", "none")
    (tmp_path / "w.json").write_text(json.dumps({"window_size": 2, "win_min_cnt": 3}))
    got = registry.window_settings(registry.load_config(str(tmp_path / "w.json")))
    assert (got.window_ms, got.min_windows, got.max_windows) == (2000, 3, 200)


def test_ddl_command(tmp_path, capsys):
    (tmp_path / "d.json").write_text(json.dumps([{"id": 1, "name": "IN_BYTES", "type": "uint32"}]))
    cli.main(["ddl", str(tmp_path / "d.json"), "flows"])
    assert capsys.readouterr().out == "CREATE TABLE flows (id STRING, inBytes LONG) USING parquet\n"
