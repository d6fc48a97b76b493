"""Steps that grow with the tables: they are dealt over tasks, and cost the same a row however many rows there are."""

import glob
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowmill.operators import ml, ranks, windower
from flowmill.plans import catalog, file_queries, queries


def test_row_chunks_are_written_by_many_tasks(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for name, rows in (("all", events), ("none", events.limit(0))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/chunks-*"))
    assert catalog.QUERIES["row_chunks"](spark, f"{tmp_path}/all").collect() == [(1000, True, True)]
    (folder,) = set(glob.glob(f"{shared}/chunks-*")) - before
    assert len({re.search(r"part-(\d+)", f)[1] for f in glob.glob(f"{folder}/part-*")}) > 4
    assert catalog.QUERIES["row_chunks"](spark, f"{tmp_path}/none").collect() == [(0, True, True)]


def test_chunk_report_finds_long_and_headless_files(spark, tmp_path):
    for name, lines in (("long", ["event_id|user_id"] + ["1|2"] * 301), ("headless", ["1|2"] * 3), ("right", ["event_id|user_id", "|", "1|"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text("\n".join(lines) + "\n")
    got = {name: tuple(file_queries.chunk_report(spark, f"{tmp_path}/{name}").first()) for name in ("long", "headless", "right")}
    assert got == {"long": (301, False, True), "headless": (3, True, False), "right": (2, True, True)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_found_by_halving(spark):
    edges = sorted([0.5, 1.0, 1.0, 2.0, 7.0])
    values = [-1.0, 0.5, 0.6, 1.0, 1.5, 7.0, 8.0, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(edges, v) for v in values] + [(None, 1.0), ([], 1.0)], "e array<double>, v double")
    got = [r.n for r in rows.select(ranks.below(F.col("e"), F.col("v"), 5).alias("n")).collect()]
    assert got == [0, 0, 1, 1, 3, 4, 5, 5, 5, 0, 0, 0]
    x = np.random.default_rng(5).integers(0, 300, 2000).astype(float)
    df = spark.createDataFrame([(float(v), "a") for v in x], "v double, k string").repartition(5)
    points = [0.7, 0.1, 1.0, 0.0, 0.1, 0.333]  # in any order, also twice
    assert ranks.quantiles(df, points, ["k"]).first().q == pytest.approx(np.quantile(x, points))
    scaled = ml.quantile_uniform(df, ["v"])
    assert "lambdafunction" in _plan(scaled) and "filter(" not in _plan(scaled)  # not all knots for each row


def test_rank_correlation(spark):
    rng = np.random.default_rng(6)
    x = np.stack([rng.integers(0, 9, 3000), rng.normal(0, 1, 3000).round(2), rng.exponential(1, 3000)], 1)
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).repartition(5)
    assert ml.spearman(df, ["a", "b", "c"]) == pytest.approx(pd.DataFrame(x).corr("spearman").to_numpy(), abs=1e-12)
    assert np.isnan(ml.spearman(df.where("false"), ["a", "b"])).all()
    with pytest.raises(Exception, match="null in a"):
        ml.spearman(df.withColumn("a", F.lit(None).cast("double")), ["a", "b"])


def test_forests_see_counted_bins(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = pd.DataFrame({"id": range(4000), "a": rng.integers(0, 5, 4000) / 4, "b": rng.random(4000), "c": np.where(rng.random(4000) < 0.4, 0.0, rng.random(4000))})
    x["label"] = np.where((x.a > 0.4) ^ (x.b > 0.7), "attack", "background")
    x.loc[::50, "c"] = np.nan
    df = spark.createDataFrame(x).repartition(6)
    edges = ml.bin_edges(df, ("a", "b", "c"))
    assert edges[0] == [0.0, 0.25, 0.5, 0.75, 1.0] and len(edges[1]) == 31 and edges[2][0] == 0.0 and 0 < edges[2][1] < 1e-300
    grown = []
    fit = ml.RandomForestClassifier._fit
    monkeypatch.setattr(ml.RandomForestClassifier, "_fit", lambda self, data: (grown.append(data.agg(F.count("*"), F.sum("__weight")).first()), fit(self, data))[1])
    for copies in (1, 20):
        many = df.crossJoin(spark.range(copies).select(F.col("id").alias("copy")))
        model = ml.train_forest(many, ("a", "b", "c"), "label", trees=20)
        got = ml.forest_scores(model, many).toPandas()
        assert len(got) == 4000 * copies and (got.predicted == got.label).mean() > 0.97 and got.confidence.between(0.5, 1).all()
    # All rows count, but the trees are grown on no more of them.
    assert [r[1] for r in grown] == [4000, 80000] and grown[0][0] == grown[1][0] < 4000


def test_history_keeps_sums_of_what_is_asked_for(spark):
    flows = queries.late_flows(spark, "/root/testdata/sf0.001")
    settings = windower.Settings(window_ms=queries.DAY_MS, min_flows=1, min_windows=1, timeout=20, max_windows=8)
    stats = windower.window_stats(windower.assign_windows(flows, settings.window_ms), settings).localCheckpoint()
    every = windower.history(stats, settings)
    for names in (("bytes_total", "ttl_std_std", "proto_all_or", "flows_concurrent_max_std"), ("bps_avg", "pps_avg_x", "ip_dst_uniq"), ("flows_itimes_min",), ("dur_avg", "bpp_avg_std", "pps_std")):
        part = windower.history(stats, settings, names)
        assert set(part.columns) == {"ip_src", "window_id", "window_total", "window_span", "window_active_ratio", *names} - {"pps_avg_x"}
        assert sorted(map(repr, part.collect())) == sorted(map(repr, every.select(part.columns).collect()))
