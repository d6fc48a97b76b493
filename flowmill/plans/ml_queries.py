"""Queries of the detection and clustering operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions import scalars
from flowmill.operators import aggregates, ml, profiles, scaling
from flowmill.plans.flows import events_as_flows, flows_cte
from flowmill.session import share_code, table
from flowmill.sources import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
FEATURES = ("in_bytes", "in_pkts", "out_bytes", "out_pkts", "ttl", "flags", "duration_in")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_code(spark)
    rows = events_as_flows(spark, sf_dir, "flow_id", "label", *FEATURES)
    return scaling.apply_min_max(rows, scaling.min_max(rows, FEATURES))


@query()
def rf_filter(spark, sf_dir):
    """ML2, FLT11: forest filter with label and confidence per flow."""
    rows = _scaled(spark, sf_dir)
    model = ml.train_forest(rows, FEATURES, "label")
    return ml.forest_scores(model, rows).select("flow_id", "label", "predicted", scalars.rounded("confidence", 6).alias("confidence"))


@query()
def rf_search(spark, sf_dir):
    """ML2: the forest chosen by cross-validation (depth and impurity; 20 trees each)."""
    rows = _scaled(spark, sf_dir)
    model = ml.train_forest(rows, FEATURES, "label", trees=20, search=True)
    return aggregates.value_counts(ml.forest_scores(model, rows), "label", "predicted")


def _network(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, ml.Autoencoder]:
    rows = scaling.assemble(_scaled(spark, sf_dir), FEATURES, ("flow_id", "label"))
    return rows, ml.fit_autoencoder(rows.where("label = 'background'"), epochs=5, **options)


@query()
def recon_score(spark, sf_dir):
    """ML3, ML4, ML5, F28: reconstruction losses per flow of a variational network fitted on background flows."""
    rows, model = _network(spark, sf_dir)
    return ml.reconstruction_losses(rows, model).select("flow_id", "label", "mse_loss", "bce_loss", "bce_kd_loss")


#: A network without hidden layers: three features to two means and log variances, and back.
_FIXED = {"wm": [[0.5, -0.25], [1.0, 0.5], [-0.5, 0.75]], "bm": [0.1, -0.1], "ws": [[0.25, 0.5], [-0.5, 0.25], [0.5, -0.25]], "bs": [-0.2, 0.1], "wd0": [[1.0, -0.5, 0.25], [0.5, 1.0, -0.75]], "bd0": [0.2, -0.3, 0.1]}
_X = ("in_bytes / 50000.0", "in_pkts / 20.0", "ttl / 100.0")


def _layer(values, weights: str, bias: str, names: str) -> str:
    return ", ".join(f"{' + '.join(f'{v} * {w[j]}' for v, w in zip(values, _FIXED[weights]))} + {b} AS {names}{j}" for j, b in enumerate(_FIXED[bias]))


_XS, _MS, _YS = ([f"{n}{i}" for i in range(k)] for n, k in (("x", 3), ("m", 2), ("y", 3)))


_FIXED_SQL = f"""WITH {flows_cte("flow_id", "in_bytes", "in_pkts", "ttl")}, a AS (SELECT flow_id, {', '.join(f'{x} AS x{i}' for i, x in enumerate(_X))} FROM flows), b AS (SELECT *, {_layer(_XS, 'wm', 'bm', 'm')}, {_layer(_XS, 'ws', 'bs', 's')} FROM a),
    c AS (SELECT *, {_layer(_MS, 'wd0', 'bd0', 'z')} FROM b), d AS (SELECT *, {', '.join(f'1 / (1 + exp(-z{i})) AS y{i}' for i in range(3))} FROM c),
    e AS (SELECT flow_id, ({' + '.join(f'pow(x{i} - y{i}, 2)' for i in range(3))}) / 3 AS mse, ({' + '.join(f'-(x{i} * ln(y{i} + 1e-9) + (1 - x{i}) * ln(1 - y{i} + 1e-9))' for i in range(3))}) / 3 AS bce, -0.5 * ({' + '.join(f'1 + s{i} - pow(m{i}, 2) - exp(s{i})' for i in range(2))}) AS kd FROM d)"""


def _fixed_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ml.Autoencoder]:
    share_code(spark)
    model = ml.Autoencoder(3, (), 2, p={k: np.array(v) for k, v in _FIXED.items()})
    rows = events_as_flows(spark, sf_dir, "flow_id", "in_bytes", "in_pkts", "ttl").select("flow_id", F.array(*[F.expr(x).cast("double") for x in _X]).alias("feature"))
    return rows, model


@query(_FIXED_SQL + " SELECT flow_id, round(mse, 6) AS mse_loss, round(bce, 6) AS bce_loss, round(bce + kd, 6) AS bce_kd_loss FROM e")
def recon_fixed(spark, sf_dir):
    """ML4, ML5: the three losses of a network with given weights, each row a batch of its own."""
    rows, model = _fixed_network(spark, sf_dir)
    losses = ml.reconstruction_losses(rows, model, batch=1)
    return losses.select("flow_id", *[scalars.rounded(c, 6).alias(c) for c in ("mse_loss", "bce_loss", "bce_kd_loss")])


@query(_FIXED_SQL + f" SELECT flow_id, {', '.join(f'round(2 * (y{i} - x{i}) / 3, 6) AS a{i}' for i in range(3))} FROM d")
def attribution_fixed(spark, sf_dir):
    """ML13: which feature makes a flow odd, by the same network."""
    rows, model = _fixed_network(spark, sf_dir)
    return ml.attributions(rows, model).select("flow_id", *[scalars.rounded(F.col("attribution")[i], 6).alias(f"a{i}") for i in range(3)])


@query(f"WITH {flows_cte('flow_id', 'in_pkts')} SELECT flow_id, CASE WHEN in_pkts > 5 THEN 'attack' ELSE 'background' END AS predicted, 1.0 AS confidence FROM flows")
def rf_separable(spark, sf_dir):
    """ML2, ML5: a forest on features any of which tells the label."""
    rows = events_as_flows(spark, sf_dir, "flow_id", "in_pkts")
    rows = rows.select("flow_id", F.when(F.col("in_pkts") > 5, "attack").otherwise("background").alias("label"), *[(F.col("in_pkts") * k).alias(f"f{i}") for i, k in enumerate((1.0, -2.0, 0.5))])
    model = ml.train_forest(rows, ("f0", "f1", "f2"), "label", trees=20)
    return ml.forest_scores(model, rows).select("flow_id", "predicted", scalars.rounded("confidence", 6).alias("confidence"))


@query("SELECT e AS estimator, count(DISTINCT c_nationkey % 3) AS clusters, CAST(0 AS BIGINT) AS noise FROM customer, (VALUES ('dbscan'), ('k_medoids'), ('kmeans')) t(e) GROUP BY 1")
def separable_clusters(spark, sf_dir):
    """ML8: each estimator finds groups that lie apart."""
    place = (F.col("c_nationkey") % 3).cast("double")
    rows = table(spark, sf_dir, "customer").select((place * 100 + F.col("c_custkey") % 7 / 10).alias("x"), (F.col("c_custkey") % 5 / 10).alias("y"))
    few = rows.distinct().orderBy("x", "y")
    x = ml.few_rows(few, ("x", "y"))
    label = ml.dbscan(x, 1.0, 3)
    medoids = min((ml.k_medoids(x, 3, seed) for seed in range(8)), key=lambda got: np.sqrt(((x - x[got[1]][got[0]]) ** 2).sum(1)).sum())[0]
    grid, centres = ml.kmeans_grid(rows, ["x", "y"], (3,))
    apart = len({round(c[0] / 100) for c in centres[3]})
    return spark.createDataFrame([("dbscan", int(label.max()) + 1, int((label < 0).sum())), ("k_medoids", len({round(v / 100) for v in x[:, 0][np.unique(medoids, return_index=True)[1]]}), 0), ("kmeans", apart, 0)], "estimator string, clusters long, noise long")


#: Widths of the plain network's layers, and of its middle.
PLAIN = {"hidden": (128, 96, 64, 32), "latent": 16, "variational": False}


@query()
def autoencoder_score(spark, sf_dir):
    """ML12: reconstruction error per flow of the plain network."""
    rows, model = _network(spark, sf_dir, **PLAIN)
    return ml.reconstruction_losses(rows, model).select("flow_id", "label", "mse_loss")


_SCORED = """scored AS (SELECT flow_id, CASE WHEN label = 'attack' THEN 1 ELSE 0 END AS is_attack, CASE WHEN (in_pkts + ttl) % 3 <> 0 THEN 1 ELSE 0 END AS filter_pred, (in_pkts * 10 + ttl % 7) / 110.0 AS filter_prob,
    in_bytes / 50000.0 AS mse_loss FROM flows)"""


def _fixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_as_flows(spark, sf_dir, "flow_id", "label", "in_pkts", "ttl", "in_bytes")
    fires = ((F.col("in_pkts") + F.col("ttl")) % 3 != 0).cast("int")
    return rows.select("flow_id", (F.col("label") == "attack").cast("int").alias("is_attack"), fires.alias("filter_pred"), ((F.col("in_pkts") * 10 + F.col("ttl") % 7) / 110.0).alias("filter_prob"), (F.col("in_bytes") / 50000.0).alias("mse_loss"))


# Thresholds as the tuning of the filter and the detector tries them: 0.8 to 1.0, and five deviations of the background's loss.
_GRID_SQL = f"""WITH {flows_cte("flow_id", "label", "in_pkts", "ttl", "in_bytes")}, {_SCORED}, b AS (SELECT avg(mse_loss) AS m, stddev_samp(mse_loss) AS s FROM scored WHERE is_attack = 0),
    g AS (SELECT f AS filter_threshold, m + s * x AS detector_threshold FROM b, (VALUES (0.8), (0.85), (0.9), (0.95), (1.0)) t(f), (VALUES (1.0 / 3), (0.5), (1.0), (2.0), (3.0)) u(x)),
    h AS (SELECT g.*, is_attack, CASE WHEN CASE WHEN filter_pred = 1 AND filter_prob >= filter_threshold THEN 1.0 ELSE mse_loss END >= detector_threshold THEN 1 ELSE 0 END AS hit FROM scored, g),
    a AS (SELECT round(filter_threshold, 6) AS filter_threshold, round(detector_threshold, 6) AS detector_threshold, round((avg(CASE WHEN is_attack = 1 THEN hit * 1.0 END) + avg(CASE WHEN is_attack = 0 THEN 1.0 - hit END)) / 2, 6) AS auc FROM h GROUP BY 1, 2)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ml.threshold_grid(_fixed_scores(spark, sf_dir))
    return out.select(*[scalars.rounded(F.col(c).cast("double"), 6).alias(c) for c in out.columns])


@query(_GRID_SQL + " SELECT * FROM a")
def threshold_grid(spark, sf_dir):
    """ML6: the area for each pair of thresholds."""
    return _grid(spark, sf_dir)


@query(_GRID_SQL + " SELECT * FROM a ORDER BY auc DESC, detector_threshold, filter_threshold LIMIT 1")
def best_thresholds(spark, sf_dir):
    """ML6: the best pair of thresholds."""
    return ml.best_thresholds(_grid(spark, sf_dir))


@query(f"""WITH {flows_cte("flow_id", "label", "in_pkts", "ttl", "in_bytes")}, {_SCORED} SELECT flow_id, CASE WHEN filter_prob >= 0.75 AND is_attack = 1 THEN 'attack' ELSE 'anomaly' END AS event_name,
    round(CASE WHEN filter_prob >= 0.75 AND is_attack = 1 THEN 0.9 ELSE mse_loss END, 6) AS metric FROM scored WHERE (filter_prob >= 0.75 AND is_attack = 1) OR mse_loss >= 0.15""")
def detection_chain(spark, sf_dir):
    """ML1, U4: decisions from given scores."""
    scored = _fixed_scores(spark, sf_dir).select("flow_id", F.col("filter_prob").alias("attack_prob"), F.lit("attack").alias("class_name"), F.when(F.col("is_attack") == 1, 0.9).otherwise(0.1).alias("class_prob"), "mse_loss")
    return ml.detect(scored).withColumn("metric", scalars.rounded("metric", 6))


@query(f"""WITH {flows_cte("flow_id", "label")} SELECT concat('{{"flow_id":"', flow_id, '","detector":"ai","event_name":"scan","metric":', CASE WHEN flow_id % 2 = 0 THEN '0.5' ELSE '0.25' END, '}}') AS value FROM flows WHERE label = 'attack'""")
def detection_messages(spark, sf_dir):
    """SNK2: the messages that detections are published as."""
    rows = events_as_flows(spark, sf_dir, "flow_id", "label").where("label = 'attack'")
    found = rows.select(F.col("flow_id").cast("string").alias("flow_id"), F.lit("ai").alias("detector"), F.lit("scan").alias("event_name"), F.when(F.col("flow_id") % 2 == 0, 0.5).otherwise(0.25).alias("metric"))
    return ingest.detections_json(found)


@query()
def detections_of_models(spark, sf_dir):
    """ML1: the online chain on fitted models: forest of two classes, forest of all, variational network."""
    rows = _scaled(spark, sf_dir).withColumn("event_class", F.when(F.col("label") == "attack", F.when(F.col("flow_id") % 2 == 0, "scan").otherwise("dos")).otherwise("background"))
    binary, classes = (ml.train_forest(rows, FEATURES, c, trees=40) for c in ("label", "event_class"))
    network = ml.fit_autoencoder(scaling.assemble(rows.where("label = 'background'"), FEATURES), epochs=2)
    return ml.detection_chain(rows, binary, classes, network, FEATURES)


@query()
def density_clusters(spark, sf_dir):
    """ML8, ML9, FLT7: DBSCAN and k-medoids over their grids and two feature subsets, each row with clusters and noise."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("num_flows"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    rows = profiles.busy_addresses(found)
    out = []
    for subset in (("quantity", "discount", "tax"), ("quantity", "discount")):
        x = ml.few_rows(ml.quantile_uniform(rows, subset, 100).orderBy("l_suppkey"), subset)
        for eps in (0.05, 0.1, 0.2):
            label = ml.dbscan(x, eps, 5)
            out.append(("dbscan", "+".join(subset), float(eps), int(label.max()) + 1, int((label < 0).sum())))
        for k in range(2, min(6, len(x)) + 1):
            label, _ = ml.k_medoids(x, k)
            out.append(("k_medoids", "+".join(subset), float(k), len(set(label.tolist())), 0))
    return spark.createDataFrame(out, "estimator string, features string, parameter double, clusters long, noise long")


@query("""WITH r AS (SELECT CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS t, CASE WHEN l_extendedprice > 40000 THEN 'hi' ELSE 'lo' END AS f FROM lineitem)
    SELECT c AS label, CAST(sum(CASE WHEN t = c THEN 1 ELSE 0 END) AS BIGINT) AS support, round(sum(CASE WHEN t = c AND f = c THEN 1.0 ELSE 0 END) / sum(CASE WHEN f = c THEN 1 ELSE 0 END), 6) AS "precision",
    round(sum(CASE WHEN t = c AND f = c THEN 1.0 ELSE 0 END) / sum(CASE WHEN t = c THEN 1 ELSE 0 END), 6) AS recall FROM r, (VALUES ('hi'), ('lo')) v(c) GROUP BY 1""")
def classification_report(spark, sf_dir):
    """ML7, R13."""
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") > 25, "hi").otherwise("lo").alias("t"), F.when(F.col("l_extendedprice") > 40000, "hi").otherwise("lo").alias("f"))
    return ml.report(rows, "t", "f").select("label", "support", scalars.rounded("precision", 6).alias("precision"), scalars.rounded("recall", 6).alias("recall"))


@query(f"""WITH {flows_cte("flow_id", "label", "in_pkts", "ttl", "in_bytes")}, {_SCORED}, r AS (SELECT is_attack, avg(rn) OVER (PARTITION BY mse_loss) AS rank FROM (SELECT *, row_number() OVER (ORDER BY mse_loss) AS rn FROM scored))
    SELECT round((sum(CASE WHEN is_attack = 1 THEN rank ELSE 0 END) - sum(is_attack) * (sum(is_attack) + 1) / 2.0) / (sum(is_attack) * (count(*) - sum(is_attack))), 6) AS auc FROM r""")
def roc_auc(spark, sf_dir):
    """ML7."""
    return ml.roc_auc(_fixed_scores(spark, sf_dir), "is_attack", "mse_loss").select(scalars.rounded("auc", 6).alias("auc"))


@query()
def kmeans_profiles(spark, sf_dir):
    """ML8, ML9: best of several seeds for each k, on quantile-scaled columns."""
    rows = table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return ml.kmeans_grid(ml.quantile_uniform(rows, ["c_acctbal", "nation"]), ["c_acctbal", "nation"], (2, 3, 4, 5))[0]


@query("""WITH r AS (SELECT avg(q) OVER (PARTITION BY l_quantity) AS a, avg(p) OVER (PARTITION BY l_extendedprice) AS b FROM (SELECT *, row_number() OVER (ORDER BY l_quantity) AS q, row_number() OVER (ORDER BY l_extendedprice) AS p FROM lineitem))
    SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    """A30."""
    m = ml.spearman(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(round(float(m[0, 1]), 6),)], "rho double")
