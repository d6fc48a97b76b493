"""Detection and clustering: forest filter, reconstruction scorer, threshold grid, clustering grid, metrics.

Training of the small networks runs in numpy on a bounded sample; scoring is a vectorised function over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.operators import ranks
from flowmill.session import spread

#: Rows a network is fitted on, at most.
SAMPLE_ROWS = 20_000


#: Bins of a feature that a forest's thresholds lie between.
BINS = 32


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Where each feature is cut into BINS bins at most, [edge, next edge): at each value if there are so few, else at 32nds of all rows. A
    value that fills more than one of those has a bin of its own."""
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features}
    shares = [i / BINS for i in range(1, BINS)]
    got = rows.agg(*[f.alias(f"{n}{i}") for i, x in enumerate(number.values()) for n, f in (("q", F.percentile_approx(x, shares, 10_000)), ("d", F.approx_count_distinct(x)))]).first()
    few = [i for i in range(len(features)) if got[f"d{i}"] <= 2 * BINS]
    values = rows.agg(*[F.collect_set(number[features[i]]).alias(f"v{i}") for i in few]).first() if few else {}
    out = []
    for i in range(len(features)):
        q = got[f"q{i}"] or []
        cuts = set(values[f"v{i}"]) if i in few and len(values[f"v{i}"]) <= BINS else set(q) | {float(np.nextafter(x, np.inf)) for x in q if q.count(x) > 1}
        cuts = sorted(float(x) for x in cuts if np.isfinite(x))
        out.append(cuts[1:] if i in few and len(cuts) == BINS else cuts or [0.0])
    return out


def _binned(rows: DataFrame, cuts: Bucketizer) -> DataFrame:
    """Adds the features' bins; nulls share the one of NaN, after all others."""
    return cuts.transform(rows).withColumns({b: F.coalesce(F.col(b), F.lit(len(x) - 1.0)).cast("byte") for b, x in zip(cuts.getOutputCols(), cuts.getSplitsArray())})


def train_forest(rows: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 8, seed: int = 7, search: bool = False) -> PipelineModel:
    """A random forest (entropy, sqrt of the features, no bootstrap), optionally chosen by cross-validation over a small grid.

    Trees only see which bin a value lies in, so all rows are counted by label and bins first, and the counts are the weights of what the trees
    are grown on. For the cross-validation they are counted by fold too; a row's fold is drawn by a hash of its columns.
    """
    bins = [f"__b{i}" for i in range(len(features))]
    cuts = Bucketizer(inputCols=list(features), outputCols=bins, splitsArray=[[-np.inf, *x, np.inf] for x in bin_edges(rows, features)], handleInvalid="keep")
    names = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(rows)
    fold = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]), F.lit(3)).cast("int") if search else F.lit(0)
    counts = _binned(names.transform(rows.withColumn("__fold", fold)), cuts).groupBy("__label", "__fold", *bins).agg(F.count("*").cast("double").alias("__weight"))
    gathered = VectorAssembler(inputCols=bins, outputCol="__x")
    # One bin more holds nulls and NaN, which are above all thresholds.
    forest = RandomForestClassifier(labelCol="__label", featuresCol="__x", weightCol="__weight", numTrees=trees, maxDepth=depth, maxBins=BINS + 2, impurity="entropy", featureSubsetStrategy="sqrt", bootstrap=False, seed=seed)
    last = forest
    if search:
        grid = ParamGridBuilder().addGrid(forest.maxDepth, [depth // 2, depth]).addGrid(forest.impurity, ["gini", "entropy"]).build()
        last = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="__label", weightCol="__weight"), numFolds=3, foldCol="__fold", seed=seed)
    # A task a core: each holds and sends the statistics of all nodes of a level.
    data = gathered.transform(spread(counts, 1)).select("__label", "__fold", "__weight", "__x").cache()
    try:
        return PipelineModel([names, cuts, gathered, last.fit(data)])
    finally:
        data.unpersist()


def forest_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds `predicted` (label) and `confidence` (its probability). Rows of the same bins have the same score, which is computed once."""
    cuts, names = model.stages[1], F.array(*[F.lit(x) for x in model.stages[0].labels])
    bins = cuts.getOutputCols()
    binned = _binned(rows, cuts)
    scored = PipelineModel(model.stages[2:]).transform(spread(binned.select(*bins).distinct()))
    scored = scored.select(*bins, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))
    return binned.join(scored, bins).drop(*bins)


@dataclass
class Autoencoder:
    """Variational or plain dense autoencoder in numpy: hidden layers of the given widths with ReLU, mirrored in the decoder, and
    a sigmoid (variational) or ReLU (plain) output."""

    size: int
    hidden: tuple[int, ...] = (512, 512, 1024)
    latent: int = 100
    variational: bool = True
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        down, up = (self.size, *self.hidden), (self.latent, *reversed(self.hidden), self.size)
        shapes = {f"e{i}": x for i, x in enumerate(zip(down, down[1:]))} | {f"d{i}": x for i, x in enumerate(zip(up, up[1:]))}
        shapes |= {"m": (down[-1], self.latent)} | ({"s": (down[-1], self.latent)} if self.variational else {})
        if not self.p:
            for name, (a, b) in shapes.items():
                self.p["w" + name], self.p["b" + name] = rng.normal(0, np.sqrt(2 / (a + b)), (a, b)), np.zeros(b)

    def _dense(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.p["w" + name] + self.p["b" + name]

    def forward(self, x: np.ndarray, noise: np.ndarray | float = 0.0):
        """Reconstruction, then (inputs of the encoder's layers, mean, log variance, inputs of the decoder's layers)."""
        ins = [x]
        for i in range(len(self.hidden)):
            ins.append(np.maximum(self._dense(ins[-1], f"e{i}"), 0))
        mean = self._dense(ins[-1], "m")
        spread = np.clip(self._dense(ins[-1], "s"), -8, 8) if self.variational else np.zeros_like(mean)
        outs = [mean + noise * np.exp(spread / 2)]
        for i in range(len(self.hidden)):
            outs.append(np.maximum(self._dense(outs[-1], f"d{i}"), 0))
        last = self._dense(outs[-1], f"d{len(self.hidden)}")
        return (1 / (1 + np.exp(-np.clip(last, -30, 30))) if self.variational else np.maximum(last, 0)), (ins, mean, spread, outs)

    def gradients(self, x: np.ndarray, noise: np.ndarray | float = 0.0) -> tuple[float, dict[str, np.ndarray]]:
        """Loss a row and its gradients: binary cross entropy plus the divergence from a unit normal, or the squared error."""
        y, (ins, mean, spread, outs) = self.forward(x, noise)
        grad, n = {}, len(x)

        def back(d: np.ndarray, name: str, before: np.ndarray) -> np.ndarray:
            grad["w" + name], grad["b" + name] = before.T @ d, d.sum(0)
            return d @ self.p["w" + name].T

        if self.variational:
            loss = float(-(x * np.log(y + 1e-9) + (1 - x) * np.log(1 - y + 1e-9)).sum() - 0.5 * (1 + spread - mean**2 - np.exp(spread)).sum()) / n
            d = (y - x) / n
        else:
            loss, d = float(((y - x) ** 2).sum()) / n, 2 * (y - x) * (y > 0) / n
        for i in range(len(self.hidden), -1, -1):
            d = back(d, f"d{i}", outs[i])
            d = d * (outs[i] > 0) if i else d
        over = back(d + (mean / n if self.variational else 0), "m", ins[-1])
        if self.variational:
            over = over + back(d * noise * np.exp(spread / 2) / 2 + (np.exp(spread) - 1) / (2 * n), "s", ins[-1])
        for i in range(len(self.hidden) - 1, -1, -1):
            over = back(over * (ins[i + 1] > 0), f"e{i}", ins[i])
        return loss, grad

    def fit(self, x: np.ndarray, epochs: int = 40, batch: int = 300, rate: float = 1e-3, decay: float = 1e-2, patience: int = 5) -> "Autoencoder":
        """Adam with decayed weights; stops early without progress."""
        rng, p = np.random.default_rng(self.seed), self.p
        m, v, t, best, stale = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0, np.inf, 0
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                part = x[order[at : at + batch]]
                loss, grad = self.gradients(part, rng.normal(size=(len(part), self.latent)) if self.variational else 0.0)
                total += loss * len(part)
                t += 1
                for k in p:
                    gk = grad[k] + decay * p[k] / len(x)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.999 * v[k] + 0.001 * gk * gk
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            if total < best * 0.9999:
                best, stale = total, 0
            elif (stale := stale + 1) >= patience:
                break
        return self

    def losses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Per row mean squared error and binary cross entropy of the mean reconstruction; the divergence, summed over the batch."""
        y, (_, mean, spread, _) = self.forward(x)
        bce = -(x * np.log(y + 1e-9) + (1 - x) * np.log(np.maximum(1 - y, 0) + 1e-9)).mean(1)
        return ((x - y) ** 2).mean(1), bce, float(-0.5 * (1 + spread - mean**2 - np.exp(spread)).sum())

    def attribution(self, x: np.ndarray) -> np.ndarray:
        """Gradient of the squared error by the reconstruction: which feature makes a row odd."""
        y, _ = self.forward(x)
        return 2 * (y - x) / x.shape[1]


def fit_autoencoder(rows: DataFrame, feature: str = "feature", seed: int = 7, epochs: int = 40, **options) -> Autoencoder:
    """Fit on at most SAMPLE_ROWS rows, those with the smallest hash of their features (a bound on the driver's memory)."""
    sample = rows.select(feature).orderBy(F.xxhash64(F.lit(seed), F.col(feature).cast("string"))).limit(SAMPLE_ROWS)
    x = np.array([r[0] for r in sample.collect()], float)
    return Autoencoder(x.shape[1], seed=seed, **options).fit(x, epochs)


#: Rows whose divergence is summed for bce_kd_loss.
BATCH = 300


def reconstruction_losses(rows: DataFrame, model: Autoencoder, feature: str = "feature", batch: int = BATCH) -> DataFrame:
    """Adds mse_loss, bce_loss and bce_kd_loss: the divergence, summed over a batch of rows, is added to each row of it.

    Which rows share a batch follows from the table's partitions, so bce_kd_loss repeats only for an equal layout; batch=1 makes it a
    row's own.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("mse_loss double, bce_loss double, bce_kd_loss double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [np.zeros((0, 3))]
            for at in range(0, len(part), batch):
                mse, bce, kd = shared.value.losses(np.stack([np.asarray(x, float) for x in part.iloc[at : at + batch]]))
                out.append(np.stack([mse, bce, bce + kd], 1))
            yield pd.DataFrame(np.concatenate(out), columns=["mse_loss", "bce_loss", "bce_kd_loss"])

    return rows.withColumn("__l", score(F.col(feature))).select("*", "__l.*").drop("__l")


def attributions(rows: DataFrame, model: Autoencoder, feature: str = "feature") -> DataFrame:
    """Adds `attribution`: for each feature, how fast the squared error grows with its reconstruction."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(shared.value.attribution(np.stack([np.asarray(x, float) for x in part]))) if len(part) else [], dtype=object)

    return rows.withColumn("attribution", score(F.col(feature)))


def detect(scored: DataFrame, binary: float = 0.75, known: float = 0.5, anomaly: float = 0.15) -> DataFrame:
    """Chained decision: a confident attack of a known class is reported with its class and confidence; what is benign or
    not confidently classed is reported as an anomaly if its reconstruction error is high. Columns: flow_id, attack_prob,
    class_name, class_prob, mse_loss."""
    attack = (F.col("attack_prob") >= binary) & (F.col("class_prob") >= known)
    odd = ~attack & (F.col("mse_loss") >= anomaly)
    name = F.when(attack, F.col("class_name")).when(odd, F.lit("anomaly"))
    out = scored.select("flow_id", name.alias("event_name"), F.when(attack, F.col("class_prob")).otherwise(F.col("mse_loss")).alias("metric"))
    return out.where(F.col("event_name").isNotNull())


def detection_chain(rows: DataFrame, binary: PipelineModel, classes: PipelineModel, network: Autoencoder, features: Sequence[str], thresholds: Sequence[float] = (0.75, 0.5, 0.15), background: str = "background") -> DataFrame:
    """The online chain on fitted models: rows (flow_id and features) to (flow_id, event_name, metric).

    The binary forest (labels attack, background) picks confident attacks; the forest of classes names them if it is confident
    and doesn't say background; what either isn't confident of, and what is benign, goes to the network, and is an anomaly if its
    reconstruction error is high. All three score each row in one pass.
    """
    least, known, anomaly = thresholds
    scored = forest_scores(binary, rows).withColumnsRenamed({"predicted": "attack_name", "confidence": "attack_conf"})
    scored = forest_scores(classes, scored).withColumnsRenamed({"predicted": "class_name", "confidence": "class_prob"})
    scored = reconstruction_losses(scored.withColumn("__f", F.array(*[F.col(c).cast("float") for c in features])), network, "__f")
    attack = F.when(F.col("attack_name") == background, F.lit(0.0)).otherwise(F.col("attack_conf"))
    scored = scored.select("flow_id", attack.alias("attack_prob"), "class_name", "class_prob", "mse_loss")
    named = F.when(F.col("class_name") == background, F.lit(0.0)).otherwise(F.col("class_prob"))
    # A confident attack that the classes confidently call background is reported by neither.
    neither = (F.col("attack_prob") >= least) & (F.col("class_prob") >= known) & (F.col("class_name") == background)
    return detect(scored.where(~neither).withColumn("class_prob", named), least, known, anomaly)


def threshold_grid(scored: DataFrame, filters: Sequence[float] = (0.8, 0.85, 0.9, 0.95, 1.0), sigmas: Sequence[float] = (1 / 3, 1 / 2, 1, 2, 3)) -> DataFrame:
    """Balanced accuracy (the area under a hard decision's ROC curve) for each filter and detector threshold.

    Columns of `scored`: is_attack 0/1, filter_pred 0/1, filter_prob, mse_loss. Detector thresholds are mean + s * deviation of the
    background's loss. A row that the filter calls an attack, at its threshold or above, counts as loss 1. One pass: each row meets the
    25 thresholds, then one aggregation.
    """
    stats = scored.where("is_attack = 0").agg(F.avg("mse_loss").alias("m"), F.stddev_samp("mse_loss").alias("s"))
    grid = stats.select(F.explode(F.array(*[F.lit(float(x)) for x in filters])).alias("filter_threshold"), "m", "s")
    grid = grid.select("filter_threshold", F.explode(F.array(*[F.col("m") + F.coalesce("s", F.lit(0.0)) * float(x) for x in sigmas])).alias("detector_threshold"))
    fires = (F.col("filter_pred") == 1) & (F.col("filter_prob") >= F.col("filter_threshold"))
    loss = F.when(fires, F.lit(1.0)).otherwise(F.col("mse_loss"))
    hit = (loss >= F.col("detector_threshold")).cast("int")
    rows = scored.crossJoin(F.broadcast(grid)).select("filter_threshold", "detector_threshold", "is_attack", hit.alias("hit"))
    rate = lambda y: F.avg(F.when(F.col("is_attack") == y, F.when(F.col("hit") == y, 1.0).otherwise(0.0)))
    return rows.groupBy("filter_threshold", "detector_threshold").agg(((rate(1) + rate(0)) / 2).alias("auc"))


def best_thresholds(grid: DataFrame) -> DataFrame:
    """The pair of thresholds with the greatest area; of equal ones the least detector threshold, then the least filter threshold."""
    return grid.orderBy(F.col("auc").desc(), "detector_threshold", "filter_threshold").limit(1)


def confusion(rows: DataFrame, truth: str, found: str) -> DataFrame:
    return rows.groupBy(truth, found).agg(F.count("*").alias("n"))


def report(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision, recall and F1 per class from the confusion counts."""
    cells = confusion(rows, truth, found)
    right = cells.where(F.col(truth) == F.col(found)).select(F.col(truth).alias("label"), F.col("n").alias("tp"))
    real = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"))
    said = cells.groupBy(F.col(found).alias("label")).agg(F.sum("n").alias("predicted"))
    out = real.join(said, "label", "full").join(right, "label", "left").na.fill(0)
    p, r = F.try_divide("tp", "predicted"), F.try_divide("tp", "support")
    return out.select("label", "support", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums; equal scores share their mean rank. Counts per score are aggregated first, and
    ranked in ranges of scores."""
    per = rows.groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    ranked = ranks.before(per, score, "n", name="rank").withColumn("rank", F.col("rank") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    return total.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("t") - F.col("p"))).alias("auc"))


def kmeans_grid(rows: DataFrame, features: Sequence[str], ks: Sequence[int], seeds: Sequence[int] = (1, 2)) -> tuple[DataFrame, dict[int, list[list[float]]]]:
    """For each k the best of several seeds: (k, inertia) and the cluster centres."""
    data = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(spread(rows)).select("__x").cache()
    found, centres = [], {}
    try:
        for k in ks:
            models = [KMeans(k=k, seed=s, featuresCol="__x", maxIter=20).fit(data) for s in seeds]
            best = min(models, key=lambda x: x.summary.trainingCost)
            found.append((k, float(best.summary.trainingCost)))
            centres[k] = [list(map(float, c)) for c in best.clusterCenters()]
    finally:
        data.unpersist()
    return rows.sparkSession.createDataFrame(found, "k int, inertia double"), centres


def few_rows(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """A table of addresses as a matrix on the driver for dbscan and k_medoids, whose memory grows with its rows: eight bytes a number."""
    got = rows.select(*[F.col(c).cast("double") for c in columns]).toArrow()
    return np.stack([got[c].to_numpy() for c in columns], 1)


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Density clustering of a matrix; -1 is noise. Clusters are numbered by their first core row; a border row is in the first that reaches it.

    Exact, over a grid whose cells are so small that rows of one are neighbours: only rows of cells with fewer than `least` count their
    neighbours, and of two cells one near pair is looked for. Memory grows with the rows, not with their pairs.
    """
    n, d = x.shape
    if not n:
        return np.full(0, -1)
    side = eps / np.sqrt(d) * (1 - 1e-9)
    cells, cell = np.unique(np.floor((x - x.min(0)) / side).astype(np.int64), axis=0, return_inverse=True)
    cell = cell.reshape(-1)
    size = np.bincount(cell)
    rows, ends = np.argsort(cell, kind="stable"), np.cumsum(size)
    inside = lambda c: rows[ends[c] - size[c] : ends[c]]
    reach = range(-int(np.ceil(np.sqrt(d))) - 1, int(np.ceil(np.sqrt(d))) + 2)
    steps = [o for o in product(reach, repeat=d) if sum(max(abs(v) - 1, 0) ** 2 for v in o) * side * side <= eps * eps * (1 + 1e-6)]
    steps.sort(key=lambda o: sum(v * v for v in o))
    place = {c: i for i, c in enumerate(map(tuple, cells.tolist()))}

    def beside(c: int) -> np.ndarray:
        """Rows of the cells that may hold neighbours."""
        at = cells[c].tolist()
        found = [place[k] for o in steps if (k := tuple(a + b for a, b in zip(at, o))) in place]
        return np.concatenate([inside(f) for f in found])

    def is_near(i: int, others: np.ndarray) -> np.ndarray:
        return ((x[others] - x[i]) ** 2).sum(1) <= eps * eps

    core, near = size[cell] >= least, {}
    for c in np.flatnonzero(size < least):
        others = beside(c)
        for i in inside(c):
            near[i] = others[is_near(i, others)]
            core[i] = len(near[i]) >= least
    cores = [own[core[own]] for own in map(inside, range(len(cells)))]
    root = np.arange(len(cells))

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    def touch(a: np.ndarray, b: np.ndarray) -> bool:
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        return any(is_near(i, b).any() for i in a)

    filled = np.array([len(own) > 0 for own in cores])
    for o in steps:
        if o <= (0,) * d:  # each pair of cells once
            continue
        while (root[root] != root).any():
            root = root[root]
        wanted = cells + np.array(o)
        other = np.array([place.get(k, -1) for k in map(tuple, wanted.tolist())])
        for a in np.flatnonzero((other >= 0) & filled):
            b = other[a]
            if filled[b] and root[a] != root[b] and (s := top(a)) != (t := top(b)) and touch(cores[a], cores[b]):
                root[max(s, t)] = min(s, t)
    while (root[root] != root).any():
        root = root[root]
    label = np.full(n, -1)
    at = np.flatnonzero(core)
    groups, first, group = np.unique(root[cell[at]], return_index=True, return_inverse=True)
    label[at] = np.argsort(np.argsort(first))[group.reshape(-1)]
    for i, others in near.items():
        if not core[i] and (found := others[core[others]]).size:
            label[i] = label[found].min()
    return label


def medoid(x: np.ndarray) -> int:
    """The row whose distances to all others have the least sum, without comparing all pairs.

    The sum is convex, so at each row that was tried its tangent plane bounds all rows from below; the row with the least bound is tried
    next, until no bound is under the best sum.
    """
    bound, best, found = np.full(len(x), -np.inf), np.inf, 0
    at = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    while True:
        apart = x[at] - x
        far = np.sqrt((apart**2).sum(1))
        total = far.sum()
        if total < best or (total == best and at < found):
            best, found = total, at
        slope = (apart / np.where(far > 0, far, 1.0)[:, None]).sum(0)
        np.maximum(bound, total - apart @ slope, out=bound)
        bound[at] = np.inf
        at = int(bound.argmin())
        if not bound[at] < best * (1 - 1e-12):
            return found


def k_medoids(x: np.ndarray, k: int, seed: int = 7, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Labels and medoid rows of a matrix by alternating assignment and medoid choice. Memory grows with the rows times k."""
    rng = np.random.default_rng(seed)
    apart = lambda rows: np.stack([np.sqrt(((x - x[m]) ** 2).sum(1)) for m in rows], 1)
    medoids = rng.choice(len(x), k, replace=False)
    for _ in range(rounds):
        label = apart(medoids).argmin(1)
        new = np.array([own[medoid(x[own])] if len(own := np.flatnonzero(label == c)) else medoids[c] for c in range(k)])
        if (new == medoids).all():
            break
        medoids = new
    return apart(medoids).argmin(1), medoids


def quantile_uniform(rows: DataFrame, columns: Sequence[str], knots: int = 1000) -> DataFrame:
    """Map each column to its quantile in [0, 1] by linear interpolation between exact percentile knots."""
    steps = [i / knots for i in range(knots + 1)]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    values = rows.select(F.explode(cells).alias("x")).select("x.*").where("v is not null")
    got = {r["feature"]: r["q"] for r in ranks.quantiles(values, steps, ["feature"]).collect()}  # knots per column

    edges = {c: F.array(*[F.lit(float(x)) for x in got.get(c, [])]).cast("array<double>") for c in columns}

    def mapped(c: str):
        v, below = F.col(c).cast("double"), F.col(f"__below_{c}")
        a, b = F.try_element_at(edges[c], below), F.try_element_at(edges[c], below + 1)
        return F.when(v.isNull(), F.lit(None)).when(below == 0, F.lit(0.0)).otherwise(F.coalesce((below - 1 + (v - a) / (b - a)) / knots, F.lit(1.0)))

    # The value lies over the knot before, at or under the one after.
    rows = rows.withColumns({f"__below_{c}": ranks.below(edges[c], F.col(c).cast("double"), knots + 1) for c in columns})
    return rows.withColumns({c: mapped(c) for c in columns}).drop(*[f"__below_{c}" for c in columns])


def spearman(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Rank correlations of the columns, equal values sharing their mean rank. Values are counted before they are ranked, and rows with equal
    values before they meet their ranks; nulls are an error."""
    v = [f"__v{i}" for i in range(len(columns))]
    known = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(F.col(c).cast("double")).alias(x) for c, x in zip(columns, v)]
    counts = rows.select(*known).groupBy(*v).agg(F.count("*").alias("__n"))
    met = counts
    for x in v:
        per = counts.groupBy(x).agg(F.sum("__n").alias("__m"))
        ranked = ranks.before(per, x, "__m")
        # Ranks from the middle one, which is their mean.
        met = met.join(ranked.select(x, (F.col("before") + (F.col("__m") + 1) / 2).alias(f"__r{x}")), x)
    centre = ((counts.agg(F.sum("__n")).first()[0] or 0) + 1) / 2
    r = [F.col(f"__r{x}") - centre for x in v]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    got = met.agg(*[F.sum(F.col("__n") * r[i] * r[j]) for i, j in pairs]).first()
    out = np.zeros((len(v), len(v)))
    for (i, j), x in zip(pairs, got):
        out[i, j] = out[j, i] = np.nan if x is None else x
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt(np.outer(out.diagonal(), out.diagonal()))
