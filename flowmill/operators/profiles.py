"""Hourly per-address profiles with mergeable sketches, and the features and selection steps of clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import ports, scalars
from flowmill.operators.aggregates import entropy_of_counts

CATEGORIES = len(ports.CATEGORY_IDS)
#: 2^12 buckets keep the sketch's error under 2 %, well inside the 5 % asked for.
SKETCH_BITS = 12
#: Distinct counts, sketched or exact: name and the columns whose joined values are counted.
DISTINCT = {
    "num_uniques_src_port_dst_port": ("port_src", "port_dst"), "num_uniques_dst_ip": ("ip_dst",), "num_uniques_dst_ip_src_port_category": ("ip_dst", "src_cat"),
    "num_uniques_dst_ip_dst_port_category": ("ip_dst", "dst_cat"), "num_uniques_dst_ip_src_port_category_dst_port_category": ("ip_dst", "src_cat", "dst_cat"),
}


def _joined(columns: Sequence[str]) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


def with_categories(flows: DataFrame) -> DataFrame:
    return flows.withColumn("src_cat", ports.port_category_id(F.col("port_src"))).withColumn("dst_cat", ports.port_category_id(F.col("port_dst")))


def hourly_profiles(flows: DataFrame, exact: bool = False) -> DataFrame:
    """One mergeable row per (ip_src, date, hour): flow counts per port category, bytes, flows and distinct counts.

    in_bytes of an address is what its flows' other side sent: the sum of OUT bytes. Distinct counts are sketches, or exact
    numbers (which don't merge) with exact=True.
    """
    at = F.timestamp_millis("start_ms")
    rows = with_categories(flows).withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at))
    count = lambda c, i, n: F.count_if(F.col(c) == i).alias(f"{n}_{i}")
    wide = [count(f"{side}_cat", i, f"num_{side}_ports_cat") for side in ("src", "dst") for i in range(CATEGORIES)]
    if exact:
        many = [F.count_distinct(_joined(c)).alias(n) for n, c in DISTINCT.items()]
    else:
        many = [F.hll_sketch_agg(_joined(c), SKETCH_BITS).alias(n) for n, c in DISTINCT.items()]
    return rows.groupBy("ip_src", "date", "hour").agg(
        F.count("*").alias("num_flows"), F.sum("out_bytes").alias("in_bytes"), F.sum("in_bytes").alias("out_bytes"), *wide, *many
    )


def file_counters(flows: DataFrame) -> DataFrame:
    """Totals of each input file beside every address that occurs in it."""
    totals = flows.groupBy("file").agg(F.count("*").alias("file_flows"), F.sum("in_bytes").alias("file_in_bytes"), F.sum("out_bytes").alias("file_out_bytes"), F.sum("in_pkts").alias("file_pkts"))
    return flows.select("file", "ip_src").distinct().join(totals, "file")


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Hourly rows to one row per address: counters are added, sketches united, then estimated."""
    sums = [c for c in profiles.columns if c in ("num_flows", "in_bytes", "out_bytes") or "_ports_cat_" in c]
    parts = [F.sum(c).alias(c) for c in sums] + [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in DISTINCT]
    return profiles.groupBy("ip_src").agg(*parts)


def profile_features(merged: DataFrame) -> DataFrame:
    """Port-category entropies (natural logarithm) and probabilities of the address's flows, byte ratio and totals."""
    out = merged.withColumn("in_out_bytes_ratio", F.col("in_bytes") / (F.col("out_bytes") + 1)).withColumn("num_total_bytes", F.col("in_bytes") + F.col("out_bytes"))
    for side in ("src", "dst"):
        n = F.array(*[F.col(f"num_{side}_ports_cat_{i}").cast("double") for i in range(CATEGORIES)])
        p = F.transform(n, lambda x: x / F.col("num_flows"))
        h = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))
        out = out.withColumn(f"{side}_ports_entropy", h)
    shares = {f"{side}_port_probability_{i}": F.col(f"num_{side}_ports_cat_{i}") / F.col("num_flows") for side in ("src", "dst") for i in range(CATEGORIES)}
    return out.withColumns(shares)


def with_clusters(features: DataFrame, labels: DataFrame, ip: str = "ip_address", label: str = "cluster_label") -> DataFrame:
    """Features of the clustered addresses with the cluster of each; addresses are unique in both tables."""
    return features.join(labels.select(ip, label), ip)


def busy_addresses(features: DataFrame, more_than: int = 1) -> DataFrame:
    """Addresses with more than so many flows: the rest tell too little to be clustered."""
    return features.where(F.col("num_flows") > more_than)


def bytes_by_hour(profiles: DataFrame) -> DataFrame:
    """48 columns of bytes per (day type, hour); hours without flows are 0."""
    kind, hour = scalars.day_type(F.col("date")), F.col("hour")
    total = F.col("in_bytes") + F.col("out_bytes")
    cells = [F.sum(F.when((kind == k) & (hour == h), total).otherwise(F.lit(0))).alias(f"bytes_{k}_{h}") for k in ("workday", "weekend") for h in range(24)]
    return profiles.groupBy("ip_src").agg(*cells)


def drop_by_prefix(rows: DataFrame, *prefixes: str) -> DataFrame:
    return rows.select(*[c for c in rows.columns if not c.startswith(prefixes)])


def whole_by_prefix(rows: DataFrame, *prefixes: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("long") for c in rows.columns if c.startswith(prefixes)})


def cluster_entropy(assigned: DataFrame, keys: Sequence[str], label: str = "cluster") -> DataFrame:
    """1 / entropy of the cluster sizes per run: low where clusters are evenly filled."""
    counts = assigned.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return entropy_of_counts(counts, list(keys), "n", None, "h").withColumn("inv_entropy", F.try_divide(F.lit(1.0), F.col("h"))).drop("h")


def gradient(rows: DataFrame, order: str, value: str, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Central differences over ordered rows; one-sided at both ends."""
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return rows.withColumn(name, F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2))


def elbow(rows: DataFrame, k: str = "k", inertia: str = "inertia", partition: Sequence[str] = ()) -> DataFrame:
    """Per partition the k at which the second difference of the inertia is greatest, the least of equal ones."""
    once = gradient(rows, k, inertia, "__d1", partition)
    twice = gradient(once, k, "__d1", "__d2", partition)
    return twice.groupBy(*partition).agg(F.max_by(k, F.struct("__d2", -F.col(k))).alias("best_k"))


def best_run(rows: DataFrame, low: int = 5, high: int = 9, feature_set: str = "all") -> DataFrame:
    """The run with the best weighted score of min-max scaled inertia (weight 1) and inverse entropy (weight 2)."""
    chosen = rows.where(F.col("k").between(low, high) & (F.col("feature_set") == feature_set))
    bounds = chosen.agg(*[f(c).alias(f"{n}_{c}") for c in ("inertia", "inv_entropy") for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    scaled = chosen.crossJoin(F.broadcast(bounds))
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))
    score = (unit("inertia") + 2 * unit("inv_entropy")) / 2
    return scaled.withColumn("score", score).drop(*bounds.columns).orderBy("score", "k").limit(1)


def v_measure(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Homogeneity, completeness and V-measure from the contingency table."""
    cells = rows.groupBy(truth, found).agg(F.count("*").cast("double").alias("n"))
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))
    of = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(xlogx(F.col("n"))).alias(name))
    total = cells.agg(F.sum("n").alias("t"), F.sum(xlogx(F.col("n"))).alias("both"))
    one = total.crossJoin(of(truth, "st")).crossJoin(of(found, "sf"))  # one row each
    h = lambda s: F.log("t") - F.col(s) / F.col("t")
    joint = F.log("t") - F.col("both") / F.col("t")
    ratio = lambda given, own: F.when(own <= 1e-12, F.lit(1.0)).otherwise(1 - given / own)
    one = one.select(ratio(joint - h("sf"), h("st")).alias("homogeneity"), ratio(joint - h("st"), h("sf")).alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    return one.withColumn("v_measure", F.when(both > 0, 2 * F.col("homogeneity") * F.col("completeness") / both).otherwise(F.lit(0.0)))
