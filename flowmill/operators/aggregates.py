"""Grouped statistics built from two-stage aggregations: entropy, majority, port shares, tumbling source features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions import scalars

# Service ports whose shares are features, in feature order; all others share one more slot.
COMMON_PORTS = (20, 21, 22, 23, 25, 50, 51, 53, 67, 68, 69, 80, 110, 119, 123, 135, 136, 137, 138, 139, 143, 161, 162, 389, 443, 3389)
# Ranges that the composed feature vector is normalised by.
FEATURE_RANGES = {
    "mean_duration": (0.0, 2042.86), "mean_packet": (1.0, 109214.27272727272), "mean_num_of_bytes": (28.0, 163795638.0909091),
    "mean_packet_rate": (0.0, 17224.14377310265), "mean_byte_rate": (0.0, 13902452.340182647), "std_duration": (0.0, 562.7625560888366),
    "std_packet": (0.0, 370614.95468242496), "std_num_of_bytes": (0.0, 543247494.7844237), "std_packet_rate": (0.0, 15783.66319664221),
    "std_byte_rate": (0.0, 16441139.793386225), "entropy_protocol": (0.0, 2.260220915066596), "entropy_dst_ip": (0.0, 13.787687869067254),
    "entropy_src_port": (0.0, 14.206227931544092), "entropy_dst_port": (0.0, 14.027301292191831), "entropy_flags": (0.0, 4.631615665225586),
}
MEASURES = ("duration", "packet", "num_of_bytes", "packet_rate", "byte_rate")
SYMBOLS = ("protocol", "dst_ip", "src_port", "dst_port", "flags")


def entropy(rows: DataFrame, keys: Sequence[str], value: str, base: float | None = None, name: str = "entropy") -> DataFrame:
    """Shannon entropy of `value` per key: counts per (key, value), then one sum; natural logarithm unless a base is given."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return entropy_of_counts(counts, keys, "__n", base, name)


def entropy_of_counts(counts: DataFrame, keys: Sequence[str], n: str, base: float | None = None, name: str = "entropy") -> DataFrame:
    """H = log N - sum(n log n) / N needs no second pass over the counts."""
    scale = F.lit(1.0) if base is None else F.lit(1.0) / F.log(F.lit(float(base)))
    c, total = F.col(n).cast("double"), F.sum(n).cast("double")
    h = F.log(total) - F.sum(F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))) / total
    # Rounding may leave a tiny negative for a single value.
    return counts.groupBy(*keys).agg((F.greatest(h, F.lit(0.0)) * scale).alias(name))


def majority(rows: DataFrame, keys: Sequence[str], value: str, name: str = "label") -> DataFrame:
    """The value that more than half of a key's rows have, else null."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    top = F.max_by(value, "__n")
    return counts.groupBy(*keys).agg(F.when(F.max("__n") * 2 > F.sum("__n"), top).alias(name))


def port_shares(port: str, known: Sequence[int] = COMMON_PORTS) -> Column:
    """Array of the shares of the known ports and of all others: an aggregate without a user function."""
    shares = [F.avg(F.when(F.col(port) == p, 1.0).otherwise(0.0)) for p in known]
    return F.array(*shares, F.avg(F.when(F.col(port).isin(*known), 0.0).otherwise(1.0)))


def tumbling_features(rows: DataFrame, window_s: int = 180, least: int = 10) -> DataFrame:
    """Per (time_window, src_ip): means, sample deviations, log2 entropies, port shares and the majority label.

    Input columns: timestamp (epoch seconds), duration, src_ip, dst_ip, src_port, dst_port, protocol, flags, packet, num_of_bytes,
    label. Groups of fewer than `least` flows are left out; missing numbers become 0.
    """
    keys = ["time_window", "src_ip"]
    rows = rows.withColumn("time_window", scalars.time_bucket(F.col("timestamp"), window_s))
    rows = rows.withColumn("packet_rate", scalars.safe_rate(F.col("packet"), F.col("duration"))).withColumn("byte_rate", scalars.safe_rate(F.col("num_of_bytes"), F.col("duration")))
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("num_flow"), *[F.avg(m).alias(f"mean_{m}") for m in MEASURES], *[F.stddev_samp(m).alias(f"std_{m}") for m in MEASURES],
        port_shares("src_port").alias("proportion_src_port"), port_shares("dst_port").alias("proportion_dst_port"),
    ).where(F.col("num_flow") >= least)
    # All entropies and the majority come from one count of (key, column, value): the flows are read twice, not once a column.
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in (*SYMBOLS, "label")])
    counts = rows.select(*keys, F.explode(cells).alias("x")).groupBy(*keys, "x.c", "x.v").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    of = lambda c, x: F.when(F.col("c") == c, x)
    bits = lambda c: F.greatest(F.log2(F.sum(of(c, n))) - F.sum(of(c, n * F.log2(n))) / F.sum(of(c, n)), F.lit(0.0)).alias(f"entropy_{c}")
    label = F.when(F.max(of("label", n)) * 2 > F.sum(of("label", n)), F.max_by(of("label", F.col("v")), of("label", n))).alias("label")
    symbols = counts.groupBy(*keys).agg(*[bits(c) for c in SYMBOLS], label)
    return base.join(symbols, keys).drop("num_flow").na.fill(0.0)


def compose_features(features: DataFrame, ranges: dict[str, tuple[float, float]] = FEATURE_RANGES) -> DataFrame:
    """Adds `features`: normalised scalars, then both port-share arrays."""
    scaled = [scalars.rescale(F.col(c), *bounds) for c, bounds in ranges.items()]
    return features.withColumn("features", F.concat(F.array(*scaled), "proportion_src_port", "proportion_dst_port"))


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def stability(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Least, greatest and sample deviation of each metric per key."""
    return rows.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("min", F.min), ("max", F.max), ("std", F.stddev_samp))])


def null_probe(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: nulls and distinct values."""
    wide = rows.agg(*[x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_distinct(c).alias(f"d_{c}"))])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])).alias("x")).select("x.*")


def widest(columns: Sequence[str]) -> Column:
    """Name of the column with a row's greatest value; the first of equal ones."""
    best = F.greatest(*columns)
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.array_position(F.array(*columns), best).cast("int"))


def kernel_density(rows: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    """Gaussian kernel density (place, density) of a column at the given points, bandwidth by Scott's rule: two aggregations, whatever the size."""
    v = F.col(value).cast("double")
    size = rows.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("s")).select((F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))  # one row
    bump = lambda x: F.avg(F.exp(-F.pow((v - F.lit(float(x))) / F.col("h"), 2) / 2) / (F.col("h") * F.lit((2 * math.pi) ** 0.5)))
    cells = rows.crossJoin(F.broadcast(size)).agg(F.array(*[F.struct(F.lit(float(x)).alias("place"), bump(x).alias("density")) for x in points]).alias("a"))
    return cells.select(F.explode("a").alias("x")).select("x.*")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return rows.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
