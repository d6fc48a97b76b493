"""Shuffles, splits and samples with a seed. Draws hash a key, so that reruns and retried tasks agree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.operators import ranks

#: Buckets in which the rows of a label are numbered.
BUCKETS = 1024


def draw(seed: int, *keys: str) -> Column:
    """Uniform in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def split(rows: DataFrame, shares: Mapping[str, float], seed: int, *keys: str) -> DataFrame:
    """Adds `part` by one draw per row; shares must add up to 1."""
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares must be positive and add up to 1")
    u, edge, part = draw(seed, *keys), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        edge += shares[name]
        part = F.when(u <= edge, name) if part is None else part.when(u <= edge, name)
    return rows.withColumn("part", F.lit(names[-1]) if part is None else part.otherwise(names[-1]))


def stratified_cap(rows: DataFrame, cap: int, seed: int, keys: list[str], strata: list[str]) -> DataFrame:
    """At most `cap` rows of each stratum, those with the smallest draws. The cap is the feature."""
    order = Window.partitionBy(*strata).orderBy(draw(seed, *keys), *keys)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= cap).drop("__r")


def balanced(rows: DataFrame, per_label: int, seed: int, keys: list[str], label: str = "label", background: str = "background") -> DataFrame:
    """Draw `per_label` rows with replacement from each attack label and as many in all from the background; adds `binary` 0/1.

    Rows are dealt to BUCKETS by hash and numbered in each, so no task sees all rows of a label; each draw picks a place among the
    label's rows by hash, which names a bucket and a number in it.
    """
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    numbered = rows.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__b").orderBy(*keys)) - 1)
    counts = rows.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(label).orderBy("__b"))  # BUCKETS rows a label
    ends = counts.withColumn("__end", upto).groupBy(label).agg(F.sort_array(F.collect_list(F.struct("__end", "__b", "__n"))).alias("__ends"), F.sum("__n").alias("__size"))
    sizes = ends
    attacks = sizes.agg(F.count_if(F.col(label) != background)).first()[0]
    wanted = F.when(F.col(label) == background, F.lit(per_label * attacks)).otherwise(F.lit(per_label))
    draws = sizes.withColumn("__d", F.explode(F.sequence(F.lit(1), F.greatest(wanted, F.lit(1))))).where(wanted > 0)
    draws = draws.withColumn("__p", F.pmod(F.xxhash64(F.lit(seed), label, "__d"), F.col("__size")))
    draws = draws.withColumn("__e", F.element_at(F.filter("__ends", lambda e: e["__end"] > F.col("__p")), 1))
    draws = draws.select(label, F.col("__e.__b").alias("__b"), (F.col("__p") - F.col("__e.__end") + F.col("__e.__n")).cast("int").alias("__r"), "__d")
    return draws.join(numbered, [label, "__b", "__r"]).withColumn("binary", (F.col(label) != background).cast("int")).drop("__b", "__r", "__d")


def split_addresses(activity: DataFrame, low: int, high: int, technique: str, ratio: float = 8 / 3, seed: int = 0) -> DataFrame:
    """Addresses with activity in [low, high], ordered by technique, dealt to train and test: every (round(ratio)+1)-th is test."""
    orders = {"mostactive": -F.col("packets"), "leastactive": F.col("packets"), "random": draw(seed, "ip")}
    step = round(ratio) + 1
    chosen = activity.where(F.col("packets").between(low, high)).withColumn("__o", orders[technique])
    ranked = ranks.before(chosen, "__o", ties=["ip"], name="__rank")
    return ranked.withColumn("part", F.when(F.pmod(F.col("__rank") + 1, F.lit(step)) == 0, "test").otherwise("train")).drop("__o", "__rank")
