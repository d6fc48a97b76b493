"""Ranks over a whole table without a global window: rows are dealt to ranges of values, summed in each, and offset by the ranges before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a table is dealt to, and the accuracy of their edges (error in rank: one in so many rows).
PARTS, ACCURACY = 64, 10_000


def below(edges: Column, value: Column, size: int) -> Column:
    """How many numbers of a sorted array of at most `size` are less than the value, by halving; 0 for null."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(size, 1).bit_length()))])
    # A place beyond the array is null, and less than nothing.
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < value, at + step).otherwise(at))


def dealt(rows: DataFrame, value: str, keys: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """Adds __range: rows of a smaller range have smaller values, equal values share a range. Nulls are in range 0.

    The edges are approximate quantiles, one row for each key; keys must be few (feature names, labels).
    """
    edges = rows.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], ACCURACY).alias("__edges"))
    rows = rows.join(F.broadcast(edges), list(keys)) if keys else rows.crossJoin(F.broadcast(edges))
    return rows.withColumn("__range", below(F.col("__edges"), F.col(value).cast("double"), parts - 1)).drop("__edges")


def before(rows: DataFrame, value: str, weight: str | None = None, keys: Sequence[str] = (), ties: Sequence[str] = (), name: str = "before", parts: int = PARTS) -> DataFrame:
    """Adds the total weight (default: 1 each) of the rows of the same keys that come before by (value, *ties)."""
    rows = dealt(rows, value, keys, parts)
    each = F.col(weight) if weight else F.lit(1).cast("long")
    ranges = rows.groupBy(*keys, "__range").agg(F.sum(each).alias("__sum"))
    # At most `parts` rows for each key.
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(*keys, "__range", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__range").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(each).over(inside), F.lit(0)))
    return rows.join(F.broadcast(offsets), [*keys, "__range"]).withColumn(name, F.col(name) + F.col("__offset")).drop("__range", "__offset")


def quantiles(values: DataFrame, points: Sequence[float], keys: Sequence[str], value: str = "v", name: str = "q") -> DataFrame:
    """Per key an array of exact quantiles, by linear interpolation between the two nearest ranks; nulls must be left out.

    Equal values are counted before they are ranked, so a value that a third of all rows have is one row.
    """
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranked = before(counts, value, "__n", keys, name="__before")
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    share, last = F.array(*[F.lit(float(p)) for p in sorted(points)]), (F.col("__total") - 1).cast("double")
    # The ranks below and above each point, ascending; a row has those from its first rank to its last.
    wanted = {"__lower": F.transform(share, lambda p: F.floor(p * last)), "__upper": F.transform(share, lambda p: F.ceil(p * last))}
    ranked = ranked.join(F.broadcast(totals.withColumns(wanted)), list(keys))

    def held(wanted: str, name: str) -> Column:
        first, end = (below(F.col(wanted), r, len(points)) for r in (F.col("__before"), F.col("__before") + F.col("__n")))
        # Most rows have none.
        found = F.when(first < end, F.sequence(first, F.greatest(first, end - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(found, lambda i: F.struct(i.alias("i"), F.lit(name).alias("side")))

    hits = ranked.select(*keys, "__total", F.col(value).alias("__v"), F.explode(F.concat(held("__lower", "low"), held("__upper", "high"))).alias("__x"))
    ends = [F.map_from_entries(F.collect_list(F.when(F.col("__x.side") == x, F.struct("__x.i", "__v")))).alias(f"__{x}") for x in ("low", "high")]
    found = hits.groupBy(*keys, "__total").agg(*ends)  # two numbers a point

    def between(i):
        place = F.get(share, i) * last
        return F.element_at("__low", i) + (place - F.floor(place)) * (F.element_at("__high", i) - F.element_at("__low", i))

    places = sorted(range(len(points)), key=lambda i: points[i])
    asked = F.array(*[F.lit(places.index(i)) for i in range(len(points))])
    return found.select(*keys, F.transform(asked, between).alias(name))
