"""Mixing sources to target weights: words per source, repetition rates, floor plus a hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import count_words, materialize, text_of

#: Rates of at most so many sources are broadcast (about 100 bytes each); more are joined by shuffle, salted.
BROADCAST_SOURCES = 100_000
SALTS = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: shares by weight, none above `most` times its source's size.

    `sizes` has (source, source_size), one row for each source. Sources are ranked by code point, null last, and
    weigh `weights`, repeating. What a capped source can't take is reshared by weight among the others until
    none is above its cap. Each round is one aggregation that returns three numbers. Sources without a word
    get a target of 0.
    """
    ranked = materialize(
        sizes.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()), "sources"
    ).withColumn("part", F.shiftright("at", 33)).withColumn("row", F.col("at").bitwiseAND((1 << 33) - 1))
    before, first = 0, {}
    for part, n in sorted((r["part"], r["n"]) for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()):
        first[part] = before  # one entry for each task of the sort
        before += n
    offset = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))[F.col("part")] if first else F.lit(0)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("row") + offset, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    level, total = 0.0, None
    while True:
        capped = F.col("cap") <= level * F.col("weight")
        got = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        total = share * (got["all"] or 0)
        if not got["open"]:
            break
        new = (total - (got["taken"] or 0.0)) / got["open"]
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20240,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The input rows plus __size, __source_size, __target and __copies (how often the mix takes the row).

    Size is the number of words; null text has none; null is a source of its own. A row's copies are
    floor(rate) plus one with probability equal to the fraction, drawn from a hash of (seed, id), so reruns and
    retried tasks agree; repeated rows of one id draw alike, null ids too. An empty table gives an empty result. Input columns
    named like the added ones are replaced. Rates of a bounded number of sources are broadcast;
    beyond that they are joined on (source, salt), so that a hot source spreads over SALTS partitions.
    """
    sized = docs.withColumn("__size", count_words(text_of(text_col)))
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("__size").alias("source_size"))
    rates = materialize(source_targets(sizes, weights, share, most), "rates").withColumnsRenamed(
        {"source": "__source", "source_size": "__source_size", "target": "__target"}
    )
    if rates.count() <= BROADCAST_SOURCES:
        found = sized.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("__source")))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = sized.withColumn("__slot", F.pmod(F.xxhash64(id_col), F.lit(SALTS))).join(
            salted, F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__slot") == F.col("__salt"))
        ).drop("__salt", "__slot")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / float(1 << 53)
    return found.withColumn("__copies", F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).drop("__source")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it, without the helper columns."""
    rows = mixed.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return rows.drop("__size", "__source_size", "__target", "__copies", "__copy")
