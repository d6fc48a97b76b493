"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the distinct hashed terms i of a text. The pair part
learns what single terms can't tell, such as an insult together with the mention of a group. Terms that a
likelihood-ratio test finds unrelated to the label, alone and beside the strongest terms, carry no weight, so that a long text's many ordinary words add
no noise. The model is fitted in numpy on a bounded sample; scoring is one narrow pass over whole texts.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import bucket_of, free, materialize, prepare, scratch

BITS = 20
#: Labelled rows the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
FACTORS = 8
#: Terms that may carry weights, at most, and the least likelihood ratio statistic and row count of one.
TERMS, LEAST_RATIO, LEAST_ROWS = 4096, 12.0, 4
#: Terms that may carry weights only for what they say beside one of the strongest, at most, and the least statistic there: a
#: term as common in toxic texts as in others, such as the name of a group, may still turn an insult.
STRONGEST, PAIRED, PAIR_RATIO = 64, 1024, 30.0
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def terms_of(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a whole text: lower-case words without punctuation at their ends."""
    words = {w.strip(_EDGES) for w in set((text or "").lower().split())}
    words.discard("")
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) >> np.uint32(32 - BITS))


@dataclass
class Machine:
    """slots: 0 for terms without weight, else the row of `w` and `v`."""

    bias: float
    slots: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        at = self.slots[terms]
        at = at[at > 0]
        z = self.bias
        if len(at):
            v = self.v[at]
            s = v.sum(0)
            z += self.w[at].sum() + 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _ratio(both: Column, seen: Column, pos: Column, n: Column) -> Column:
    """Likelihood-ratio statistic of presence (seen of n rows, both of them labelled) against a label that pos of n rows have."""
    cells = ((both, seen * pos / n), (seen - both, seen * (n - pos) / n), (pos - both, (n - seen) * pos / n), (n - pos - seen + both, (n - seen) * (n - pos) / n))
    return 2 * sum((F.when(got > 0, got * F.log(got / want)).otherwise(F.lit(0.0)) for got, want in cells), F.lit(0.0))


def _best(counts: DataFrame, key: str, least: float, most: int) -> list[int]:
    """The terms of rows (term, both, seen, pos, n) with the highest statistic, at most `most` of them."""
    scored = counts.where(F.col("seen") >= LEAST_ROWS).select(key, _ratio(*[F.col(c).cast("double") for c in ("both", "seen", "pos", "n")]).alias("ratio")).where(F.col("ratio") >= least)
    return [r[0] for r in scored.groupBy(key).agg(F.max("ratio").alias("ratio")).orderBy(F.col("ratio").desc(), key).limit(most).collect()]


def related(rows: DataFrame) -> list[int]:
    """Terms that tell of the label in rows (label, terms): on their own, or among the rows that have one of the strongest terms.

    All counts are aggregated in the cluster; at most TERMS + PAIRED numbers come to the driver.
    """
    totals = rows.agg(F.count("*").alias("n"), F.sum("label").alias("pos"))  # one row
    presence = [F.count("*").alias("seen"), F.sum("label").alias("both")]
    alone = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(*presence)
    own = _best(alone.crossJoin(F.broadcast(totals)), "term", LEAST_RATIO, TERMS)
    strong = F.array(*[F.lit(x) for x in own[:STRONGEST]]).cast("array<int>")
    within = rows.select("label", "terms", F.explode(F.array_intersect("terms", strong)).alias("strong"))
    sizes = within.groupBy("strong").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))  # STRONGEST rows at most
    beside = within.select("label", "strong", F.explode("terms").alias("term")).groupBy("strong", "term").agg(*presence)
    return own + [x for x in _best(beside.join(F.broadcast(sizes), "strong"), "term", PAIR_RATIO, PAIRED) if x not in set(own)]


def fit(rows: list[np.ndarray], labels: np.ndarray, kept: list[int], epochs: int = 60, rate: float = 0.05, decay: float = 2e-3, seed: int = 7) -> Machine:
    """Logistic loss, Adam on whole batches of the sample, decayed weights; without both labels, the prior alone.

    `rows` hold the kept terms of each row.
    """
    labels = np.asarray(labels, float)
    slots = np.zeros(1 << BITS, np.int32)
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not 0 < share < 1:
        return Machine(bias, slots, np.zeros(1), np.zeros((1, FACTORS)))
    slots[kept] = np.arange(1, len(kept) + 1)
    found = [slots[x] for x in rows]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept) + 1), rng.normal(0, 0.01, (len(kept) + 1, FACTORS))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v, np.zeros(1))]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    col = np.concatenate(found) if found else np.zeros(0, np.int32)
    b = np.array([bias])
    for step in range(1, epochs * 5 + 1):
        vc = v[col]
        sums = np.stack([np.bincount(row, vc[:, f], minlength=len(found)) for f in range(FACTORS)], 1)
        squares = np.bincount(row, (vc * vc).sum(1), minlength=len(found))
        z = b[0] + np.bincount(row, w[col], minlength=len(found)) + 0.5 * ((sums * sums).sum(1) - squares)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(found)
        e = error[row]
        gw = np.bincount(col, e, minlength=len(w)) + decay * w / len(w)
        gv = np.stack([np.bincount(col, e * (sums[row, f] - vc[:, f]), minlength=len(w)) for f in range(FACTORS)], 1) + decay * v / len(w)
        for x, g, m in ((w, gw, moments[0]), (v, gv, moments[1]), (b, np.array([error.sum()]), moments[2])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        w[0], v[0] = 0, 0
    return Machine(float(b[0]), slots, w, v)


def held_out(id_col: str = "doc_id") -> Column:
    return bucket_of(id_col, 4) == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on at most SAMPLE_ROWS labelled rows that aren't held out; null labels and ids are left out.

    An id counts once: of repeated rows with different texts one is taken (that of the least terms), of labels that contradict each other the
    higher. Without labels the model is the prior alone. No text is shuffled: the sampled ids are broadcast (their number is
    bounded), and only the kept terms of a row, TERMS + PAIRED at most, come to the driver.
    """
    prepare(docs.sparkSession)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    sample = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(sample), "id").select(F.col("id").cast("long").alias("id"), "label", "body")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = pa.array([terms_of(x.as_py()).astype(np.int32) for x in b.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), terms], names=["id", "label", "terms"])

    once = rows.mapInArrow(hashed, "id long, label int, terms array<int>").groupBy("id").agg(F.min(F.struct("terms", "label")).alias("x"))
    with scratch():
        once = materialize(once.select("x.label", "x.terms"), "terms")
        kept = related(once)
        wanted = np.array(sorted(kept), np.int32)

        def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                few = [np.intersect1d(x.values.to_numpy(), wanted, assume_unique=True).astype("<i4").tobytes() for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(few, pa.binary())], names=["label", "terms"])

        # The order of collected rows may change from run to run; a fixed one makes the fit repeatable.
        found = sorted((r["label"], bytes(r["terms"])) for r in once.mapInArrow(narrowed, "label int, terms binary").collect())
    return fit([np.frombuffer(x, "<i4") for _, x in found], np.array([y for y, _ in found], float), kept)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "__score") -> DataFrame:
    """The input rows plus the score. Null and empty texts get the score of no terms; repeated rows and null ids are scored as any
    row, an empty table gives an empty result; other columns pass through, one named like the score is replaced.

    The model has at most TERMS rows, so what tasks are sent is bounded.
    """
    spark = prepare(docs.sparkSession)
    at = np.flatnonzero(machine.slots)
    shared = spark.sparkContext.broadcast((machine.bias, at, machine.slots[at], machine.w, machine.v))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, at, to, w, v = shared.value
        slots = np.zeros(1 << BITS, np.int32)
        slots[at] = to
        model = Machine(bias, slots, w, v)
        for texts in parts:
            yield pd.Series([model.score(terms_of(x)) for x in texts], dtype=float)

    return docs.withColumn(name, scored(F.col(text_col)))


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The input rows whose score is below the threshold."""
    name = free(docs, "__score")
    return score(docs, machine, text_col, name).where(F.col(name) < threshold).drop(name)
