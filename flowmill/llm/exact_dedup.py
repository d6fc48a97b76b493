"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only texts whose (length, prefix hash) group has a second member get their whole content hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import few_or_shuffled, fixed_rows, free, join_groups, materialize, numbered, scratch, text_of

#: Code points that the prefix hash covers.
PREFIX = 256
#: Keys of groups with copies that may be broadcast: 16 bytes each, 64 MB with hash-table overhead at most.
BROADCAST_KEYS = 1_000_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, rid_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, rid.

    rid is the column rid_col, or else a number drawn in the scan that hashes, good for telling the result's rows apart only.

    Texts are equal when identical; null counts as empty. The row with the largest id stays; of repeated rows
    with that id exactly one does. Null ids rank below all others. text_sha256 is null for rows that an earlier
    level already proved unique, unless digest_all. An empty table gives an empty result; other columns are ignored.

    Levels 1 and 2 are one partial aggregation over (length, prefix hash), so a hot group shrinks to one row
    per task before the shuffle. Texts are never shuffled: the keys of groups with copies come back as a
    broadcast if they are few, and otherwise every row is hashed in the scan, which is cheaper than moving it. A group
    meets its rows by join_groups, so no task gets all rows of a large one.
    """
    keyed = fixed_rows(docs).select(
        F.col(id_col).alias("id"), (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"), text_of(text_col).alias("body")
    ).select("id", "rid", "body", F.octet_length("body").alias("size"))
    keyed = keyed.withColumn("head", F.xxhash64(F.substring("body", 1, PREFIX)))
    shared = materialize(
        keyed.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1").select("size", "head", F.lit(True).alias("again")), "lengths"
    )
    if shared.count() <= BROADCAST_KEYS:
        keyed = keyed.join(F.broadcast(shared), ["size", "head"], "left")
    else:
        keyed = keyed.withColumn("again", F.lit(True))
    again = F.coalesce("again", F.lit(False))
    digest = F.sha2(F.col("body").cast("binary"), 256)
    slim = materialize(
        keyed.select("id", "rid", "size", again.alias("again"), (digest if digest_all else F.when(again, digest)).alias("text_sha256")), "digests"
    )
    alone = slim.where(~F.col("again")).select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "rid"
    )
    rest = slim.where("again")
    # Order of struct fields: id, then the earliest of repeated rows. Only groups of several rows are joined back.
    groups = rest.groupBy("text_sha256").agg(F.max(F.struct("id", (-F.col("rid")).alias("back"))).alias("best"), F.count("*").alias("group_size"))
    joined = join_groups(rest, materialize(groups.where("group_size > 1"), "groups"), "text_sha256", how="left")
    several = F.col("group_size").isNotNull()
    found = joined.select(
        F.col("id").alias(id_col), F.when(several, F.col("best.id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best.back") == -F.col("rid"), F.lit(True)).alias("kept"), "text_sha256", "rid",
    )
    return alone.unionByName(found)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, without the copies: one row for each distinct text.

    Rows are joined by a number written with them, so repeated ids are told apart.
    """
    rid = free(docs, "__rid")
    marked = numbered(docs, rid)
    with scratch() as keep:
        gone = exact_groups(marked, id_col, text_col, rid_col=rid).where(~F.col("kept")).select(F.col("rid").alias(rid))
        gone = keep(materialize(gone, "gone"))
    return marked.join(few_or_shuffled(gone), rid, "left_anti").drop(rid)
