"""The queries opN_<name> over the whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import bagminhash, chat, exact_dedup, lm_score, mixing, packing, pii, quality, toxicity
from flowmill.llm.common import prepare, read_documents


VOCABULARY = "byte_bpe_50k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(read_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.ppm_scores(read_documents(spark, sf_dir)).withColumn("mean_score", F.col("score") / F.col("n_tokens"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_ids(read_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_documents(spark, sf_dir).select("doc_id", "text"))
    failed = (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))
    counts = [F.col(f"__{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, failed.alias("base_failed"), (~failed & F.col("__passes")).alias("kept"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_groups(read_documents(spark, sf_dir)).drop("rid")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = F.create_map(*(F.lit(x) for i, k in enumerate(pii.KINDS) for x in (k, i)))

    def listed(spans):
        keyed = F.array_sort(F.transform(spans, lambda x: F.struct(order[x["kind"]].alias("o"), x["start"].alias("a"), x["end"].alias("b"), x["kind"].alias("k"))))
        return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["k"], x["a"].cast("string"), x["b"].cast("string"))), ",")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_documents(spark, sf_dir), digest_all=True).drop("rid")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, machine, name="score")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: A conversation whose texts hold the template's own control strings.
CONTROL = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.read_back(rows.unionByName(extra))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_quality, op3_lm_score, op4_token_ids, op5_mixing, op6_bagminhash, op7_pii, op8_exact_dedup, op9_toxicity, op10_chat)
}

SQL: dict[str, str] = {
    "op10_chat": r"""
        WITH r AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS safe FROM r)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
               CAST(sum(length(role) + length(safe) + 15) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
