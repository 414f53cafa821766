"""The queries of the training-data operators: op1 to op10, and the pipeline of corpus_pipeline.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import common, exact_dedup, html_blocks, line_rules, minhash, packing, pii, quality, simple8b, toxicity, trie_bpe

Query = Callable[[SparkSession, str], DataFrame]


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = simple8b.write_tokens(common.table(spark, sf_dir, "documents"), end_id=2)
    return simple8b.read_tokens(blocks, with_ids=False)


def _judged(scores: DataFrame, modulus: int, rest: int, threshold: float) -> DataFrame:
    held = common.crc32_of(F.col("doc_id")) % modulus == rest
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return _judged(toxicity.score(docs, model), 3, 1, toxicity.THRESHOLD)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(common.table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = trie_bpe.encode_decode(common.table(spark, sf_dir, "documents"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return _judged(quality.score(docs, quality.fit(docs, labels)), 4, 2, 0.7)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(common.table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), end_id=1)


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.assess(common.table(spark, sf_dir, "documents"), clean=False)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simple8b, op2_toxicity, op3_exact_dedup, op4_bpe_trie, op5_pii, op6_quality, op7_html_text, op8_packing, op9_line_rules, op10_minhash, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": """
            WITH d AS (
                SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content
                FROM documents
            ), g AS (
                SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id,
                       count(*) OVER (PARTITION BY content) AS group_size
                FROM d
            )
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
        """,
    }
