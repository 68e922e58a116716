"""The registered queries of this package: thin forms of its operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.llm import forest, jaccard, langid, linededup, mixing, pieces, pii, quadratic, quality_rules, secrets
from parchwork.llm import spans as S
from parchwork.llm.text import crc_fold
from parchwork.session import attach, shared_folder, table

#: The SentencePiece model that the queries encode with.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    return pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.read_model(MODEL))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text", "source")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    # two arrivals: the second scan does only those blobs that the first has not seen
    late = F.coalesce(crc_fold(F.col("path"), 2) == 1, F.lit(False))
    folder = f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    secrets.update(versions.where(~late), folder)
    found = secrets.findings(versions, secrets.update(versions.where(late), folder))
    kinds = {r.name: F.col(f"found_{r.name}") for r in secrets.RULES}
    base = {k: kinds[k] for k in secrets.BASE}
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(S.written(base, by_start=True), 256).alias("base_sha256"), S.written(kinds, by_start=True).alias("spans"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    stats = quadratic.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    model = quadratic.fit(stats.where(~held_out), labels)
    scored = stats.select("doc_id", held_out.alias("held_out"), quadratic.score(F.col("stats"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = {k: F.col(f"found_{k}") for k in pii.BASE}
    kinds = base | {k: F.col(f"found_{k}") for k in pii.PROPOSED}
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()]
    every = sum((F.size(c) for c in kinds.values()), F.lit(0)).cast("long")
    return found.select("doc_id", *counts, F.sha2(S.written(base, by_start=False), 256).alias("base_sha256"), S.written(kinds, by_start=False).alias("spans"), every.alias("n_spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    profiles = langid.train(docs.where(~held_out))
    found = langid.predict(F.col("text"), profiles)
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return forest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_personal_data": op8_personal_data,
    "op9_language_id": op9_language_id,
    "op10_hash_prefix_forest": op10_hash_prefix_forest,
}

SQL: dict[str, str] = {
    "op4_mix_sources": mixing.SQL,
    "op5_jaccard_join": jaccard.SQL,
    "op6_secret_ledger": secrets.SQL,
    "op10_hash_prefix_forest": forest.SQL,
}
