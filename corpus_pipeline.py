"""From raw documents to a mixed, encoded training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.llm import jaccard, langid, linededup, mixing, pieces
from parchwork.llm.text import n_words
from parchwork.session import attach, stored, table

#: The SentencePiece model of the last stage.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in none of the languages that the documents are marked with."""
    attach(spark)
    return langid.accept(docs, langid.train(docs)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks of lines that earlier documents have, and documents of which no word is left."""
    attach(spark)
    found = linededup.dedup_lines(docs.select(COLUMNS))
    left = found.where((F.col("deleted_lines") == 0) | (n_words(F.col("text")) > 0))
    return left.withColumn("n_chars", F.when(F.col("deleted_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates."""
    attach(spark)
    return jaccard.representatives(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, up to three times each, until the sources have their shares of all words."""
    attach(spark)
    return mixing.take(docs.select(COLUMNS)).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document of the mix."""
    attach(spark)
    return pieces.encode_documents(docs, pieces.read_model(MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the learned profiles nor the patience alignment nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
