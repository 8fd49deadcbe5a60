"""A corpus pipeline: language, repeated lines, near-duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next. All but the last
return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.llm import byte_bpe, decontam, langid, line_dedup, simhash
from parcelyard.llm.common import looked_up, saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes if no language is told, or its phrases are less than this share as long as is usual in its language.
LEAST_SCORE = 0.5
#: Words in a shingle of the near-duplicate stage, and the least similarity of two texts that belong together.
SHINGLE, SIMILAR = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay; lang stays as it was given. Null texts and those without a letter go."""
    rows = docs.select(*COLUMNS)
    train = rows.where(langid.remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")
    told = langid.identify(rows, langid.sample_languages(train))
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the lines that repeat, within the edits, the first stays; texts left without a line go.

    Null and blank texts stay. Of rows with one doc_id (null is one) and one
    text a single one stays; rows with one doc_id and different texts are
    documents of their own.
    """
    rows = line_dedup.without_repeated_lines(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id, a null one last.

    Null and empty texts are equal to each other. Rows of one doc_id are
    documents of their own if their texts differ, and one document if not.
    """
    return simhash.one_of_each(docs.select(*COLUMNS), words=SHINGLE, least=SIMILAR).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay; each row is judged by itself, whatever its doc_id."""
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", F.lit(0), "text").alias("row"))
    leaked = decontam.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row").select("row").distinct()
    return looked_up(rows, saved(leaked, "leaked"), "row", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ids, the byte-level BPE ids of the text; a null text has none."""
    return byte_bpe.encode_texts(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("encoded", encoded)]

#: Language identification, SimHash and BPE are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
