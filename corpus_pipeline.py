"""A pipeline that turns raw documents into token ids, in stages.

Each stage takes the documents that the one before kept and returns what it
keeps, written as Parquet in the shared folder in between. A document is a row
of doc_id, text, lang, source and n_chars.

1. language: texts without letters, and texts in none of the learned languages, go.
2. near_duplicates: of each group of near copies one document stays.
3. decontaminate: documents with benchmark passages go.
4. redact: personal data is replaced.
5. tokenize: texts become token ids that decode to the same text again.

No SQL can express stages 1, 4 and 5, so there is none for run().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerflow import runtime
from ledgerflow.llm import byte_pairs, decontaminate as decontamination, jaccard, language as languages, personal
from ledgerflow.llm.text import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, with null ids and repeated rows as they are.

    It learns from the rows that have a doc_id, lang and text. Null and empty
    texts and texts without a letter go; if nothing can be learned, all others
    stay. Further columns of docs are left out here and in every stage.
    """
    runtime.ship(spark)
    return languages.keep_written(docs.select(*COLUMNS), languages.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: one whose doc_id names it, and one of rows that are equal in all columns.

    Rows of different texts that share that id all stay only if no link joins
    them. Null and empty texts are linked with nothing, so each stays.
    """
    runtime.ship(spark)
    return jaccard.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands stay; null and empty texts hold none, and an empty benchmark has none."""
    runtime.ship(spark)
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans of personal data become [KIND], n_chars the new length where a text has changed. Null texts stay null."""
    runtime.ship(spark)
    return personal.redact(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token_ids (empty for null and empty texts) and n_tokens; ids decode to the text again."""
    runtime.ship(spark)
    return byte_pairs.append_ids(docs.select(*COLUMNS)).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact), ("tokenize", tokenize)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, runtime.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        runtime.drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
