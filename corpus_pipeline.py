"""A training corpus from ``documents``: five stages, each one operator of ``corridor.llm``.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All stages but the last
keep the columns of ``documents``; the last gives the packed pieces.

Defined results of every stage: empty tables give empty tables; columns beside
doc_id and text are carried along untouched, whatever their names; texts are
read whole; a null or repeated doc_id never fails a row.  What happens to null
and empty texts, null ids and repeated rows is told at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corridor.llm import _spark, op01_language, op05_secrets, op07_jaccard, op08_packing, op10_decontamination

NEAR_WORDS = 5
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language (``und``): null and empty texts and those without a letter.

    Repeated rows and null ids stay.
    """
    _spark.small_batches(spark)
    return op01_language.accept(docs, op01_language.train(docs.where(~op01_language.fold())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked at five words and 0.8.

    Texts without a word are linked with nothing and stay.  Rows without an id stay;
    rows that repeat an id stay or go together.
    """
    _spark.small_batches(spark)
    return op07_jaccard.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, row by row; null and empty texts hold none."""
    return op10_decontamination.clean(docs, _spark.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a rule finds a secret, row by row; null and empty texts hold none."""
    return op05_secrets.without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; one row for each piece.  A null or empty text is its end mark; null ids stay null."""
    _spark.small_batches(spark)
    return op08_packing.pack(docs, op08_packing.default_tokenizer(), keep_words=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _spark.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The network, the alignment and the tokenizer have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None
