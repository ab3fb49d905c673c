"""A corpus pipeline of five stages: quality, near-duplicates, decontamination, secrets, tokens.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``. Every stage takes
null values in any column, empty and very long texts, repeated rows and empty tables, and leaves other columns out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm import bpe_codec, decontaminate, quality_fm, secret_scan, super_minhash
from sparkclin.llm.common import drop_written, table, written, written_since
from sparkclin.llm.queries import pre_token_pattern, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, trained on the labels, does not reject.

    A null text is scored like an empty one, and equal texts alike whatever their other columns hold.
    """
    return quality_fm.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that shares 0.8 of its shingles of five words.

    Null ids come last in a group, and of rows that tie one stays. Documents without words all stay, whatever their id.
    """
    return super_minhash.deduplicate(docs.select(*COLUMNS), size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; those without words stay, and repeated rows stay or go alike."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blotted out and n_chars counted anew where that changed the text; null texts stay null."""
    clean = secret_scan.redact(docs.select(*COLUMNS).withColumn("__old", F.length("text")))
    return clean.withColumn("n_chars", F.when(F.length("text") != F.col("__old"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left; a null or empty text has none."""
    return bpe_codec.encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), pre_token_pattern())


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", tokens),
]

#: A trained classifier and merges by rank have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder but the last.

    What a stage has read or made on the way is deleted once its own result is written.
    """
    docs, first = table(spark, sf_dir, "documents"), len(written_since())
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            for made in written_since(first):
                if made is not docs:
                    drop_written(made)
    return docs
