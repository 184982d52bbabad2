"""A training corpus in five stages, each one of the numbered operators at work on what its predecessor kept.

1. quality: documents that the factorisation machine scores under one half go.
2. near duplicates: of each SimHash group the document with the smallest doc_id stays.
3. decontamination: documents that hold a benchmark window go.
4. personal data: entities are replaced by surrogates in the texts.
5. tokens: texts become token ids; what the ids decode to is checked against the text, and exact says whether it is the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import bpe, decontamination, pii, quality, simhash
from tidebook.llm.common import read_table, scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The machine learns from the labelled rows of the documents table, never from held-out ones."""
    return quality.good(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text where the table has it."""
    done = pii.replaced(docs, pii.query_key(spark))
    own = [F.length("text").cast(done.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return done.select(*own)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all texts, digests of ids and of what they decode to, and whether that is the text."""
    found = bpe.encoded(docs, digests=True, checked=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"), F.col("token_ids").alias("ids"), "exact")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", replace_personal_data),
    ("tokens", tokens),
]

#: SQL has no factorisation machine, XXH64 SimHash or BPE; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
