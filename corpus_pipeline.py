"""The corpus pipeline: stages over ``documents``, each written and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlift import Workspace
from eventlift.llm import hyperminhash, packing, pii, quality, suffix_dedup

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or the likelihood ratio go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles the one of least id stays; it stays once."""
    found = hyperminhash.near_duplicates(docs, n=5, limit=80)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionAll(left.where("doc_id IS NULL"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by 100 bytes that also start earlier in the corpus are cut out."""
    return _counted(suffix_dedup.without_repeats(docs, length=100))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _counted(pii.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences of at most 4,096."""
    return packing.pack(docs, WORD_BPE, end_id=1, capacity=4096)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]
#: SQL has no twin of the models, sketches and tokenizers; tests hold the stages against fixed cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    workspace = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = workspace.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
