"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlift.llm import (
    byte_bpe,
    html_labeller,
    hyperminhash,
    id_codec,
    lexical_search,
    packing,
    periodic_runs,
    pii,
    pivot_topk,
    quality,
    suffix_dedup,
    token_counts,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(documents, BYTE_RANKS, public_tokenizers.PATTERN)


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_codec.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_topk.top_k(vectors, vectors["vec_id"] % 20 == 0, k=20, scale=64.0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE, limit=2048)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labeller.extract(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, limit=80)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, rules).drop("score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, capacity=4096)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.toDF("item_id", "rank", "doc_id", "score")


def with_periods(documents: DataFrame) -> DataFrame:
    """Every tenth document by checksum of its id goes on periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    named = documents.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    placed = named.selectExpr("*", "size(words) AS n", "g % nullif(size(words), 0) AS a")
    placed = placed.selectExpr("*", "1 + (n - a) DIV (3 + g % 8) AS p")
    times = "array_repeat(slice(words, CAST(a + 1 AS INT), CAST(p AS INT)), CAST(1 + (n - a) DIV p AS INT))"
    again = f"slice(concat(slice(words, 1, CAST(a AS INT)), flatten({times})), 1, n)"
    return placed.selectExpr("doc_id", f"CASE WHEN n > 0 THEN array_join({again}, ' ') ELSE text END AS text")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(with_periods(table(spark, sf_dir, "documents")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


OPERATORS = [
    op1_byte_bpe,
    op2_id_files,
    op3_pivot_topk,
    op4_token_counts,
    op5_suffix_dedup,
    op6_html_text,
    op7_near_duplicates,
    op8_pii,
    op9_quality_rules,
    op10_best_fit_packing,
    op11_lexical_search,
    op12_periodic_runs,
    op13_warc,
]
QUERIES: dict[str, Query] = {f.__name__: f for f in OPERATORS}
