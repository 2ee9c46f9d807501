"""The queries of the operators in this subpackage, over the whole given tables.

Each query applies its operator with production parameters and derives the digest columns.
``ORACLE`` holds DuckDB twins where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.llm import (
    alignment,
    jaccard_join,
    minhash,
    mixing,
    packing,
    private_data,
    quality,
    suffix_dedup,
    token_counts,
    token_files,
    tree_packing,
    turn_repair,
    url_rules,
)
from newsgauge.plans.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


@query
def op1_near_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_leaders(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return token_files.read_documents(spark, manifest)


@query
def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_spans(table(spark, sf_dir, "documents"))


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"))


ORACLE["op4_url_filters"] = url_rules.ORACLE


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op13_tree_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_packing.packed_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        with_ids=False,
    )


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.Alignment(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    return aligned.documents()
