"""Queries of the subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from beaconlake.llm import alignment, bpe, embed_dedup, line_dedup, mixing, ngram_join, quality, records, secret_scan, shards, substring, token_rollup, whitening

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda spark, sf_dir: table(spark, sf_dir, "documents")
    return {
        "op1_embed_dedup": lambda spark, sf_dir: embed_dedup.op1_embed_dedup(table(spark, sf_dir, "embeddings")),
        "op2_records": lambda spark, sf_dir: records.op2_records(docs(spark, sf_dir), TOKENIZER),
        "op3_line_dedup": lambda spark, sf_dir: line_dedup.op3_line_dedup(docs(spark, sf_dir)),
        "op4_quality": lambda spark, sf_dir: quality.op4_quality(docs(spark, sf_dir)),
        "op5_substring": lambda spark, sf_dir: substring.op5_passages(docs(spark, sf_dir)),
        "op6_ngram_join": lambda spark, sf_dir: ngram_join.op6_ngram_join(docs(spark, sf_dir)),
        "op7_token_rollup": lambda spark, sf_dir: token_rollup.op7_token_rollup(docs(spark, sf_dir)),
        "op8_shards": lambda spark, sf_dir: shards.op8_shards(docs(spark, sf_dir)),
        "op9_mixing": lambda spark, sf_dir: mixing.op9_mixing(docs(spark, sf_dir)),
        "op10_bpe": lambda spark, sf_dir: bpe.token_digests(docs(spark, sf_dir), TOKENIZER),
        "op11_alignment": lambda spark, sf_dir: alignment.op11_alignment(docs(spark, sf_dir), TOKENIZER, PIECES),
        "op12_whitening": lambda spark, sf_dir: whitening.op12_whitening(table(spark, sf_dir, "embeddings")),
        "op13_secrets": lambda spark, sf_dir: secret_scan.op13_secrets(docs(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_token_rollup": token_rollup.OP7_SQL}
