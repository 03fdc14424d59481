"""The registered queries of this subpackage: thin wrappers that read whole tables and apply an operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its lines, how many stay, and for each that goes the document and line that stay for it."""
    from .line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, with_text=False).select("doc_id", "n_lines", "n_kept", "removed")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_spans

    return secret_spans(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(_table(spark, sf_dir, "documents"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_html_text, op3_byte_bpe, op4_fingerprints, op5_line_dedup, op6_packing, op7_jaccard_join, op8_secrets, op9_quality, op10_sharding, op11_lm_scores, op12_centroids, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    from . import centroids, jaccard_join, topk_search

    return {"op1_topk_search": topk_search.ORACLE_SQL, "op7_jaccard_join": jaccard_join.ORACLE_SQL, "op12_centroids": centroids.oracle_sql()}
