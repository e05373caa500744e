"""The registered queries: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


@query
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


@query
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import shared_start_trie

    return shared_start_trie(table(spark, sf_dir, "conversations"))


@query
def op13_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_clusters import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, width=64)
