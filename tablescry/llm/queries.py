"""The queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, mixing, near_dedup, packing, quality, secret_scan, suffix_dedup, syncmers, vptree, warc
from .common import few_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """The vocabulary that the packing query uses; only the driver needs the file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": lambda spark, d: mixing.mixed_documents(table(spark, d, "documents")),
    "op2_syncmer_prints": lambda spark, d: syncmers.edited_fingerprints(table(spark, d, "documents")),
    "op3_pack_best_fit": lambda spark, d: few_files(packing.packed_documents(table(spark, d, "documents"), tokenizer())),
    "op4_quality_filter": lambda spark, d: few_files(quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))),
    "op5_warc_bundles": lambda spark, d: warc.archived_pages(table(spark, d, "pages")),
    "op6_suffix_dedup": lambda spark, d: few_files(suffix_dedup.without_repeats(table(spark, d, "documents"))),
    "op7_near_dedup": lambda spark, d: few_files(near_dedup.near_duplicates(table(spark, d, "documents"))),
    "op8_line_dedup": lambda spark, d: few_files(line_dedup.deduplicated_lines(table(spark, d, "documents"))),
    "op9_secret_scan": lambda spark, d: secret_scan.found_secrets(table(spark, d, "documents")),
    "op10_vp_neighbours": lambda spark, d: vptree.neighbours(table(spark, d, "embeddings")),
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_bundles": warc.PAGES_SQL,
    "op6_suffix_dedup": suffix_dedup.REPEATS_SQL,
    "op7_near_dedup": near_dedup.NEAR_SQL,
    "op8_line_dedup": line_dedup.LINES_SQL,
}
