"""The registered queries of this subpackage. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescast.llm.context_tree import score_documents
from salescast.llm.decontaminate import contaminated
from salescast.llm.html_extract import extract_main_text
from salescast.llm.license_scan import license_scan
from salescast.llm.merkle_manifest import verified_leaves
from salescast.llm.near_dedup import near_duplicate_groups
from salescast.llm.pivotal_mix import mix_sources
from salescast.llm.quality_repeats import quality_rules
from salescast.llm.reshard import reshard
from salescast.llm.rule_ensemble import quality_scores
from salescast.llm.scratch import modest_batches, scratch_path
from salescast.llm.separator_scan import document_lengths, scan_blocks, write_token_files
from salescast.llm.token_alignment import align_tokenizers
from salescast.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item whose shingles it contains to 75 % or more."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and repetition verdict of every document.

    SQL can tell how many words lie in repeated windows, and whether any repeat is
    longer than the limit; the length of the longest repeat is left out.
    """
    return quality_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document under a byte model of the training documents."""
    return score_documents(_table(spark, sf_dir, "documents"))


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, found in flat token files of all documents."""
    path = scratch_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), path)
    return document_lengths(scan_blocks(spark, path))


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of the sources at weights 5, 2, 1 takes."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, by its own notices or by its directory's.

    The documents are taken as the files of one tree: directories by source, then by
    doc_id in thousands, then in hundreds; the first twenty of a hundred lie a directory
    above. The content tells which of them are licence files.
    """
    docs = _table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id").cast("long")
    hundreds = F.when(doc_id % 100 >= 20, F.floor(doc_id / 100))
    steps = [F.coalesce("source", F.lit("-")), F.floor(doc_id / 1000), hundreds, doc_id]
    path = F.concat_ws("/", *[step.cast("string") for step in steps])
    files = docs.select(doc_id.alias("doc_id"), F.when(doc_id.isNotNull(), path).alias("path"), "text")
    return license_scan(files)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document when 32 shards by text hash become 40 of equal size."""
    placed = reshard(_table(spark, sf_dir, "documents"))
    digest = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"]
    return placed.select(F.col("doc_id").cast("long"), *digest[1:])


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document in a Merkle manifest by source."""
    return verified_leaves(_table(spark, sf_dir, "documents"))


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by weighted rules over its statistics."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups and links of two tokenizers' tokens in every document."""
    return align_tokenizers(_table(spark, sf_dir, "documents")).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_repeats": op2_quality_repeats,
    "op3_context_tree": op3_context_tree,
    "op4_separator_scan": op4_separator_scan,
    "op5_pivotal_mix": op5_pivotal_mix,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_reshard": op9_reshard,
    "op10_html_extract": op10_html_extract,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_rule_ensemble": op12_rule_ensemble,
    "op13_token_alignment": op13_token_alignment,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
