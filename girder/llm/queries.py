"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from girder.llm import bpe_automaton, id_files, media_boxes, pii_crf, simhash_tiles, site_quality, source_mix, spot_sigs, substring_dedup, tag_paths
from girder.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.digests(table(spark, sf_dir, "documents"))


def op3_spot_sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_sigs.digests(table(spark, sf_dir, "documents"))


def op4_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.digests(table(spark, sf_dir, "pages"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(table(spark, sf_dir, "documents"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.digests(spark, sf_dir)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(table(spark, sf_dir, "documents"))


def op8_media_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_boxes.digests(table(spark, sf_dir, "documents"))


def op9_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.digests(table(spark, sf_dir, "documents"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.digests(table(spark, sf_dir, "documents"))


def spot_sigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3's likeness join: the length-partitioned comparison of all fingerprints."""
    return spot_sigs.linked(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_pii_crf, op3_spot_sigs, op4_tag_paths, op5_bpe_automaton, op6_site_quality, op7_source_mix, op8_media_boxes, op9_simhash_tiles, op10_id_files, spot_sigs_links)}
#: The other operators are held against brute force in the tests: SQL has no fitted models, tokenizers, XXH64 or CRC-32.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": substring_dedup.SQL, "op3_spot_sigs": spot_sigs.SQL, "op7_source_mix": source_mix.SQL}
