"""The queries of the llm operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import abuse, mixing, names, ocr, packing, pii, places
from quillstone.runtime import table


def p1_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the symmetric-delete index repairs."""
    return ocr.mended(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "ai_requests"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.found(table(spark, sf_dir, "ocr_results"), table(spark, sf_dir, "ai_requests"))


def p2_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by the trie join and the word orders alone."""
    return names.linked(table(spark, sf_dir, "suppliers"), table(spark, sf_dir, "buyers"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each party: its entity."""
    return names.entities(table(spark, sf_dir, "suppliers"), table(spark, sf_dir, "buyers"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(table(spark, sf_dir, "suppliers"), table(spark, sf_dir, "buyers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "responses"), table(spark, sf_dir, "ai_requests"))


def p5_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each address with a street: its location."""
    return places.locations(table(spark, sf_dir, "addresses"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.found(table(spark, sf_dir, "addresses"))


def p6_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches inside the buckets alone, without topping up."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"), top_up=False)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p6_containers(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_method, p1_found, p2_method, p2_found, p2_entities, p4_found, p5_method, p5_found, p6_method, p6_containers, p6_unused, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {}
