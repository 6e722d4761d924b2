"""The queries of problems 1 to 10: name -> (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import consensus, cutoff, leakage, neardup, packing, pairs, repetition, residue, toxicity, truncation
from .values import long_values

Query = Callable[[SparkSession, str], DataFrame]


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "mrl_records"), table(spark, d, "reasoning_completions"), table(spark, d, "judge_log")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_fields(table(spark, d, "mrl_records"))


def p1_templates(spark: SparkSession, d: str) -> DataFrame:
    """Mined templates that are residue, with their kind and number of messages."""
    return residue.classified(residue.templates(residue.parsed(table(spark, d, "mrl_records"))))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "mrl_records"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, d, "mrl_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    mrl, completions, _ = _three(spark, d)
    return pairs.broken_pairs(mrl, completions)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.subset_cutoffs(table(spark, d, "reasoning_completions"), table(spark, d, "subset_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    mrl, completions, _ = _three(spark, d)
    return repetition.repeated_values(mrl, completions)


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    mrl, completions, _ = _three(spark, d)
    return repetition.repetition_shares(long_values(mrl, completions).distinct())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_values(*_three(spark, d))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(*_three(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "judge_log"))[0].select("_eval_id", "score_name", "band")


def p7_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "judge_log"))[1]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.flagged(table(spark, d, "documents"), table(spark, d, "moderation_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(table(spark, d, "documents"), table(spark, d, "moderation_labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_templates, p2_found, p2_classes, p3_found, p4_found, p5_found, p5_shares, p6_found, p6_rates,
        p7_found, p7_annotators, p8_packed, p8_fill, p9_found, p9_items, p10_found, p10_rates,
    )
}
