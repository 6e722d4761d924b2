"""The text values problems 3, 5 and 6 look at, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("tbl", "row_key", "pos")


def mrl_answers(mrl: DataFrame, *more: str) -> DataFrame:
    return mrl.select(F.lit("mrl_records").alias("tbl"), F.col("record_id").alias("row_key"), F.lit(-1).alias("pos"), *more, F.col("query").alias("query"), F.col("answer").alias("text"))


def thinks(completions: DataFrame, *more: str) -> DataFrame:
    """One row per interaction, positions from 0; a null or empty array gives none."""
    rows = completions.select("completion_id", "conv_mode", *more, F.posexplode("interactions").alias("pos", "it"))
    return rows.select(F.lit("reasoning_completions").alias("tbl"), F.col("completion_id").alias("row_key"), "pos", "conv_mode", *more, F.col("it.query").alias("query"), F.col("it.think").alias("text"))


def long_values(mrl: DataFrame, completions: DataFrame) -> DataFrame:
    """Key and text of all answers of mrl_records and all thinks; blank ones can't repeat or break off and are left out."""
    a = mrl_answers(mrl).select(*KEY, "text")
    t = thinks(completions).select(*KEY, "text")
    return a.unionByName(t).filter(F.length("text") > 0)
