"""Problem 4: cutoff keeping a target fraction.

Method: sketch-bracketed exact selection.  A quantile sketch with a guaranteed rank
error brackets each source's cutoff; records above the bracket are only counted,
and only records inside it are ordered, after equal scores have been added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRID = 200  # quantiles of the sketch
MOST_TARGETS = 100_000  # sources whose brackets are broadcast (24 bytes and the sketch's ends each)
ACCURACY = 2000  # its rank error is at most n / ACCURACY


def cutoffs(rows: DataFrame, targets: DataFrame, source: str, score: str, percent: str) -> DataFrame:
    """source, cutoff, n_kept, n: the highest observed score such that at least `percent` of a source's rows reach it.

    Rows with null source or score don't count.  A source without rows or target has no
    row; with a target of 0 or less the highest score is the cutoff.  Ties are kept whole.
    """
    r = rows.select(F.col(source).alias("s"), F.col(score).alias("v")).filter(F.col("s").isNotNull() & F.col("v").isNotNull())
    want = targets.select(F.col(source).alias("s"), F.col(percent).alias("p")).filter(F.col("s").isNotNull() & F.col("p").isNotNull()).dropDuplicates(["s"])
    grid = [i / GRID for i in range(GRID + 1)]
    sketch = r.groupBy("s").agg(F.percentile_approx("v", grid, ACCURACY).alias("q"), F.count("*").alias("n")).join(want, "s")
    # Rank from below of the wanted record, and the grid cells around it by more than the sketch's error.
    below = F.greatest(F.lit(0.0), 1 - F.col("p") / 100.0)
    lo = F.greatest(F.lit(0), F.floor(below * GRID).cast("int") - 1)
    hi = F.least(F.lit(GRID), F.ceil(below * GRID).cast("int") + 1)
    bracket = sketch.select("s", "n", "p", F.col("q")[lo].alias("low"), F.col("q")[hi].alias("high"), (lo == 0).alias("open_low"), (hi == GRID).alias("open_high"))
    # One row a target: sent to the records while there are few, so that these stay where they are.
    b = r.join(F.broadcast(bracket) if want.count() <= MOST_TARGETS else bracket, "s")
    above = ~F.col("open_high") & (F.col("v") > F.col("high"))
    inside = ~above & (F.col("open_low") | (F.col("v") >= F.col("low")))
    counted = b.filter(above | inside).groupBy("s", "n", "p", F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("s").orderBy(F.col("v").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("at_least", F.sum("c").over(w)).filter(F.col("v").isNotNull() & (F.col("at_least") * 100 >= F.col("n") * F.col("p")))
    return ranked.groupBy("s", "n").agg(F.max_by(F.struct("v", "at_least"), "v").alias("x")).select(F.col("s").alias(source), F.col("x.v").alias("cutoff"), F.col("x.at_least").alias("n_kept"), "n")


def latest(completions: DataFrame) -> DataFrame:
    """One row per completion_id: that of the latest ingested_at; of equal times, the row with the greatest values."""
    row = F.struct("ingested_at", "_subset", "overall_score")
    return completions.filter(F.col("completion_id").isNotNull()).groupBy("completion_id").agg(F.max(row).alias("r")).select("completion_id", "r._subset", "r.overall_score")


def subset_cutoffs(completions: DataFrame, targets: DataFrame, low: int = 1, high: int = 10) -> DataFrame:
    """(_subset, cutoff, n_kept) with cutoff in low..high; a subset for which no such cutoff keeps its share has no row."""
    rows = latest(completions).withColumn("overall_score", F.when(F.col("overall_score") > high, high).otherwise(F.col("overall_score")))
    c = cutoffs(rows, targets, "_subset", "overall_score", "target_pct")
    return c.filter(F.col("cutoff") >= low).select("_subset", F.col("cutoff").cast("int").alias("cutoff"), F.col("n_kept").cast("long").alias("n_kept"))
