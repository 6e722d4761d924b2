"""Exact order statistics without bringing an order's rows into one task.

Rows are range-partitioned once and checkpointed; what is known of a partition is one
number, so positions follow from a table with a row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

GRID = 200  # quantiles of a sketch
ACCURACY = 2000  # its rank error is at most n / ACCURACY


def _ranged(df: DataFrame, key: str) -> DataFrame:
    """df in ranges of the key, with the number of each row's range."""
    return cut(df.repartitionByRange(key)).withColumn("_part", F.spark_partition_id())


def key_at(df: DataFrame, key: str, position: int):
    """The key with `position` - 1 smaller distinct keys; the greatest if there are fewer, None if there is none.  Null keys don't count."""
    if position < 1:
        return None
    k = _ranged(df.select(key).filter(F.col(key).isNotNull()).distinct(), key)
    sizes = sorted(tuple(r) for r in k.groupBy("_part").count().collect())
    before = 0
    for part, n in sizes:
        if before + n >= position or part == sizes[-1][0]:
            return k.filter(F.col("_part") == part).select(key).orderBy(key).limit(position - before).agg(F.max(key)).first()[0]
        before += n
    return None


def running_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows with a smaller key (keys are unique); null values count 0."""
    r = _ranged(df, key)
    v = F.coalesce(F.col(value), F.lit(0))
    totals = sorted(tuple(x) for x in r.groupBy("_part").agg(F.sum(v)).collect())
    at, offset = 0, {}
    for part, n in totals:
        offset[part] = at
        at += n
    start = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in offset.items() for x in p)), F.col("_part")), F.lit(0)) if offset else F.lit(0)
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn(name, start + F.coalesce(F.sum(v).over(w), F.lit(0))).drop("_part")


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the exact percentile of `value` (linear between neighbours); null values don't count.

    A sketch with a guaranteed rank error brackets the wanted places; values below a
    bracket are counted, and only those inside are ordered, after equal ones are added up.
    """
    r = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    keys = [F.coalesce(F.col(b).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, b in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    sketch = r.groupBy(*keys).agg(F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("q"), F.count("*").alias("n"))
    want = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()))).alias("w")
    lo, hi = F.floor(F.col("w.p") * GRID).cast("int") - 1, F.ceil(F.col("w.p") * GRID).cast("int") + 1
    bracket = sketch.select(*names, "n", "q", want).select(
        *names, F.col("w.name").alias("name"), (F.col("w.p") * (F.col("n") - 1)).alias("place"),
        F.when(lo >= 0, F.get("q", lo)).otherwise(F.lit(float("-inf"))).alias("low"), F.when(hi <= GRID, F.get("q", hi)).otherwise(F.lit(float("inf"))).alias("high"),
    )
    j = r.select(*by, *keys, "_v").join(bracket, names)
    counted = j.filter(F.col("_v") <= F.col("high")).groupBy(*by, "name", "place", F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by, "name").orderBy(F.col("v").asc_nulls_first())
    placed = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("v IS NOT NULL")
    holds = lambda k: (k >= F.col("upto") - F.col("c")) & (k < F.col("upto"))
    k = F.floor("place")
    got = placed.groupBy(*by, "name", "place").agg(F.max(F.when(holds(k), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil("place")), F.col("v"))).alias("b"))
    one: Column = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, one)).alias(n) for n in shares))
