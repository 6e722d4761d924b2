"""Greedy near-duplicate removal on word sets, in input order.

A row goes if its word set has a Jaccard similarity of at least the threshold with
an earlier row that stays.  Candidates come from an exact prefix filter: two such
sets share one of their rarest words, so rows meet only under those.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut


def greedy(df: DataFrame, key: str, text: str, threshold: float = 0.9) -> DataFrame:
    """(key, kept): rows without words go; of equal word sets the smallest key decides alone.

    Rounds settle a row as soon as its earlier neighbours are settled; their number is
    bounded by the longest chain of neighbours.
    """
    sets = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(X.words(F.col(text)))).alias("w"))
    distinct = cut(sets.filter(F.size("w") > 0).groupBy("w").agg(F.min("id").alias("id")).withColumn("n", F.size("w")))
    words = distinct.select("id", "n", F.explode("w").alias("t"))
    df_count = words.groupBy("t").agg(F.count("*").alias("f"))
    ranked = words.join(df_count, "t").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("r"))
    prefix = ranked.select("id", "n", F.explode(F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1)).alias("x")).select("id", "n", F.col("x.t").alias("t"))
    # Similar sets are of similar size: their size classes are equal or neighbours, so a frequent word is split by size.
    size = F.floor(F.log(F.col("n").cast("double")) / -math.log(min(threshold, 0.99))).cast("int") if threshold > 0 else F.lit(0)
    a = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "t", size.alias("s"))
    b = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "t", F.explode(F.array(size - 1, size, size + 1)).alias("s"))
    pairs = a.join(b, ["t", "s"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    w = distinct.select("id", "w")
    full = pairs.join(w.toDF("a", "wa"), "a").join(w.toDF("b", "wb"), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    near = cut(full.filter(shared >= threshold * (F.size("wa") + F.size("wb") - shared)).select("a", "b"))
    state = cut(distinct.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        waits = near.join(state.toDF("a", "ka"), "a").groupBy("b").agg(F.max(F.coalesce(F.col("ka"), F.lit(False)).cast("int")).alias("hit"), F.max(F.col("ka").isNull().cast("int")).alias("open"))
        new = state.join(waits, state["id"] == waits["b"], "left")
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit") == 1, False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut(new.select("id", verdict.alias("kept")))
        if not state.filter("kept IS NULL").limit(1).count():
            break
    return sets.join(state, "id", "left").select(F.col("id").alias(key), F.coalesce("kept", F.lit(False)).alias("kept"))
