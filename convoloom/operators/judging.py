"""Analytics over a judge log: latest state, coverage, agreement, bias, kappa, ranking.

Input columns: seq, _eval_id, _model, _status, _subset, _sample_index,
_latency_seconds, _usage, _example_stats, judgment, error_type, error.  Rows
without an _eval_id take no part.  All operators return empty frames for an empty
log; a score that is null counts nowhere, and a statistic without values is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order

SCORES = ("memory_score", "instruction_score", "freshness_score", "overall_score")
LOW, HIGH = 1, 10
PLACES = 3


def rounded(c: Column, places: int = PLACES) -> Column:
    """Half to even."""
    return F.bround(c.cast("double"), places)


def flatten(log: DataFrame) -> DataFrame:
    """Nested log rows as flat columns; a missing sub-object gives nulls."""
    return log.filter(F.col("_eval_id").isNotNull()).select(
        "seq", "_eval_id", "_model", "_status", "_subset", "_sample_index", "_latency_seconds", "_finish_reason", "error_type", "error",
        *(F.col(f"_usage.{c}").alias(c) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")),
        F.col("_example_stats.n_interactions").alias("n_interactions"), F.col("_example_stats.prompt_chars").alias("prompt_chars"),
        F.col("judgment.confidence").alias("confidence"), *(F.col(f"judgment.{s}").alias(s) for s in SCORES),
    )


def latest(log: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """One flat row per model and id: the last ok attempt, else the last attempt.

    Whole rows are compared, so columns that aren't named are not pruned: name those needed.

    One aggregation with map-side combine; no window and no sort.
    """
    f = flatten(log)
    if columns is not None:
        f = f.select(*dict.fromkeys(("seq", "_eval_id", "_model", "_status", *columns)))
    rest = [c for c in f.columns if c not in ("_eval_id", "_model")]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col("_status") == "ok", F.lit(False)), F.col("seq"))).alias("r")
    return f.groupBy("_eval_id", "_model").agg(best).select("_eval_id", "_model", *(F.col(f"r.{c}").alias(c) for c in rest))


def latest_ok(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The last ok attempt per model and id, with the named flat columns only.

    An ok attempt always wins, so the others are filtered before the aggregation, in
    the scan.  Numbers are kept one by one, which leaves a hash aggregation without a sort.
    """
    f = flatten(log.filter(F.col("_status") == "ok")).select("seq", "_eval_id", "_model", *columns)
    return f.groupBy("_eval_id", "_model").agg(F.max("seq").alias("seq"), *(F.max_by(c, "seq").alias(c) for c in columns)).withColumn("_status", F.lit("ok"))


def ok(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("_status") == "ok")


def status_counts(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("_model", "_status").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("_model"))
    return n.select("_model", "_status", "n", total.alias("total"), rounded(100 * F.col("n") / total, 2).alias("pct"))


def error_counts(log: DataFrame) -> DataFrame:
    """Over all attempts, not only the latest."""
    return log.filter((F.col("_status") == "error") & F.col("_eval_id").isNotNull()).groupBy("_model", "error_type", "error").agg(F.count("*").alias("n"))


def score_summary(rows: DataFrame, by: tuple[str, ...] = ("_model",), median: bool = False) -> DataFrame:
    agg = []
    for s in SCORES:
        agg += [F.count(s).alias(f"{s}_count"), rounded(F.avg(s)).alias(f"{s}_mean"), rounded(F.stddev_samp(s)).alias(f"{s}_std")]
        if median:
            agg.append(rounded(F.median(s)).alias(f"{s}_median"))
    return ok(rows).groupBy(*by).agg(F.count("*").alias("n_ok"), *agg)


def _by_id(rows: DataFrame) -> DataFrame:
    """(_eval_id, list of all models' scores): pairs are made inside the row, so ids are shuffled once and not joined."""
    return ok(rows).filter(F.col("_model").isNotNull()).groupBy("_eval_id").agg(F.sort_array(F.collect_list(F.struct("_model", *SCORES))).alias("m"))


def model_pairs(rows: DataFrame) -> DataFrame:
    """One row per id and ordered pair of its models; the number of models bounds the fan-out."""
    x = _by_id(rows).select("_eval_id", F.posexplode("m").alias("i", "l"), "m")
    return x.select("_eval_id", "l", F.explode(F.slice("m", F.col("i") + 2, F.greatest(F.size("m") - F.col("i") - 1, F.lit(0)))).alias("r"))


def pairwise_agreement(rows: DataFrame) -> DataFrame:
    """left_model, right_model, n_common, and per score: mean absolute error, rank correlation, weighted kappa.

    Ranks are average ranks of each side over its own values within the pair.
    They come from counts per value, not from sorted rows: per pair and score the
    distinct value combinations are counted first, and all statistics are computed
    on those few counts.
    """
    p = model_pairs(rows)
    n = p.groupBy(F.col("l._model").alias("left_model"), F.col("r._model").alias("right_model")).agg(F.count("*").alias("n_common"))
    cells = p.select(F.col("l._model").alias("left_model"), F.col("r._model").alias("right_model"), F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"l.{s}").alias("a"), F.col(f"r.{s}").alias("b")) for s in SCORES))).alias("x"))
    c = cells.groupBy("left_model", "right_model", "x.s", "x.a", "x.b").agg(F.count("*").alias("n"))
    pair = ["left_model", "right_model", "s"]

    def rank(side: str) -> Column:
        whole = Window.partitionBy(*pair).orderBy(F.col(side).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
        same = Window.partitionBy(*pair, side)
        return F.sum("n").over(whole) - (F.sum("n").over(same) - 1) / 2

    r = c.withColumn("ra", rank("a")).withColumn("rb", rank("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    w = F.col("n")
    in_range = F.col("a").between(LOW, HIGH) & F.col("b").between(LOW, HIGH)
    q = F.when(in_range, w).otherwise(0)
    d = F.col("a") - F.col("b")
    g = r.groupBy(*pair).agg(
        (F.sum(w * F.abs(d)) / F.sum(w)).alias("mae"),
        F.sum(w).alias("k"), F.sum(w * F.col("ra")).alias("sx"), F.sum(w * F.col("rb")).alias("sy"), F.sum(w * F.col("ra") * F.col("ra")).alias("sxx"), F.sum(w * F.col("rb") * F.col("rb")).alias("syy"), F.sum(w * F.col("ra") * F.col("rb")).alias("sxy"),
        F.sum(q).alias("m"), F.sum(q * d * d).alias("od"), F.sum(q * F.col("a")).alias("qa"), F.sum(q * F.col("b")).alias("qb"), F.sum(q * F.col("a") * F.col("a")).alias("qaa"), F.sum(q * F.col("b") * F.col("b")).alias("qbb"),
    )
    den = F.sqrt((F.col("k") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("k") * F.col("syy") - F.col("sy") * F.col("sy")))
    corr = F.when(den > 0, (F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy")) / den)
    # Sum over all marginal combinations of (i - j)^2 is n * (sum a^2 + sum b^2) - 2 * sum a * sum b.
    expected = F.try_divide(F.col("m") * (F.col("qaa") + F.col("qbb")) - 2 * F.col("qa") * F.col("qb"), F.col("m"))
    kappa = F.when(F.col("m") > 0, F.when(expected > 0, 1 - F.col("od") / expected).when(F.col("od") == 0, 1.0))
    s = g.select(*pair, rounded(F.col("mae")).alias("mae"), rounded(corr).alias("corr"), rounded(kappa).alias("kappa"))
    wide = s.groupBy("left_model", "right_model").agg(*(F.max(F.when(F.col("s") == x, F.col(y))).alias(f"{x}_{z}") for x in SCORES for y, z in (("mae", "mae"), ("corr", "corr"), ("kappa", "weighted_kappa"))))
    return n.join(wide, ["left_model", "right_model"], "left")


def against(rows: DataFrame, reference: str) -> DataFrame:
    """One row per id and other model with the reference model's scores beside its own."""
    x = _by_id(rows).withColumn("ref", F.try_element_at(F.filter("m", lambda v: v["_model"] == reference), F.lit(1))).filter(F.col("ref").isNotNull())
    return x.select("_eval_id", "ref", F.explode(F.filter("m", lambda v: v["_model"] != reference)).alias("o")).select("_eval_id", F.col("o._model").alias("model"), *(F.col(f"ref.{s}").alias(f"reference_{s}") for s in SCORES), *(F.col(f"o.{s}").alias(f"model_{s}") for s in SCORES))


def reference_bias(rows: DataFrame, reference: str) -> DataFrame:
    """Per model: mean and median difference to the reference, and shares of exact and near agreement over all common ids."""
    p = against(rows, reference)
    agg = []
    for s in SCORES:
        d = F.col(f"model_{s}") - F.col(f"reference_{s}")
        agg += [
            rounded(F.avg(d)).alias(f"{s}_mean_bias"),
            rounded(F.median(d)).alias(f"{s}_median_bias"),
            rounded(100 * F.avg(F.coalesce((d == 0).cast("int"), F.lit(0)))).alias(f"{s}_pct_exact"),
            rounded(100 * F.avg(F.coalesce((F.abs(d) <= 1).cast("int"), F.lit(0)))).alias(f"{s}_pct_within_1"),
        ]
    return p.groupBy("model").agg(F.count("*").alias("n_common"), *agg).select(F.lit(reference).alias("reference_model"), "model", "n_common", *(c for s in SCORES for c in (f"{s}_mean_bias", f"{s}_median_bias", f"{s}_pct_exact", f"{s}_pct_within_1")))


def top_disagreements(rows: DataFrame, reference: str, limit: int = 25) -> DataFrame:
    """The `limit` rows with the largest sum of absolute differences; a null score sorts last; ties by id and model."""
    p = against(rows, reference)
    total = sum((F.abs(F.col(f"model_{s}") - F.col(f"reference_{s}")) for s in SCORES), F.lit(0)).cast("double")
    return p.withColumn("total_abs_diff", total).orderBy(F.col("total_abs_diff").desc_nulls_last(), "_eval_id", "model").limit(limit)


def fleiss_kappa(rows: DataFrame, complete: bool = True) -> DataFrame:
    """Per score: items, raters and kappa (null with fewer than two raters or one category only).

    `complete` counts the items rated by every model present, as Fleiss has it.  Without it
    every item with two ratings or more counts, with as many raters as it has: its own
    agreement among its pairs, and chance agreement from all ratings; on complete data both are equal.
    Ratings outside the scale count as disagreement.
    """
    o = ok(rows).filter(F.col("_model").isNotNull())
    long = o.select("_eval_id", "_model", F.explode(F.array(*(F.struct(F.lit(s).alias("metric"), F.col(s).alias("v")) for s in SCORES))).alias("x")).select("_eval_id", "_model", "x.metric", "x.v").filter("v IS NOT NULL")
    raters = long.groupBy("metric").agg(F.countDistinct("_model").alias("n_raters"))
    cells = long.groupBy("metric", "_eval_id", "v").agg(F.count("*").alias("c"))
    items = cells.groupBy("metric", "_eval_id").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v").between(LOW, HIGH), F.col("c") * (F.col("c") - 1)).otherwise(0)).alias("agreeing"), F.map_from_entries(F.collect_list(F.struct("v", "c"))).alias("m"))
    full = items.join(F.broadcast(raters), "metric").filter((F.col("n") == F.col("n_raters")) if complete else (F.col("n") > 1))  # one row per score
    head = full.groupBy("metric").agg(F.count("*").alias("n_items"), F.sum("n").alias("total"), F.avg(F.try_divide("agreeing", F.col("n") * (F.col("n") - 1))).alias("p_bar"))
    share = full.select("metric", F.explode("m").alias("v", "c")).filter(F.col("v").between(LOW, HIGH)).groupBy("metric", "v").agg(F.sum("c").alias("c")).groupBy("metric").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    k = head.join(share, "metric", "left").withColumn("pe", F.col("cc") / (F.col("total") * F.col("total")))
    kappa = F.when((F.col("pe") != 1) & F.col("p_bar").isNotNull(), F.try_divide(F.col("p_bar") - F.col("pe"), 1 - F.col("pe")))
    out = k.select("metric", "n_items", rounded(kappa).alias("fleiss_kappa"))
    return raters.join(out, "metric", "left").select("metric", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "n_raters", "fleiss_kappa")


def operations(rows: DataFrame) -> DataFrame:
    """Per model: mean, median and 95th percentile of the latency, and mean tokens and sizes, over ok rows."""
    o = ok(rows)
    agg = [F.count("_eval_id").alias("n_ok"), rounded(F.avg("_latency_seconds")).alias("avg_latency_seconds")]
    agg += [rounded(F.avg(c)).alias(f"avg_{c}") for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens", "n_interactions", "prompt_chars")]
    places = order.percentiles(o, ["_model"], "_latency_seconds", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("_model", "m")
    g = o.groupBy("_model").agg(*agg).join(places, F.col("_model").eqNullSafe(F.col("m")), "left")
    mean, *rest = (c for c in g.columns if c.startswith("avg_"))
    return g.select("_model", "n_ok", mean, rounded(F.col("p50")).alias("p50_latency_seconds"), rounded(F.col("p95")).alias("p95_latency_seconds"), *rest)


def common_only(rows: DataFrame) -> DataFrame:
    """Rows (of any status) of the ids that every model judged ok."""
    o = ok(rows)
    models = o.agg(F.countDistinct("_model").alias("k"))
    ids = o.groupBy("_eval_id").agg(F.countDistinct("_model").alias("k")).join(F.broadcast(models), "k").select("_eval_id")
    return rows.join(ids, "_eval_id", "left_semi")


def most_covering(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the n models that judged most ids ok; of equal ones the first by name."""
    top = ok(rows).groupBy("_model").agg(F.countDistinct("_eval_id").alias("k")).orderBy(F.col("k").desc(), "_model").limit(n)
    return rows.join(F.broadcast(top.select("_model")), "_model", "left_semi")  # n rows


def shape(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("_eval_id").agg(F.min_by(F.struct("_subset", "n_interactions", "prompt_chars"), "seq").alias("r")).select("_eval_id", "r.*")
    return first.filter(F.col("_subset").isNotNull()).groupBy("_subset").agg(F.count("*").alias("n_examples"), rounded(F.avg("n_interactions")).alias("avg_n_interactions"), F.min("n_interactions").alias("min_n_interactions"), F.max("n_interactions").alias("max_n_interactions"), rounded(F.avg("prompt_chars")).alias("avg_prompt_chars"))


def repeat_reliability(log: DataFrame) -> DataFrame:
    """Per model: ids judged ok more than once, and the mean spread of their scores."""
    o = ok(flatten(log))
    per = o.groupBy("_model", "_eval_id").agg(F.count("*").alias("k"), *(F.stddev_samp(s).alias(s) for s in SCORES)).filter("k > 1")
    return per.groupBy("_model").agg(F.count("*").alias("n_repeated_examples"), *(rounded(F.avg(s)).alias(f"{s}_mean_repeat_std") for s in SCORES))


def coverage(rows: DataFrame, expected: DataFrame, per_subset: int) -> DataFrame:
    """Every model with every expected subset (column _subset), zero filled."""
    grid = rows.select("_model").filter("_model IS NOT NULL").distinct().crossJoin(F.broadcast(expected.select("_subset").filter("_subset IS NOT NULL").distinct()))
    n = rows.groupBy("_model", "_subset").agg(F.count("*").alias("n_total"), F.sum(F.coalesce((F.col("_status") == "ok").cast("long"), F.lit(0))).alias("n_ok"))
    got = grid.join(n, ["_model", "_subset"], "left").select("_model", "_subset", F.coalesce("n_total", F.lit(0)).alias("n_total"), F.coalesce("n_ok", F.lit(0)).alias("n_ok"))
    return got.select("*", F.lit(per_subset).cast("long").alias("n_expected"), F.greatest(F.lit(per_subset) - F.col("n_ok"), F.lit(0)).cast("long").alias("missing_ok"), rounded(100 * F.col("n_ok") / per_subset, 2).alias("ok_pct"))


def ensemble(rows: DataFrame, primary: str) -> DataFrame:
    """Per id, subset and index: models, mean and spread of each score over the models, and the primary model's scores; rounded."""
    o = ok(rows)
    agg = [F.countDistinct("_model").alias("n_models_ok")]
    for s in SCORES:
        agg += [rounded(F.avg(s)).alias(f"{s}_ensemble_mean"), rounded(F.stddev_samp(s)).alias(f"{s}_ensemble_std")]
    mine = F.max_by(F.when(F.col("_model") == primary, F.struct(*SCORES)), F.when(F.col("_model") == primary, F.col("seq"))).alias("p")
    return o.groupBy("_eval_id", "_subset", "_sample_index").agg(*agg, mine).select("*", *(F.col(f"p.{s}").cast("double").alias(f"{s}_primary") for s in SCORES)).drop("p")


def ranking(examples: DataFrame, suffix: str = "primary") -> DataFrame:
    """Subsets by mean overall score, dense rank from the best; the rank follows the unrounded mean."""
    g = examples.filter(F.col("_subset").isNotNull()).groupBy("_subset").agg(
        F.count("_eval_id").alias("n_examples"), F.avg("n_models_ok").alias("m"), F.avg(f"overall_score_{suffix}").alias("quality"), F.stddev_samp(f"overall_score_{suffix}").alias("sd"),
        *(F.avg(f"{s}_{suffix}").alias(s) for s in SCORES[:3]),
    )
    r = F.dense_rank().over(Window.orderBy(F.round("quality", 9).desc_nulls_last()))
    return g.select("_subset", "n_examples", rounded(F.col("m")).alias("n_models_ok_avg"), rounded(F.col("quality")).alias("overall_mean"), rounded(F.col("sd")).alias("overall_std"), *(rounded(F.col(s)).alias(s.replace("_score", "_mean")) for s in SCORES[:3]), rounded(F.col("quality")).alias("quality_index"), r.cast("int").alias("rank"))


def hypothesis(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: hypothesis_group, expected_rank, _subset.  Observed dense rank of the rounded group mean against the expected rank."""
    g = ranked.join(F.broadcast(groups), "_subset").groupBy("hypothesis_group", "expected_rank").agg(F.count("*").alias("n_subsets"), rounded(F.avg("quality_index"), 3).alias("mean_quality_index"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_subset"))), lambda x: x["_subset"]), ", ").alias("subsets"))
    r = F.dense_rank().over(Window.orderBy(F.col("mean_quality_index").desc_nulls_last())).cast("int")
    return g.withColumn("observed_rank", r).withColumn("matches", F.col("observed_rank") == F.col("expected_rank"))


def pending(inputs: DataFrame, log: DataFrame, key: str = "_eval_id") -> DataFrame:
    """Inputs without an ok judgment: what a resumed run still has to judge."""
    return inputs.join(log.filter(F.col("_status") == "ok").select(F.col("_eval_id").alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def token_usage(log: DataFrame) -> DataFrame:
    return flatten(log).groupBy("_model").agg(F.count("*").alias("n_calls"), *(F.sum(c).alias(f"sum_{c}") for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")))


def retryable(error_type: Column, error: Column) -> Column:
    """Time-outs, lost connections and rate limits, and the status numbers that are worth another attempt."""
    status = F.regexp_extract(error, r"\b(?:status|code)[ =:]*(\d{3})\b", 1)
    # Retryable status numbers and error types.
    return F.coalesce(error_type.isin("APITimeoutError", "APIConnectionError", "RateLimitError", "InternalServerError"), F.lit(False)) | F.coalesce(status.isin("408", "409", "425", "429", "500", "502", "503", "504"), F.lit(False))
