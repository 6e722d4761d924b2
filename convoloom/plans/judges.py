"""Queries over the judge log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judging as J
from ..sources.tables import table

REFERENCE = "aster-judge-120b"
PER_SUBSET = 100
GROUPS = (("recall", 1), ("chat", 2), ("think", 3), ("dialog", 4))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_log")


def _latest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """All columns, or only the named flat ones beside seq, ids and status."""
    return J.latest(_log(spark, d), columns or None)


def _ok(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return J.latest_ok(_log(spark, d), (*J.SCORES, *more))


def judge_latest(spark, d):
    return _latest(spark, d).drop("error", "_latency_seconds")


def judge_status(spark, d):
    return J.status_counts(_latest(spark, d, "_status"))


def judge_errors(spark, d):
    return J.error_counts(_log(spark, d))


def judge_scores(spark, d):
    return J.score_summary(_ok(spark, d))


def judge_subset_summary(spark, d):
    return J.score_summary(_ok(spark, d, "_subset"), ("_model", "_subset"), median=True)


def judge_pairwise(spark, d):
    return J.pairwise_agreement(_ok(spark, d))


def judge_bias(spark, d):
    return J.reference_bias(_ok(spark, d), REFERENCE)


def judge_top_disagreements(spark, d):
    return J.top_disagreements(_ok(spark, d), REFERENCE)


def judge_fleiss(spark, d):
    """Kappa over all models; an item has as many raters as judged it, since none is judged by all."""
    return J.fleiss_kappa(_ok(spark, d), complete=False)


def judge_fleiss_complete(spark, d):
    """Kappa among the three models that judge most ids, over the ids that all three judged."""
    return J.fleiss_kappa(J.most_covering(_ok(spark, d), 3))


def judge_ops_percentiles(spark, d):
    return J.operations(J.latest_ok(_log(spark, d), ("_latency_seconds", "prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens", "n_interactions", "prompt_chars")))


def judge_common_only(spark, d):
    """Ids that both of the two models with most judgments judged."""
    rows = J.most_covering(_latest(spark, d, "_status", "overall_score"), 2)
    return J.common_only(rows).select("_eval_id", "_model", "_status", "overall_score")


def judge_shape(spark, d):
    return J.shape(_latest(spark, d, "_status", "_subset", "n_interactions", "prompt_chars"))


def judge_intra(spark, d):
    return J.repeat_reliability(_log(spark, d))


def judge_pending(spark, d):
    ids = table(spark, d, "reasoning_completions").select("_eval_id").filter("_eval_id IS NOT NULL").distinct()
    return J.pending(ids, _log(spark, d))


def judge_token_usage(spark, d):
    return J.token_usage(_log(spark, d))


def judge_retryable(spark, d):
    log = _log(spark, d).filter((F.col("_status") == "error") & F.col("_eval_id").isNotNull())
    return log.groupBy("_model", J.retryable(F.col("error_type"), F.col("error")).alias("retryable")).agg(F.count("*").alias("n"))


def subset_coverage(spark, d):
    return J.coverage(_latest(spark, d, "_status", "_subset"), table(spark, d, "subset_targets"), PER_SUBSET)


def subset_ensemble(spark, d):
    return J.ensemble(_ok(spark, d, "_subset", "_sample_index"), REFERENCE)


def subset_ranking(spark, d):
    return J.ranking(J.ensemble(_ok(spark, d, "_subset", "_sample_index"), REFERENCE))


def subset_disagreement(spark, d):
    e = J.ensemble(_ok(spark, d, "_subset", "_sample_index"), REFERENCE)
    return e.orderBy(F.col("overall_score_ensemble_std").desc_nulls_last(), "_eval_id", "_subset", "_sample_index").limit(50).select("_eval_id", "_subset", "_sample_index", "overall_score_ensemble_std", "overall_score_ensemble_mean")


def subset_hypothesis(spark, d):
    s = table(spark, d, "subset_targets").select("_subset").filter("_subset IS NOT NULL")
    word = F.split("_subset", "-")[1]
    groups = s.withColumn("hypothesis_group", word).join(F.broadcast(spark.createDataFrame(GROUPS, "hypothesis_group string, expected_rank int")), "hypothesis_group")
    return J.hypothesis(J.ranking(J.ensemble(_ok(spark, d, "_subset", "_sample_index"), REFERENCE)), groups)


_FLAT = """
flat AS (SELECT seq, _eval_id, _model, _status, _subset, _sample_index, _latency_seconds, _finish_reason, error_type, error,
  _usage.prompt_tokens AS prompt_tokens, _usage.completion_tokens AS completion_tokens, _usage.reasoning_tokens AS reasoning_tokens, _usage.total_tokens AS total_tokens,
  _example_stats.n_interactions AS n_interactions, _example_stats.prompt_chars AS prompt_chars, judgment.confidence AS confidence,
  judgment.memory_score AS memory_score, judgment.instruction_score AS instruction_score, judgment.freshness_score AS freshness_score, judgment.overall_score AS overall_score
  FROM judge_log WHERE _eval_id IS NOT NULL),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY _eval_id, _model ORDER BY coalesce(_status = 'ok', false) DESC, seq DESC) AS rn FROM flat) WHERE rn = 1),
ok AS (SELECT * FROM latest WHERE _status = 'ok')
"""
_W = "WITH " + _FLAT
_S = J.SCORES


def _each(f, sep=", "):
    return sep.join(f(s) for s in _S)


def _summary(by: str, median: bool) -> str:
    m = (lambda s: f", round_even(median({s}), 3) AS {s}_median") if median else (lambda s: "")
    return _W + f"SELECT {by}, count(*) AS n_ok, " + _each(lambda s: f"count({s}) AS {s}_count, round_even(avg({s}), 3) AS {s}_mean, round_even(stddev_samp({s}), 3) AS {s}_std{m(s)}") + f" FROM ok GROUP BY {by}"


_AGAINST = _W + ", pairs AS (SELECT r._eval_id, o._model AS model, " + _each(lambda s: f"r.{s} AS reference_{s}, o.{s} AS model_{s}") + f" FROM ok r JOIN ok o USING (_eval_id) WHERE r._model = '{REFERENCE}' AND o._model <> '{REFERENCE}')"


def _pairwise() -> str:
    parts = []
    for s in _S:
        parts.append(f"""
k_{s} AS (
  SELECT left_model, right_model, round_even(avg(abs(a - b)), 3) AS {s}_mae,
    round_even(corr(ra, rb), 3) AS {s}_corr FROM (
    SELECT left_model, right_model, a, b,
      CASE WHEN a IS NOT NULL THEN rank() OVER (PARTITION BY left_model, right_model ORDER BY a NULLS LAST) + (count(*) OVER (PARTITION BY left_model, right_model, a) - 1) / 2.0 END AS ra,
      CASE WHEN b IS NOT NULL THEN rank() OVER (PARTITION BY left_model, right_model ORDER BY b NULLS LAST) + (count(*) OVER (PARTITION BY left_model, right_model, b) - 1) / 2.0 END AS rb
    FROM (SELECT left_model, right_model, l_{s} AS a, r_{s} AS b FROM p)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
w_{s} AS (
  SELECT c.left_model, c.right_model, round_even(1 - sum(c.n * (c.a - c.b) * (c.a - c.b)) / min(e.ex), 3) AS {s}_weighted_kappa
  FROM (SELECT left_model, right_model, l_{s} AS a, r_{s} AS b, count(*) AS n FROM p WHERE l_{s} BETWEEN 1 AND 10 AND r_{s} BETWEEN 1 AND 10 GROUP BY ALL) c
  JOIN (SELECT x.left_model, x.right_model, sum(x.n * y.n * (x.a - y.b) * (x.a - y.b)) / min(t.n)::DOUBLE AS ex
    FROM (SELECT left_model, right_model, l_{s} AS a, count(*) AS n FROM p WHERE l_{s} BETWEEN 1 AND 10 AND r_{s} BETWEEN 1 AND 10 GROUP BY ALL) x
    JOIN (SELECT left_model, right_model, r_{s} AS b, count(*) AS n FROM p WHERE l_{s} BETWEEN 1 AND 10 AND r_{s} BETWEEN 1 AND 10 GROUP BY ALL) y USING (left_model, right_model)
    JOIN (SELECT left_model, right_model, count(*) AS n FROM p WHERE l_{s} BETWEEN 1 AND 10 AND r_{s} BETWEEN 1 AND 10 GROUP BY ALL) t USING (left_model, right_model) GROUP BY ALL) e USING (left_model, right_model) GROUP BY ALL)""")
    return (
        _W
        + ", p AS (SELECT l._model AS left_model, r._model AS right_model, "
        + _each(lambda s: f"l.{s} AS l_{s}, r.{s} AS r_{s}")
        + " FROM ok l JOIN ok r USING (_eval_id) WHERE l._model < r._model), n AS (SELECT left_model, right_model, count(*) AS n_common FROM p GROUP BY ALL),"
        + ",".join(parts)
        + " SELECT n.*, "
        + _each(lambda s: f"{s}_mae, {s}_corr, {s}_weighted_kappa")
        + " FROM n "
        + " ".join(f"LEFT JOIN k_{s} USING (left_model, right_model) LEFT JOIN w_{s} USING (left_model, right_model)" for s in _S)
    )


_ENS = (
    _W
    + ", ens AS (SELECT _eval_id, _subset, _sample_index, count(DISTINCT _model) AS n_models_ok, "
    + _each(lambda s: f"round_even(avg({s}), 3) AS {s}_ensemble_mean, round_even(stddev_samp({s}), 3) AS {s}_ensemble_std")
    + ", "
    + _each(lambda s: f"CAST(max(CASE WHEN _model = '{REFERENCE}' THEN {s} END) AS DOUBLE) AS {s}_primary")
    + " FROM ok GROUP BY _eval_id, _subset, _sample_index)"
)
_RANK = (
    _ENS
    + ", g AS (SELECT _subset, count(_eval_id) AS n_examples, avg(n_models_ok) AS m, avg(overall_score_primary) AS q, stddev_samp(overall_score_primary) AS sd, avg(memory_score_primary) AS a, avg(instruction_score_primary) AS b, avg(freshness_score_primary) AS c FROM ens WHERE _subset IS NOT NULL GROUP BY _subset),"
    " ranked AS (SELECT _subset, n_examples, round_even(m, 3) AS n_models_ok_avg, round_even(q, 3) AS overall_mean, round_even(sd, 3) AS overall_std, round_even(a, 3) AS memory_mean, round_even(b, 3) AS instruction_mean, round_even(c, 3) AS freshness_mean, round_even(q, 3) AS quality_index, CAST(dense_rank() OVER (ORDER BY round(q, 9) DESC NULLS LAST) AS INTEGER) AS rank FROM g)"
)
_TOP = lambda n: f"(SELECT _model FROM ok GROUP BY _model ORDER BY count(DISTINCT _eval_id) DESC, _model LIMIT {n})"


def _fleiss(models: str, complete: bool) -> str:
    """Kappa from the definition: agreeing pairs of ratings over pairs, against the squared shares of all ratings."""
    some = "n = r" if complete else "n > 1"
    parts = [
        f"l_{s} AS (SELECT _eval_id, _model, {s} AS v FROM ok WHERE {s} IS NOT NULL{models}), i_{s} AS (SELECT * FROM (SELECT _eval_id, count(*) AS n, (SELECT count(DISTINCT _model) FROM l_{s}) AS r FROM l_{s} GROUP BY _eval_id) WHERE {some}), "
        f"p_{s} AS (SELECT a._eval_id, count(*) FILTER (WHERE a.v = b.v AND a.v BETWEEN 1 AND 10) AS agreeing FROM l_{s} a JOIN l_{s} b ON a._eval_id = b._eval_id AND a._model <> b._model GROUP BY a._eval_id), "
        f"e_{s} AS (SELECT sum(c * c) / (SELECT sum(n) ** 2 FROM i_{s}) AS pe FROM (SELECT count(*)::DOUBLE AS c FROM l_{s} JOIN i_{s} USING (_eval_id) WHERE v BETWEEN 1 AND 10 GROUP BY v))"
        for s in _S
    ]
    one = lambda s: f"SELECT '{s}' AS metric, count(*) AS n_items, max(r) AS n_raters, round_even((avg(agreeing / (n * (n - 1))) - (SELECT pe FROM e_{s})) / (1 - (SELECT pe FROM e_{s})), 3) AS fleiss_kappa FROM i_{s} JOIN p_{s} USING (_eval_id)"
    return _W + ", " + ", ".join(parts) + " " + " UNION ALL ".join(one(s) for s in _S)


ORACLE = {
    "judge_latest": _W + "SELECT * EXCLUDE (error, _latency_seconds) FROM latest",
    "judge_status": _W + "SELECT _model, _status, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY _model) AS BIGINT) AS total, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY _model), 2) AS pct FROM latest GROUP BY _model, _status",
    "judge_errors": _W + "SELECT _model, error_type, error, count(*) AS n FROM flat WHERE _status = 'error' GROUP BY ALL",
    "judge_scores": _summary("_model", False),
    "judge_subset_summary": _summary("_model, _subset", True),
    "judge_pairwise": _pairwise(),
    "judge_bias": _AGAINST + f" SELECT '{REFERENCE}' AS reference_model, model, count(*) AS n_common, " + _each(lambda s: f"round_even(avg(model_{s} - reference_{s}), 3) AS {s}_mean_bias, round_even(median(model_{s} - reference_{s}), 3) AS {s}_median_bias, round_even(100.0 * avg(coalesce(CAST(model_{s} = reference_{s} AS INT), 0)), 3) AS {s}_pct_exact, round_even(100.0 * avg(coalesce(CAST(abs(model_{s} - reference_{s}) <= 1 AS INT), 0)), 3) AS {s}_pct_within_1") + " FROM pairs GROUP BY model",
    "judge_top_disagreements": _AGAINST + " SELECT *, CAST(" + _each(lambda s: f"abs(model_{s} - reference_{s})", " + ") + " AS DOUBLE) AS total_abs_diff FROM pairs ORDER BY total_abs_diff DESC NULLS LAST, _eval_id, model LIMIT 25",
    "judge_fleiss": _fleiss("", False),
    "judge_fleiss_complete": _fleiss(f" AND _model IN {_TOP(3)}", True),
    "judge_ops_percentiles": _W + "SELECT _model, count(_eval_id) AS n_ok, round_even(avg(_latency_seconds), 3) AS avg_latency_seconds, round_even(median(_latency_seconds), 3) AS p50_latency_seconds, round_even(quantile_cont(_latency_seconds, 0.95), 3) AS p95_latency_seconds, " + ", ".join(f"round_even(avg({c}), 3) AS avg_{c}" for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens", "n_interactions", "prompt_chars")) + " FROM ok GROUP BY _model",
    "judge_common_only": _W + ", two AS (SELECT * FROM latest WHERE _model IN " + _TOP(2) + ") SELECT _eval_id, _model, _status, overall_score FROM two WHERE _eval_id IN (SELECT _eval_id FROM two WHERE _status = 'ok' GROUP BY _eval_id HAVING count(DISTINCT _model) = (SELECT count(DISTINCT _model) FROM two WHERE _status = 'ok'))",
    "judge_shape": _W + "SELECT _subset, count(*) AS n_examples, round_even(avg(n_interactions), 3) AS avg_n_interactions, min(n_interactions) AS min_n_interactions, max(n_interactions) AS max_n_interactions, round_even(avg(prompt_chars), 3) AS avg_prompt_chars FROM (SELECT *, row_number() OVER (PARTITION BY _eval_id ORDER BY seq) AS rn FROM latest) WHERE rn = 1 AND _subset IS NOT NULL GROUP BY _subset",
    "judge_intra": _W + "SELECT _model, count(*) AS n_repeated_examples, " + _each(lambda s: f"round_even(avg(d_{s}), 3) AS {s}_mean_repeat_std") + " FROM (SELECT _model, _eval_id, " + _each(lambda s: f"stddev_samp({s}) AS d_{s}") + " FROM flat WHERE _status = 'ok' GROUP BY _model, _eval_id HAVING count(*) > 1) GROUP BY _model",
    "judge_pending": "SELECT DISTINCT _eval_id FROM reasoning_completions WHERE _eval_id IS NOT NULL AND _eval_id NOT IN (SELECT _eval_id FROM judge_log WHERE _status = 'ok' AND _eval_id IS NOT NULL)",
    "judge_token_usage": _W + "SELECT _model, count(*) AS n_calls, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")) + " FROM flat GROUP BY _model",
    "judge_retryable": _W + "SELECT _model, coalesce(error_type IN ('APITimeoutError', 'APIConnectionError', 'RateLimitError', 'InternalServerError'), false) OR coalesce(regexp_extract(error, '\\b(?:status|code)[ =:]*(\\d{3})\\b', 1) IN ('408', '409', '425', '429', '500', '502', '503', '504'), false) AS retryable, count(*) AS n FROM flat WHERE _status = 'error' GROUP BY ALL",
    "subset_coverage": _W + f"SELECT m._model, t._subset, count(l._eval_id) AS n_total, count(*) FILTER (WHERE l._status = 'ok') AS n_ok, CAST({PER_SUBSET} AS BIGINT) AS n_expected, CAST(greatest({PER_SUBSET} - count(*) FILTER (WHERE l._status = 'ok'), 0) AS BIGINT) AS missing_ok, round_even(100.0 * count(*) FILTER (WHERE l._status = 'ok') / {PER_SUBSET}, 2) AS ok_pct FROM (SELECT DISTINCT _model FROM latest WHERE _model IS NOT NULL) m CROSS JOIN (SELECT DISTINCT _subset FROM subset_targets WHERE _subset IS NOT NULL) t LEFT JOIN latest l ON l._model = m._model AND l._subset = t._subset GROUP BY m._model, t._subset",
    "subset_ensemble": _ENS + " SELECT * FROM ens",
    "subset_ranking": _RANK + " SELECT * FROM ranked",
    "subset_disagreement": _ENS + " SELECT _eval_id, _subset, _sample_index, overall_score_ensemble_std, overall_score_ensemble_mean FROM ens ORDER BY overall_score_ensemble_std DESC NULLS LAST, _eval_id, _subset, _sample_index LIMIT 50",
    "subset_hypothesis": _RANK + ", groups AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', {k})" for g, k in GROUPS) + ") v(hypothesis_group, expected_rank)), x AS (SELECT hypothesis_group, expected_rank, count(*) AS n_subsets, round_even(avg(quality_index), 3) AS mean_quality_index, string_agg(_subset, ', ' ORDER BY rank, _subset) AS subsets FROM ranked JOIN groups ON split_part(_subset, '-', 2) = hypothesis_group GROUP BY ALL) SELECT *, CAST(dense_rank() OVER (ORDER BY mean_quality_index DESC NULLS LAST) AS INTEGER) AS observed_rank, dense_rank() OVER (ORDER BY mean_quality_index DESC NULLS LAST) = expected_rank AS matches FROM x",
}
QUERIES = {n: globals()[n] for n in ORACLE}
