"""Queries over records, rule stacks, facts, parsers, near duplicates, the stream and generation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import taxonomy as K
from ..operators import conversations as V
from ..operators import dedup, generate, judging
from ..operators import records as R
from ..session import checkpoint_dir
from ..sources.tables import table
from ..streaming import judgelog
from . import conversations as Q
from . import judges

TYPES = ("json_valid", "first_letter", "yaml_valid", "alphabetical_sentence_starts", "length_tokens", "markdown_table")
MIX = {"explore": 0.5, "transform": 0.3, "memory": 0.2}
NAMES = ("Grilarenne", "Dusholoris", "Solmuque", "Bekiwadale")
NEW_NAMES = ("Ana", "Ben", "Cleo", "Dan")


def _records(spark, d):
    """Completions as records; some are spoilt on purpose, by their id."""
    c = V.latest_rows(table(spark, d, "reasoning_completions"), "completion_id").filter("interactions IS NOT NULL")
    k = F.col("completion_id") % 11

    def turn(x, i):
        seg = lambda kind, f: F.struct(F.lit(kind).alias("segment_type"), F.coalesce(x[f], F.lit("")).alias("text"))
        s = F.array(F.when(k != 3, seg("query", "query")), F.when(x["think"].isNotNull(), seg("reasoning", "think")), seg("answer", "answer"))
        empty = lambda t: F.lit(None).cast(t)
        return F.struct(i.alias("turn_index"), F.array_compact(s).alias("segments"), empty("string").alias("intent"), empty("string").alias("policy"), empty(R.RULE).alias("constraint_spec"), empty("struct<passed:boolean,detail:string,regenerations:int>").alias("verification"), F.lit(True).alias("reasoning_flag"), empty("string").alias("topk_logits_ref"))

    return c.select(
        F.col("completion_id").cast("string").alias("conversation_id"),
        F.struct(F.lit("d").alias("dataset"), F.coalesce("topics", F.lit("")).alias("first_query"), F.lit("c").alias("category"), F.lit("general").alias("domain"), F.lit("en").alias("lang"), F.lit(False).alias("is_haystack")).alias("source_seed"),
        F.when(k == 1, "other").otherwise("mixed").alias("mode"),
        (F.size("interactions") + F.when(k == 2, 1).otherwise(0)).cast("int").alias("length"),
        F.transform("interactions", turn).alias("turns"),
        F.array().cast(f"array<{R.FACT}>").alias("fact_ledger"),
        F.lit("{}").alias("cross_turn_checks"), F.lit(None).cast("string").alias("holistic_score"), F.create_map(F.lit("teacher"), F.lit("t")).alias("factory_models"),
    )


def record_round_trip(spark, d):
    a = _records(spark, d)
    b = R.from_rows(R.to_rows(a))
    same = F.to_json(F.struct("x.*")) == F.to_json(F.struct("y.*"))
    j = a.select("conversation_id", F.struct("source_seed", "mode", "length", "turns", "fact_ledger").alias("x")).join(b.select("conversation_id", F.struct("source_seed", "mode", "length", "turns", "fact_ledger").alias("y")), "conversation_id")
    return j.select("conversation_id", same.alias("same"))


def record_problems(spark, d):
    return _records(spark, d).groupBy(F.coalesce(R.problem(), F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


def constraint_stack(spark, d):
    t = Q._turns(spark, d).select("c", "turn_index", F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(F.col("c") + F.col("turn_index"), F.lit(len(TYPES))) + 1).cast("int")).alias("type"), F.when(F.pmod(F.col("c") + 2 * F.col("turn_index"), F.lit(5)) < 4, "standing").otherwise("turn").alias("scope"))
    return R.active_rules(t).select("c", "turn_index", F.array_join("active", ",").alias("active"))


def fact_history(spark, d):
    """The overall score of an id as a fact that each ok judgment of the log updates."""
    log = table(spark, d, "judge_log").filter("_status = 'ok' AND _eval_id IS NOT NULL AND judgment.overall_score IS NOT NULL")
    f = R.facts(log.select(F.col("_eval_id").alias("c"), F.lit("overall").alias("fact_id"), F.col("seq").alias("turn"), F.col("judgment.overall_score").cast("string").alias("value")))
    return f.select("c", "value", "planted_turn", F.array_join("stale", ",").alias("stale"), F.col("n_updates").cast("long").alias("n_updates"))


def stream_latest(spark, d):
    """The log folded batch by batch; the same rows as judge_latest."""
    home = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{d.rstrip('/')}/judge_log.parquet"
    stream = judgelog.source(spark, path)
    judgelog.compact(stream, f"{home}/state", f"{home}/checkpoint")
    return judgelog.current(spark, f"{home}/state").drop("error", "_latency_seconds")


def greedy_near_dup(spark, d):
    m = V.latest_rows(table(spark, d, "mrl_records"), "record_id")
    return dedup.greedy(m, "record_id", "query")


def bleu_topic_filter(spark, d):
    m = V.latest_rows(table(spark, d, "mrl_records"), "record_id")
    return m.select("record_id", parsing.topic_filter("query", "answer", "interactions").alias("kept"))


def name_replacement(spark, d):
    m = V.latest_rows(table(spark, d, "mrl_records"), "record_id").select("record_id", "query", "answer")
    return R.replace_names(m, "record_id", list(NAMES), list(NEW_NAMES), skip=0.1)


def error_replies(spark, d):
    """Objects and valid judgments in the replies that errors quote."""
    e = table(spark, d, "judge_log").filter("error IS NOT NULL").select("seq", "error_type", F.regexp_replace("error", r"^[^:]{0,60}: ", "").alias("reply"))
    return e.select("seq", "error_type", parsing.count_objects("reply").alias("n_objects"), parsing.parse_judgment("reply")["overall_score"].alias("overall_score"))


def rubric_parse(spark, d):
    """Judge scores written as a rubric inside prose, parsed back, clamped and rounded."""
    j = judging.latest(table(spark, d, "judge_log")).filter("_status = 'ok'")
    text = F.concat(F.lit('Verdict: {"coherence": '), F.coalesce(F.col("overall_score").cast("string"), F.lit("null")), F.lit(', "recall_fidelity": '), F.coalesce((F.col("memory_score") + 0.5).cast("string"), F.lit('"x"')), F.lit(', "flagged_turns": [{"turn_index": 1, "severity": 9}], "notes": "a } b"} and more }'))
    x = j.select("_eval_id", "_model", parsing.parse_rubric(text).alias("r"))
    return x.select("_eval_id", "_model", "r.coherence", "r.recall_fidelity", F.col("r.flagged_turns")[0]["severity"].alias("severity"))


def interactions_parse(spark, d):
    """Interactions written as JSON and parsed back: the number of interactions survives."""
    c = V.latest_rows(table(spark, d, "reasoning_completions"), "completion_id").filter("interactions IS NOT NULL")
    return c.select("completion_id", F.size(parsing.parse_interactions(F.concat(F.lit("```json\n"), F.to_json("interactions"), F.lit("\n```")))).cast("long").alias("n"))


def mock_judging(spark, d):
    """Pending ids judged by the mock client, as a resumed run would."""
    c = V.latest_rows(table(spark, d, "reasoning_completions"), "completion_id").filter("_eval_id IS NOT NULL AND interactions IS NOT NULL")
    todo = judging.pending(c.select("_eval_id", V.plain_transcript(F.col("interactions")).alias("transcript")), table(spark, d, "judge_log"))
    return generate.judge(todo, generate.MockClient(), "mock", "Judge this:\n{conversation}").drop("_latency_seconds")


def conversation_plan(spark, d):
    s = V.latest_rows(table(spark, d, "mrl_records"), "record_id").select("record_id")
    return generate.plan(s, "record_id", 6, MIX)


def sampled_pairs(spark, d):
    """Share of each intent and policy among drawn pairs: the mask's product weights."""
    s = V.latest_rows(table(spark, d, "mrl_records"), "record_id").select("record_id")
    x = generate.draw_pairs(s, ["record_id"], dict(K.INTENTS), dict(K.POLICIES), set(K.INVALID))
    return x.groupBy("intent", "policy").agg(F.count("*").alias("n"))


_TYPE = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_FORM, _START = (", ".join(f"'{t}'" for t in g) for g in (("json_valid", "yaml_valid", "markdown_table"), ("first_letter", "alphabetical_sentence_starts")))
_W = Q._W
ORACLE = {
    "record_round_trip": _W + "SELECT CAST(completion_id AS VARCHAR) AS conversation_id, true AS same FROM comp WHERE interactions IS NOT NULL",
    "record_problems": _W + "SELECT CASE WHEN completion_id % 11 = 1 THEN 'invalid mode' WHEN completion_id % 11 = 2 THEN 'length differs from turns' WHEN completion_id % 11 = 3 AND len(interactions) > 0 THEN 'turn without query' ELSE 'valid' END AS problem, count(*) AS n FROM comp WHERE interactions IS NOT NULL GROUP BY 1",
    "constraint_stack": _W + f", r AS (SELECT c, turn_index, {_TYPE}[(c + turn_index) % {len(TYPES)} + 1] AS type, (c + 2 * turn_index) % 5 < 4 AS lasting FROM turns) SELECT t.c, t.turn_index, coalesce((SELECT string_agg(a.type, ',' ORDER BY a.turn_index) FROM r a WHERE a.c = t.c AND a.turn_index <= t.turn_index AND a.lasting AND NOT EXISTS (SELECT 1 FROM r k WHERE k.c = a.c AND k.turn_index > a.turn_index AND k.turn_index <= t.turn_index AND k.lasting AND k.type <> a.type AND ((k.type IN ({_FORM}) AND a.type IN ({_FORM})) OR (k.type IN ({_START}) AND a.type IN ({_START}))))), '') AS active FROM r t",
    "fact_history": "SELECT c, list_last(v) AS value, p AS planted_turn, array_to_string(v[1:len(v) - 1], ',') AS stale, CAST(len(v) - 1 AS BIGINT) AS n_updates FROM (SELECT _eval_id AS c, list(CAST(judgment.overall_score AS VARCHAR) ORDER BY seq) AS v, min(seq) AS p FROM judge_log WHERE _status = 'ok' AND _eval_id IS NOT NULL AND judgment.overall_score IS NOT NULL GROUP BY _eval_id)",
    "interactions_parse": _W + "SELECT completion_id, CAST(len(interactions) AS BIGINT) AS n FROM comp WHERE interactions IS NOT NULL",
    "rubric_parse": judges._W + "SELECT _eval_id, _model, CASE WHEN overall_score IS NOT NULL THEN least(10, greatest(1, overall_score)) END AS coherence, CASE WHEN memory_score IS NOT NULL THEN least(10, greatest(1, CAST(round_even(memory_score + 0.5, 0) AS INTEGER))) END AS recall_fidelity, CASE WHEN overall_score IS NOT NULL OR memory_score IS NOT NULL THEN 3 END AS severity FROM ok",
    "stream_latest": judges.ORACLE["judge_latest"],
}
_U = Q._UNIFORM
_VALID = [(i, p, w * v) for i, w in K.INTENTS.items() for p, v in K.POLICIES.items() if (i, p) not in K.INVALID]


def _renamed(column: str) -> str:
    for n in NAMES:
        pool = "[" + ", ".join(f"'{x}'" for x in NEW_NAMES) + "]"
        name = f"'{n}'"
        skip = "'skip'"
        column = f"CASE WHEN {_U('record_id', name, skip)} >= 0.1 THEN replace({column}, '{n}', {pool}[CAST(floor({_U('record_id', name)} * {len(NEW_NAMES)}) AS INTEGER) + 1]) ELSE {column} END"
    return column


def _mock(prompt: str) -> str:
    """The mock's judgment of a prompt at its first attempt, as the JSON text that is logged."""
    d = f"sha256(('0x' || left(sha256('42:' || _eval_id || ':0'), 8))::BIGINT || ':' || {prompt})"
    byte = lambda i: f"('0x' || substr(d, {2 * i + 1}, 2))::BIGINT"
    scores = " || ".join(f"'{', ' if i else ''}\"{n}\": ' || (1 + {byte(i)} % 10)" for i, n in enumerate(("memory_score", "instruction_score", "freshness_score", "overall_score")))
    return f"SELECT _eval_id, '{{' || {scores} || ', \"confidence\": \"' || ['low', 'medium', 'high'][{byte(5)} % 3 + 1] || '\", \"issues\": [], \"rationale\": {{\"memory\": \"m\", \"instruction\": \"i\", \"freshness\": \"f\"}}}}' AS judgment FROM (SELECT _eval_id, {d} AS d FROM todo)"


ORACLE |= {
    "greedy_near_dup": _W + f", w AS (SELECT record_id, list_sort(list_distinct({Q._WORDS('query')})) AS w FROM mrl), " + "u AS (SELECT w, min(record_id) AS record_id, row_number() OVER (ORDER BY min(record_id)) AS i FROM w WHERE len(w) > 0 GROUP BY w), near AS (SELECT a.i AS a, b.i AS b FROM u a JOIN u b ON a.i < b.i AND len(a.w) * 10 >= len(b.w) * 9 AND len(b.w) * 10 >= len(a.w) * 9 WHERE len(list_intersect(a.w, b.w)) >= 0.9 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))), "
    "k(i, kept) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL SELECT k.i + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE b = k.i + 1 AND list_contains(k.kept, a)) THEN k.kept ELSE list_append(k.kept, k.i + 1) END FROM k WHERE k.i < (SELECT count(*) FROM u)) "
    "SELECT w.record_id, coalesce(list_contains((SELECT kept FROM k ORDER BY i DESC LIMIT 1), u.i), false) AS kept FROM w LEFT JOIN u ON u.record_id = w.record_id",
    "name_replacement": _W + f"SELECT record_id, {_renamed('query')} AS query, {_renamed('answer')} AS answer FROM mrl",
    "conversation_plan": _W + f"SELECT record_id, CAST(t AS INTEGER) AS turn_index, CASE WHEN t = 1 THEN 'explore' WHEN {_U('record_id', 't')} < 0.5 THEN 'explore' WHEN {_U('record_id', 't')} < 0.8 THEN 'transform' ELSE 'memory' END AS category FROM mrl, unnest(range(1, 6)) v(t)",
    "sampled_pairs": _W
    + f", pairs AS (SELECT *, sum(w) OVER (ORDER BY o) AS upto, sum(w) OVER () AS total FROM (VALUES {', '.join(f'({k}, {Q.q(i)}, {Q.q(p)}, {float(w)}::DOUBLE)' for k, (i, p, w) in enumerate(_VALID))}) v(o, intent, policy, w)) "
    + f"SELECT intent, policy, count(*) AS n FROM (SELECT record_id, {_U('record_id')} AS u FROM mrl) m JOIN pairs ON u * total >= upto - w AND u * total < upto GROUP BY intent, policy",
    "mock_judging": _W
    + f", latest AS (SELECT * FROM comp WHERE _eval_id IS NOT NULL AND interactions IS NOT NULL AND _eval_id NOT IN (SELECT _eval_id FROM judge_log WHERE _status = 'ok' AND _eval_id IS NOT NULL)), todo AS (SELECT _eval_id, coalesce((SELECT string_agg(s, chr(10) ORDER BY turn_index) FROM (SELECT c, turn_index, concat_ws(chr(10), CASE WHEN NOT ({Q._BLANK('query')}) THEN 'User: ' || query END, CASE WHEN NOT ({Q._BLANK('answer')}) THEN 'Assistant: ' || answer END) AS s FROM turns) WHERE c = completion_id AND s <> ''), '') AS transcript FROM latest), j AS ("
    + _mock("'Judge this:' || chr(10) || transcript")
    + ") SELECT _eval_id, 'mock' AS _model, 'ok' AS _status, judgment, CAST(NULL AS VARCHAR) AS error_type, CAST(NULL AS VARCHAR) AS error FROM j",
}
# Braces inside strings don't occur in these replies, so every closing brace ends an object.
ORACLE["error_replies"] = (
    "SELECT seq, error_type, CAST(length(r) - length(replace(r, '}', '')) AS INTEGER) AS n_objects, CASE WHEN json_valid(r) THEN CASE WHEN list_sort(json_keys(r)) = ['confidence', 'freshness_score', 'instruction_score', 'issues', 'memory_score', 'overall_score', 'rationale'] THEN CAST(json_extract(r, '$.overall_score') AS INTEGER) END END AS overall_score "
    "FROM (SELECT seq, error_type, regexp_replace(error, '^[^:]{0,60}: ', '') AS r FROM judge_log WHERE error IS NOT NULL)"
)
# Recursive for the fold over the rows' order.
ORACLE["greedy_near_dup"] = ORACLE["greedy_near_dup"].replace("WITH comp", "WITH RECURSIVE comp", 1)
_OTHERS = ("bleu_topic_filter",)
QUERIES = {n: globals()[n] for n in (*ORACLE, *_OTHERS)}
