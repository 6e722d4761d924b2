"""Queries over generation on the mock client, each with its SQL where SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import taxonomy as K
from ..operators import conversations as V
from ..operators import preferences
from ..operators import synthesis as S
from ..sources.tables import table
from . import conversations as Q

POOL = ("harbours", "ledgers", "lanterns", "bridges", "markets")
WRITER = S.MockWriter()


def _seeds(spark, d):
    """Queries of all records, with a length and a sensitive flag by their id."""
    m = V.latest_rows(table(spark, d, "mrl_records"), "record_id", columns=("query", "_subset"))
    return m.select("record_id", "query").withColumns({"n": (F.pmod("record_id", F.lit(12)) + 2).cast("int"), "sensitive": F.pmod("record_id", F.lit(5)) == 0})


def planned_turns(spark, d):
    return S.plan(_seeds(spark, d), "record_id", "n", "sensitive")


def planned_mix(spark, d):
    """Follow-ups per kind for each length."""
    n = spark.range(0, 30).select(F.col("id").cast("int").alias("n"))
    return n.select("n", S.composition(F.col("n")).alias("c")).select("n", "c.explore", "c.transform", "c.memory")


def planned_intents(spark, d):
    """Intent and policy drawn for each planned follow-up from its category, supportive ones for sensitive seeds."""
    from ..operators import generate

    x = planned_turns(spark, d).join(_seeds(spark, d).select("record_id", "sensitive"), "record_id").withColumn("allowed", S.allowed(F.col("category"), F.col("sensitive")))
    r = generate.draw_pairs(x, ["record_id", "turn_index"], dict(K.INTENTS), dict(K.POLICIES), set(K.INVALID), "allowed")
    return r.select("record_id", "turn_index", "intent", "policy")


def planned_voices(spark, d):
    return S.voices(planned_turns(spark, d).select("record_id", "turn_index"), "record_id")


def drawn_topics(spark, d):
    return S.requests(spark, 40, "Write about:\n{topics}\nFORM: items 2", list(POOL), 3)


def generated_items(spark, d):
    """Items of 60 requests of 1 to 5 items each, until there are more than 100."""
    r = spark.range(60).select(F.col("id").alias("iteration"), F.concat(F.lit("FORM: items "), (F.col("id") % 5 + 1).cast("string")).alias("prompt"))
    return S.generated_items(S.answered(r, "iteration", WRITER), 100).select("iteration", "position", F.size("interactions").alias("n_follow"))


def generated_pairs(spark, d):
    """Question and answer pairs behind a think block; every seventh response is no list."""
    form = F.when(F.col("id") % 7 == 3, F.lit("FORM: answer")).otherwise(F.lit("FORM: pairs 4"))
    r = S.answered(spark.range(30).select(F.col("id").alias("iteration"), form.alias("prompt")), "iteration", WRITER, streamed=True)
    return S.failed_iterations(r).withColumn("n_items", F.lit(S.generated_items(r).count()))


def generated_conversations(spark, d):
    """Conversations of which 6 turns are wanted and 3 to 8 delivered: at least 5 are kept, and all are 6 long; stops at 12."""
    r = spark.range(40).select(F.col("id").alias("iteration"), F.concat(F.lit("FORM: interactions "), (F.col("id") % 6 + 3).cast("string")).alias("prompt"))
    x = S.generated_conversations(S.answered(r, "iteration", WRITER), 6, 12)
    return x.select("iteration", F.size("interactions").alias("n"), F.size(F.filter("interactions", lambda v: v["query"] == "")).alias("n_blank"))


def generated_preferences(spark, d):
    r = spark.range(40).select(F.col("id").alias("iteration"), F.concat(F.lit("FORM: preferences "), (F.col("id") % 6 + 3).cast("string")).alias("prompt"))
    x = S.generated_preferences(S.answered(r, "iteration", WRITER), 6, 12)
    pair = F.element_at(preferences.pairs(F.col("interactions")), 2)
    return x.select("iteration", F.size("interactions").alias("n"), F.size(F.filter("interactions", lambda v: v["query"] == "")).alias("n_blank"), pair["prompt"].contains(F.col("interactions")[0]["accepted"]["answer"]).alias("accepted_in_prompt"), pair["prompt"].contains(F.col("interactions")[0]["rejected"]["answer"]).alias("rejected_in_prompt"))


def _conversations(spark, d):
    return V.latest_rows(table(spark, d, "reasoning_completions"), "completion_id", columns=("interactions",)).filter(F.size("interactions") > 0)


def _filled(df):
    return df.select("completion_id", F.size("interactions").alias("n"), F.size(F.filter("interactions", lambda x: F.length(x["think"]) > 0)).alias("n_thinks"))


def completed_at_once(spark, d):
    return _filled(S.completed(_conversations(spark, d), "completion_id", WRITER))


def completed_turn_by_turn(spark, d):
    return _filled(S.completed_turns(_conversations(spark, d), "completion_id", WRITER))


def completed_preferences(spark, d):
    x = S.completed_preferences(_conversations(spark, d), "completion_id", WRITER)
    own = F.aggregate("interactions", F.lit(0).cast("long"), lambda a, v: a + F.length(v["accepted"]["answer"]))
    return x.select("completion_id", F.size("interactions").alias("n"), own.alias("n_accepted_chars"))


def personal_facts(spark, d):
    return S.personal_facts(_seeds(spark, d), "record_id", 3)


def rubric_scores(spark, d):
    """Rubrics of all conversations by the mock, read back: one in eleven has none, and every axis lies in 1 to 10."""
    from ..operators import generate

    c = _conversations(spark, d).select("completion_id", V.transcript(F.col("interactions")).alias("transcript"))
    r = generate.scored(c, "completion_id", generate.MockRubric(), "Grade:\n{conversation}")
    return r.select("completion_id", F.col("rubric").isNotNull().alias("scored"), F.col("rubric.coherence").alias("coherence"))


def conversations_made(spark, d):
    """Whole conversations of four turns from all queries, on the mock client: sums of the run."""
    rows, stats = S.converse(_seeds(spark, d).filter("query IS NOT NULL").select("record_id", "query"), "record_id", WRITER, WRITER, 4)
    return S.merged_stats(stats, stats.select(*(F.lit(0).cast("long").alias(c) for c in stats.columns)))


_U = Q._UNIFORM
_SEEDS = Q._W + ", seeds AS (SELECT record_id AS k, query, CAST(record_id % 12 + 2 AS INTEGER) AS n, record_id % 5 = 0 AS s FROM mrl)"
_MIX = lambda n: (
    f"least(CAST(round_even(0.3 * ({n}), 0) AS INTEGER), CAST(floor(({n}) * 0.5) AS INTEGER))",
    f"CAST(round_even(0.2 * ({n}), 0) AS INTEGER)",
)
_T, _M = _MIX("m")
_COUNTS = f"SELECT *, {_T} AS tr, CASE WHEN {_T} + {_M} > m - 1 AND m >= 2 THEN greatest(0, m - 1 - {_T}) ELSE {_M} END AS me FROM"
_PLAN = (
    _SEEDS + f", cnt AS (SELECT *, greatest(0, m - tr - me) AS ex FROM ({_COUNTS} (SELECT *, n - 1 AS m FROM seeds) WHERE m > 0)), "
    "slots AS (SELECT k, s, m, i, CASE WHEN i < ex THEN 'explore' WHEN i < ex + tr THEN 'transform' ELSE 'memory' END AS kind FROM cnt, unnest(range(0, m)) v(i)), "
    f"mixed AS (SELECT k, s, kind, row_number() OVER (PARTITION BY k ORDER BY {_U('k', 'i')}, kind) AS t FROM slots), "
    "fe AS (SELECT k, min(t) FILTER (WHERE kind = 'explore') AS f, min_by(kind, t) AS head FROM mixed GROUP BY k), "
    "fr AS (SELECT mixed.k, s, t, CASE WHEN f > 1 AND t = 1 THEN 'explore' WHEN f > 1 AND t = f THEN head ELSE kind END AS category FROM mixed JOIN fe USING (k)), "
    "mem AS (SELECT k, min(t) AS p FROM fr WHERE category = 'memory' GROUP BY k), "
    "far AS (SELECT k, list(t ORDER BY t) AS far FROM fr JOIN mem USING (k) WHERE category = 'memory' AND t - p >= 4 GROUP BY k), "
    f"planned AS (SELECT fr.k AS record_id, CAST(t AS INTEGER) AS turn_index, category, s, CASE WHEN category <> 'memory' THEN NULL WHEN s OR far IS NULL THEN 'content' WHEN t = p THEN 'plant' WHEN t = far[1] THEN 'recall' WHEN t = far[2] AND {_U('fr.k', chr(39) + 'update' + chr(39))} < 0.5 THEN 'update' ELSE 'content' END AS memory_kind FROM fr LEFT JOIN mem USING (k) LEFT JOIN far USING (k))"
)
_PICK = lambda u, names: f"[{', '.join(map(Q.q, names))}][CAST(floor({u} * {len(names)}) AS INTEGER) + 1]"
_CATEGORY = {i: c for c, v in K.CATEGORIES.items() for i in v}
_PAIRS = ", ".join(f"({n}, {Q.q(i)}, {Q.q(p)}, {Q.q(_CATEGORY[i])}, {str(i in K.SENSITIVE).lower()}, {float(w * v)}::DOUBLE)" for n, (i, p, w, v) in enumerate((i, p, w, v) for i, w in K.INTENTS.items() for p, v in K.POLICIES.items() if (i, p) not in K.INVALID))
ORACLE = {
    "planned_turns": _PLAN + " SELECT record_id, turn_index, category, memory_kind FROM planned",
    "planned_mix": f"SELECT CAST(m AS INTEGER) AS n, CAST(greatest(0, m - tr - me) AS INTEGER) AS explore, tr AS transform, CAST(me AS INTEGER) AS memory FROM ({_COUNTS} range(0, 30) v(m))",
    "planned_intents": _PLAN
    + f", pairs AS (SELECT * FROM (VALUES {_PAIRS}) v(o, intent, policy, category, kind_, w)), "
    # A sensitive seed's memory turns permit no intent of their own, so all are permitted.
    + "ok AS (SELECT p.record_id, p.turn_index, o, q.intent, q.policy, w, sum(w) OVER (PARTITION BY p.record_id, p.turn_index ORDER BY o) AS upto, sum(w) OVER (PARTITION BY p.record_id, p.turn_index) AS total FROM planned p JOIN pairs q ON (p.s AND p.category = 'memory') OR (q.category = p.category AND (NOT p.s OR q.kind_))) "
    + f"SELECT record_id, turn_index, intent, policy FROM (SELECT *, {_U('record_id', 'turn_index')} AS u FROM ok) WHERE u * total >= upto - w AND u * total < upto",
    "planned_voices": _PLAN
    + f", w AS (SELECT record_id, turn_index, sum(1 + CAST(floor({_U('record_id', 'turn_index')} * {len(P.PERSONAS) - 1}) AS INTEGER)) OVER (PARTITION BY record_id ORDER BY turn_index) AS step FROM planned) SELECT record_id, turn_index, [{', '.join(map(Q.q, P.PERSONAS))}][CAST(step % {len(P.PERSONAS)} AS INTEGER) + 1] AS persona, {_PICK(_U('record_id', 'turn_index', chr(39) + 'verbosity' + chr(39)), P.VERBOSITIES)} AS verbosity FROM w",
    "drawn_topics": "SELECT i AS iteration, 'Write about:' || chr(10) || " + " || chr(10) || ".join(f"'- ' || {_PICK(_U('i', str(k)), POOL)}" for k in range(3)) + " || chr(10) || 'FORM: items 2' AS prompt FROM range(0, 40) v(i)",
    "generated_items": "WITH n AS (SELECT i, i % 5 + 1 AS n, coalesce(sum(i % 5 + 1) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM range(0, 60) v(i)) SELECT i AS iteration, CAST(p AS INTEGER) AS position, 2 AS n_follow FROM n, unnest(range(0, n)) u(p) WHERE before <= 100",
    "generated_pairs": "SELECT 30 AS n_iterations, count(*) AS n_failed, 4 * (30 - count(*)) AS n_items FROM range(0, 30) v(i) WHERE i % 7 = 3",
    "generated_conversations": "WITH n AS (SELECT i, i % 6 + 3 AS n, row_number() OVER (ORDER BY i) AS k FROM range(0, 40) v(i) WHERE i % 6 + 3 >= 5) SELECT i AS iteration, 6 AS n, CAST(greatest(6 - n, 0) AS INTEGER) AS n_blank FROM n WHERE k <= 12",
    "generated_preferences": "WITH n AS (SELECT i, i % 6 + 3 AS n, row_number() OVER (ORDER BY i) AS k FROM range(0, 40) v(i) WHERE i % 6 + 3 >= 5) SELECT i AS iteration, 6 AS n, CAST(greatest(6 - n, 0) AS INTEGER) AS n_blank, true AS accepted_in_prompt, false AS rejected_in_prompt FROM n WHERE k <= 12",
    "completed_at_once": Q._W + "SELECT completion_id, CAST(len(interactions) AS INTEGER) AS n, CAST(len(interactions) AS INTEGER) AS n_thinks FROM comp WHERE len(interactions) > 0",
    "completed_turn_by_turn": Q._W + "SELECT completion_id, CAST(len(interactions) AS INTEGER) AS n, CAST(len(interactions) AS INTEGER) AS n_thinks FROM comp WHERE len(interactions) > 0",
    "completed_preferences": Q._W + "SELECT completion_id, CAST(len(interactions) AS INTEGER) AS n, CAST(list_sum(list_transform(interactions, lambda x: length(coalesce(x.answer, '')))) AS BIGINT) AS n_accepted_chars FROM comp WHERE len(interactions) > 0",
}
_TURN = f"CAST(floor({_U('record_id', Q.q('label'))} * {len(S.LABELS)}) AS INTEGER)"
_LABEL = lambda names: f"[{', '.join(map(Q.q, names))}][({_TURN} + i) % {len(S.LABELS)} + 1]"
_FACT = lambda shift: f"[{', '.join(map(Q.q, S.ONSETS))}][(CAST(floor({_U('record_id', 'i', Q.q('onset'))} * {len(S.ONSETS)}) AS INTEGER) + {shift}) % {len(S.ONSETS)} + 1] || {_PICK(_U('record_id', 'i', Q.q('ending')), S.ENDINGS)} || {_LABEL(S.LABELS.values())}"
ORACLE |= {
    "personal_facts": Q._W + f"SELECT *, 'By the way, my ' || label || ' is ' || value || '.' AS plant, 'Actually, my ' || label || ' is now ' || new_value || '.' AS update, 'What is my ' || label || '?' AS recall FROM (SELECT record_id, CAST(i AS INTEGER) AS position, {_LABEL(S.LABELS)} AS label, {_FACT(0)} AS value, {_FACT(1)} AS new_value FROM mrl, unnest(range(0, 3)) v(i))",
    "rubric_scores": "WITH tr AS (" + Q.ORACLE["judge_transcript"].replace("WHERE interactions IS NOT NULL", "WHERE len(interactions) > 0") + "), h AS (SELECT completion_id, sha256(('0x' || left(sha256('42:' || completion_id), 8))::BIGINT || ':Grade:' || chr(10) || transcript) AS x FROM tr) SELECT completion_id, ('0x' || left(x, 2))::BIGINT % 11 <> 0 AS scored, CASE WHEN ('0x' || left(x, 2))::BIGINT % 11 <> 0 THEN CAST(1 + ('0x' || substr(x, 5, 2))::BIGINT % 10 AS INTEGER) END AS coherence FROM h",
}
_OTHERS = ("conversations_made",)
QUERIES = {n: globals()[n] for n in (*ORACLE, *_OTHERS)}
