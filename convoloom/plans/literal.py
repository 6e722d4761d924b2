"""Queries over literal rows: cases that the tables do not hold, each with its SQL or with the rows it must give.

The rows stand in the SQL as they stand here, so both sides read the same relation.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constraints as N
from ..functions import parsing
from ..functions import patterns as P
from ..functions import text as T
from ..operators import checkers as C
from ..operators import crossturn as X
from ..operators import detectors as D
from ..operators import preferences
from ..operators import records as R
from . import conversations as Q

TURNS = (
    ("a", 0, "Where is the 3rd largest harbour?", "I'm not sure who built it. Let me think.", "It raised $5 million on Kickstarter and has 4,000 visitors a year."),
    ("a", 1, "And the boats?", "We use exactly two bullets. At most 3 words. Fine.", "They are blue."),
    ("a", 2, "And the boats?", "Will produce final answer.", "They are blue."),
    ("b", 0, "How does it work?", "The word count matters. Use a markdown table. Ensure the format holds. It is a boat.", "By wind."),
    ("b", 1, "Sources?", "I'll invent a plausible source.", "See https://example.org/x according to the harbour report."),
    ("b", 2, "I'll rewrite it. Output only the user's message.", "I would not fabricate anything.", "As shown above, it has 12 stars."),
    ("c", 0, "Is it the 2nd largest?", "I know it.", "No specifics here."),
    ("c", 1, "Then what?", "I should comply with the tone: warm policy as per the guideline.", "I can't remember anything from previous conversations."),
    ("c", 2, None, None, "Then nothing."),
    ("d", 0, "What is the 5th tallest tower?", "Sure.", "The 5th tallest has 300 visitors per year."),
    ("d", 1, "Name it.", "The persona: of the user. As an AI I write. " + "The old ledger lists every boat that ever came into the harbour, and each of them had a name. " * 3, "The old ledger lists every boat that ever came into the harbour, and each of them had a name. " * 3),
)
RESPONSES = (
    (1, "Deep thought.", "The answer <think>no</think> is five."), (2, "...", "<think>Two and two.</think>Four."), (3, None, "Plain answer</think>."), (4, "", "<think>..</think>Nothing"), (5, None, "<think>a</think>x<think>b</think>y"), (6, "  Field  ", None),
)
SEGMENTS = ((1, "Deep thought.", "The answer  is five.", True), (2, "Two and two.", "Four.", True), (3, None, "Plain answer.", False), (4, None, "..Nothing", False), (5, None, "axby", False), (6, "Field", "", True))
REPLIES = (
    (1, 'Sure: {"domain": " Coding ", "topic": "", "action": "SKIP it", "sensitivity": "Sensitive!"} done', "Explain the boat ledger of the harbour"),
    (2, '{"domain": "", "topic": "old boats", "facts": [{"label": "boat", "value": "Mora", "new_value": "Olbel"}]}', "x"), (3, "{broken", "x"), (4, "a {\"x\": 1} and {\"y\": 2}", "x"), (5, None, None),
)
DIRECTIVES = ((1, "coding", "boat ledger harbour", "skip", "sensitive", None), (2, "general", "old boats", "keep", "none", "Mora"), (3, None, None, None, None, None), (4, None, None, None, None, None), (5, None, None, None, None, None))
CHATS = (
    (1, json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": "  {\"a\": 1} "}}], "usage": {"prompt_tokens": 7, "completion_tokens": 5, "total_tokens": 12, "completion_tokens_details": {"reasoning_tokens": 2}}})),
    (2, json.dumps({"choices": [{"finish_reason": "length", "message": {"content": [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}}]})),
    (3, json.dumps({"choices": [{"message": {"content": None, "reasoning_content": "no object", "reasoning": " {\"b\": 2} "}}], "usage": {}})),
    (4, json.dumps({"choices": []})), (5, "no json"), (6, json.dumps({"choices": [{"message": {"content": "[1, 2]"}}]})),
)
CONTENTS = ((1, '{"a": 1}', "stop", 7, 5, 12, 2), (2, "one\ntwo", "length", None, None, None, None), (3, '{"b": 2}', None, None, None, None, None), (4, "", None, None, None, None, None), (5, "", None, None, None, None, None), (6, "[1, 2]", None, None, None, None, None))
LISTS = (
    (1, "[('q1', 'a1', [('f1', 'b1'), ('f2', 'b2')]), ('q2', 'a2', [])"), (2, "<think>" + "x" * 14 + "('q', 'a')]"), (3, "[('only',)]"), (4, "[]"), (5, "no list"), (6, None), (7, "[('q', 'a'), ('r', 'b', [('f', 'c', 'd')])]"),
)
ITEMS = ((1, 2, "q1", 2), (2, 1, "q", 0), (3, None, None, None), (4, 0, None, None), (5, None, None, None), (6, None, None, None), (7, None, None, None))
PREFERENCES = (
    (1, "```python\n[{'query': 'q', 'accepted': {'think': 't', 'answer': 'a'}, 'rejected': {'answer': 'r'}}, {'query': 'odd'}]\n```"), (2, '{"query": "q", "accepted": {"answer": "same"}, "rejected": {"answer": " same "}}'),
    (3, "[{'query': 'a', 'accepted': {}, 'rejected': {}}, {'query': 'b', 'accepted': {'answer': 'x'}, 'rejected': {'answer': 'y'}}, {'query': 'c', 'acc"), (4, "nothing"), (5, None),
)
PARSED = ((1, 1, "q", "a", "r", 0, 2), (2, 1, "q", "same", " same ", 1, 2), (3, 2, "a", "", "", 1, 2), (4, None, None, None, None, None, None), (5, None, None, None, None, None, None))
SCOPES = (("a", 0, "From now on answer in JSON.", "standing"), ("a", 1, "Answer in JSON.", "standing"), ("a", 2, "Answer in JSON.", "current_turn"), ("b", 0, None, "standing"), ("b", 1, "ALWAYS be brief.", "standing"))
UPDATES = (
    (1, "The value is now Olbel.", "Olbel", "Mora"), (2, "It was Mora, now Olbel.", "Olbel", "Mora"), (3, "I cannot recall that.", "Olbel", "Mora"), (4, "olbel!", "Olbel", "Mora"), (5, None, "Olbel", "Mora"),
)
FACTS = (("a", "boat", 0), ("a", "name", 3), ("b", "boat", 2))
ASKED = (("a", 0), ("a", 3), ("a", 4), ("a", 8), ("b", 2), ("b", 6))


RULES = ((1, "first_letter", "letter", "B"), (2, "forbidden_token", "token", "Boat"), (3, "n_bullets", "n", "5"), (4, "json_valid", None, None), (5, "odd", None, None), (6, "length_tokens", "max_words", None))
ASKED_FOR = (
    (1, "'b'|letter b|start with b", "say that again so that each sentence begins with the letter 'B'"), (2, "'boat'|boat|the word", "say that again without the word 'Boat'"), (3, "5|bullet", "sum that up in 5 bullet points"),
    (4, "json", "give that answer again as one valid JSON object"), (5, "", "revise that answer"), (6, "|word|shorter|concise|compress|trim", "say that again in no more than  words"),
)


def rows(spark: SparkSession, values: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def literal(values: tuple, *names: str) -> str:
    """The rows as a relation of SQL."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else Q.q(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in values) + f") v({', '.join(names)})"


def _turns(spark: SparkSession) -> DataFrame:
    return rows(spark, TURNS, "c string, turn_index int, query string, reasoning string, answer string")


def literal_flags(spark, d):
    """Flags of detectors A, B, D and E."""
    return D.all_flags(_turns(spark)).select("c", "turn_index", "detector", "name", "severity")


def literal_evidence(spark, d):
    return D.confidence_mismatch(_turns(spark)).select("c", "turn_index", "name", "evidence")


def literal_prefilter(spark, d):
    return D.prefilter(_turns(spark))


def literal_cues(spark, d):
    return D.exploratory_cues(_turns(spark))


def literal_rewrites(spark, d):
    from ..operators import conversations as V

    return V.identical_rewrites(_turns(spark))


def literal_answer_defects(spark, d):
    return D.answer_defects(_turns(spark))


def literal_format(spark, d):
    return D.format_bookkeeping(_turns(spark)).select("c", "turn_index", "evidence")


def literal_standing(spark, d):
    t = rows(spark, SCOPES, "c string, turn_index int, query string, scope string")
    return D.phantom_standing(t).select("c", "turn_index", "name", "severity", "evidence")


def literal_segments(spark, d):
    s = T.segment_response(F.col("field"), F.col("content"))
    x = rows(spark, RESPONSES, "id int, field string, content string").select("id", s.alias("s"))
    return x.select("id", "s.reasoning", "s.answer", "s.well_formed")


def literal_directives(spark, d):
    x = rows(spark, REPLIES, "id int, reply string, query string").select("id", parsing.directive(F.col("reply"), F.col("query")).alias("d"))
    return x.select("id", "d.domain", "d.topic", "d.action", "d.sensitivity", F.col("d.facts")[0]["value"].alias("fact"))


def literal_greedy_json(spark, d):
    return rows(spark, REPLIES, "id int, reply string, query string").select("id", parsing.greedy_object(F.col("reply")).isNotNull().alias("is_object"))


def literal_chat_responses(spark, d):
    c = F.col("body")
    x = rows(spark, CHATS, "id int, body string").select("id", parsing.response_content(c).alias("content"), parsing.response_metadata(c).alias("m"))
    return x.select("id", "content", "m.finish_reason", "m.prompt_tokens", "m.completion_tokens", "m.total_tokens", "m.reasoning_tokens")


def literal_items(spark, d):
    x = rows(spark, LISTS, "id int, body string").select("id", parsing.parse_items("body").alias("i"))
    first = F.try_element_at("i", F.lit(1))
    return x.select("id", F.when(F.col("i").isNotNull(), F.size("i")).alias("n"), first["query"].alias("query"), F.when(first.isNotNull(), F.size(first["interactions"])).alias("n_follow"))


def literal_preferences(spark, d):
    x = rows(spark, PREFERENCES, "id int, body string").select("id", parsing.parse_preferences("body").alias("p"))
    first = F.try_element_at("p", F.lit(1))
    n = F.size("p")
    fit = F.size(preferences.fitted(F.col("p"), 2, preferences.blank_preference(), 0.5))
    some = lambda c: F.when(F.col("p").isNotNull(), c)
    return x.select("id", some(n).alias("n"), first["query"].alias("query"), first["accepted"]["answer"].alias("accepted"), first["rejected"]["answer"].alias("rejected"), some(F.size(preferences.same_sides(F.col("p")))).alias("n_same"), some(fit).alias("n_fitted"))


def literal_updates(spark, d):
    x = rows(spark, UPDATES, "id int, answer string, value string, stale string")
    return x.select("id", C.check("fact_update", F.col("answer"), {"value": "Olbel", "stale_values": ["Mora"]}).alias("passed"), C.check("fact_recall", F.col("answer"), {"value": "the Olbel boat", "match": "fuzzy"}).alias("fuzzy"))


def literal_known_facts(spark, d):
    """For each turn the oldest fact that may be recalled (planted 4 turns before or more) and the newest that may be updated."""
    f, t = rows(spark, FACTS, "c string, fact_id string, planted_turn int"), rows(spark, ASKED, "c string, turn_index int")
    old = R.recallable(f, t, 4).withColumnRenamed("fact_id", "recallable")
    new = R.updatable(f, t).withColumnRenamed("fact_id", "updatable")
    return t.join(old, ["c", "turn_index"], "left").join(new, ["c", "turn_index"], "left")


def literal_requests(spark, d):
    """Markers and wording of constraints with their parameters."""
    x = rows(spark, RULES, "id int, kind string, name string, value string")
    params = F.when(F.col("name").isNotNull(), F.create_map("name", "value"))
    return x.select("id", F.array_join(N.markers(F.col("kind"), params), "|").alias("markers"), N.request(F.col("kind"), params).alias("request"))


_LIT = "WITH turns AS (SELECT * FROM " + literal(TURNS, "c", "turn_index", "query", "reasoning", "answer") + ") "
_FIRST = lambda x, patterns: "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce({x}, ''), {Q.q('(?i)(' + p + ')')}, 1)[1:50], '')" for p in patterns) + ")"


def _guarded(x: str, patterns: list[str]) -> str:
    """The first match of a pattern without a negation shortly before it, by the patterns' order."""
    one = lambda p: f"CASE WHEN {Q.has(x, p)} AND NOT regexp_matches(right(regexp_extract(coalesce({x}, ''), {Q.q('(?is)^(.*?)(?:' + p + ')')}, 1), {P.NEGATION_REACH}), {Q.q('(?i)' + P.NEGATION)}) THEN regexp_extract({x}, {Q.q('(?i)(' + p + ')')}, 1)[1:50] END"
    return "coalesce(" + ", ".join(map(one, patterns)) + ")"


_SPECIFIC = "CASE " + " ".join(f"WHEN {Q.has('answer', p)} THEN {Q.q(n + ' ' + chr(39))} || regexp_extract(answer, {Q.q('(?i)(' + p + ')')}, 1)[1:50] || chr(39)" for n, p in P.SPECIFICS.items()) + " END"


def confidence_sql(head: str) -> str:
    """Common table expressions up to `a` (c, turn_index, name, evidence): detector A over `turns`."""
    return (
        head + f", x AS (SELECT c, turn_index, query, {_SPECIFIC} AS s, {_guarded('reasoning', P.UNCERTAINTY)} AS u, {_guarded('reasoning', P.ADMISSION)} AS m FROM turns), "
        f"g AS (SELECT c, min_by(query, turn_index) AS q, min(turn_index) FILTER (WHERE s IS NOT NULL) AS st, min(turn_index) FILTER (WHERE s IS NOT NULL AND u IS NOT NULL) AS ut, min(turn_index) FILTER (WHERE m IS NOT NULL) AS mt FROM x GROUP BY c HAVING st IS NOT NULL), "
        f"k AS (SELECT *, CASE WHEN ut IS NOT NULL THEN 'confidence_uncertainty_mismatch' WHEN {Q.has('q', P.UNGROUNDED_PREMISE)} THEN 'ungrounded_premise_fabrication' WHEN mt IS NOT NULL THEN 'fabrication_admission' END AS name FROM g), "
        "a AS (SELECT k.c, coalesce(ut, st) AS turn_index, name, CASE name WHEN 'confidence_uncertainty_mismatch' THEN 'unsure: ''' || y.u || ''', asserts ' || y.s WHEN 'ungrounded_premise_fabrication' THEN 'premise: ''' || coalesce(q, '')[1:45] || ''', asserts ' || z.s ELSE 'turn ' || mt || ' admits ''' || w.m || ''', asserts ' || z.s END AS evidence "
        "FROM k LEFT JOIN x y ON y.c = k.c AND y.turn_index = ut LEFT JOIN x z ON z.c = k.c AND z.turn_index = st LEFT JOIN x w ON w.c = k.c AND w.turn_index = mt WHERE name IS NOT NULL)"
    )


_MECHANIC = Q.has("s", P.FORMAT_MECHANICS)
_FORMAT = (
    ", fs AS (SELECT c, turn_index, list_filter(string_split(regexp_replace(coalesce(reasoning, ''), '([.!?\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\\S')) AS ss FROM turns), "
    f"fm AS (SELECT c, turn_index, len(ss) AS n, len(list_filter(ss, lambda s: {_MECHANIC})) AS k FROM fs), f AS (SELECT c, turn_index, k || '/' || n AS evidence FROM fm WHERE k >= 2 AND k >= 0.45 * n)"
)
_FLAGS = (
    " SELECT c, turn_index, 'A' AS detector, name, 3 AS severity FROM a UNION ALL "
    f"SELECT c, turn_index, 'B', 'fabricated_specifics', CAST(least(k, 3) AS INTEGER) FROM (SELECT c, turn_index, {Q._SPEC} AS k FROM turns) WHERE k > 0 UNION ALL "
    "SELECT c, turn_index, 'D', 'format_bookkeeping_reasoning', 1 FROM f UNION ALL "
    f"SELECT c, turn_index, 'E', 'filler_tail', 1 FROM turns WHERE {' OR '.join(Q.has('reasoning', p) for p in P.FILLER_TAIL)} UNION ALL SELECT c, turn_index, 'E', 'answer_duplicated_in_reasoning', 1 FROM turns WHERE length(coalesce(answer, '')) > 200 AND {Q._overlap('reasoning', 'answer')} >= 0.82"
)


def hard_sql(head: str, regenerations: str = "false") -> str:
    kinds = {**Q._KINDS, "excess_regenerations": regenerations}
    return head + ", hard AS (" + " UNION ALL ".join(f"SELECT c, turn_index, '{k}' AS kind FROM turns WHERE {v}" for k, v in kinds.items()) + ")"


PREFILTER = " SELECT c, count(*) AS n_turns, CAST(coalesce(any_value(b.n), 0) AS BIGINT) AS n_hard, any_value(b.n) IS NULL AS passed FROM turns LEFT JOIN (SELECT c, count(*) AS n FROM (SELECT c FROM hard UNION ALL SELECT c FROM a) GROUP BY c) b USING (c) GROUP BY c"
PREVALENCE = ", flags AS (" + _FLAGS + ") SELECT detector, count(DISTINCT c) AS n_conversations, count(*) AS n_flags, round(100.0 * count(DISTINCT c) / (SELECT count(DISTINCT c) FROM turns), 2) AS pct FROM flags GROUP BY detector"

ORACLE = {
    "literal_flags": confidence_sql(_LIT) + _FORMAT + _FLAGS,
    "literal_evidence": confidence_sql(_LIT) + " SELECT * FROM a",
    "literal_prefilter": hard_sql(confidence_sql(_LIT)) + PREFILTER,
    "literal_cues": _LIT + "SELECT cue, count(*) AS n FROM turns, (VALUES " + ", ".join(f"({Q.q(c)})" for c in P.EXPLORATORY_CUES) + f") v(cue) WHERE contains(lower(coalesce(reasoning, '')), cue) AND NOT {Q.has('reasoning', P.HARNESS)} GROUP BY cue",
    "literal_rewrites": _LIT + f"SELECT c, turn_index FROM (SELECT *, lag(answer) OVER (PARTITION BY c ORDER BY turn_index) AS prev FROM turns) WHERE NOT ({Q._BLANK('answer')}) AND trim(answer) = trim(prev)",
    "literal_answer_defects": _LIT + " UNION ALL ".join(f"SELECT c, turn_index, '{k}' AS defect FROM turns WHERE {v}" for k, v in Q._DEFECTS.items()),
    "literal_format": _LIT.rstrip() + _FORMAT + " SELECT * FROM f",
    "literal_standing": f"SELECT c, turn_index, 'phantom_standing_constraint' AS name, 2 AS severity, query[1:60] AS evidence FROM {literal(SCOPES, 'c', 'turn_index', 'query', 'scope')} WHERE scope = 'standing' AND coalesce(query, '') <> '' AND NOT {Q.has('query', P.STANDING_LICENCE)}",
    "literal_segments": f"SELECT * FROM {literal(SEGMENTS, 'id', 'reasoning', 'answer', 'well_formed')}",
    "literal_directives": f"SELECT * FROM {literal(DIRECTIVES, 'id', 'domain', 'topic', 'action', 'sensitivity', 'fact')}",
    "literal_greedy_json": f"SELECT id, coalesce(regexp_extract(reply, '(?s)\\{{.*\\}}') <> '' AND json_valid(regexp_extract(reply, '(?s)\\{{.*\\}}')), false) AS is_object FROM {literal(REPLIES, 'id', 'reply', 'query')}",
    "literal_chat_responses": f"SELECT id, content, finish_reason, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens, CAST(total_tokens AS BIGINT) AS total_tokens, CAST(reasoning_tokens AS BIGINT) AS reasoning_tokens FROM {literal(CONTENTS, 'id', 'content', 'finish_reason', 'prompt_tokens', 'completion_tokens', 'total_tokens', 'reasoning_tokens')}",
    "literal_items": f"SELECT * FROM {literal(ITEMS, 'id', 'n', 'query', 'n_follow')}",
    "literal_preferences": f"SELECT * FROM {literal(PARSED, 'id', 'n', 'query', 'accepted', 'rejected', 'n_same', 'n_fitted')}",
    "literal_updates": f"SELECT id, coalesce(NOT {Q.has('answer', P.RECALL_REFUSAL)} AND contains({Q._NORM('answer')}, {Q._NORM('value')}) AND NOT contains({Q._NORM('answer')}, {Q._NORM('stale')}), false) AS passed, coalesce(NOT {Q.has('answer', P.RECALL_REFUSAL)} AND 2 * len(list_intersect(['the', 'olbel', 'boat'], string_split({Q._NORM('answer')}, ' '))) >= 3, false) AS fuzzy FROM {literal(UPDATES, 'id', 'answer', 'value', 'stale')}",
    "literal_requests": f"SELECT * FROM {literal(ASKED_FOR, 'id', 'markers', 'request')}",
    "literal_known_facts": f"WITH f AS (SELECT * FROM {literal(FACTS, 'c', 'fact_id', 'planted_turn')}), t AS (SELECT * FROM {literal(ASKED, 'c', 'turn_index')}) SELECT c, turn_index, (SELECT min_by(fact_id, planted_turn) FROM f WHERE f.c = t.c AND t.turn_index - planted_turn >= 4) AS recallable, (SELECT max_by(fact_id, planted_turn) FROM f WHERE f.c = t.c AND planted_turn < t.turn_index) AS updatable FROM t",
}
QUERIES = {n: globals()[n] for n in ORACLE}
