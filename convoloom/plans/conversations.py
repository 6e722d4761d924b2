"""Queries over conversations and single texts, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import checkers as C
from ..operators import conversations as V
from ..operators import crossturn as X
from ..operators import detectors as D
from ..sources.tables import table

TAILS = ("", " Will produce final answer.", "\nProceed.", " Okay, let's go.")
RULES = (("length_tokens", {"max_words": 60}), ("max_words_per_sentence", {"max_words": 22}), ("no_gendered_pronouns", {}), ("n_lines", {"n": 1}))
CHECKS = (
    ("json_valid", {}), ("markdown_table", {}), ("n_bullets", {}), ("n_bullets_5", {"n": 5}), ("length_tokens", {"min_words": 10, "max_words": 60}), ("n_lines", {"n": 1}), ("limerick_structure", {}),
    ("max_words_per_sentence", {"max_words": 22}), ("no_gendered_pronouns", {}), ("alphabetical_sentence_starts", {}), ("first_letter", {"letter": "t"}), ("forbidden_token", {"token": "model"}), ("fact_recall", {"value": "the model recalled"}), ("markdown_format", {}),
)


def _completions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return V.latest_rows(table(spark, d, "reasoning_completions"), "completion_id", columns=columns or ("interactions",))


def _mrl(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return V.latest_rows(table(spark, d, "mrl_records"), "record_id", columns=columns or ("_subset",))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return V.turns(_completions(spark, d), "completion_id")


def turn_rows(spark, d):
    return _turns(spark, d)


def conversation_stats(spark, d):
    return V.stats(_completions(spark, d), "completion_id")


def interactions_nonempty(spark, d):
    return V.nonempty(_completions(spark, d)).select("completion_id")


def interactions_by_length(spark, d):
    return V.by_length(_completions(spark, d), 2, 3).select("completion_id")


def interactions_histogram(spark, d):
    return V.length_histogram(_completions(spark, d))


def marked_text(spark, d):
    return _completions(spark, d).select("completion_id", F.posexplode(V.marked_text(F.col("interactions"))).alias("turn_index", "marked"))


def judge_transcript(spark, d):
    return _completions(spark, d).filter("interactions IS NOT NULL").select("completion_id", V.transcript(F.col("interactions")).alias("transcript"))


def plain_transcript(spark, d):
    return _completions(spark, d).filter("interactions IS NOT NULL").select("completion_id", V.plain_transcript(F.col("interactions")).alias("transcript"))


def role_messages(spark, d):
    return _completions(spark, d).select("completion_id", F.posexplode(V.messages(F.col("interactions"))).alias("position", "m")).select("completion_id", "position", "m.role", "m.content")


def turn_hard_fails(spark, d):
    return D.hard_fails(_turns(spark, d))


def prefilter_result(spark, d):
    return D.prefilter(_turns(spark, d))


def turn_specifics(spark, d):
    return D.fabricated_specifics(_turns(spark, d)).select("c", "turn_index", "name", "severity")


def turn_answer_defects(spark, d):
    return D.answer_defects(_turns(spark, d))


def turn_filler_tails(spark, d):
    return D.reasoning_artifacts(_turns(spark, d)).select("c", "turn_index", "name", "severity")


def format_bookkeeping(spark, d):
    return D.format_bookkeeping(_turns(spark, d)).select("c", "turn_index", "evidence")


def defect_prevalence(spark, d):
    return D.prevalence(_turns(spark, d))


def identical_rewrite(spark, d):
    return V.identical_rewrites(_turns(spark, d))


def answer_quality_gate(spark, d):
    return _turns(spark, d).groupBy(F.coalesce(T.quality(F.col("answer")), F.lit("ok")).alias("result")).agg(F.count("*").alias("n"))


def reasoning_shape(spark, d):
    t = _turns(spark, d).filter(F.col("reasoning").rlike(r"\S"))
    r = F.col("reasoning")
    return t.select("c", "turn_index", T.word_count(r).alias("n_words"), F.size(T.sentences(r)).alias("n_sentences"), T.nonempty_lines(r).alias("n_lines"), T.degenerate(r).alias("degenerate"), T.restarts(r).alias("restarts"), F.round(T.repeat_ratio(r), 6).alias("repeat_ratio"))


def reasoning_answer_overlap(spark, d):
    return _turns(spark, d).select("c", "turn_index", F.round(T.overlap(F.col("reasoning"), F.col("answer")), 6).alias("overlap"), F.round(T.jaccard(F.col("query"), F.col("answer")), 6).alias("jaccard"))


def repeat_ratio_by_source(spark, d):
    x = table(spark, d, "documents").filter("text IS NOT NULL").select("source", T.repeat_ratio(F.col("text")).alias("r"))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_ratio"), F.sum((F.col("r") > 0.5).cast("long")).alias("n_high"))


def checker_results(spark, d):
    """One row per record and checker."""
    x = _mrl(spark, d, "answer").filter("answer IS NOT NULL")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("checker"), C.check(n.replace("_5", ""), F.col("answer"), p).alias("passed")) for n, p in CHECKS))).alias("x")
    return x.select("record_id", each).select("record_id", "x.checker", "x.passed")


def standing_adherence(spark, d):
    """The rule number pmod(turn_index, 4) of each turn, checked against every later answer."""
    t = _turns(spark, d)
    j = D.standing_checks(t, t.select("c", "turn_index", F.pmod("turn_index", F.lit(len(RULES))).alias("rule")))
    ok = F.coalesce(*(F.when(F.col("rule") == i, C.check(n, F.col("answer"), p)) for i, (n, p) in enumerate(RULES)))
    return j.groupBy("rule").agg(F.count("*").alias("n_checks"), F.sum(ok.cast("long")).alias("n_passed"))


def duplicate_query_first(spark, d):
    return V.first_of(_mrl(spark, d, "query").filter("query IS NOT NULL"), "query", ["record_id"]).select("query", "record_id")


def per_subset_head(spark, d):
    return V.head_per(_mrl(spark, d).select("record_id", "_subset"), "_subset", ["record_id"], 5)


def sample_per_subset(spark, d):
    return V.sample_per(_mrl(spark, d).select("record_id", "_subset"), "_subset", "record_id", 5)


def split_by_position(spark, d):
    a, b = V.split_at(_mrl(spark, d).select("record_id"), "record_id", 100)
    return a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)))


def union_append(spark, d):
    m = _mrl(spark, d, "query", "answer")
    return V.append(m.filter("record_id % 2 = 0").select("record_id", "query", "answer"), m.filter("record_id % 2 = 1").select("record_id", "query"))


def example_ids(spark, d):
    return _completions(spark, d, "_subset", "_sample_index", "topics").select("completion_id", V.example_id(F.col("_subset"), F.col("_sample_index"), F.coalesce("topics", F.lit(""))).alias("example_id"))


def derive_variants(spark, d):
    v = V.variants(_completions(spark, d).filter("interactions IS NOT NULL"), "completion_id", ("reasoning", "instruct"))
    return v.select("conversation_id", "variant", F.size("interactions").cast("long").alias("n"), F.size(F.filter("interactions", lambda x: x["think"].isNotNull())).cast("long").alias("n_thinks"))


def seed_curation(spark, d):
    return V.seeds(_mrl(spark, d, "query"), "record_id")


def think_parse(spark, d):
    wrapped = F.concat(F.when(F.col("turn_index") % 3 < 2, F.concat(F.lit("<think>"), T.text("reasoning"), F.lit("</think>"))).otherwise(F.lit("")), T.text("answer"))
    p = T.parse_think(wrapped)
    return _turns(spark, d).select("c", "turn_index", p["well_formed"].alias("well_formed"), F.length(p["answer"]).alias("n_answer"))


def exploratory_cues(spark, d):
    return D.exploratory_cues(_turns(spark, d))


def _scores(spark, d):
    return _completions(spark, d, "overall_score", "memory_score").select(F.col("completion_id").alias("c"), F.col("overall_score").alias("coherence"), F.col("memory_score").alias("appropriateness"))


def gate_decision(spark, d):
    """Accepted conversations: no hard fail, and neither of the two known axes below its minimum."""
    hard = D.hard_fails(_turns(spark, d)).select("c").distinct().withColumn("bad", F.lit(True))
    s = _scores(spark, d).join(hard, "c", "left")
    return s.select("c", D.gate(s, F.col("bad").isNull()).alias("accepted"))


def _judged(spark, d):
    """Turns with regenerations, and scores on four axes with flagged turns, derived from what the tables hold."""
    t = _turns(spark, d).withColumn("regenerations", F.pmod(F.col("c") + F.col("turn_index"), F.lit(4)).cast("int"))
    flag = F.when(F.col("overall_score") < 4, F.array(F.struct(F.lit(0).alias("turn_index"), F.when(F.col("memory_score") < 5, "recall_fidelity").otherwise("coherence").alias("dimension"), F.lit(2).alias("severity")))).otherwise(F.array())
    s = _completions(spark, d, "overall_score", "memory_score").select(F.col("completion_id").alias("c"), F.col("overall_score").alias("coherence"), F.col("memory_score").alias("appropriateness"), F.greatest("overall_score", "memory_score").alias("reasoning_quality"), F.least("overall_score", "memory_score").alias("reasoning_answer_consistency"), F.coalesce(flag, F.array()).alias("flagged_turns"))
    return t, s


def batch_summary(spark, d):
    return D.accepted(D.batch_summary(*_judged(spark, d)))


def batch_counts(spark, d):
    return D.batch_counts(*_judged(spark, d))


def variant_thinks(spark, d):
    """Turns of the mixed variant that keep their thinking."""
    v = V.variants(_completions(spark, d).filter("interactions IS NOT NULL"), "completion_id", ("mixed",))
    return v.select("conversation_id", F.posexplode("interactions").alias("turn_index", "x")).select("conversation_id", "turn_index", F.col("x.think").isNotNull().alias("thinks"))


def sampled_rows(spark, d):
    return V.sampled(_mrl(spark, d).select("record_id"), "record_id", 50)


def rows_per_subset(spark, d):
    return V.subset_counts(_mrl(spark, d))


def new_heads(spark, d):
    """The first three records per subset that the five first ones don't hold."""
    m = _mrl(spark, d).select("record_id", "_subset")
    return V.exclusive_head(m, V.head_per(m, "_subset", ["record_id"], 5), "record_id", "_subset", 3)


def zipped_seeds(spark, d):
    """Queries and curated directives joined by their place in the order of ids."""
    m = _mrl(spark, d, "query").select("record_id", "query")
    x = V.joined_by_position(m, V.seeds(m, "record_id").select("record_id", "action", "domain"), ["record_id"])
    return x.select("record_id", "action", "domain")


def content_ids(spark, d):
    """Example ids over the canonical JSON of an example."""
    j = V.canonical_json({"topics": F.col("topics"), "conv_mode": F.col("conv_mode")})
    return _completions(spark, d, "_subset", "_sample_index", "topics", "conv_mode").select("completion_id", j.alias("content"), V.example_id(F.col("_subset"), F.col("_sample_index"), j).alias("example_id"))


def prior_references(spark, d):
    """Turns whose query points back, or names a word of the conversation's topics."""
    c = _completions(spark, d, "topics", "interactions")
    t = V.turns(c, "completion_id").join(c.select(F.col("completion_id").alias("c"), "topics"), "c")
    return t.select("c", "turn_index", T.references_prior(F.col("query"), F.col("topics")).alias("refers"), T.prompt_echo(F.col("query")).alias("echo"))


def clean_reasoning(spark, d):
    return _turns(spark, d).filter("reasoning IS NOT NULL").select("c", "turn_index", F.length(T.sanitize(F.concat("reasoning", F.element_at(F.array(*map(F.lit, TAILS)), (F.pmod(F.col("c") + F.col("turn_index"), F.lit(len(TAILS))) + 1).cast("int"))))).alias("n_chars"))


def rule_pass_rates(spark, d):
    """Pass rate of each of the four rules over all answers, by conversation mode."""
    t = _completions(spark, d, "conv_mode", "interactions").select("conv_mode", F.explode("interactions").alias("i")).select("conv_mode", F.col("i.answer").alias("answer"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), C.check(n, F.col("answer"), p).alias("passed")) for n, p in RULES))).alias("x")
    return D.pass_rates(t.select("conv_mode", each).select("conv_mode", "x.rule", "x.passed"), ["conv_mode", "rule"])


def _facts(spark, d):
    """The first capitalised word of a turn's query as the value of the conversation's one fact."""
    name = F.regexp_extract(T.text("query"), r"\b([A-Z][a-z]{5,})\b", 1)
    return _turns(spark, d).select("c", F.lit("name").alias("fact_id"), F.col("turn_index").alias("turn"), name.alias("value")).filter("value <> ''")


def cross_turn_checks(spark, d):
    """Even turns must update the fact, odd ones recall it."""
    t = _turns(spark, d).withColumns({"fact_id": F.lit("name"), "kind": F.when(F.col("turn_index") % 2 == 0, "update_overwrite").otherwise("delayed_recall")})
    return X.recall_checks(t, _facts(spark, d))


def cross_turn_pass_rate(spark, d):
    return X.pass_rate(cross_turn_checks(spark, d))


def turn_verification(spark, d):
    """First failure of each turn; the own rule is that of its number, and every third turn is a compression."""
    own = F.coalesce(*(F.when(F.col("turn_index") % len(RULES) == i, C.check(n, F.col("answer"), p)) for i, (n, p) in enumerate(RULES)))
    t = _turns(spark, d).withColumn("intent", F.when(F.col("turn_index") % 3 == 1, "compress"))
    return X.verified(t, own).groupBy(F.coalesce("failure", F.lit("verified")).alias("result")).agg(F.count("*").alias("n"))


def record_defect_counts(spark, d):
    """Defects of conversations whose plan is derived from their numbers."""
    k = F.pmod(F.col("c") + F.col("turn_index"), F.lit(5))
    intent = F.element_at(F.array(*map(F.lit, ("compress", "fact_recall", "fact_update", "restyle", "deepen"))), (k + 1).cast("int"))
    name = F.regexp_extract(T.text("query"), r"\b([A-Z][a-z]{5,})\b", 1)
    please = F.array(F.lit("Please"))
    t = _turns(spark, d).withColumns({"verifier": F.when(k == 3, "programmatic"), "markers": please, "intent": intent, "scope": F.when(k == 1, "delayed_recall"), "planted_turn": F.lit(0), "value": F.when(k == 2, F.lit("premium plan")).otherwise(name), "stale_values": F.array(F.lit("Zanzibar"))})
    c = _scores(spark, d).join(_completions(spark, d, "topics").select(F.col("completion_id").alias("c"), F.col("topics").alias("first_query")), "c").withColumns({"sensitive": F.col("c") % 7 == 0, "role_consistency": F.col("coherence")})
    return X.record_defects(t, c).groupBy("defect").agg(F.count("*").alias("n"))


def materialised_subsets(spark, d):
    return V.materialised(_mrl(spark, d).select("record_id", "_subset").filter("_subset IS NOT NULL"), "invented", "_subset", "record_id", 3)


def yaml_answers(spark, d):
    return _mrl(spark, d, "answer").select("record_id", C.check("yaml_valid", F.col("answer")).alias("valid"))


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(x: str, patterns) -> str:
    return f"regexp_matches(coalesce({x}, ''), {q(T.any_of(patterns))})"


def _latest(t: str, key: str) -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) AS rn FROM {t} WHERE {key} IS NOT NULL) WHERE rn = 1)"


_W = (
    f"WITH comp AS {_latest('reasoning_completions', 'completion_id')}, mrl AS {_latest('mrl_records', 'record_id')}, "
    "turns AS (SELECT completion_id AS c, CAST(i - 1 AS INTEGER) AS turn_index, interactions[i].query AS query, interactions[i].think AS reasoning, interactions[i].answer AS answer FROM comp, unnest(range(1, len(interactions) + 1)) AS u(i)) "
)
_BLANK = lambda x: f"NOT regexp_matches(coalesce({x}, ''), '\\S')"
_WORDS = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_COUNT = lambda x: f"len(regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_][''\\p{{L}}\\p{{N}}_-]*'))"
_CLEAN = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '[\\s]+', ' ', 'g'))"
_SENT = lambda x: f"list_filter(string_split(regexp_replace({_CLEAN(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[^\\s\\p{{Z}}]'))"
_LINES = lambda x: f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '\\r\\n|\\n|\\r'), lambda s: regexp_matches(s, '[^\\s\\p{{Z}}]')))"


def _grams(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def _repeat(x: str) -> str:
    w = _WORDS(x)
    return f"CASE WHEN len({w}) < 6 THEN 0.0 ELSE 1 - len(list_distinct({_grams(w, 3)})) / len({_grams(w, 3)}) END"


def _overlap(a: str, b: str) -> str:
    x, y = f"list_distinct({_grams(_WORDS(a), 2)})", f"list_distinct({_grams(_WORDS(b), 2)})"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / least(len({x}), len({y})) END"


def _jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({_WORDS(a)})", f"list_distinct({_WORDS(b)})"
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"


_UNITS = lambda x: f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[\\n.;]+'), lambda u: lower(trim(u))), lambda u: length(u) > 3)"
_DEGENERATE = lambda x: f"(len({_UNITS(x)}) >= 6 AND 1 - len(list_distinct({_UNITS(x)})) / len({_UNITS(x)}) > 0.4)"
_RESTARTS = lambda x: f"len(regexp_extract_all(coalesce({x}, ''), {q('(?im)' + P.RESTART)}))"
_INDEX = lambda x: f"(regexp_matches(coalesce({x}, ''), {q(P.TURN_INDEX_STRICT)}) OR {has(x, P.TURN_INDEX_CUE)})"
_TRIM = lambda x: f"regexp_replace(coalesce({x}, ''), '\\s+$', '')"
_ARTIFACT = lambda x: f"(regexp_matches({_TRIM(x)}, {q(P.ARTIFACT_KNOWN)}) OR (regexp_extract({_TRIM(x)}, {q(P.ARTIFACT_TAIL)}, 1) NOT IN ('', {', '.join(map(q, P.ARTIFACT_ALLOWED))})))"
_KINDS = dict(
    zip(
        D.KINDS,
        (
            _INDEX("answer"), _INDEX("reasoning"), f"len(regexp_extract_all(coalesce(reasoning, ''), {q('(?im)' + P.FLOW_LINE)})) >= 2", has("reasoning", P.HARNESS),
            f"({_ARTIFACT('query')} OR {_ARTIFACT('reasoning')} OR {_ARTIFACT('answer')})", _DEGENERATE("reasoning"), f"(NOT {_DEGENERATE('reasoning')} AND {_RESTARTS('reasoning')} >= {P.RESTARTS_FAIL})", "false",
        ),
        strict=True,
    )
)
_HARD = _W + ", hard AS (" + " UNION ALL ".join(f"SELECT c, turn_index, '{k}' AS kind FROM turns WHERE {v}" for k, v in _KINDS.items()) + ")"
_SPEC = " + ".join(f"CAST({has('answer', p)} AS INTEGER)" for p in P.SPECIFICS.values())
_DEFECTS = {
    "prompt_echo": has("query", P.PROMPT_ECHO),
    "memory_disclaimer": has("answer", P.MEMORY_DISCLAIMER),
    "cot_leak": has("answer", P.COT_LEAK),
    "spec_leak": f"({has('query', P.SPEC_LEAK)} OR {has('reasoning', P.SPEC_LEAK)} OR {has('answer', P.SPEC_LEAK)})",
    "dangling_reference": has("answer", P.DANGLING),
    "role_confusion": f"turn_index >= 1 AND {has('query', P.ROLE_CONFUSION)}",
    "reasoning_missing": f"NOT ({_BLANK('answer')}) AND {_BLANK('reasoning')}",
}
_INITIAL = "lower(regexp_extract(s, '(\\p{L})', 1))"
_CHECK_SQL = {
    "json_valid": "trim(answer) <> '' AND json_valid(answer)",
    "markdown_table": "len(list_filter(regexp_split_to_array(answer, '\\r\\n|\\n|\\r'), lambda s: length(s) - length(replace(s, '|', '')) >= 2)) > 0 AND len(list_filter(regexp_split_to_array(answer, '\\r\\n|\\n|\\r'), lambda s: regexp_matches(s, '^\\s*\\|?\\s*:?-{2,}:?\\s*(?:\\|\\s*:?-{2,}:?\\s*)+\\|?\\s*$'))) > 0",
    "n_bullets": "len(list_filter(regexp_split_to_array(answer, '\\r\\n|\\n|\\r'), lambda s: regexp_matches(s, '^\\s*(?:[-*+]|\\d+[.)])\\s+\\S'))) > 0",
    "n_bullets_5": "len(list_filter(regexp_split_to_array(answer, '\\r\\n|\\n|\\r'), lambda s: regexp_matches(s, '^\\s*(?:[-*+]|\\d+[.)])\\s+\\S'))) = 5",
    "length_tokens": f"{_COUNT('answer')} BETWEEN 10 AND 60",
    "n_lines": f"{_LINES('answer')} = 1",
    "limerick_structure": f"{_LINES('answer')} = 5",
    "max_words_per_sentence": f"len({_SENT('answer')}) > 0 AND len(list_filter({_SENT('answer')}, lambda s: {_COUNT('s')} > 22)) = 0",
    "no_gendered_pronouns": "len(list_intersect(regexp_extract_all(lower(answer), '[\\p{L}\\p{N}_'']+'), [" + ", ".join(map(q, P.GENDERED_PRONOUNS)) + "])) = 0",
    "alphabetical_sentence_starts": f"len({_SENT('answer')}) >= 2 AND len(list_filter({_SENT('answer')}, lambda s: {_INITIAL} = '')) = 0 AND list_transform({_SENT('answer')}, lambda s: {_INITIAL}) = list_sort(list_transform({_SENT('answer')}, lambda s: {_INITIAL}))",
    "first_letter": f"len({_SENT('answer')}) > 0 AND len(list_filter({_SENT('answer')}, lambda s: {_INITIAL} <> 't')) = 0",
    "forbidden_token": "NOT regexp_matches(answer, '(?i)\\bmodel\\b')",
    "fact_recall": f"NOT {has('answer', P.RECALL_REFUSAL)} AND contains(trim(regexp_replace(lower(answer), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), 'the model recalled')",
    "markdown_format": "regexp_matches(answer, '(?m)^\\s*#{1,6}\\s+\\S|^\\s*(?:[-*+]|\\d+[.)])\\s+\\S|\\*\\*[^*\\n]+\\*\\*|__[^_\\n]+__')",
}
_RULE_SQL = f"CASE rule WHEN 0 THEN {_COUNT('answer')} <= 60 WHEN 1 THEN {_CHECK_SQL['max_words_per_sentence']} WHEN 2 THEN {_CHECK_SQL['no_gendered_pronouns'].replace('lower(answer)', chr(108) + 'ower(coalesce(answer, ' + chr(39) * 2 + '))')} ELSE {_LINES('answer')} = 1 END"
_TRIMMED = "trim(coalesce(answer, ''))"
_DOMAIN = "CASE " + "".join(f"WHEN h_{n} = m AND m > 0 THEN '{n}' " for n in P.DOMAINS) + "ELSE 'general' END"
_HITS = ", ".join(f"{' + '.join(f'CAST(contains(low, {q(k)}) AS INTEGER)' for k in kws)} AS h_{n}" for n, kws in P.DOMAINS.items())
_QWORDS = "regexp_extract_all(coalesce(query, ''), '[A-Za-z0-9'']+')"
_KEPT = f"list_filter({_QWORDS}, lambda s: lower(s) NOT IN ({', '.join(map(q, P.TOPIC_STOPWORDS))}))"

_NORM = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_NAME = "regexp_extract(coalesce(query, ''), '\\b([A-Z][a-z]{5,})\\b', 1)"
_FACTS = _W + f", ev AS (SELECT c, turn_index AS turn, {_NAME} AS value FROM turns WHERE {_NAME} <> ''), chk AS (SELECT c, turn_index, CASE WHEN turn_index % 2 = 0 THEN 'update_overwrite' ELSE 'delayed_recall' END AS kind, CASE WHEN turn_index % 2 = 1 THEN coalesce(contains({_NORM('answer')}, {_NORM('last')}) AND last IS NOT NULL, false) ELSE coalesce(NOT {has('answer', P.RECALL_REFUSAL)} AND now IS NOT NULL AND contains({_NORM('answer')}, {_NORM('now')}) AND len(list_filter(olds, lambda s: contains({_NORM('answer')}, {_NORM('s')}))) = 0, false) END AS passed FROM (SELECT t.*, (SELECT max_by(value, turn) FROM ev WHERE ev.c = t.c) AS last, (SELECT max_by(value, turn) FROM ev WHERE ev.c = t.c AND turn <= t.turn_index) AS now, coalesce((SELECT list(value ORDER BY turn) FROM ev WHERE ev.c = t.c AND turn <= t.turn_index)[:-2], []) AS olds FROM turns t))"
_OWN = f"CASE turn_index % 4 WHEN 0 THEN {_COUNT('answer')} <= 60 WHEN 1 THEN {_CHECK_SQL['max_words_per_sentence']} WHEN 2 THEN {_CHECK_SQL['no_gendered_pronouns'].replace('lower(answer)', 'lower(coalesce(answer, ' + chr(39) * 2 + '))')} ELSE {_LINES('answer')} = 1 END"
_QUALITY = f"CASE WHEN length({_TRIMMED}) < 8 THEN 'too_short' WHEN len({_WORDS(_TRIMMED)}) < 2 THEN 'too_few_words' WHEN {has(_TRIMMED, P.REFUSAL)} THEN 'refusal' WHEN {_repeat(_TRIMMED)} > 0.5 THEN 'repetition' END"

ORACLE = {
    "exploratory_cues": _W + "SELECT cue, count(*) AS n FROM turns, (VALUES " + ", ".join(f"({q(c)})" for c in P.EXPLORATORY_CUES) + f") v(cue) WHERE contains(lower(coalesce(reasoning, '')), cue) AND NOT {has('reasoning', P.HARNESS)} GROUP BY cue",
    "cross_turn_checks": _FACTS + " SELECT * FROM chk",
    "cross_turn_pass_rate": _FACTS + " SELECT count(*) AS n_checks, count(*) FILTER (WHERE passed) AS n_passed, round(avg(CAST(passed AS INTEGER)), 4) AS pass_rate FROM chk",
    "turn_verification": _W + f", v AS (SELECT *, lag(answer) OVER (PARTITION BY c ORDER BY turn_index) AS prior, {_QUALITY} AS ql FROM turns) SELECT CASE WHEN ql IS NOT NULL THEN 'quality: ' || ql WHEN {has('answer', P.MEMORY_DISCLAIMER)} THEN 'memory disclaimer' WHEN {has('answer', P.COT_LEAK)} THEN 'leaked thought' WHEN turn_index % 3 = 1 AND regexp_matches(coalesce(prior, ''), '\\S') AND lower({_CLEAN('answer')}) = lower({_CLEAN('prior')}) THEN 'identical to prior answer' WHEN {has('reasoning', P.SPEC_LEAK)} THEN 'rule names in reasoning' WHEN {_KINDS['harness_in_reasoning']} THEN 'harness_leak' WHEN {_KINDS['turn_index_in_reasoning']} THEN 'turn_index' WHEN {_KINDS['numbered_flow_in_reasoning']} THEN 'flow_list' WHEN {_DEGENERATE('reasoning')} THEN 'degenerate' WHEN {_RESTARTS('reasoning')} >= {P.RESTARTS_FAIL} THEN 'restart_spiral' WHEN NOT ({_OWN}) THEN 'own rule' ELSE 'verified' END AS result, count(*) AS n FROM v GROUP BY 1",
    "materialised_subsets": _W + "SELECT record_id, _subset, 'invented' AS _source_repo, 'train' AS _split, CAST(rn - 1 AS INTEGER) AS _sample_index, 42 AS _sampling_seed FROM (SELECT record_id, _subset, row_number() OVER (PARTITION BY _subset ORDER BY md5('42:' || record_id), record_id) AS rn FROM mrl WHERE _subset IS NOT NULL) WHERE rn <= 3",
    "turn_rows": _W + "SELECT * FROM turns",
    "conversation_stats": _W + "SELECT completion_id, CAST(coalesce(len(interactions), 0) AS INTEGER) AS n_interactions, CAST(coalesce(list_sum(list_transform(interactions, lambda x: length(coalesce(x.query, '')) + length(coalesce(x.think, '')) + length(coalesce(x.answer, '')))), 0) AS BIGINT) AS n_chars FROM comp",
    "interactions_nonempty": _W + f"SELECT completion_id FROM comp WHERE completion_id NOT IN (SELECT c FROM turns WHERE {_BLANK('query')} OR {_BLANK('answer')})",
    "interactions_by_length": _W + "SELECT completion_id FROM comp WHERE len(interactions) BETWEEN 2 AND 3",
    "interactions_histogram": _W + "SELECT CAST(coalesce(len(interactions), 0) AS INTEGER) AS n_interactions, count(*) AS n FROM comp GROUP BY 1",
    "marked_text": _W + "SELECT c AS completion_id, turn_index, '[Q] ' || trim(coalesce(query, '')) || CASE WHEN length(trim(coalesce(reasoning, ''))) > 10 THEN ' [T] ' || trim(reasoning) ELSE '' END || ' [A] ' || trim(coalesce(answer, '')) AS marked FROM turns",
    "judge_transcript": _W + f"SELECT completion_id, coalesce(regexp_replace((SELECT string_agg('[Turn ' || turn_index || ']' || chr(10) || 'User: ' || coalesce(query, '') || chr(10) || 'Reasoning: ' || CASE WHEN {_BLANK('reasoning')} THEN '(none)' ELSE reasoning END || chr(10) || 'Assistant: ' || coalesce(answer, '') || chr(10), chr(10) ORDER BY turn_index) FROM turns WHERE c = completion_id), '\\s+$', ''), '') AS transcript FROM comp WHERE interactions IS NOT NULL",
    "plain_transcript": _W + f"SELECT completion_id, coalesce((SELECT string_agg(s, chr(10) ORDER BY turn_index) FROM (SELECT c, turn_index, concat_ws(chr(10), CASE WHEN NOT ({_BLANK('query')}) THEN 'User: ' || query END, CASE WHEN NOT ({_BLANK('answer')}) THEN 'Assistant: ' || answer END) AS s FROM turns) WHERE c = completion_id AND s <> ''), '') AS transcript FROM comp WHERE interactions IS NOT NULL",
    "role_messages": _W + f"SELECT completion_id, CAST(row_number() OVER (PARTITION BY completion_id ORDER BY turn_index, k) - 1 AS INTEGER) AS position, role, content FROM (SELECT c AS completion_id, turn_index, 0 AS k, 'user' AS role, query AS content FROM turns UNION ALL SELECT c, turn_index, 1, 'assistant', answer FROM turns) WHERE NOT ({_BLANK('content')})",
    "turn_hard_fails": _HARD + " SELECT * FROM hard",
    "turn_specifics": _W + f"SELECT c, turn_index, 'fabricated_specifics' AS name, CAST(least(k, 3) AS INTEGER) AS severity FROM (SELECT c, turn_index, {_SPEC} AS k FROM turns) WHERE k > 0",
    "turn_answer_defects": _W + " UNION ALL ".join(f"SELECT c, turn_index, '{k}' AS defect FROM turns WHERE {v}" for k, v in _DEFECTS.items()),
    "turn_filler_tails": _W + f"SELECT c, turn_index, 'filler_tail' AS name, 1 AS severity FROM turns WHERE {' OR '.join(has('reasoning', p) for p in P.FILLER_TAIL)} UNION ALL SELECT c, turn_index, 'answer_duplicated_in_reasoning', 1 FROM turns WHERE length(coalesce(answer, '')) > 200 AND {_overlap('reasoning', 'answer')} >= 0.82",
    "identical_rewrite": _W + f"SELECT c, turn_index FROM (SELECT *, lag(answer) OVER (PARTITION BY c ORDER BY turn_index) AS prev FROM turns) WHERE NOT ({_BLANK('answer')}) AND trim(answer) = trim(prev)",
    "answer_quality_gate": _W + f"SELECT CASE WHEN length({_TRIMMED}) < 8 THEN 'too_short' WHEN len({_WORDS(_TRIMMED)}) < 2 THEN 'too_few_words' WHEN {has(_TRIMMED, P.REFUSAL)} THEN 'refusal' WHEN {_repeat(_TRIMMED)} > 0.5 THEN 'repetition' ELSE 'ok' END AS result, count(*) AS n FROM turns GROUP BY 1",
    "reasoning_shape": _W + f"SELECT c, turn_index, CAST({_COUNT('reasoning')} AS INTEGER) AS n_words, CAST(len({_SENT('reasoning')}) AS INTEGER) AS n_sentences, CAST({_LINES('reasoning')} AS INTEGER) AS n_lines, {_DEGENERATE('reasoning')} AS degenerate, CAST({_RESTARTS('reasoning')} AS INTEGER) AS restarts, round({_repeat('reasoning')}, 6) AS repeat_ratio FROM turns WHERE regexp_matches(reasoning, '\\S')",
    "reasoning_answer_overlap": _W + f"SELECT c, turn_index, round({_overlap('reasoning', 'answer')}, 6) AS overlap, round({_jaccard('query', 'answer')}, 6) AS jaccard FROM turns",
    "repeat_ratio_by_source": f"WITH w AS (SELECT doc_id, source, {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w), g AS (SELECT doc_id, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)), r AS (SELECT doc_id, count(*) AS n, count(DISTINCT (a, b, c)) AS k FROM g WHERE c IS NOT NULL GROUP BY doc_id), v AS (SELECT source, CASE WHEN len(w) >= 6 THEN 1 - r.k / r.n ELSE 0.0 END AS r FROM w LEFT JOIN r USING (doc_id)) SELECT source, count(*) AS n, round(avg(r), 6) AS mean_ratio, count(*) FILTER (WHERE r > 0.5) AS n_high FROM v GROUP BY source",
    "checker_results": _W + " UNION ALL ".join(f"SELECT record_id, '{n}' AS checker, {_CHECK_SQL[n]} AS passed FROM mrl WHERE answer IS NOT NULL" for n, _ in CHECKS),
    "standing_adherence": _W + f"SELECT rule, count(*) AS n_checks, count(*) FILTER (WHERE {_RULE_SQL}) AS n_passed FROM (SELECT CAST(r.turn_index % 4 AS INTEGER) AS rule, t.answer FROM turns r JOIN turns t ON r.c = t.c AND t.turn_index > r.turn_index) GROUP BY rule",
    "duplicate_query_first": _W + "SELECT query, min(record_id) AS record_id FROM mrl WHERE query IS NOT NULL GROUP BY query",
    "per_subset_head": _W + "SELECT record_id, _subset FROM (SELECT *, row_number() OVER (PARTITION BY _subset ORDER BY record_id) AS rn FROM mrl) WHERE rn <= 5",
    "sample_per_subset": _W + "SELECT record_id, _subset FROM (SELECT *, row_number() OVER (PARTITION BY _subset ORDER BY md5('42:' || record_id), record_id) AS rn FROM mrl) WHERE rn <= 5",
    "split_by_position": _W + "SELECT record_id, CASE WHEN row_number() OVER (ORDER BY record_id) <= 100 THEN 0 ELSE 1 END AS part FROM mrl",
    "union_append": _W + "SELECT record_id, query, CASE WHEN record_id % 2 = 0 THEN answer END AS answer FROM mrl",
    "example_ids": _W + "SELECT completion_id, coalesce(_subset, 'unknown_subset') || ':' || coalesce(CAST(_sample_index AS VARCHAR), 'unknown_index') || ':' || left(sha1(coalesce(topics, '')), 12) AS example_id FROM comp",
    "derive_variants": _W + "SELECT completion_id || ':' || variant AS conversation_id, variant, len(interactions) AS n, CASE WHEN variant = 'instruct' THEN 0 ELSE len(list_filter(interactions, lambda x: x.think IS NOT NULL)) END AS n_thinks FROM comp, (VALUES ('reasoning'), ('instruct')) v(variant) WHERE interactions IS NOT NULL",
    "seed_curation": _W + f"SELECT record_id, CASE WHEN {has('t', P.CONTENTLESS)} OR length(t) < 6 THEN 'skip' ELSE 'keep' END AS action, CASE WHEN {has('t', P.SENSITIVE)} THEN 'sensitive' ELSE 'none' END AS sensitivity, length(t) >= 1500 AS is_haystack, {_DOMAIN} AS domain, coalesce(nullif(array_to_string(({_KEPT.replace('query', 't')})[1:6], ' '), ''), nullif(array_to_string(({_QWORDS.replace('query', 't')})[1:6], ' '), ''), 'this topic') AS topic FROM (SELECT *, greatest({', '.join('h_' + n for n in P.DOMAINS)}) AS m FROM (SELECT *, {_HITS} FROM (SELECT record_id, trim(coalesce(query, '')) AS t, lower(trim(coalesce(query, ''))) AS low FROM mrl)))",
    "gate_decision": _HARD + " SELECT completion_id AS c, completion_id NOT IN (SELECT c FROM hard) AND NOT coalesce(overall_score < 7, false) AND NOT coalesce(memory_score < 7, false) AS accepted FROM comp",
    "rule_pass_rates": _W
    + "SELECT conv_mode, rule, count(*) AS n_attempts, round(avg(CAST(passed AS INTEGER)), 4) AS pass_rate, CAST(CASE WHEN count(*) >= 5 AND avg(CAST(passed AS INTEGER)) < 0.3 THEN 0.25 ELSE 1.0 END AS DOUBLE) AS weight FROM ("
    + " UNION ALL ".join(f"SELECT conv_mode, '{n}' AS rule, {e} AS passed FROM (SELECT conv_mode, coalesce(answer, '') AS answer FROM turns JOIN comp ON c = completion_id)" for n, e in (("length_tokens", f"{_COUNT('answer')} <= 60"), ("max_words_per_sentence", _CHECK_SQL["max_words_per_sentence"]), ("no_gendered_pronouns", _CHECK_SQL["no_gendered_pronouns"]), ("n_lines", f"{_LINES('answer')} = 1")))
    + ") GROUP BY conv_mode, rule",
    "think_parse": _W + "SELECT c, turn_index, ok AS well_formed, CAST(CASE WHEN ok OR turn_index % 3 = 2 THEN length(regexp_replace(coalesce(answer, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) ELSE length(regexp_replace(coalesce(reasoning, '') || coalesce(answer, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) END AS INTEGER) AS n_answer FROM (SELECT *, turn_index % 3 < 2 AND NOT regexp_matches(trim(regexp_replace(coalesce(reasoning, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '^(?:\\.{0,3}|…)$') AS ok FROM turns)",
}
_UNIFORM = lambda *parts: "(('0x' || left(md5(concat_ws(':', '42', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 8))::BIGINT / 4294967296.0)"
_INTENT = "['compress', 'fact_recall', 'fact_update', 'restyle', 'deepen'][(c + turn_index) % 5 + 1]"
_PLANNED = (
    _W + f", p AS (SELECT *, {_INTENT} AS intent, (c + turn_index) % 5 AS k, CASE WHEN (c + turn_index) % 5 = 2 THEN 'premium plan' ELSE {_NAME} END AS value, lag(answer) OVER (PARTITION BY c ORDER BY turn_index) AS prior, "
    "coalesce(string_agg(concat_ws(chr(10), query, answer), chr(10)) OVER (PARTITION BY c ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS known FROM turns), "
    "conv AS (SELECT completion_id AS c, overall_score AS coherence, memory_score AS appropriateness, trim(coalesce(topics, '')) AS q, completion_id % 7 = 0 AS sensitive FROM comp), "
    "df AS ("
    f"SELECT c, 'same_turn_fact' AS defect FROM p WHERE k = 1 AND (turn_index = 0 OR ({_NORM('value')} <> '' AND contains({_NORM('query')}, {_NORM('value')}))) UNION ALL "
    f"SELECT c, 'phantom_stale' FROM p WHERE intent = 'fact_update' AND NOT contains({_NORM('known')}, 'zanzibar') UNION ALL "
    f"SELECT c, 'bad_fact_type' FROM p WHERE intent IN ('fact_recall', 'fact_update') AND {has('value', P.BAD_FACT)} UNION ALL "
    "SELECT p.c, 'sensitive_flippant' FROM p JOIN conv ON conv.c = p.c WHERE sensitive AND intent IN ('restyle', 'fact_recall', 'fact_update') UNION ALL "
    "SELECT c, 'constraint_mismatch' FROM p WHERE k = 3 AND turn_index >= 1 AND NOT contains(lower(coalesce(query, '')), 'please') UNION ALL "
    f"SELECT c, 'identical_rewrite' FROM p WHERE intent IN ('compress', 'restyle') AND NOT ({_BLANK('answer')}) AND trim(answer) = trim(prior) UNION ALL "
    "SELECT c, 'transformation_density' FROM p WHERE turn_index >= 1 GROUP BY c HAVING avg(CAST(intent IN ('compress', 'restyle') AS INTEGER)) > 0.6 UNION ALL "
    f"SELECT c, 'contentless_seed_kept' FROM conv WHERE {has('q', P.CONTENTLESS)} OR length(q) < 6 UNION ALL "
    "SELECT c, 'role_confusion' FROM conv WHERE coherence < 7 UNION ALL "
    "SELECT c, 'judge_low' FROM conv WHERE coalesce(coherence < 6, false) OR coalesce(appropriateness < 7, false))"
)
_JUDGED = ", sc AS (SELECT completion_id AS c, overall_score AS coherence, memory_score AS appropriateness, greatest(overall_score, memory_score) AS rq, least(overall_score, memory_score) AS rac, CASE WHEN overall_score < 4 THEN CASE WHEN memory_score < 5 THEN 'recall_fidelity' ELSE 'coherence' END END AS flagged FROM comp)"
# Imported here, as the literal queries use the definitions above.
from . import literal as _L  # noqa: E402

_HARD_AGAIN = _L.hard_sql(_L.confidence_sql(_W.rstrip()), "(c + turn_index) % 4 > 2")
_SOFT = f"{_RESTARTS('reasoning')} > 1 AND {_RESTARTS('reasoning')} < {P.RESTARTS_FAIL}"
_KNOWN_MEANS = {"coherence": "coherence", "appropriateness": "appropriateness", "reasoning_quality": "rq", "reasoning_answer_consistency": "rac"}
_RULES_SQL = {**{f"no_{k}": f"n_{k} = 0" for k in D.FATAL}, "regenerations": "most_regenerations <= 2", "reasoning_quality": "coalesce(mean_reasoning_quality >= 8, false)", "reasoning_answer_consistency": "coalesce(mean_reasoning_answer_consistency >= 8, false)", "pass_rate_in_band": "coalesce(pass_rate BETWEEN 0.65 AND 0.95, false)"}
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_CLEANED = (
    _W + f", tl AS (SELECT c, turn_index, regexp_replace(reasoning || [{', '.join('replace(' + q(t.replace(chr(10), '~')) + ', chr(126), chr(10))' for t in TAILS)}][(c + turn_index) % {len(TAILS)} + 1], '(?i)\\bstanding (instruction)', 'ongoing \\1', 'g') AS x FROM turns WHERE reasoning IS NOT NULL), "
    f"rt AS (SELECT c, turn_index, regexp_replace(x, '\\s+$', '') AS t FROM tl), gl AS (SELECT *, regexp_replace(t, '([.!?*)\\]\"''])\\s*(?:{P.ARTIFACT_JUNK})\\s*$', '\\1') AS g, regexp_extract(t, {q(P.ARTIFACT_TAIL)}, 1) AS e FROM rt), "
    f"wo AS (SELECT c, turn_index, CASE WHEN g <> t THEN regexp_replace(g, '\\s+$', '') WHEN e NOT IN ('', {', '.join(map(q, P.ARTIFACT_ALLOWED))}) THEN left(t, length(t) - length(e) - 1) || '.' ELSE regexp_replace(t, '\\s+(?:{P.ARTIFACT_JUNK})\\s*$', '') END AS w FROM gl) "
    f"SELECT c, turn_index, CAST(length(CASE WHEN s = '' THEN {_STRIP('w')} ELSE s END) AS INTEGER) AS n_chars FROM (SELECT *, {_STRIP('regexp_replace(w, ' + q(P.CLOSING_PHRASES) + ', ' + chr(39) * 2 + ')')} AS s FROM wo)"
)
ORACLE |= {
    "prefilter_result": _L.hard_sql(_L.confidence_sql(_W.rstrip())) + _L.PREFILTER,
    "format_bookkeeping": _W.rstrip() + _L._FORMAT + " SELECT * FROM f",
    "defect_prevalence": _L.confidence_sql(_W.rstrip()) + _L._FORMAT + _L.PREVALENCE,
    "record_defect_counts": _PLANNED + " SELECT defect, count(*) AS n FROM df GROUP BY defect",
    "batch_counts": _HARD_AGAIN + _JUDGED + f" SELECT 'hard' AS part, kind AS name, count(*) AS n FROM hard GROUP BY kind UNION ALL SELECT 'flag', 'restarts', count(*) FROM turns WHERE {_SOFT} HAVING count(*) > 0 UNION ALL SELECT 'dimension', flagged, count(*) FROM sc WHERE flagged IS NOT NULL GROUP BY flagged",
    "batch_summary": _HARD_AGAIN
    + _JUDGED
    + ", bad AS (SELECT c, count(*) AS n FROM (SELECT c FROM hard UNION ALL SELECT c FROM a) GROUP BY c), conv AS (SELECT c, count(*) AS n_turns FROM turns GROUP BY c), "
    + "j AS (SELECT conv.c, n_turns, bad.n AS n_bad, coherence, appropriateness, rq, rac, bad.n IS NULL AND NOT coalesce(coherence < 7, false) AND NOT coalesce(appropriateness < 7, false) AND NOT coalesce(rq < 7, false) AND NOT coalesce(rac < 7, false) AS ok FROM conv LEFT JOIN bad USING (c) LEFT JOIN sc USING (c)), "
    + "b AS (SELECT count(*) AS n_conversations, CAST(coalesce(sum(n_turns), 0) AS BIGINT) AS n_turns, CAST(coalesce(sum(n_bad), 0) AS BIGINT) AS n_hard_fails, count(*) FILTER (WHERE ok) AS n_passed, round_even(avg(CAST(ok AS INTEGER)), 3) AS pass_rate, "
    + ", ".join(f"round_even(avg({_KNOWN_MEANS[a]}), 2) AS mean_{a}" if a in _KNOWN_MEANS else f"CAST(NULL AS DOUBLE) AS mean_{a}" for a in D.AXES)
    + ", "
    + ", ".join(f"(SELECT count(*) FROM hard WHERE kind = '{k}') AS n_{k}" for k in D.FATAL)
    + ", (SELECT CAST(max((c + turn_index) % 4) AS INTEGER) FROM turns) AS most_regenerations FROM j) SELECT *, "
    + ", ".join(f"{v} AS ok_{k}" for k, v in _RULES_SQL.items())
    + ", "
    + " AND ".join(f"({v})" for v in _RULES_SQL.values())
    + " AS accepted FROM b",
    "variant_thinks": _W + f"SELECT c || ':mixed' AS conversation_id, turn_index, reasoning IS NOT NULL AND {_UNIFORM('c', 'turn_index')} < 0.5 AS thinks FROM turns",
    "sampled_rows": _W + "SELECT record_id FROM mrl ORDER BY md5('42:' || record_id), record_id LIMIT 50",
    "rows_per_subset": _W + "SELECT _subset, count(*) AS n FROM mrl GROUP BY _subset",
    "new_heads": _W + "SELECT record_id, _subset FROM (SELECT *, row_number() OVER (PARTITION BY _subset ORDER BY record_id) AS rn FROM mrl) WHERE rn BETWEEN 6 AND 8",
    "content_ids": _W + "SELECT completion_id, j AS content, coalesce(_subset, 'unknown_subset') || ':' || coalesce(CAST(_sample_index AS VARCHAR), 'unknown_index') || ':' || left(sha1(j), 12) AS example_id FROM (SELECT *, '{\"conv_mode\":' || CAST(coalesce(to_json(conv_mode), 'null') AS VARCHAR) || ',\"topics\":' || CAST(coalesce(to_json(topics), 'null') AS VARCHAR) || '}' AS j FROM comp)",
    "prior_references": _W + f"SELECT c, turn_index, len(list_filter(list_filter(regexp_extract_all(lower(coalesce(topics, '')), '[a-z0-9'']+'), lambda w: w NOT IN ({', '.join(map(q, (*P.TOPIC_STOPWORDS, *P.MORE_STOPWORDS)))})), lambda w: contains(lower(coalesce(query, '')), w))) > 0 OR regexp_matches(lower(coalesce(query, '')), {q(P.BACK_REFERENCE)}) AS refers, {has('query', P.PROMPT_ECHO)} AS echo FROM turns JOIN comp ON c = completion_id",
    "clean_reasoning": _CLEANED,
    "zipped_seeds": "WITH z AS (" + ORACLE["seed_curation"] + ") SELECT record_id, action, domain FROM z",
}
_OTHERS = ("yaml_answers",)
QUERIES = {n: globals()[n] for n in (*ORACLE, *_OTHERS)}
