"""Small tests of the core: literal cases, edge cases and comparisons with plain Python."""

import datetime as dt
import itertools
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from convoloom.functions import parsing
from convoloom.functions import patterns as P
from convoloom.functions import text as T
from convoloom.operators import checkers as C
from convoloom.operators import conversations as V
from convoloom.operators import crossturn as X
from convoloom.operators import dedup, detectors, generate, judging, preferences, synthesis
from convoloom.operators import records as R
from convoloom.sources import config, readers, writers
from convoloom.streaming import judgelog

TURN = "c string, turn_index int, query string, reasoning string, answer string"
LOG = readers.JUDGE_LOG


def one(spark, text, *cols):
    return tuple(spark.createDataFrame([(text,)], "x string").select(*cols).first())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------------ texts


@pytest.mark.parametrize(
    "text,words,sents,lines,bullets",
    [(None, 0, 0, 0, 0), ("", 0, 0, 0, 0), ("One two. Three?", 3, 2, 1, 0), ("- a\n* b\n1. c\n\n2) d", 6, 2, 4, 4), ("it's well-known, été là", 4, 1, 1, 0)],
)
def test_counts(spark, text, words, sents, lines, bullets):
    x = F.col("x")
    assert one(spark, text, T.word_count(x), F.size(T.sentences(x)), T.nonempty_lines(x), T.bullets(x)) == (words, sents, lines, bullets)


def test_repeat_ratio_and_overlap(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdef") for _ in range(r.randint(0, 30))) for _ in range(60)]
    tri = lambda t, n: list(zip(*(t.split()[i:] for i in range(n)), strict=False))

    def ratio(t):
        return 0.0 if len(t.split()) < 6 else 1 - len(set(tri(t, 3))) / len(tri(t, 3))

    def over(a, b):
        x, y = set(tri(a, 2)), set(tri(b, 2))
        return len(x & y) / min(len(x), len(y)) if x and y else 0.0

    pairs = list(zip(texts, texts[::-1], strict=True))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for i, rr, oo in df.select("i", T.repeat_ratio(F.col("a")), T.overlap(F.col("a"), F.col("b"))).collect():
        assert rr == pytest.approx(ratio(pairs[i][0])) and oo == pytest.approx(over(*pairs[i]))


@pytest.mark.parametrize("text,leak", [("As said in Turn 6 of it", True), ("reference_turn_2", True), ("turn 90 degrees left", False), ("see turn 3", True), (None, False)])
def test_turn_index(spark, text, leak):
    assert one(spark, text, T.turn_index_leak(F.col("x"))) == (leak,)


@pytest.mark.parametrize("text,bad", [("the output.cw", True), ("write.s", True), ("see main.py", False), ("All fine.", False), ("", False), (None, False)])
def test_trailing_artifact(spark, text, bad):
    assert one(spark, text, T.trailing_artifact(F.col("x"))) == (bad,)


@pytest.mark.parametrize(
    "text,want",
    [("<think>I add.</think>Four.", ("I add.", "Four.", True)), ("Four.", (None, "Four.", False)), ("<think>...</think>Four.", (None, "...Four.", False)), ("<think>a</think><think>b</think>c", (None, "abc", False)), ("x</think>", (None, "x", False))],
)
def test_parse_think(spark, text, want):
    p = T.parse_think(F.col("x"))
    assert one(spark, text, p["reasoning"], p["answer"], p["well_formed"]) == want


def test_degenerate_restarts_quality(spark):
    x = F.col("x")
    assert one(spark, "same unit here\n" * 8, T.degenerate(x)) == (True,)
    assert one(spark, "Wait, no. " * 7, T.restarts(x)) == (7,)
    assert one(spark, "short", T.quality(x)) == ("too_short",)
    assert one(spark, "I cannot help with this request.", T.quality(x)) == ("refusal",)
    assert one(spark, "all of this is fine and well", T.quality(x)) == (None,)
    assert one(spark, "How do I compile python code for this api?", T.domain(x), T.topic(x)) == ("coding", "I compile python code this api")
    assert one(spark, None, T.domain(x), T.topic(x)) == ("general", "this topic")


def test_guard_against_negation(spark):
    x = F.col("x")
    assert one(spark, "We cannot fabricate data here", F.size(T.guarded_markers(x, P.ADMISSION))) == (0,)
    assert one(spark, "So I will fabricate a source", F.size(T.guarded_markers(x, P.ADMISSION))) == (1,)


# ------------------------------------------------------------------ checkers


@pytest.mark.parametrize(
    "name,text,params,want",
    [
        ("json_valid", '{"a": 1}', {}, True), ("json_valid", '```json\n{"a": 1}\n```', {}, True), ("json_valid", "plain", {}, False), ("json_valid", "[1]", {"top_type": "object"}, False), ("json_valid", "[1]", {"top_type": "array"}, True),
        ("n_bullets", "- a\n- b\n- c", {"n": 3}, True), ("n_bullets", "- a\n- b\n- c", {"n": 2}, False), ("n_bullets", "none", {}, False),
        ("length_tokens", "a b c", {"max_words": 5}, True), ("length_tokens", "a b c d e f", {"max_words": 5}, False), ("n_lines", "a\n\nb", {"n": 2}, True),
        ("fact_recall", "It is the Red Boat!", {"value": "red boat"}, True), ("fact_recall", "I can't recall the red boat", {"value": "red boat"}, False), ("fact_recall", "the boat", {"value": "red boat", "match": "fuzzy"}, True),
        ("fact_update", "now 12", {"value": "12", "stale_values": ["7"]}, True), ("fact_update", "7 then 12", {"value": "12", "stale_values": ["7"]}, False), ("fact_update", "none", {"value": "12"}, False),
        ("first_letter", "The one. That two.", {"letter": "T"}, True), ("first_letter", "The one. A two.", {"letter": "t"}, False), ("first_letter", "", {"letter": "t"}, False),
        ("max_words_per_sentence", "One two. Three.", {"max_words": 2}, True), ("forbidden_token", "a model b", {"token": "Model"}, False), ("forbidden_token", "models", {"token": "model"}, True),
        ("no_gendered_pronouns", "He went", {}, False), ("no_gendered_pronouns", "They went", {}, True), ("alphabetical_sentence_starts", "A b. B c. C d.", {}, True), ("alphabetical_sentence_starts", "B c. A b.", {}, False),
        ("alphabetical_sentence_starts", "A b. A c.", {"strict": True}, False), ("limerick_structure", "a\nb\nc\nd\ne", {}, True), ("markdown_table", "| a | b |\n|---|---|\n| 1 | 2 |", {}, True), ("markdown_format", "# Title", {}, True), ("yaml_valid", "a: 1\nb: [2, 3]", {}, True), ("yaml_valid", "A plain sentence.", {}, False), ("yaml_valid", "", {}, False), ("yaml_valid", "a: [1", {}, False), ("unknown_type", "x", {}, False), ("json_valid", None, {}, False),
    ],
)
def test_checkers(spark, name, text, params, want):
    assert one(spark, text, C.check(name, F.col("x"), params)) == (want,)


def test_registry(spark):
    assert one(spark, "The one.", C.check("first_letter", F.col("x"), {"letter": "t"}, lang="de")) == (False,)
    assert one(spark, "x", C.verify("json_valid", F.col("x"), verifier="judge")) == (True,)
    C.register("always", lambda a, p: F.lit(True), "en")
    assert one(spark, "x", C.check("always", F.col("x"))) == (True,) and "always" in C.registered("en")
    assert C.conflict("json_valid", "yaml_valid") and not C.conflict("json_valid", "json_valid") and not C.conflict("json_valid", "first_letter")


# ------------------------------------------------------------------ detectors


def turns(spark, *rows):
    return spark.createDataFrame(list(rows), TURN)


def test_hard_fails_and_prefilter(spark):
    t = turns(
        spark,
        ("a", 0, "q", "Here's my thinking process: go", "See Turn 2."), ("b", 0, "q", "Plain thought about boats.", "A fine answer."), ("c", 0, "q", "1. User: hi\n2. Model: yo", "ok then"),
        ("d", 0, None, None, None), ("e", 0, "q", "again and again\n" * 9, "fine"), ("f", 0, "q", "Wait, a. Wait, b. Wait, c. Wait, d. Wait, e. Wait, f. done", "fine"),
    )
    got = {(c, k) for c, _, k in rows_of(detectors.hard_fails(t))}
    assert got == {("a", "harness_in_reasoning"), ("a", "turn_index_in_answer"), ("c", "numbered_flow_in_reasoning"), ("e", "degenerate_reasoning"), ("f", "restart_spiral")}
    assert {c: p for c, _, _, p in rows_of(detectors.prefilter(t))} == {"a": False, "b": True, "c": False, "d": True, "e": False, "f": False}
    assert rows_of(detectors.prefilter(t.limit(0))) == []
    again = t.withColumn("regenerations", F.lit(4))
    assert ("b", 0, "excess_regenerations") in rows_of(detectors.hard_fails(again))


def test_confidence_mismatch(spark):
    spec = "It raised $3 million on Kickstarter."
    t = turns(
        spark,
        ("a1", 0, "q", "I'm guessing here", spec), ("a2", 0, "the 37th largest city?", "fine", "x"), ("a2", 1, "q", "fine", spec), ("a3", 0, "q", "so I made it up", "x"), ("a3", 1, "q", "fine", spec),
        ("ok", 0, "q", "I must not fabricate", spec), ("none", 0, "q", "I'm guessing", "nothing special"),
    )
    assert {c: n for c, _, _, n, _, _ in rows_of(detectors.confidence_mismatch(t))} == {"a1": "confidence_uncertainty_mismatch", "a2": "ungrounded_premise_fabrication", "a3": "fabrication_admission"}
    assert {(c, s) for c, _, _, _, s, _ in rows_of(detectors.fabricated_specifics(t))} >= {("a1", 1)}


def test_other_detectors(spark):
    text = "word " * 60
    t = turns(spark, ("d", 0, "q", "Exactly three bullets. Word count next. Then go.", "x"), ("e", 0, "q", "Let's comply.", "x"), ("f", 0, "q", " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(80))), ("g", 0, "q", text, None))
    assert [(r[0], r[3]) for r in rows_of(detectors.reasoning_artifacts(t))] == [("e", "filler_tail"), ("f", "answer_duplicated_in_reasoning")]
    assert [r[0] for r in rows_of(detectors.format_bookkeeping(t))] == ["d"]
    s = t.withColumn("scope", F.lit("standing"))
    assert len(rows_of(detectors.phantom_standing(s))) == 4 and not rows_of(detectors.phantom_standing(s.withColumn("query", F.lit("from now on, be brief"))))
    d = rows_of(detectors.answer_defects(turns(spark, ("x", 1, "quiz me", "", "I don't have any memory of previous conversations. as shown above"))))
    assert {k for _, _, k in d} == {"memory_disclaimer", "dangling_reference", "role_confusion", "reasoning_missing"}


def test_gate(spark):
    schema = "id string, coherence int, instruction_following int, flagged_turns array<struct<turn_index:int,severity:int>>, passed boolean"
    df = spark.createDataFrame([("ok", 8, 6, [], True), ("low", 6, 9, [], True), ("flag", 9, 9, [(1, 3)], True), ("pre", 9, 9, [], False), ("absent", None, None, None, True)], schema)
    assert {i: g for i, g in df.select("id", detectors.gate(df, F.col("passed"))).collect()} == {"ok": True, "low": False, "flag": False, "pre": False, "absent": True}


def test_batch_summary_and_rates(spark):
    t = turns(spark, ("a", 0, "q", "Plain thought.", "Fine answer."), ("b", 0, "q", "As per the system prompt", "Fine answer."), ("c", 0, "q", "Plain.", "Fine."))
    s = spark.createDataFrame([("a", 9), ("b", 9), ("c", 5)], "c string, coherence int")
    b = detectors.batch_summary(t, s).first()
    assert (b["n_conversations"], b["n_turns"], b["n_hard_fails"], b["n_passed"], b["pass_rate"], b["mean_coherence"], b["mean_reasoning_quality"], b["n_harness_in_reasoning"], b["most_regenerations"]) == (3, 3, 1, 1, 0.333, 7.67, None, 1, 0)
    good = turns(spark, ("a", 0, "q", "Plain thought.", "Fine answer."), ("b", 0, "q", "Wait, so. Wait, now. It holds.", "Fine answer."), ("c", 0, "q", "Plain.", "Fine.")).withColumn("regenerations", F.lit(1))
    axes = spark.createDataFrame([("a", 9, 9, [(0, "coherence", 1)]), ("b", 9, 8, []), ("c", 7, 6, None)], "c string, reasoning_quality int, reasoning_answer_consistency int, flagged_turns array<struct<turn_index:int,dimension:string,severity:int>>")
    v = detectors.accepted(detectors.batch_summary(good, axes)).first()
    assert v["mean_reasoning_quality"] == 8.33 and v["mean_reasoning_answer_consistency"] == 7.67 and v["pass_rate"] == 0.667
    assert [k for k in v.asDict() if k.startswith("ok_") and not v[k]] == ["ok_reasoning_answer_consistency"] and not v["accepted"]
    assert detectors.accepted(detectors.batch_summary(good, axes), least=7.0).first()["accepted"]
    assert not detectors.accepted(detectors.batch_summary(good.withColumn("regenerations", F.lit(3)), axes), least=7.0).first()["ok_regenerations"]
    assert rows_of(detectors.batch_counts(good, axes)) == [("dimension", "coherence", 1), ("flag", "restarts", 1)]
    empty = detectors.accepted(detectors.batch_summary(t.limit(0), s)).first()
    assert empty["n_conversations"] == 0 and not empty["accepted"]
    r = spark.createDataFrame([("x", False)] * 6 + [("y", True)], "k string, passed boolean")
    assert rows_of(detectors.pass_rates(r, ["k"])) == [("x", 6, 0.0, 0.25), ("y", 1, 1.0, 1.0)]


def test_standing_checks(spark):
    t = turns(spark, ("c", 0, "q", "r", '{"a": 1}'), ("c", 1, "q", "r", '{"b": 2}'), ("c", 2, "q", "r", "plain"), ("d", 0, "q", "r", "x"))
    j = detectors.standing_checks(t, t.filter("turn_index = 0").select("c", "turn_index"))
    assert rows_of(j.select("c", "turn_index", C.check("json_valid", F.col("answer")))) == [("c", 1, True), ("c", 2, False)]


# ------------------------------------------------------------------ conversations

INTER = "id long, interactions array<struct<query:string,think:string,answer:string>>, ingested_at timestamp"


def conv(spark, *rows):
    return spark.createDataFrame([(i, it, dt.datetime(2025, 1, d)) for i, it, d in rows], INTER)


def test_projections(spark):
    df = conv(spark, (1, [("q1", "a long enough think", "a1"), ("q2", "x", None)], 1), (2, [], 1), (3, None, 1), (4, [(None, None, None)], 1))
    assert rows_of(V.nonempty(df).select("id")) == [(2,), (3,)]
    assert rows_of(V.by_length(df, 2, None).select("id")) == [(1,)] and df.count() == V.by_length(df, 0, None).count()
    assert rows_of(V.length_histogram(df)) == [(0, 2), (1, 1), (2, 1)]
    assert rows_of(V.stats(df, "id"))[0] == (1, 2, len("q1a long enough thinka1q2x"))
    assert df.filter("id = 1").select(V.marked_text(F.col("interactions"))).first()[0] == ["[Q] q1 [T] a long enough think [A] a1", "[Q] q2 [A] "]
    t = df.filter("id = 1").select(V.transcript(F.col("interactions"))).first()[0]
    assert t.startswith("[Turn 0]\nUser: q1\nReasoning: a long") and t.endswith("Assistant:")
    assert [tuple(m) for m in df.filter("id = 1").select(V.messages(F.col("interactions"))).first()[0]] == [("user", "q1"), ("assistant", "a1"), ("user", "q2")]


def test_variants(spark):
    df = conv(spark, *((i, [("q", "t", "a")] * 4, 1) for i in range(200)))
    v = V.variants(df, "id")
    n = {k: c for k, c in v.groupBy("variant").agg(F.sum(F.size(F.filter("interactions", lambda x: x["think"].isNotNull())))).collect()}
    assert n["reasoning"] == 800 and n["instruct"] == 0 and 320 < n["mixed"] < 480
    assert rows_of(v.repartition(7)) == rows_of(V.variants(df.repartition(3), "id"))
    with pytest.raises(ValueError, match="unknown"):
        V.variants(df, "id", ("odd",))


def test_latest_first_head_sample_split(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2025, 1, 1), "x"), (1, "b", dt.datetime(2025, 1, 2), "y"), (None, "n", None, "z"), (2, "c", dt.datetime(2025, 1, 1), "x"), (3, "d", dt.datetime(2025, 1, 1), None)], "id long, v string, ingested_at timestamp, s string")
    assert rows_of(V.latest_rows(df, "id").select("id", "v")) == [(1, "b"), (2, "c"), (3, "d")]
    assert rows_of(V.first_of(df.filter("id is not null"), "s", ["id"]).select("s", "id")) == [("x", 1), ("y", 1), (None, 3)]
    assert len(rows_of(V.head_per(df, "s", ["v"], 1))) == 4
    big = spark.range(1000).withColumn("s", F.col("id") % 3)
    a, b = (rows_of(V.sample_per(x, "s", "id", 20)) for x in (big, big.repartition(5)))
    assert a == b and len(a) == 60
    x, y = V.split_at(big.select("id"), "id", 10)
    assert x.count() == 10 and y.count() == 990
    x, y = V.split_at(big.select("id"), "id", 0)
    assert x.count() == 0 and y.count() == 1000
    assert V.append(None, df) is df and V.append(df.select("id"), df).count() == 10


def test_identical_rewrites(spark):
    t = turns(spark, ("c", 0, "q", "", "same"), ("c", 1, "q", "", " same "), ("c", 2, "q", "", ""), ("c", 3, "q", "", ""), ("d", 0, "q", "", "same"))
    assert rows_of(V.identical_rewrites(t)) == [("c", 1)]


# ------------------------------------------------------------------ judge log


def log(spark, *rows):
    """rows: seq, id, model, status, scores or None"""
    base = lambda s, i, m, st, sc: (s, i, m, st, 1.0, "stop", None, None, "r", "s", "train", 0, (*sc, "low", [], None) if sc else None, None if st == "ok" else "ValueError", None if st == "ok" else "bad")
    return spark.createDataFrame([base(*r) for r in rows], LOG)


def test_latest_state(spark):
    df = log(spark, (1, "a", "m", "ok", (1, 1, 1, 1)), (2, "a", "m", "error", None), (3, "b", "m", "error", None), (4, "b", "m", "ok", (2, 2, 2, 2)), (5, "c", "m", "error", None), (6, "c", "m", "error", None), (7, "d", "m", "ok", (1, 1, 1, 1)), (8, "d", "m", "ok", (5, 5, 5, 5)), (9, None, "m", "ok", (1, 1, 1, 1)))
    assert rows_of(judging.latest(df).select("_eval_id", "seq")) == [("a", 1), ("b", 4), ("c", 6), ("d", 8)]
    assert rows_of(judging.status_counts(judging.latest(df))) == [("m", "error", 1, 4, 25.0), ("m", "ok", 3, 4, 75.0)]
    assert rows_of(judging.repeat_reliability(df).select("n_repeated_examples")) == [(1,)]
    assert rows_of(judging.latest(df.limit(0))) == []
    assert rows_of(judging.pending(spark.createDataFrame([("a",), ("c",), ("z",)], "_eval_id string"), df)) == [("c",), ("z",)]


def kappa(pairs):
    n = len(pairs)
    obs = sum((a - b) ** 2 for a, b in pairs) / n
    exp = sum((a - b) ** 2 for a, _ in pairs for _, b in pairs) / n / n
    return 1 - obs / exp if exp else 1.0


def test_agreement_against_plain_python(spark):
    r = random.Random(3)
    rows, k, scores = [], 0, {}
    for i in range(60):
        for m in "abc":
            if r.random() < 0.9:
                k += 1
                s = tuple(r.choice([None, *range(1, 11)]) for _ in range(4))
                scores[f"e{i}", m] = s
                rows.append((k, f"e{i}", m, "ok", s))
    got = {(x["left_model"], x["right_model"]): x for x in judging.pairwise_agreement(judging.latest(log(spark, *rows))).collect()}
    for a, b in itertools.combinations("abc", 2):
        ids = [i for i in {i for i, _ in scores} if (i, a) in scores and (i, b) in scores]
        assert got[a, b]["n_common"] == len(ids)
        p = [(scores[i, a][0], scores[i, b][0]) for i in ids if scores[i, a][0] and scores[i, b][0]]
        assert got[a, b]["memory_score_mae"] == pytest.approx(sum(abs(x - y) for x, y in p) / len(p), abs=6e-4)
        assert got[a, b]["memory_score_weighted_kappa"] == pytest.approx(kappa(p), abs=6e-4)
    bias = judging.reference_bias(judging.latest(log(spark, *rows)), "a").collect()
    assert {x["model"] for x in bias} == {"b", "c"}
    top = judging.top_disagreements(judging.latest(log(spark, *rows)), "a", 5).collect()
    assert [x["total_abs_diff"] for x in top] == sorted((x["total_abs_diff"] for x in top), reverse=True)


def test_fleiss_edge_cases(spark):
    same = log(spark, *((k, f"e{k // 2}", "ab"[k % 2], "ok", (5, 5, 5, 5)) for k in range(8)))
    assert {(m, n, r, v) for m, n, r, v in rows_of(judging.fleiss_kappa(judging.latest(same)))} == {(s, 4, 2, None) for s in judging.SCORES}
    alone = log(spark, (1, "a", "m", "ok", (1, 2, 3, 4)))
    assert {r[3] for r in rows_of(judging.fleiss_kappa(judging.latest(alone)))} == {None}


# ------------------------------------------------------------------ records


def test_rule_stack(spark):
    t = spark.createDataFrame([("c", 0, "json_valid", "standing"), ("c", 1, "first_letter", "cumulative"), ("c", 2, "yaml_valid", "standing"), ("c", 3, "length_tokens", "turn"), ("c", 4, "yaml_valid", "standing"), ("c", 5, None, None)], "c string, turn_index int, type string, scope string")
    got = {i: a for _, i, a in R.active_rules(t).collect()}
    assert got[0] == ["json_valid"] and got[2] == got[3] == ["first_letter", "yaml_valid"] and got[5] == ["first_letter", "yaml_valid", "yaml_valid"]


def test_facts_and_recall(spark):
    e = spark.createDataFrame([("c", "f1", 0, "red"), ("c", "f1", 3, "blue"), ("c", "f2", 1, "x"), ("c", None, 1, "y")], "c string, fact_id string, turn int, value string")
    f = R.facts(e)
    assert rows_of(f.select("fact_id", "value", "planted_turn", "stale", "n_updates")) == [("f1", "blue", 0, ["red"], 1), ("f2", "x", 1, [], 0)]
    t = spark.createDataFrame([("c", i) for i in range(5)], "c string, turn_index int")
    assert rows_of(R.recallable(f, t, 3)) == [("c", 3, "f1"), ("c", 4, "f1")]


def test_name_replacement(spark):
    df = spark.createDataFrame([(1, "Anna and Bert", "Anna left"), (2, None, "Bert"), (3, "", "")], "id long, query string, answer string")
    got = {i: (q, a) for i, q, a in R.replace_names(df, "id", ["Anna", "Bert"], ["Zoe", "Yan"]).collect()}
    assert not re.search("Anna|Bert", str(got)) and got[1][0].split()[0] == got[1][1].split()[0] and got[2][0] is None
    assert rows_of(R.replace_names(df, "id", ["Anna"], ["Zoe"], skip=1.0)) == rows_of(df)


def test_known_before(spark):
    t = turns(spark, ("c", 0, "my boat is Red Star", "", "ok"), ("c", 1, "x", "", "y")).withColumn("v", F.lit("red star"))
    assert rows_of(R.leaks_before(t, "v")) == [("c", 0, False), ("c", 1, True)]


# ------------------------------------------------------------------ parsers


def test_objects_and_judgment():
    good = {"memory_score": 3, "instruction_score": 4, "freshness_score": 5, "overall_score": 6, "confidence": "low", "issues": [], "rationale": {"memory": "a } b", "instruction": '"{', "freshness": ""}}
    s = json.dumps(good)
    assert parsing.objects('x {"a": "}"} {b') == ['{"a": "}"}']
    assert parsing.judgment(f"Well, {{}} here: {s} and more") == good
    assert parsing.judgment(json.dumps({**good, "overall_score": 11})) is None and parsing.judgment(json.dumps({**good, "more": 1})) is None and parsing.judgment(json.dumps({**good, "overall_score": True})) is None
    assert parsing.judgment(None) is None and parsing.judgment("{" * 50_000) is None


def test_rubric():
    r = parsing.rubric('Here {"coherence": 7.5, "naturalness": true, "appropriateness": 14, "flagged_turns": [{"turn_index": "2"}, {"severity": 3}, 5], "notes": null} then prose }')
    assert r["coherence"] == 8 and r["naturalness"] is None and r["appropriateness"] == 10 and r["flagged_turns"] == [{"turn_index": 2, "dimension": "", "severity": 1, "evidence": ""}] and r["notes"] == ""
    assert parsing.rubric('{"x": 1}') is None and parsing.rubric("") is None


def test_literals():
    assert parsing.literal("```python\n[{'query': 'a', 'answer': None}]\n```") == [{"query": "a", "answer": None}]
    assert parsing.literal('[{"query": "a"}, {"query": "b') == [{"query": "a"}]
    assert parsing.literal("__import__('os')") is None and parsing.literal(None) is None
    assert parsing.interactions('{"interactions": [{"query": "q", "think": "t", "answer": 3}, 5]}') == [{"query": "q", "think": "t", "answer": "3"}]


def test_bleu():
    assert parsing.bleu4("abcdef", "abcdef") == pytest.approx(1.0) and parsing.bleu4("abcdef", "uvwxyz") == 0 and parsing.bleu4("", "") == 0
    a = [{"query": "tell me of boats and harbours", "answer": "boats are many in harbours"}]
    b = [{"query": "zzz qqq xxx jjj", "answer": "kkk vvv www"}]
    assert parsing.keeps_topics(a[0]["query"], a[0]["answer"], b + a) and not parsing.keeps_topics(a[0]["query"], a[0]["answer"], a + b) and not parsing.keeps_topics("q", "a", [])


# ------------------------------------------------------------------ dedup, sources, stream, generation


def test_greedy_near_duplicates(spark):
    r = random.Random(5)
    rows = []
    for i in range(150):
        w = [f"w{r.randrange(40)}" for _ in range(r.randint(1, 14))] if not rows or r.random() < 0.4 else (r.choice(rows)[1] or "x").split()
        if r.random() < 0.5:
            w[r.randrange(len(w))] = f"w{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(900, ""), (901, None), (902, "...")]
    kept, want = [], {}
    for i, t in rows:
        s = set(re.findall(r"[a-z0-9_]+", (t or "").lower()))
        want[i] = bool(s) and not any(len(s & k) >= 0.7 * len(s | k) for k in kept)
        if want[i]:
            kept.append(s)
    assert dict(rows_of(dedup.greedy(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.7))) == want


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"query": " hi "}\n\n{"prompt": "p"}\n{"messages": [{"role": "user", "content": "m"}]}\n')
    (tmp_path / "b.json").write_text('[{"text": "t"},\n {"question": "x"}]')
    assert rows_of(readers.seeds(spark, str(tmp_path / "a.jsonl")).select("seed")) == [("hi",), ("m",), ("p",)]
    assert rows_of(readers.seeds(spark, str(tmp_path / "b.json")).select("seed")) == [("t",), ("x",)]
    (tmp_path / "bad.jsonl").write_text('{"query": "a"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), readers.SEEDS).collect()
    df = spark.createDataFrame([(1, "a", None), (2, "b", "é")], "id long, _subset string, v string")
    writers.jsonl(df, str(tmp_path / "o"))
    assert '"v":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    writers.per_subset(df, str(tmp_path / "s"))
    assert rows_of(spark.read.parquet(str(tmp_path / "s")).select("id", "_subset")) == [(1, "a"), (2, "b")]
    assert readers.existing(spark, str(tmp_path / "none")) is None
    assert "| 1 | a |" in writers.markdown(df, "T") and "No data" in writers.markdown(df.limit(0), "T")
    assert rows_of(writers.attach(df, spark.createDataFrame([(2, "new")], "id long, v string"), "id", "v").select("id", "v")) == [(1, None), (2, "new")]
    (tmp_path / "d" / "sub").mkdir(parents=True)
    df.write.parquet(str(tmp_path / "d/sub/train.parquet"))
    assert readers.dataset(spark, str(tmp_path / "d"), "sub").count() == 2
    with pytest.raises(ValueError, match="no split"):
        readers.dataset(spark, str(tmp_path / "d"), "other")


def test_stream_folds_batches(spark, tmp_path):
    a = log(spark, (1, "a", "m", "ok", (1, 1, 1, 1)), (2, "b", "m", "error", None))
    b = log(spark, (3, "a", "m", "error", None), (4, "b", "m", "ok", (2, 2, 2, 2)), (5, "c", "m", "error", None))
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    for x in (a, b):
        x.coalesce(1).write.mode("append").parquet(src)
        judgelog.compact(judgelog.source(spark, src), state, ck)
    assert len(list(Path(state, "manifest").iterdir())) == 2
    assert rows_of(judgelog.current(spark, state).select("_eval_id", "seq")) == rows_of(judging.latest(a.unionByName(b)).select("_eval_id", "seq")) == [("a", 1), ("b", 4), ("c", 5)]


def test_stream_rewrites_touched_buckets_only(spark, tmp_path):
    src, state, ck = (str(tmp_path / x) for x in ("src", "state", "ck"))
    assert judgelog.current(spark, state) is None
    rows = []
    for k in range(4):
        new = [(10 * k + i, f"e{i if k else i + 40}", "m", "ok", (k, k, k, k)) for i in range(6 if k < 3 else 1)]
        rows += new
        log(spark, *new).coalesce(1).write.mode("append").parquet(src)
        judgelog.compact(judgelog.source(spark, src), state, ck, buckets=8)
        assert rows_of(judgelog.current(spark, state).select("_eval_id", "seq")) == rows_of(judging.latest(log(spark, *rows)).select("_eval_id", "seq"))
    assert len(list(Path(state, "data/3").glob("bucket=*"))) == 1 and sorted(p.name for p in Path(state, "manifest").iterdir()) == ["2", "3"]
    kept = {p.parent.name for p in Path(state, "data").glob("*/bucket=*")}
    assert "3" in kept and "1" not in kept  # the second batch's buckets were all written again


def test_order_statistics(spark):
    from convoloom.operators import order

    r = random.Random(4)
    v = [r.choice([None, r.random(), 5.0]) for _ in range(400)]
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None, x) for i, x in enumerate(v)], "id long, g string, v double").repartition(5)
    got = {g: (a, b) for g, a, b in rows_of(order.percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).na.fill("none", ["g"]))}
    for g in ("a", "b", None):
        x = sorted(y for i, y in enumerate(v) if y is not None and ("ab"[i % 2] if i % 7 else None) == g)
        at = lambda p: x[int(p * (len(x) - 1))] + (x[min(len(x) - 1, int(p * (len(x) - 1)) + 1)] - x[int(p * (len(x) - 1))]) * (p * (len(x) - 1) % 1)  # noqa: B023, E731
        assert got[g or "none"] == pytest.approx((at(0.5), at(0.95)))
    keys = spark.createDataFrame([(x,) for x in (3, 1, 4, 1, 5, 9, 2, 6)] + [(None,)], "k long").repartition(4)
    assert [order.key_at(keys, "k", p) for p in (0, 1, 3, 7, 99)] == [None, 1, 3, 9, 9]
    assert order.key_at(keys.limit(0), "k", 2) is None
    a, b = V.split_at(keys, "k", 3)
    assert (rows_of(a), sorted(x[0] or 0 for x in b.collect())) == ([(1,), (1,), (2,), (3,)], [0, 4, 5, 6, 9])
    t = order.running_total(spark.createDataFrame([(i, i) for i in range(20)], "k long, v long").repartition(6), "k", "v", "before")
    assert sorted(tuple(r) for r in t.select("k", "before").collect()) == [(i, i * (i - 1) // 2) for i in range(20)]


def test_words_of_four_languages(spark):
    """Runs of letters of any script, as a word pattern of Unicode reads them."""
    texts = ["Für die Brücke, größer!", "L’été à Nîmes_2 était très doux", "Zażółć gęślą jaźń", "naïve café 東京 ½", None, ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.words(F.col("t"))).orderBy("i").collect()
    assert [r[1] for r in got] == [re.findall(r"\w+", (t or "").lower()) for t in texts]
    row = spark.createDataFrame([("über größe", "größe über alles")], "a string, b string").select(T.jaccard(F.col("a"), F.col("b")), T.overlap(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (pytest.approx(2 / 3), 0.0)


def test_sanitising_and_echoes(spark):
    rows = {"The sum is 391.cw": "The sum is 391.", "They write.s": "They write.", "See main.py": "See main.py", "All done cw": "All done", "It holds. Will produce final answer.": "It holds.", "Proceed.": "Proceed.", "A standing instruction holds": "A ongoing instruction holds", "Fine. Okay, let's go.": "Fine."}
    got = dict(rows_of(spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.sanitize(F.col("t")))))
    assert got == rows
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.sanitize(F.lit(None).cast("string"))) is None
    assert one(T.prompt_echo(F.lit("Go on. Output only the user's message."))) and not one(T.prompt_echo(F.lit("What is a persona?")))
    assert one(T.references_prior(F.lit("Tell me of the harbour"), F.lit("the old harbour"))) and one(T.references_prior(F.lit("As you said"), F.lit(""))) and not one(T.references_prior(F.lit("And now?"), F.lit("the old boat")))
    assert one(T.safe_filename(F.lit("a/b c:é.txt"))) == "a_b_c__.txt"
    assert one(T.harness_match(F.lit("It matches the provided text"))) == "matches the provided"


def test_segments_of_a_response(spark):
    df = spark.createDataFrame([(1, "I think so.", "Yes <think>no</think> sir"), (2, "...", "<think>deep</think>Yes"), (3, None, "plain</think>"), (4, "", "")], "i int, r string, c string")
    seg = lambda s: [tuple(x[0]) for x in df.orderBy("i").select(T.segment_response(F.col("r"), F.col("c"), s)).collect()]
    assert seg("auto")[:2] == [("I think so.", "Yes  sir", True), ("deep", "Yes", True)]
    assert seg("field")[1] == ("", "Yes", False) and seg("inline")[0] == ("no", "Yes  sir", True)
    with pytest.raises(ValueError, match="unknown source"):
        T.segment_response(F.col("r"), F.col("c"), "odd")


def test_one_json_value(spark):
    cases = {'{"a": 1}': True, "[1, 2]": True, "3": True, '"x"': True, "": False, '{"a": 1} {"b": 2}': False, '{"a": 1} tail': False, "1, 2": False, '1, "b": 2': False, "1] , [2": False, "{": False}
    got = dict(rows_of(spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.is_json(F.col("t")))))
    assert got == cases


def test_preferences(spark):
    side = lambda a: {"think": "t", "answer": a}
    p = [{"query": f"q{i}", "accepted": side(f"a{i}"), "rejected": side(f"r{i}")} for i in range(4)]
    text = str(p)
    df = spark.createDataFrame([(text,), (text[: text.index("q3") + 8],), ("x",), (None,)], "t string").select(parsing.parse_preferences("t").alias("p"))
    n = [None if r[0] is None else len(r[0]) for r in df.collect()]
    assert n == [4, 3, None, None]
    first = df.limit(1)
    fit = lambda k, least=0.8: first.select(F.size(preferences.fitted(F.col("p"), k, preferences.blank_preference(), least))).first()[0]
    assert (fit(3), fit(4), fit(5), fit(6), fit(6, 0.5)) == (3, 4, 5, None, 6)
    pair = first.select(preferences.pairs(F.col("p"))[2]).first()[0]
    assert pair["prompt"] == "User: q0\nAssistant: a0\nUser: q1\nAssistant: a1\nUser: q2" and (pair["chosen"], pair["rejected"]) == ("a2", "r2")
    talk = spark.createDataFrame([([("q", "old", "a"), ("r", None, "b")], ["x", "y"], [("t", "no")])], "i array<struct<query:string,think:string,answer:string>>, th array<string>, o array<struct<think:string,answer:string>>")
    assert [tuple(x) for x in talk.select(preferences.with_thinks(F.col("i"), F.col("th"))).first()[0]] == [("q", "x", "a"), ("r", "y", "b")]
    assert talk.select(preferences.with_thinks(F.col("i"), F.slice("th", 1, 1)), preferences.with_side(F.col("i"), F.col("o"))).first()[:] == (None, None)
    one = talk.select(preferences.with_side(F.slice("i", 1, 1), F.col("o"), "accepted")[0]).first()[0]
    assert (one["accepted"]["answer"], one["rejected"]["answer"]) == ("no", "a")
    with pytest.raises(ValueError, match="unknown side"):
        preferences.with_side(F.col("i"), F.col("o"), "odd")


def test_plans_keep_their_rules(spark):
    s = spark.range(300).select("id", (F.col("id") % 16).cast("int").alias("n"), (F.col("id") % 3 == 0).alias("s"))
    by = {}
    for i, t, c, k in synthesis.plan(s.repartition(3), "id", "n", "s").collect():
        by.setdefault(i, {})[t] = (c, k)
    assert set(by) == {i for i in range(300) if i % 16 > 1}
    for i, turns_ in by.items():
        n = i % 16 - 1
        kinds = [turns_[t][0] for t in range(1, n + 1)]
        assert len(turns_) == n and kinds[0] == "explore" and kinds.count("transform") <= n // 2
        at = {k: t for t, (_, k) in turns_.items() if k and k != "content"}
        assert not at or (i % 3 and at["recall"] - at["plant"] >= 4 and at.get("update", 99) > at["recall"])
    assert any("update" in {k for _, k in t.values()} for t in by.values())
    v = synthesis.voices(synthesis.plan(s, "id", "n").select("id", "turn_index"), "id").orderBy("id", "turn_index").collect()
    assert all(a["persona"] != b["persona"] for a, b in itertools.pairwise(v) if a["id"] == b["id"])


def test_conversations_behind_a_client(spark):
    seeds = spark.createDataFrame([(i, f"What is the {c} harbour about?") for i, c in enumerate("abcde")], "id long, query string")

    class Moody(synthesis.MockWriter):
        """Refuses half of the time, breaks its form at times, and never answers for one seed."""

        def generate(self, prompt, seed):
            if prompt.endswith("FORM: answer"):
                if "the e harbour" in prompt:
                    raise TimeoutError("late")
                if seed % 2:
                    return "<think>I'm not allowed.</think>I cannot help with that."
            return super().generate(prompt, seed)

    rows, stats = synthesis.converse(seeds, "id", synthesis.MockWriter(), Moody(), 3, attempts=6)
    got = {(r["id"], r["turn_index"]): r for r in rows.collect()}
    s = stats.first()
    assert {i for i, _ in got} <= {0, 1, 2, 3} and s["n_seeds"] == 5 and s["n_dropped"] == 5 - s["n_conversations"] and s["n_regenerations"] > 0
    assert all(not r["passed"] or "cannot" not in r["answer"] for r in got.values()) and all(len([1 for j, _ in got if j == i]) == 3 for i, _ in got)
    again, _ = synthesis.converse(seeds.repartition(3), "id", synthesis.MockWriter(), Moody(), 3, attempts=6)
    assert rows_of(again) == rows_of(rows)
    slow = synthesis.answered(synthesis.requests(spark, 2, "FORM: items 3"), "iteration", synthesis.MockWriter(), streamed=True, seconds=-1.0)
    assert {len(r["response"]) for r in slow.collect()} == {16}
    total = synthesis.merged_stats(stats, stats).first()
    assert total["n_turns"] == 2 * s["n_turns"]
    assert synthesis.stamped(seeds, "d", {"judge": "m"}).first()["factory_models"] == {"judge": "m"}


def test_code_of_answers_runs_only_if_allowed(spark):
    block = lambda x: f"See:\n```python\n{x}\n```"
    t = turns(spark, ("a", 0, "q", "r", block("def f():\n    return 1") + block("assert f() == 2")), ("b", 0, "q", "r", block("assert 1 + 1 == 2")), ("c", 0, "q", "r", block("import time\nassert time.nothing")), ("d", 0, "q", "r", block("assert unknown")), ("e", 0, "q", "r", block("while True: pass\nassert 0")), ("f", 0, "q", "r", None), ("g", 0, "q", "r", block("print(1)")))
    with pytest.raises(PermissionError):
        detectors.code_mismatch(t)
    assert [(r[0], r[3], r[4]) for r in rows_of(detectors.code_mismatch(t, allow=True))] == [("a", "assert_failed", 3), ("c", "code_error", 2)]


def test_calls_are_repeated_for_passing_errors_only(spark):
    todo = spark.createDataFrame([("e1", "talk")], "_eval_id string, transcript string")

    class Client:
        def __init__(self, error, path):
            self.error, self.path = error, path

        def generate(self, prompt, seed):
            with open(self.path, "a") as f:
                f.write("x")
            raise self.error

    import tempfile

    for error, calls in ((ValueError("no such model"), 1), (TimeoutError("late"), 3), (RuntimeError("status 503"), 3), (RuntimeError("status 400"), 1)):
        with tempfile.NamedTemporaryFile() as f:
            r = generate.judge(todo, Client(error, f.name), "m", "J").collect()
            assert r[0]["_status"] == "error" and len(Path(f.name).read_text()) == calls
    both = generate.judge_all(todo, {"good": generate.MockClient(), "bad": Client(ValueError("no"), "/dev/null")}, "J {conversation}")
    assert {(r["_model"], r["_status"]) for r in both.collect()} == {("good", "ok"), ("bad", "error")}
    with pytest.raises(ValueError, match="no models"):
        generate.judge_all(todo, {}, "J")
    assert generate.scored(todo, "_eval_id", Client(ValueError("no"), "/dev/null"), "J").first()["rubric"] is None


def test_personal_facts(spark):
    pool = "array<struct<label:string,value:string,new_value:string>>"
    df = spark.createDataFrame([(1, [("boat", " Mora ", "Olbel"), ("", "x", "y"), ("z", "a", "b")]), (2, None)], f"id long, pool {pool}")
    f = {}
    for r in synthesis.personal_facts(df, "id", 3, "pool").collect():
        f.setdefault(r["id"], {})[r["position"]] = r
    assert {i: sorted(v) for i, v in f.items()} == {1: [0, 1, 2], 2: [0, 1, 2]}
    assert f[1][0]["plant"] == "By the way, my boat is Mora." and f[1][0]["update"] == "Actually, my boat is now Olbel." and f[2][0]["value"] != f[2][0]["new_value"]
    assert f[2][0]["label"] != f[2][1]["label"] and not re.search(P.BAD_FACT, " ".join(x["plant"] for v in f.values() for x in v.values()))


def test_sinks_of_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "a", "y")], "b long, _subset string, a string")
    assert writers.jsonl(df, str(tmp_path / "j"), sort_keys=True) == 3
    lines = sorted(x for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines())
    assert all(list(json.loads(x)) == ["_subset", "a", "b"] for x in lines) and len(lines) == 3
    writers.bundle(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/all")).count() == 3 and sorted(p.name for p in (tmp_path / "b/subsets").glob("_subset=*")) == ["_subset=a", "_subset=b"]
    writers.report(spark, {"rows": df, "none": df.limit(0)}, "Report", str(tmp_path / "r"))
    assert "| 2 | b | x |" in (tmp_path / "r/report.md").read_text() and "No data." in (tmp_path / "r/report.md").read_text()
    prevalence = spark.createDataFrame([("A", 2, 3, 50.0)], "detector string, n_conversations long, n_flags long, pct double")
    writers.filtered(df, prevalence, str(tmp_path / "f"))
    assert json.loads((tmp_path / "f/prevalence.json").read_text())["A"]["n_flags"] == 3
    with pytest.raises(Exception, match="exists"):
        writers.filtered(df, prevalence, str(tmp_path / "f"))
    counts = spark.createDataFrame([("hard", "x", 2)], "part string, name string, n long")
    writers.audit(prevalence.select("pct"), counts, {"seed": 42}, str(tmp_path / "audit.json"))
    assert json.loads((tmp_path / "audit.json").read_text()) == {"settings": {"seed": 42}, "summary": {"pct": 50.0}, "counts": {"hard": {"x": 2}}}
    src = str(tmp_path / "s")
    for i in range(3):
        spark.createDataFrame([(i,)], "i long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("i long").option("maxFilesPerTrigger", 1).parquet(src)
    assert writers.partial(stream, str(tmp_path / "out"), str(tmp_path / "ck"), every=2) == []
    assert sorted(r["i"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_readers_of_seeds_and_logs(spark, tmp_path):
    x = readers.in_memory(spark, ["Hello there", {"prompt": " Why? ", "lang": "en"}, {"messages": [{"role": "user", "content": "Hi"}]}])
    assert [(r["position"], r["seed"], r["lang"]) for r in x.orderBy("position").collect()] == [(0, "Hello there", None), (1, "Why?", "en"), (2, "Hi", None)]
    (tmp_path / "m.jsonl").write_text(json.dumps({"seq": 1, "_eval_id": "e", "_status": "ok"}) + "\n")
    rows, missing = readers.model_logs(spark, {"m": str(tmp_path / "m.jsonl"), "n": str(tmp_path / "none.jsonl")})
    assert rows.select("_model", "_eval_id").collect()[0][:] == ("m", "e") and missing == ["n"]
    assert readers.model_logs(spark, {"n": str(tmp_path / "none.jsonl")})[0].count() == 0
    assert readers.existing(spark, str(tmp_path / "none")) is None
    a, b = (spark.createDataFrame(v, s) for v, s in (([(1, "x", 2)], "k int, v string, only_a int"), ([(2, "y", "z")], "k int, v string, w string")))
    assert rows_of(V.common_columns(a, b)) == [(1, "x"), (2, "y")]


def test_generation_is_repeatable(spark):
    todo = spark.createDataFrame([(f"e{i}", "talk" if i else None) for i in range(20)], "_eval_id string, transcript string")
    a, b = (rows_of(generate.judge(x, generate.MockClient(), "m", "J {conversation}").drop("_latency_seconds")) for x in (todo, todo.repartition(5)))
    assert a == b and {r[2] for r in a} == {"ok"}

    class Broken:
        def generate(self, prompt, seed):
            raise TimeoutError("late")

    assert {(r[2], r[4]) for r in rows_of(generate.judge(todo, Broken(), "m", "J").drop("_latency_seconds"))} == {("error", "TimeoutError")}
    p = generate.plan(todo, "_eval_id", 5, {"explore": 0.5, "memory": 0.5})
    assert p.count() == 80 and {r[2] for r in rows_of(p) if r[1] == 1} == {"explore"}


def test_entry():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


# ------------------------------------------------------------------ cross-turn checks


def test_recall_and_update_checks(spark):
    events = spark.createDataFrame([("c", "f", 0, "red boat"), ("c", "f", 2, "blue boat")], "c string, fact_id string, turn int, value string")
    t = spark.createDataFrame(
        [("c", 1, "It is the red boat.", "f", "delayed_recall"), ("c", 2, "Now the blue boat.", "f", "update_overwrite"), ("c", 3, "Red boat, then blue boat", "f", "update_overwrite"), ("c", 4, "THE BLUE-BOAT", "f", "delayed_recall"), ("c", 5, "x", "g", "delayed_recall"), ("c", 6, "x", None, "delayed_recall")],
        "c string, turn_index int, answer string, fact_id string, kind string",
    )
    got = {i: p for _, i, _, p in rows_of(X.recall_checks(t, events))}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}
    assert tuple(X.pass_rate(X.recall_checks(t, events)).first()) == (5, 2, 0.4) and tuple(X.pass_rate(X.recall_checks(t.limit(0), events)).first()) == (0, 0, 1.0)


def test_verification_order(spark):
    good = "This is a fine answer about boats."
    t = turns(spark, ("a", 0, "q", "fine", good), ("a", 1, "q", "fine", good), ("b", 0, "q", "top_type rule", good), ("c", 0, "q", "as per the system", good), ("d", 0, "q", "fine", "x"), ("e", 0, "q", "fine", None))
    got = {(c, i): f for c, i, f in X.verified(t.withColumn("intent", F.lit("compress"))).collect()}
    assert got == {("a", 0): None, ("a", 1): "identical to prior answer", ("b", 0): "rule names in reasoning", ("c", 0): "harness_leak", ("d", 0): "quality: too_short", ("e", 0): "quality: too_short"}
    assert {f for _, _, f in X.verified(t, own=F.lit(False)).filter("c = 'a'").collect()} == {"own rule"}


def test_record_defects(spark):
    schema = TURN + ", intent string, scope string, planted_turn int, value string, stale_values array<string>"
    t = spark.createDataFrame(
        [
            ("a", 0, "my cat is Tom", "r", "ok", "open_chat", None, None, None, None), ("a", 1, "what is my cat called, Tom?", "r", "Tom", "fact_recall", "delayed_recall", 0, "Tom", None),
            ("a", 2, "now Max", "r", "Max", "fact_update", None, 0, "premium plan", ["Tom", "Zoe"]), ("b", 0, "q", "r", "same", "restyle", None, None, None, None), ("b", 1, "q", "r", "same ", "restyle", None, None, None, None), ("n", 0, None, None, None, None, None, None, None, None),
        ],
        schema,
    )
    c = spark.createDataFrame([("a", "tell me of cats", False, 9, 9), ("b", "hello!", True, 5, None), ("n", None, None, None, None)], "c string, first_query string, sensitive boolean, coherence int, appropriateness int")
    assert set(rows_of(X.record_defects(t, c))) == {
        ("a", 1, "same_turn_fact"), ("a", 2, "phantom_stale"), ("a", 2, "bad_fact_type"), ("b", 0, "sensitive_flippant"), ("b", 1, "sensitive_flippant"), ("b", 1, "identical_rewrite"),
        ("b", -1, "transformation_density"), ("b", -1, "contentless_seed_kept"), ("b", -1, "judge_low"), ("n", -1, "contentless_seed_kept"),
    }


def test_policies_and_fact_cleanup(spark):
    t = spark.createDataFrame([("c", 0, 0, None), ("c", 5, 1, 1), ("c", 4, None, 1)], "c string, turn_index int, n_active int, oldest_fact int")
    assert rows_of(X.valid_policies(t)) == [("c", 0, False, False, False), ("c", 4, False, True, False), ("c", 5, True, True, True)]
    f = spark.createDataFrame([(1, [("the cat", "Tom", None), ("dog", "tom", None), ("x", "y", None), ("account", "number", None), (None, "zz", None), ("a", "bb", "cc"), ("b", "cc", None), ("c", "dd", None), ("d", "ee", None)]), (2, None)], "id int, facts array<struct<label:string,value:string,new_value:string>>")
    assert rows_of(X.clean_facts(f, "id").select("position", "label", "value")) == [(0, "cat", "Tom"), (1, "a", "bb"), (2, "b", "cc"), (3, "c", "dd")]


def test_extract_strip_materialise_notes(spark):
    df = conv(spark, (1, [(" q ", " t ", "as shown above it is")], 1), (2, None, 1))
    assert V.extracted(df.withColumn("system", F.lit("  "))).collect()[0][0] is None and V.extracted(df).count() == 1
    assert tuple(df.filter("id = 1").select(V.stripped(F.col("interactions"))).first()[0][0]) == ("q", " t ", "as shown above it is")
    assert [tuple(x) for x in df.filter("id = 1").select(V.dangling_notes(F.col("interactions"))).first()[0]] == [(0, ["as shown above"])]
    m = V.materialised(spark.range(100).withColumn("_subset", F.col("id") % 2), "r", "_subset", "id", 5)
    assert sorted(x["_sample_index"] for x in m.collect()) == sorted(list(range(5)) * 2)
    assert one(spark, "﻿text", writers.clean_utf8(F.encode(F.col("x"), "UTF-8"))) == ("text",)


def test_drawn_pairs_follow_weights(spark):
    df = spark.range(20_000).withColumn("allowed", F.when(F.col("id") % 10 == 0, F.array(F.lit("b"))).when(F.col("id") % 10 == 1, F.array(F.lit("z"))))
    x = generate.draw_pairs(df, ["id"], {"a": 3, "b": 1}, {"p": 1, "q": 1}, {("a", "q")}, "allowed")
    n = {(i, p): c for i, p, c in x.filter("id % 10 > 1").groupBy("intent", "policy").count().collect()}
    assert set(n) == {("a", "p"), ("b", "p"), ("b", "q")} and abs(n["a", "p"] / sum(n.values()) - 0.6) < 0.02
    assert {r[0] for r in x.filter("id % 10 = 0").select("intent").distinct().collect()} == {"b"}
    assert {r[0] for r in x.filter("id % 10 = 1").select("intent").distinct().collect()} == {"a", "b"}  # none of its intents is known: all are permitted
    with pytest.raises(ValueError, match="no valid pair"):
        generate.draw_pairs(df, ["id"], {"a": 1}, {"p": 1}, {("a", "p")})


def test_config_and_cues(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("seed: 7\nodd: 1\ninvalid_pairs: [[a, b]]\n")
    c = config.config(str(tmp_path / "c.yaml"))
    assert c.seed == 7 and c.invalid_pairs == [("a", "b")] and c.samples_per_subset == 100
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError, match="no object"):
        config.mapping(str(tmp_path / "l.json"))
    t = turns(spark, ("a", 0, "q", "a policy on boats, tone: calm", "x"), ("b", 0, "q", "openai policy", "x"), ("c", 0, "q", None, "x"))
    assert rows_of(detectors.exploratory_cues(t)) == [("policy", 1), ("tone:", 1)]
    assert rows_of(detectors.axis_means(spark.createDataFrame([("m", 4), ("m", 5), ("n", None)], "judge string, q int"), "judge")) == [("m", 2, 4.5), ("n", 1, None)]
