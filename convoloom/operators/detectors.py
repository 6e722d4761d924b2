"""Defect detectors over turns (c, turn_index, query, reasoning, answer[, regenerations, scope]).

Detectors give one row per flag: c, turn_index, detector, name, severity, evidence.
Null segments count as empty.  Per-turn detectors are a single projection; only the
conversation-level detector A aggregates, once, by conversation.
"""

from __future__ import annotations

import ast
import re
import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.parsing import AXES

KINDS = ("turn_index_in_answer", "turn_index_in_reasoning", "numbered_flow_in_reasoning", "harness_in_reasoning", "trailing_artifact", "degenerate_reasoning", "restart_spiral", "excess_regenerations")


#: Kinds of which a batch must hold none.
FATAL = ("turn_index_in_answer", "harness_in_reasoning", "trailing_artifact", "degenerate_reasoning")


def _flag(detector: str, name: str, severity: Column | int, evidence: Column) -> list[Column]:
    s = severity if isinstance(severity, Column) else F.lit(severity)
    return [F.lit(detector).alias("detector"), F.lit(name).alias("name"), s.cast("int").alias("severity"), evidence.alias("evidence")]


def hard_fails(t: DataFrame, most_regenerations: int = 2) -> DataFrame:
    """(c, turn_index, kind): objective defects of each turn; a turn can have several."""
    q, r, a = F.col("query"), F.col("reasoning"), F.col("answer")
    again = F.coalesce(F.col("regenerations"), F.lit(0)) if "regenerations" in t.columns else F.lit(0)
    degenerate = T.degenerate(r)
    found = (
        T.turn_index_leak(a),
        T.turn_index_leak(r),
        T.flow_list(r),
        T.has(r, P.HARNESS),
        T.trailing_artifact(q) | T.trailing_artifact(r) | T.trailing_artifact(a),
        degenerate,
        ~degenerate & (T.restarts(r) >= P.RESTARTS_FAIL),
        again > most_regenerations,
    )
    kinds = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in zip(KINDS, found, strict=True))))
    return t.select("c", "turn_index", F.explode(kinds).alias("kind"))


def fabricated_specifics(t: DataFrame) -> DataFrame:
    """B: checkable specifics in an answer; the more classes, the more severe."""
    s = T.specifics(F.col("answer"))
    text = F.array_join(F.transform(F.slice("s", 1, 4), lambda x: F.concat(x["name"], F.lit(":"), x["matched"])), ", ")
    return t.withColumn("s", s).filter(F.size("s") > 0).select("c", "turn_index", *_flag("B", "fabricated_specifics", F.least(F.size("s"), F.lit(3)), text))


def confidence_mismatch(t: DataFrame) -> DataFrame:
    """A: at most one flag per conversation, by the first of three rules that holds.

    A1 a turn is unsure in its reasoning and specific in its answer; A2 the first query
    asks for an exact rank and some answer is specific; A3 some reasoning admits
    invention and some answer is specific.
    """
    x = t.select("c", "turn_index", T.specifics(F.col("answer")).alias("s"), T.guarded_markers(F.col("reasoning"), P.UNCERTAINTY).alias("u"), T.guarded_markers(F.col("reasoning"), P.ADMISSION).alias("m"), "query")
    x = x.select("c", "turn_index", F.try_element_at("s", F.lit(1)).alias("s"), F.try_element_at("u", F.lit(1)).alias("u"), F.try_element_at("m", F.lit(1)).alias("m"), "query")
    first = lambda when, *more: F.min_by(F.struct("turn_index", *more), F.when(when, F.col("turn_index")))
    g = x.groupBy("c").agg(
        first(F.col("s").isNotNull(), F.col("s.name").alias("name"), F.col("s.matched").alias("matched")).alias("spec"),
        first(F.col("s").isNotNull() & F.col("u").isNotNull(), F.col("s.name").alias("name"), F.col("s.matched").alias("matched"), "u").alias("a1"),
        first(F.col("m").isNotNull(), "m").alias("a3"),
        F.min_by("query", "turn_index").alias("q"),
    )
    asserts = lambda r: F.concat(r["name"], F.lit(" '"), r["matched"], F.lit("'"))
    found = (
        F.when(F.col("a1").isNotNull(), F.struct(F.col("a1.turn_index").alias("turn_index"), F.lit("confidence_uncertainty_mismatch").alias("name"), F.concat(F.lit("unsure: '"), F.col("a1.u"), F.lit("', asserts "), asserts(F.col("a1"))).alias("evidence")))
        .when(T.has(F.col("q"), P.UNGROUNDED_PREMISE), F.struct(F.col("spec.turn_index").alias("turn_index"), F.lit("ungrounded_premise_fabrication").alias("name"), F.concat(F.lit("premise: '"), F.substring(T.text(F.col("q")), 1, 45), F.lit("', asserts "), asserts(F.col("spec"))).alias("evidence")))
        .when(F.col("a3").isNotNull(), F.struct(F.col("spec.turn_index").alias("turn_index"), F.lit("fabrication_admission").alias("name"), F.concat(F.lit("turn "), F.col("a3.turn_index").cast("string"), F.lit(" admits '"), F.col("a3.m"), F.lit("', asserts "), asserts(F.col("spec"))).alias("evidence")))
    )
    y = g.filter(F.col("spec").isNotNull()).select("c", found.alias("f")).filter("f IS NOT NULL")
    return y.select("c", "f.turn_index", F.lit("A").alias("detector"), "f.name", F.lit(3).alias("severity"), "f.evidence")


_BLOCK = re.compile(r"```(?:python|py)\s*\n(.*?)```", re.S | re.I)
_ASSERT = re.compile(r"^\s*assert\b", re.M)
_SKIP = re.compile(r"\btimeit\b|\binput\s*\(|\bwhile True\b|__main__|requests\.|urllib|socket", re.I)


def code_mismatch(t: DataFrame, allow: bool = False, seconds: float = 8.0) -> DataFrame:
    """C: answers whose own Python assertions fail when their blocks are run in an isolated process.

    This runs code that a model wrote, on the executors; it is refused unless `allow` is set, and then
    the executors must be sandboxed by the caller.  Blocks that measure time or read input, and those that
    can't be parsed, are left out; unknown names and time-outs are no flags.
    """
    if not allow:
        raise PermissionError("running code of answers must be allowed explicitly")

    def verdict(answer: str) -> tuple[str, int, str] | None:
        blocks = [b for b in _BLOCK.findall(answer or "") if not _SKIP.search(b)]
        usable = []
        for b in blocks:
            try:
                ast.parse(b)
            except (SyntaxError, ValueError):
                continue
            usable.append(b)
        script = "\n\n".join(usable)
        if not _ASSERT.search(script):
            return None
        try:
            done = subprocess.run([sys.executable, "-I", "-c", script], capture_output=True, text=True, timeout=seconds, check=False)
        except subprocess.TimeoutExpired:
            return None
        if not done.returncode or "NameError" in done.stderr:
            return None
        failed = "AssertionError" in done.stderr
        last = (done.stderr.strip().splitlines() or [""])[-1]
        return ("assert_failed", 3, last[:100]) if failed else ("code_error", 2, last[:100])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(c, i, "C", *v) for c, i, a in zip(pdf["c"], pdf["turn_index"], pdf["answer"], strict=True) if (v := verdict(a))]
            yield pd.DataFrame(out, columns=["c", "turn_index", "detector", "name", "severity", "evidence"])

    kind = t.schema["c"].dataType.simpleString()
    return t.select("c", "turn_index", "answer").mapInPandas(run, f"c {kind}, turn_index int, detector string, name string, severity int, evidence string")


def format_bookkeeping(t: DataFrame, share: float = 0.45) -> DataFrame:
    """D: reasoning of which many sentences are about format rules."""
    s = F.filter(F.split(T.text("reasoning"), r"(?<=[.!?\n])\s+"), lambda v: v.rlike(r"\S"))
    hit = F.filter(s, lambda v: v.rlike(T.any_of(P.FORMAT_MECHANICS)))
    x = t.select("c", "turn_index", F.size(s).alias("n"), F.size(hit).alias("k")).filter((F.col("k") >= 2) & (F.col("k") >= share * F.col("n")))
    return x.select("c", "turn_index", *_flag("D", "format_bookkeeping_reasoning", 1, F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"))))


def reasoning_artifacts(t: DataFrame, same: float = 0.82) -> DataFrame:
    """E: a mechanical closing phrase in the reasoning, or the answer already written there."""
    tail = T.first_match(F.col("reasoning"), P.FILLER_TAIL)
    copied = (F.length(T.text("answer")) > 200) & (T.overlap(F.col("reasoning"), F.col("answer")) >= same)
    names = F.array_compact(F.array(F.when(tail.isNotNull(), F.struct(F.lit("filler_tail").alias("n"), tail.alias("e"))), F.when(copied, F.struct(F.lit("answer_duplicated_in_reasoning").alias("n"), F.lit("").alias("e")))))
    return t.select("c", "turn_index", F.explode(names).alias("f")).select("c", "turn_index", F.lit("E").alias("detector"), F.col("f.n").alias("name"), F.lit(1).alias("severity"), F.col("f.e").alias("evidence"))


def phantom_standing(t: DataFrame) -> DataFrame:
    """F: a standing rule that the query does not license.  Needs column `scope`."""
    x = t.filter((F.col("scope") == "standing") & (T.text("query") != "") & ~T.has(F.col("query"), P.STANDING_LICENCE))
    return x.select("c", "turn_index", *_flag("F", "phantom_standing_constraint", 2, F.substring(T.text("query"), 1, 60)))


def answer_defects(t: DataFrame) -> DataFrame:
    """(c, turn_index, defect): memory disclaimers, leaked thought, leaked rule names, dangling references, role confusion, missing reasoning."""
    q, r, a = F.col("query"), F.col("reasoning"), F.col("answer")
    blank = lambda c: ~T.text(c).rlike(r"\S")
    found = {
        "prompt_echo": T.prompt_echo(q),
        "memory_disclaimer": T.has(a, P.MEMORY_DISCLAIMER),
        "cot_leak": T.has(a, P.COT_LEAK),
        "spec_leak": T.has(q, P.SPEC_LEAK) | T.has(r, P.SPEC_LEAK) | T.has(a, P.SPEC_LEAK),
        "dangling_reference": T.has(a, P.DANGLING),
        "role_confusion": (F.col("turn_index") >= 1) & T.has(q, P.ROLE_CONFUSION),
        "reasoning_missing": ~blank(a) & blank(r),
    }
    return t.select("c", "turn_index", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found.items())))).alias("defect"))


def all_flags(t: DataFrame) -> DataFrame:
    out = confidence_mismatch(t)
    for f in (fabricated_specifics, format_bookkeeping, reasoning_artifacts):
        out = out.unionByName(f(t))
    return out.unionByName(phantom_standing(t)) if "scope" in t.columns else out


def prefilter(t: DataFrame) -> DataFrame:
    """(c, n_turns, n_hard, passed): a conversation passes without any hard fail or A flag."""
    bad = hard_fails(t).select("c").unionByName(confidence_mismatch(t).select("c")).groupBy("c").agg(F.count("*").alias("n_hard"))
    n = t.groupBy("c").agg(F.count("*").alias("n_turns"))
    return n.join(bad, "c", "left").select("c", "n_turns", F.coalesce("n_hard", F.lit(0)).alias("n_hard"), F.col("n_hard").isNull().alias("passed"))


def prevalence(t: DataFrame) -> DataFrame:
    """detector, conversations, flags, pct of all conversations."""
    n = t.agg(F.countDistinct("c").alias("all"))
    g = all_flags(t).groupBy("detector").agg(F.countDistinct("c").alias("n_conversations"), F.count("*").alias("n_flags"))
    return g.join(F.broadcast(n)).select("detector", "n_conversations", "n_flags", F.round(100 * F.col("n_conversations") / F.col("all"), 2).alias("pct"))


def gate(scores: DataFrame, prefiltered: Column) -> Column:
    """Accept: prefilter passed, and no present axis below its minimum, and no flagged turn of severity 3.

    `scores` has the axes as columns, null where absent, and flagged_turns.
    """
    low = F.lit(False)
    for axis, least in P.GATE_MINIMA.items():
        if axis in scores.columns:
            low = low | F.coalesce(F.col(axis) < least, F.lit(False))
    flagged = F.coalesce(F.exists("flagged_turns", lambda f: F.coalesce(f["severity"], F.lit(1)) >= 3), F.lit(False)) if "flagged_turns" in scores.columns else F.lit(False)
    return prefiltered & ~low & ~flagged


def standing_checks(t: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule (c, turn_index, rule...) with every later turn of its conversation.

    An equality join on the conversation with the order as a residual condition.
    """
    r = rules.withColumnRenamed("turn_index", "rule_turn")
    return r.join(t.select("c", "turn_index", "answer"), "c").filter(F.col("turn_index") > F.col("rule_turn"))


def batch_counts(t: DataFrame, scores: DataFrame) -> DataFrame:
    """(part, name, n): hard fails by kind, soft flags by kind, and flagged turns by the judge's dimension."""
    hard = hard_fails(t).groupBy(F.lit("hard").alias("part"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    soft = soft_flags(t).groupBy(F.lit("flag").alias("part"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    out = hard.unionByName(soft)
    if "flagged_turns" in scores.columns:
        f = scores.select(F.explode("flagged_turns").alias("f")).groupBy(F.lit("dimension").alias("part"), F.col("f.dimension").alias("name")).agg(F.count("*").alias("n"))
        out = out.unionByName(f)
    return out


def soft_flags(t: DataFrame) -> DataFrame:
    """(c, turn_index, kind): restarts that are too few to fail a turn."""
    n = T.restarts(F.col("reasoning"))
    return t.filter((n > 1) & (n < P.RESTARTS_FAIL)).select("c", "turn_index", F.lit("restarts").alias("kind"))


def batch_summary(t: DataFrame, scores: DataFrame, most_regenerations: int = 2) -> DataFrame:
    """One row: conversations, turns, hard fails in all and by the kinds that acceptance looks at, the gate's pass rate, the mean of every axis, the most regenerations.

    scores: c, the axes that are known, and optionally flagged_turns; a conversation without
    scores is judged by the prefilter alone.  An axis that is missing has a null mean.
    """
    p = prefilter(t)
    s = p.join(scores, "c", "left")
    ok = gate(s, F.col("passed"))
    means = [F.bround(F.avg(a), 2).alias(f"mean_{a}") if a in scores.columns else F.lit(None).cast("double").alias(f"mean_{a}") for a in AXES]
    again = F.max(F.coalesce(F.col("regenerations"), F.lit(0))) if "regenerations" in t.columns else F.lit(0)
    kinds = hard_fails(t, most_regenerations).agg(*(F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0)).alias(f"n_{k}") for k in FATAL))
    head = s.agg(F.count("*").alias("n_conversations"), F.coalesce(F.sum("n_turns"), F.lit(0)).alias("n_turns"), F.coalesce(F.sum("n_hard"), F.lit(0)).alias("n_hard_fails"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("n_passed"), F.bround(F.avg(ok.cast("int")), 3).alias("pass_rate"), *means)
    most = t.agg(F.coalesce(again, F.lit(0)).alias("most_regenerations"))
    return head.crossJoin(kinds).crossJoin(most)  # one row each


def acceptance(low: float = 0.65, high: float = 0.95, least: float = 8.0, most_regenerations: int = 2) -> dict[str, Column]:
    """The eight rules of a batch, as booleans over the columns of `batch_summary`; all must hold."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return {
        **{f"no_{k}": F.col(f"n_{k}") == 0 for k in FATAL},
        "regenerations": F.col("most_regenerations") <= most_regenerations,
        "reasoning_quality": yes(F.col("mean_reasoning_quality") >= least),
        "reasoning_answer_consistency": yes(F.col("mean_reasoning_answer_consistency") >= least),
        "pass_rate_in_band": yes(F.col("pass_rate").between(low, high)),
    }


def accepted(summary: DataFrame, **bounds) -> DataFrame:
    """The summary with a column per rule and `accepted`."""
    rules = acceptance(**bounds)
    all_ = F.lit(True)
    for r in rules.values():
        all_ = all_ & r
    return summary.withColumns({**{f"ok_{k}": v for k, v in rules.items()}, "accepted": all_})


def pass_rates(attempts: DataFrame, by: list[str], least: int = 5, low: float = 0.3, weight: float = 0.25) -> DataFrame:
    """Pass rate per kind and its sampling weight: lowered where enough attempts passed too rarely."""
    g = attempts.groupBy(*by).agg(F.count("*").alias("n_attempts"), F.avg(F.col("passed").cast("int")).alias("r"))
    return g.select(*by, "n_attempts", F.round("r", 4).alias("pass_rate"), F.when((F.col("n_attempts") >= least) & (F.col("r") < low), weight).otherwise(1.0).alias("weight"))


def exploratory_cues(t: DataFrame) -> DataFrame:
    """(cue, n): how many reasonings that the leak patterns pass still hold each cue."""
    low = F.lower(T.text("reasoning"))
    x = t.filter(~T.has(F.col("reasoning"), P.HARNESS)).select(F.explode(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(c)), F.lit(c)) for c in P.EXPLORATORY_CUES)))).alias("cue"))
    return x.groupBy("cue").agg(F.count("*").alias("n"))


def axis_means(scores: DataFrame, by: str) -> DataFrame:
    """Means of all numeric axes per judge, to compare two judges of the same conversations."""
    axes = [f.name for f in scores.schema.fields if f.name != by and f.dataType.typeName() in ("integer", "long", "double")]
    return scores.groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.avg(a), 4).alias(a) for a in axes))
