"""Checks across the turns of a conversation, and the classes of record defects.

Facts come as rows (c, fact_id, turn, value); turns as (c, turn_index, query,
reasoning, answer) with further columns where an operator names them.  All joins are
equality joins on the conversation with the order as a residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .records import facts


def present(answer: Column, value: Column, fuzzy: Column | None = None) -> Column:
    """Does the answer hold the value: as a normalised part, or (fuzzy) with at least half of its words."""
    want, have = T.normalised(value), T.normalised(answer)
    exact = (want != "") & F.contains(have, want)
    if fuzzy is None:
        return exact
    x, y = F.array_distinct(F.split(want, " ")), F.array_distinct(F.split(have, " "))
    return F.when(F.coalesce(fuzzy, F.lit(False)), (want != "") & (2 * F.size(F.array_intersect(x, y)) >= F.size(x))).otherwise(exact)


def state_at(t: DataFrame, events: DataFrame) -> DataFrame:
    """(c, turn_index, fact_id, value, stale): every fact known before or at a turn, with its value then and the values before it."""
    j = t.select("c", "turn_index").join(events.filter("fact_id IS NOT NULL"), "c").filter(F.col("turn") <= F.col("turn_index"))
    g = j.groupBy("c", "turn_index", "fact_id").agg(F.sort_array(F.collect_list(F.struct("turn", "value"))).alias("h"))
    return g.select("c", "turn_index", "fact_id", F.element_at("h", -1)["value"].alias("value"), F.transform(F.slice("h", F.lit(1), F.size("h") - 1), lambda x: x["value"]).alias("stale"))


def recall_checks(t: DataFrame, events: DataFrame) -> DataFrame:
    """(c, turn_index, kind, passed) of the turns that refer to a fact (column fact_id, kind delayed_recall or update_overwrite).

    A recall must hold the fact's last value of all; an update must hold its value at
    that turn and none of the earlier ones, and must not refuse.  An unknown fact fails.
    """
    asked = t.filter("fact_id IS NOT NULL AND kind IS NOT NULL").select("c", "turn_index", "kind", "fact_id", "answer")
    last = facts(events).select("c", "fact_id", F.col("value").alias("last"))
    then = state_at(asked, events)
    j = asked.join(last, ["c", "fact_id"], "left").join(then, ["c", "turn_index", "fact_id"], "left")
    recall = present(F.col("answer"), F.col("last"))
    update = ~T.has(F.col("answer"), P.RECALL_REFUSAL) & present(F.col("answer"), F.col("value")) & ~F.coalesce(F.exists("stale", lambda s: present(F.col("answer"), s)), F.lit(False))
    return j.select("c", "turn_index", "kind", F.coalesce(F.when(F.col("kind") == "delayed_recall", F.col("last").isNotNull() & recall).otherwise(F.col("value").isNotNull() & update), F.lit(False)).alias("passed"))


def pass_rate(checks: DataFrame) -> DataFrame:
    """One row: checks, passed, and their share; 1 if there are none."""
    return checks.agg(F.count("*").alias("n_checks"), F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0)).alias("n_passed"), F.round(F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(1.0)), 4).alias("pass_rate"))


def first_failure(own: Column | None = None, active: Column | None = None) -> Column:
    """Why a turn fails, by the first of the ordered checks; null if it passes.

    Works on columns query, reasoning, answer, intent and prior_answer.  `own` and `active`
    are the results of the turn's own and of the lasting rules.
    """
    a, r = F.col("answer"), F.col("reasoning")
    same = F.lower(T.collapsed(a)) == F.lower(T.collapsed(F.col("prior_answer")))
    out = (
        F.when(T.quality(a).isNotNull(), F.concat(F.lit("quality: "), T.quality(a)))
        .when(T.has(a, P.MEMORY_DISCLAIMER), "memory disclaimer")
        .when(T.has(a, P.COT_LEAK), "leaked thought")
        .when(F.coalesce(F.col("intent").isin(*P.TRANSFORM_INTENTS), F.lit(False)) & F.col("prior_answer").rlike(r"\S") & same, "identical to prior answer")
        .when(T.has(r, P.SPEC_LEAK), "rule names in reasoning")
        .when(T.reasoning_defect(r).isNotNull(), T.reasoning_defect(r))
    )
    if own is not None:
        out = out.when(~F.coalesce(own, F.lit(False)), "own rule")
    if active is not None:
        out = out.when(~F.coalesce(active, F.lit(False)), "active rule")
    return out


def verified(t: DataFrame, own: Column | None = None, active: Column | None = None) -> DataFrame:
    """(c, turn_index, failure) of every turn; the prior answer is that of the turn before."""
    x = t.withColumn("prior_answer", F.lag("answer").over(Window.partitionBy("c").orderBy("turn_index")))
    if "intent" not in t.columns:
        x = x.withColumn("intent", F.lit(None).cast("string"))
    return x.select("c", "turn_index", first_failure(own, active).alias("failure"))


def record_defects(t: DataFrame, conversations: DataFrame) -> DataFrame:
    """(c, turn_index, defect) for defects that need the plan of a conversation; turn -1 stands for all of it.

    t: also intent, scope, planted_turn, value, stale_values (array), and optionally verifier and
    markers (array: words of which a request for the rule must hold one).  conversations: c,
    first_query, sensitive, coherence, appropriateness, and optionally role_consistency.
    """
    known = F.array_join(F.collect_list(F.concat_ws("\n", "query", "answer")).over(Window.partitionBy("c").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)), "\n")
    x = t.withColumn("known", known).withColumn("prior", F.lag("answer").over(Window.partitionBy("c").orderBy("turn_index"))).join(conversations.select("c", "sensitive"), "c", "left")
    for name, kind in (("verifier", "string"), ("markers", "array<string>")):
        x = x if name in t.columns else x.withColumn(name, F.lit(None).cast(kind))
    memory, transform = F.col("intent").isin(*P.MEMORY_INTENTS), F.col("intent").isin(*P.TRANSFORM_INTENTS)
    recall = (F.col("intent") == "fact_recall") & (F.col("scope") == "delayed_recall")
    per_turn = {
        "same_turn_fact": recall & ((F.col("planted_turn") == F.col("turn_index")) | present(F.col("query"), F.col("value"))),
        "phantom_stale": (F.col("intent") == "fact_update") & F.exists("stale_values", lambda s: (F.trim(s) != "") & ~present(F.col("known"), s)),
        "bad_fact_type": memory & T.has(F.col("value"), P.BAD_FACT),
        "sensitive_flippant": F.col("sensitive") & (transform | memory | (F.col("intent") == "chained_compute")) & ~F.col("intent").isin(*P.SENSITIVE_INTENTS),
        "constraint_mismatch": F.col("verifier").isin("programmatic", "hybrid") & (F.col("turn_index") >= 1) & ~F.coalesce(memory, F.lit(False)) & (F.size("markers") > 0) & ~F.exists("markers", lambda m: F.contains(F.lower(T.text(F.col("query"))), F.lower(m))),
        "identical_rewrite": transform & F.col("answer").rlike(r"\S") & (F.trim("answer") == F.trim("prior")),
    }
    a = x.select("c", "turn_index", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in per_turn.items())))).alias("defect"))
    dense = t.filter("turn_index >= 1").groupBy("c").agg(F.avg(F.coalesce(transform, F.lit(False)).cast("int")).alias("s")).filter("s > 0.6").select("c", F.lit(-1).alias("turn_index"), F.lit("transformation_density").alias("defect"))
    q = F.trim(T.text("first_query"))
    role = F.col("role_consistency") < 7 if "role_consistency" in conversations.columns else F.lit(False)
    whole = {
        "role_confusion": F.coalesce(role, F.lit(False)),
        "contentless_seed_kept": T.has(q, P.CONTENTLESS) | (F.length(q) < 6),
        "judge_low": F.coalesce(F.col("coherence") < 6, F.lit(False)) | F.coalesce(F.col("appropriateness") < 7, F.lit(False)),
    }
    b = conversations.select("c", F.lit(-1).alias("turn_index"), F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in whole.items())))).alias("defect"))
    return a.unionByName(dense).unionByName(b)


def valid_policies(t: DataFrame, distance: int = 4) -> DataFrame:
    """t with n_active, oldest_fact (turn): which memory policies make sense at each turn."""
    return t.select(
        "c", "turn_index", (F.coalesce("n_active", F.lit(0)) > 0).alias("cumulative"), (F.col("turn_index") >= 1).alias("standing"),
        F.coalesce(F.col("turn_index") - F.col("oldest_fact") >= distance, F.lit(False)).alias("delayed_recall"),
    )


def clean_facts(df: DataFrame, key: str) -> DataFrame:
    """(key, position, label, value, new_value) from facts ARRAY<STRUCT<label, value, new_value>>: the first four good ones with different values."""
    x = df.select(key, F.posexplode("facts").alias("p", "f")).select(key, "p", F.regexp_replace(F.trim(T.text(F.col("f.label"))), r"(?i)^(?:the|my|your|a|an)\s+", "").alias("label"), F.trim(T.text(F.col("f.value"))).alias("value"), F.trim(T.text(F.col("f.new_value"))).alias("new_value"))
    good = x.filter((F.col("label") != "") & (F.length("value") >= 2) & ~T.has(F.concat_ws(" ", "label", "value", "new_value"), P.BAD_FACT))
    first = good.groupBy(key, F.lower("value").alias("v")).agg(F.min_by(F.struct("p", "label", "value", "new_value"), "p").alias("r"))
    w = Window.partitionBy(key).orderBy("r.p")
    return first.withColumn("position", F.row_number().over(w) - 1).filter("position < 4").select(key, "position", "r.label", "r.value", "r.new_value")
