"""Conversation records: schema, JSON-row round trip, validation, rule stacks, facts, renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

SEGMENT = "struct<segment_type:string,text:string>"
RULE = "struct<intent:string,type:string,params:string,lang:string,verifier:string,scope:string,applies_from_turn:int,planted_turn:int,fact_id:string>"
TURN = f"struct<turn_index:int,segments:array<{SEGMENT}>,intent:string,policy:string,constraint_spec:{RULE},verification:struct<passed:boolean,detail:string,regenerations:int>,reasoning_flag:boolean,topk_logits_ref:string>"
FACT = "struct<fact_id:string,value:string,planted_turn:int,fact_type:string,value_history:array<struct<turn:int,value:string>>>"
SEED = "struct<dataset:string,first_query:string,category:string,domain:string,lang:string,is_haystack:boolean>"
SCHEMA = f"conversation_id string, source_seed {SEED}, mode string, length int, turns array<{TURN}>, fact_ledger array<{FACT}>, cross_turn_checks string, holistic_score string, factory_models map<string,string>"
SEED_FIELDS = ("dataset", "first_query", "category", "domain", "lang", "is_haystack")
_KEEP = {"ignoreNullFields": "false"}


def to_rows(records: DataFrame) -> DataFrame:
    """Stored form: scalars as columns, nested parts as JSON text with their nulls."""
    return records.select(
        "conversation_id", *(F.col(f"source_seed.{f}").alias(f) for f in SEED_FIELDS), "mode", "length",
        *(F.to_json(c, _KEEP).alias(c) for c in ("turns", "fact_ledger")), "cross_turn_checks", "holistic_score", F.to_json("factory_models", _KEEP).alias("factory_models"),
    )


def from_rows(rows: DataFrame) -> DataFrame:
    """Records from their stored form; JSON that can't be read gives null parts."""
    return rows.select(
        "conversation_id", F.struct(*SEED_FIELDS).alias("source_seed"), "mode", F.col("length").cast("int").alias("length"),
        F.from_json("turns", f"array<{TURN}>").alias("turns"), F.from_json("fact_ledger", f"array<{FACT}>").alias("fact_ledger"), "cross_turn_checks", "holistic_score", F.from_json("factory_models", "map<string,string>").alias("factory_models"),
    )


def segment(turn: Column, kind: str) -> Column:
    """The text of the first segment of a kind; null without one."""
    return F.try_element_at(F.filter(turn["segments"], lambda s: s["segment_type"] == kind), F.lit(1))["text"]


def problem() -> Column:
    """The first thing wrong with a record; null if it is valid."""
    bad_turn = lambda f: F.exists("turns", f)
    kinds = lambda t: F.transform(F.coalesce(t["segments"], F.array()), lambda s: F.coalesce(s["segment_type"], F.lit("")))
    return (
        F.when(F.col("conversation_id").isNull() | F.col("source_seed").isNull() | F.col("turns").isNull() | F.col("fact_ledger").isNull(), "missing key")
        .when(F.greatest(*(F.col(f"source_seed.{f}").isNull().cast("int") for f in SEED_FIELDS)) == 1, "seed lacks a key")
        .when(~F.coalesce(F.col("mode").isin("reasoning", "instruct", "mixed"), F.lit(False)), "invalid mode")
        .when(F.coalesce(F.col("length"), F.lit(-1)) != F.size("turns"), "length differs from turns")
        .when(bad_turn(lambda t: t["turn_index"].isNull() | t["segments"].isNull() | t["reasoning_flag"].isNull()), "turn lacks a key")
        .when(bad_turn(lambda t: F.size(F.array_except(kinds(t), F.array(*map(F.lit, ("query", "reasoning", "answer"))))) > 0), "invalid segment type")
        .when(bad_turn(lambda t: ~F.array_contains(kinds(t), "query")), "turn without query")
        .when(bad_turn(lambda t: ~F.array_contains(kinds(t), "answer")), "turn without answer")
        .when((F.col("mode") == "instruct") & bad_turn(lambda t: F.array_contains(kinds(t), "reasoning")), "reasoning in instruct mode")
        .when(bad_turn(lambda t: t["constraint_spec"].isNotNull() & (t["constraint_spec"]["intent"].isNull() | t["constraint_spec"]["type"].isNull() | t["constraint_spec"]["verifier"].isNull() | t["constraint_spec"]["scope"].isNull() | t["constraint_spec"]["lang"].isNull())), "rule lacks a key")
    )


def conflicts(a: Column, b: Column) -> Column:
    one = lambda g: a.isin(*g) & b.isin(*g)
    return F.coalesce((a != b) & (one(P.FORM_CONSTRAINTS) | one(P.START_CONSTRAINTS)), F.lit(False))


def active_rules(turns: DataFrame) -> DataFrame:
    """(c, turn_index, active): types of the rules in force after each turn.

    turns: c, turn_index, type, scope.  A lasting rule (standing or cumulative) puts out
    those it conflicts with and is added.  The fold runs inside the row, over one
    conversation's turns.
    """
    one = turns.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("turn_index", "type", "scope"))).alias("t"))
    empty = F.array().cast("array<string>")

    def fold(prefix: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            lasting = F.coalesce(t["scope"].isin("standing", "cumulative"), F.lit(False)) & t["type"].isNotNull()
            return F.when(lasting, F.concat(F.filter(acc, lambda a: ~conflicts(a, t["type"])), F.array(t["type"]))).otherwise(acc)

        return F.aggregate(prefix, empty, step)

    return one.select("c", F.explode(F.transform("t", lambda t, i: F.struct(t["turn_index"].alias("turn_index"), fold(F.slice("t", F.lit(1), i + 1)).alias("active")))).alias("x")).select("c", "x.turn_index", "x.active")


def facts(events: DataFrame) -> DataFrame:
    """(c, fact_id, value, planted_turn, stale, n_updates) from (c, fact_id, turn, value): latest value and those before it."""
    g = events.filter("fact_id IS NOT NULL").groupBy("c", "fact_id").agg(F.sort_array(F.collect_list(F.struct("turn", "value"))).alias("h"))
    return g.select("c", "fact_id", F.element_at("h", -1)["value"].alias("value"), F.element_at("h", 1)["turn"].alias("planted_turn"), F.transform(F.slice("h", F.lit(1), F.size("h") - 1), lambda x: x["value"]).alias("stale"), (F.size("h") - 1).alias("n_updates"))


def recallable(facts_: DataFrame, turns: DataFrame, distance: int) -> DataFrame:
    """(c, turn_index, fact_id): the oldest fact planted at least `distance` turns before each turn."""
    j = turns.select("c", "turn_index").join(facts_.select("c", "fact_id", "planted_turn"), "c").filter(F.col("turn_index") - F.col("planted_turn") >= distance)
    return j.groupBy("c", "turn_index").agg(F.min_by("fact_id", F.struct("planted_turn", "fact_id")).alias("fact_id"))


def updatable(facts_: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, turn_index, fact_id): the newest fact planted before each turn."""
    j = turns.select("c", "turn_index").join(facts_.select("c", "fact_id", "planted_turn"), "c").filter(F.col("planted_turn") < F.col("turn_index"))
    return j.groupBy("c", "turn_index").agg(F.max_by("fact_id", F.struct("planted_turn", "fact_id")).alias("fact_id"))


def replace_names(df: DataFrame, key: str, names: list[str], new: list[str], skip: float = 0.0, seed: int = 42) -> DataFrame:
    """Known names replaced in query and answer alike, in order, by a new name drawn from seed, key and name.

    Later names see earlier replacements.  A name is skipped with probability `skip`.
    """
    pool = F.array(*map(F.lit, new))
    q, a = F.col("query"), F.col("answer")
    for n in names:
        go = X.uniform(seed, F.col(key), F.lit(n), F.lit("skip")) >= skip
        to = F.element_at(pool, F.floor(X.uniform(seed, F.col(key), F.lit(n)) * len(new)).cast("int") + 1)
        q, a = (F.when(go, F.replace(c, F.lit(n), to)).otherwise(c) for c in (q, a))
    return df.withColumns({"query": q, "answer": a})


def leaks_before(t: DataFrame, value: str) -> DataFrame:
    """(c, turn_index, known): did the value of a column stand in any earlier query or answer of the conversation."""
    text = F.array_join(F.collect_list(F.concat_ws("\n", "query", "answer")).over(Window.partitionBy("c").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)), "\n")
    return t.select("c", "turn_index", F.contains(X.normalised(text), X.normalised(F.col(value))).alias("known"))
