"""Synthetic conversations: requests, generated items, completions, plans and whole conversations behind a client.

A client is any picklable object with `generate(prompt, seed) -> str`, or with
`stream(prompt, seed)`, an iterator of text parts.  Calls happen on the executors inside
mapInPandas; everything before and after a call is DataFrame work.  Seeds of calls depend on
the row's key, the step and the attempt, so results don't depend on the partitioning.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import patterns as P
from ..functions import taxonomy as K
from ..functions import text as T
from ..session import cut
from . import conversations as V
from . import order, preferences
from .crossturn import first_failure


class MockWriter:
    """Deterministic stand-in for a model: what it writes depends on the form that the prompt asks for, on the prompt and on the seed.

    Forms are named in the prompt as `FORM: items 3`, `pairs`, `interactions`, `preferences`, `thinks`, `user` or `answer`.
    """

    WORDS = "harbour boat ledger lantern market bridge garden winter summer letter number city story answer question reason".split()

    def _text(self, d: bytes, i: int, n: int = 9) -> str:
        w = [self.WORDS[d[(i * 7 + k) % len(d)] % len(self.WORDS)] for k in range(n)]
        return " ".join(w).capitalize() + "."

    def generate(self, prompt: str, seed: int) -> str:
        d = hashlib.sha512(f"{seed}:{prompt}".encode()).digest()
        form, _, n = prompt.rpartition("FORM: ")[2].split("\n")[0].strip().partition(" ")
        n = int(n or 1)
        t = self._text
        if form == "items":
            return repr([(t(d, i), t(d, i + 1), [(t(d, i + k), t(d, i + k + 3)) for k in range(2)]) for i in range(n)])[:-1]  # the last bracket is lost
        if form == "pairs":
            return "<think>" + "x" * 14 + repr([(t(d, i), t(d, i + 1)) for i in range(n)])
        if form == "interactions":
            return "```python\n" + repr([{"query": t(d, i), "think": t(d, i + 1), "answer": t(d, i + 2)} for i in range(n)]) + "\n```"
        if form == "preferences":
            return repr([{"query": t(d, i), "accepted": {"think": t(d, i + 1), "answer": t(d, i + 2)}, "rejected": {"think": t(d, i + 3), "answer": t(d, i + 4)}} for i in range(n)])
        if form == "thinks":
            return repr([t(d, i) for i in range(n)])
        if form == "user":
            return "Tell me more about the " + t(d, 1, 4)
        return f"<think>{t(d, 2)}</think>{t(d, 3, 12)}"

    def stream(self, prompt: str, seed: int) -> Iterator[str]:
        text = self.generate(prompt, seed)
        yield from (text[i : i + 16] for i in range(0, len(text), 16))


def seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:4], "big")


def answered(rows: DataFrame, key: str, client, step: int = 0, seed: int = 42, streamed: bool = False, seconds: float = float("inf")) -> DataFrame:
    """rows (key, prompt, ...) with `response` and `error`: what the client wrote, or an empty text and what it raised.

    A streamed response is cut when its time is over; what came until then is the response.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "response string", "error string"])

    def call(prompt: str, s: int) -> str:
        if not streamed:
            return client.generate(prompt, s)
        began, parts = time.monotonic(), []
        for part in client.stream(prompt, s):
            parts.append(part)
            if time.monotonic() - began > seconds:
                break
        return "".join(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for k, prompt in zip(pdf[key], pdf["prompt"], strict=True):
                try:
                    got.append((call(prompt or "", seed_of(seed, k, step)), None))
                except Exception as e:  # noqa: BLE001  whatever a client raises is data here
                    got.append(("", f"{type(e).__name__}: {e}"))
            yield pdf.assign(response=[x for x, _ in got], error=[e for _, e in got])

    return rows.mapInPandas(run, schema)


# ---------------------------------------------------------------- items in batches


def drawn(pool: list[str], n: int, seed: int, *parts: Column) -> Column:
    """n entries of the pool, with replacement; which ones depends on the seed and the parts."""
    entries = F.array(*map(F.lit, pool))
    pick = lambda i: F.element_at(entries, F.floor(T.uniform(seed, *parts, i) * len(pool)).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pick) if n > 0 and pool else F.array().cast("array<string>")


def requests(spark: SparkSession, iterations: int, template: str, topics: list[str] | None = None, n_topics: int = 0, seed: int = 42) -> DataFrame:
    """(iteration, prompt): the template with `{topics}` replaced by a list of drawn topics."""
    t = F.array_join(F.transform(drawn(topics or [], n_topics, seed, F.col("iteration")), lambda x: F.concat(F.lit("- "), x)), "\n")
    return spark.range(iterations).select(F.col("id").alias("iteration")).withColumn("prompt", F.replace(F.lit(template), F.lit("{topics}"), t))


def until(rows: DataFrame, n: Column, most: int | None, inclusive: bool = False) -> DataFrame:
    """The iterations that a run makes which stops once it has more than `most` items (`inclusive`: that many); None never stops."""
    counted = rows.withColumn("_n", n)
    if most is None:
        return counted.drop("_n")
    r = order.running_total(counted, "iteration", "_n", "_before")
    return r.filter((F.col("_before") < most) if inclusive else (F.col("_before") <= most)).drop("_n", "_before")


def generated_items(responses: DataFrame, max_items: int | None = None) -> DataFrame:
    """(iteration, position, query, answer, interactions) of all responses that hold a list of items, until there are more than `max_items`."""
    r = responses.select("iteration", parsing.parse_items("response").alias("items"))
    kept = until(r, F.coalesce(F.size("items"), F.lit(0)), max_items)
    return kept.select("iteration", F.posexplode("items").alias("position", "i")).select("iteration", "position", "i.query", "i.answer", "i.interactions")


def failed_iterations(responses: DataFrame) -> DataFrame:
    """One row: iterations, and those whose response held no list of items."""
    return responses.select(parsing.parse_items("response").isNull().cast("long").alias("f")).agg(F.count("*").alias("n_iterations"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_failed"))


def generated_conversations(responses: DataFrame, turns: int, max_items: int | None = None) -> DataFrame:
    """(iteration, interactions): conversations written at once, fitted to the wanted turns; others are left out."""
    r = responses.select("iteration", preferences.fitted(F.transform(parsing.parse_interactions("response"), _text_turn), turns, preferences.blank_turn()).alias("interactions"))
    return until(r, F.col("interactions").isNotNull().cast("int"), max_items, inclusive=True).filter("interactions IS NOT NULL")


def generated_preferences(responses: DataFrame, turns: int, max_items: int | None = None) -> DataFrame:
    """(iteration, interactions) of preference turns, in the same way."""
    r = responses.select("iteration", preferences.fitted(parsing.parse_preferences("response"), turns, preferences.blank_preference()).alias("interactions"))
    return until(r, F.col("interactions").isNotNull().cast("int"), max_items, inclusive=True).filter("interactions IS NOT NULL")


def _text_turn(x: Column) -> Column:
    return F.struct(*(T.text(x[k]).alias(k) for k in ("query", "think", "answer")))


# ---------------------------------------------------------------- completions


def completed(rows: DataFrame, key: str, client, seed: int = 42) -> DataFrame:
    """(key, interactions): thinks asked for all turns of a conversation at once; null where their number differs."""
    n = F.size("interactions").cast("string")
    asked = rows.filter(F.size("interactions") > 0).select(key, "interactions", F.concat(V.plain_transcript(F.col("interactions")), F.lit("\nFORM: thinks "), n).alias("prompt"))
    r = answered(asked, key, client, seed=seed)
    return r.select(key, preferences.with_thinks(F.col("interactions"), parsing.parse_strings("response")).alias("interactions"))


def completed_turns(rows: DataFrame, key: str, client, seed: int = 42) -> DataFrame:
    """(key, interactions): a think asked for each turn by itself, with the turns before it; a turn without one keeps its own.

    One call a turn; the calls of a conversation are independent, so they are spread over the cluster.
    """
    x = rows.filter(F.size("interactions") > 0).select(key, "interactions", F.posexplode("interactions").alias("_at", "_x"))
    upto = V.plain_transcript(F.slice("interactions", F.lit(1), F.col("_at") + 1))
    asked = x.select(F.concat_ws(":", F.col(key).cast("string"), "_at").alias("_call"), key, "_at", "_x", F.concat(upto, F.lit("\nFORM: thinks 1")).alias("prompt"))
    r = answered(asked, "_call", client, seed=seed)
    think = F.coalesce(F.try_element_at(parsing.parse_strings("response"), F.lit(1)), F.col("_x.think"))
    turn = F.struct("_at", F.struct(F.col("_x.query").alias("query"), think.alias("think"), F.col("_x.answer").alias("answer")).alias("t"))
    return r.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda v: v["t"]).alias("interactions"))


def completed_preferences(rows: DataFrame, key: str, client, target: str = "rejected", seed: int = 42) -> DataFrame:
    """(key, interactions): preference turns from conversations, the other side of all turns asked at once; null where the counts differ."""
    n = F.size("interactions").cast("string")
    asked = rows.filter(F.size("interactions") > 0).select(key, "interactions", F.concat(F.lit(f"Write the {target} side.\n"), V.plain_transcript(F.col("interactions")), F.lit("\nFORM: interactions "), n).alias("prompt"))
    r = answered(asked, key, client, seed=seed)
    other = F.transform(parsing.parse_interactions("response"), lambda x: F.struct(x["think"].alias("think"), x["answer"].alias("answer")))
    return r.select(key, preferences.with_side(F.col("interactions"), other, target).alias("interactions"))


# ---------------------------------------------------------------- plans


def composition(n: Column, ratios: dict[str, float] | None = None, most_transform: float = K.MOST_TRANSFORM) -> Column:
    """struct<explore, transform, memory>: how many of n follow-ups are of each kind.

    Transformations are capped, at least one follow-up explores where there is more than one, and exploring takes what is left.
    """
    r = ratios or K.RATIOS
    transform = F.least(F.bround(n * r["transform"]).cast("int"), F.floor(n * min(most_transform, K.MOST_TRANSFORM)).cast("int"))
    wanted = F.bround(n * r["memory"]).cast("int")
    memory = F.when((transform + wanted > n - 1) & (n >= 2), F.greatest(F.lit(0), n - 1 - transform)).otherwise(wanted)
    return F.struct(F.greatest(F.lit(0), n - transform - memory).cast("int").alias("explore"), transform.alias("transform"), memory.cast("int").alias("memory"))


def plan(seeds: DataFrame, key: str, length: str, sensitive: str | None = None, distance: int = 4, seed: int = 42, ratios: dict[str, float] | None = None) -> DataFrame:
    """(key, turn_index, category, memory_kind): the kinds of the follow-ups of conversations of `length` turns.

    The kinds are shuffled by hash, and an exploring one is moved to the front.  Memory turns recall
    content; if a later one lies `distance` turns or more behind the first, the first plants a fact and
    that one recalls it, and half of the time the next such one updates it.  Sensitive seeds plant nothing.
    """
    n = F.greatest(F.coalesce(F.col(length), F.lit(0)) - 1, F.lit(0))
    x = seeds.select(F.col(key).alias("k"), n.alias("n"), (F.coalesce(F.col(sensitive), F.lit(False)) if sensitive else F.lit(False)).alias("s")).filter("n > 0").withColumn("c", composition(F.col("n"), ratios))
    kinds = F.concat(*(F.array_repeat(F.lit(c), F.col(f"c.{c}")) for c in K.CATEGORIES))
    # The shuffle: every slot gets a hash of its own, and the kinds follow the hashes' order.
    mixed = F.transform(F.array_sort(F.transform(kinds, lambda v, i: F.struct(T.uniform(seed, F.col("k"), i).alias("u"), v.alias("v")))), lambda z: z["v"])
    x = x.withColumn("m", mixed).withColumn("f", F.array_position("m", "explore").cast("int"))
    front = F.when(F.col("f") > 1, F.transform("m", lambda v, i: F.when(i == 0, "explore").when(i == F.col("f") - 1, F.col("m")[0]).otherwise(v))).otherwise(F.col("m"))
    x = x.withColumn("m", front)
    memory = F.filter(F.transform("m", lambda v, i: F.when(v == "memory", i + 1)), lambda i: i.isNotNull())
    x = x.withColumn("at", memory).withColumn("far", F.filter("at", lambda i: i - F.element_at("at", 1) >= distance)).withColumn("ok", ~F.col("s") & (F.size("far") > 0))
    more = (F.size("far") > 1) & (T.uniform(seed, F.col("k"), F.lit("update")) < 0.5)
    kind = lambda i: F.when(F.col("ok") & (i == F.element_at("at", 1)), "plant").when(F.col("ok") & (i == F.try_element_at("far", F.lit(1))), "recall").when(F.col("ok") & more & (i == F.try_element_at("far", F.lit(2))), "update").otherwise("content")
    # Exploded as an expression: of a column that is an array Spark infers a filter, and would evaluate all of this twice, the second time below the scan.
    rows = F.transform("m", lambda v, i: F.struct((i + 1).alias("turn_index"), v.alias("category"), F.when(v == "memory", kind(i + 1)).alias("memory_kind")))
    return x.select(F.col("k").alias(key), F.explode(rows).alias("t")).select(key, "t.turn_index", "t.category", "t.memory_kind")


def allowed(category: Column, sensitive: Column | None = None) -> Column:
    """Intents of a follow-up's category, kept to the supportive ones for a sensitive seed; null permits all."""
    names = lambda c: F.array(*map(F.lit, c))
    own = F.coalesce(*(F.when(category == c, names(v)) for c, v in K.CATEGORIES.items()))
    if sensitive is None:
        return own
    both = F.when(own.isNull(), names(K.SENSITIVE)).otherwise(F.array_intersect(own, names(K.SENSITIVE)))
    return F.when(F.coalesce(sensitive, F.lit(False)), F.when(F.size(both) > 0, both)).otherwise(own)


def voices(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """rows (key, turn_index, ...) with a persona that differs from the turn's before and a verbosity.

    A walk over the personas: each turn moves on by a drawn number of places that is never none.
    """
    from pyspark.sql import Window

    steps = 1 + F.floor(T.uniform(seed, F.col(key), F.col("turn_index")) * (len(P.PERSONAS) - 1))
    at = F.sum(steps).over(Window.partitionBy(key).orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0))
    persona = F.element_at(F.array(*map(F.lit, P.PERSONAS)), (F.pmod(at, F.lit(len(P.PERSONAS))) + 1).cast("int"))
    word = F.element_at(F.array(*map(F.lit, P.VERBOSITIES)), F.floor(T.uniform(seed, F.col(key), F.col("turn_index"), F.lit("verbosity")) * len(P.VERBOSITIES)).cast("int") + 1)
    return rows.withColumns({"persona": persona, "verbosity": word})


# Invented pieces of personal facts that a user may mention; never accounts or payments.
ONSETS = ("Tam", "Rel", "Kor", "Min", "Sav", "Dor", "Lun", "Pes", "Vim", "Gal", "Hes", "Nor")
ENDINGS = ("ela", "ion", "ush", "ar", "ette", "im", "owa", "en")
LABELS = {"pet's name": "", "mentor's name": "", "home town": "burg", "childhood street": " Lane", "favourite author": " Senn", "project's name": "-1"}


def personal_facts(rows: DataFrame, key: str, n: int, pool: str | None = None, seed: int = 42) -> DataFrame:
    """(key, position, label, value, new_value, plant, update, recall): n facts a row and the sentences that plant, update and ask for them.

    The first ones come from the row's own pool (array<struct<label, value, new_value>>) where it has usable
    entries; the others are drawn, so that a fact's two values differ and neighbours have different labels.
    """
    k = F.col(key)
    u = lambda *p: T.uniform(seed, k, *p)
    pick = lambda names, x: F.element_at(F.array(*map(F.lit, names)), F.floor(x * len(names)).cast("int") + 1)
    turn = F.floor(u(F.lit("label")) * len(LABELS)).cast("int")
    label = lambda i: F.element_at(F.array(*map(F.lit, LABELS)), F.pmod(turn + i, F.lit(len(LABELS))) + 1)
    tail = lambda i: F.element_at(F.array(*map(F.lit, LABELS.values())), F.pmod(turn + i, F.lit(len(LABELS))) + 1)
    at = lambda i: F.floor(u(i, F.lit("onset")) * len(ONSETS)).cast("int")
    name = lambda i, shift: F.concat(F.element_at(F.array(*map(F.lit, ONSETS)), F.pmod(at(i) + shift, F.lit(len(ONSETS))) + 1), pick(ENDINGS, u(i, F.lit("ending"))), tail(i))
    drawn_ = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(label(i).alias("label"), name(i, 0).alias("value"), name(i, 1).alias("new_value")))
    all_ = drawn_
    if pool is not None:
        good = F.filter(F.coalesce(F.col(pool), F.array().cast("array<struct<label:string,value:string,new_value:string>>")), lambda f: (F.trim(T.text(f["label"])) != "") & (F.length(F.trim(T.text(f["value"]))) >= 2))
        own = F.transform(good, lambda f: F.struct(F.trim(f["label"]).alias("label"), F.trim(f["value"]).alias("value"), F.trim(T.text(f["new_value"])).alias("new_value")))
        all_ = F.slice(F.concat(own, drawn_), F.lit(1), F.lit(n))
    x = rows.select(k, F.posexplode(all_).alias("position", "f")).select(key, "position", "f.*")
    mine = F.concat(F.lit("my "), F.col("label"))
    return x.withColumns({"plant": F.concat(F.lit("By the way, "), mine, F.lit(" is "), F.col("value"), F.lit(".")), "update": F.concat(F.lit("Actually, "), mine, F.lit(" is now "), F.col("new_value"), F.lit(".")), "recall": F.concat(F.lit("What is "), mine, F.lit("?"))})


# ---------------------------------------------------------------- whole conversations


def converse(seeds: DataFrame, key: str, user, model, turns: int = 6, attempts: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(turn rows, statistics) of conversations that start with the seeds' queries.

    All conversations move on together, turn by turn: the user's message, then the answer, which is
    checked by the turn checks and asked again for the failing conversations only.  A conversation
    whose first answer never passes is dropped; a later turn keeps its last answer, marked as not passed.
    Turn rows: key, turn_index, query, reasoning, answer, category, memory_kind, regenerations, passed.
    Statistics: one row of sums.
    """
    follow = plan(seeds.withColumn("_len", F.lit(turns)), key, "_len", seed=seed)
    done: DataFrame | None = None
    history = seeds.select(F.col(key), F.array().cast("array<struct<query:string,think:string,answer:string>>").alias("h"))
    first = seeds.select(F.col(key), F.col("query"))
    for t in range(turns):
        if t == 0:
            asked = first.join(history, key).withColumns({"category": F.lit("seed"), "memory_kind": F.lit(None).cast("string")})
        else:
            todo = history.join(follow.filter(F.col("turn_index") == t).drop("turn_index"), key)
            said = answered(todo.withColumn("prompt", F.concat(V.plain_transcript(F.col("h")), F.lit("\nKind: "), F.col("category"), F.lit("\nFORM: user"))), key, user, 1000 * t, seed)
            bad = T.has(F.col("response"), P.ROLE_CONFUSION) | T.prompt_echo(F.col("response")) | ~F.col("response").rlike(r"\S")
            asked = said.withColumn("query", F.when(bad, F.concat(F.lit("Tell me more about this: "), F.element_at("h", -1)["query"])).otherwise(T.without_artifact(F.col("response")))).drop("prompt", "response", "error")
        asked = cut(asked)
        open_, good = asked, None
        for a in range(attempts):
            r = answered(open_.withColumn("prompt", F.concat(V.plain_transcript(F.col("h")), F.lit("\nUser: "), F.col("query"), F.lit("\nFORM: answer"))), key, model, 1000 * t + a + 1, seed)
            s = T.segment_response(F.lit(None).cast("string"), F.col("response"))
            r = r.withColumn("s", s).withColumns({"reasoning": T.sanitize(F.col("s.reasoning")), "answer": T.without_artifact(F.col("s.answer")), "intent": F.lit(None).cast("string"), "prior_answer": F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform("h", lambda x: x["answer"])), -1)})
            r = cut(r.withColumns({"regenerations": F.lit(a), "passed": first_failure().isNull() & F.col("s.well_formed")}).drop("s", "intent", "prior_answer", "prompt", "response", "error"))
            ok = r.filter("passed")
            good = ok if good is None else good.unionByName(ok)
            open_ = r.filter("NOT passed")
            if a + 1 == attempts:
                good = good if t == 0 else good.unionByName(open_)
            elif not open_.limit(1).count():
                break
            else:
                open_ = open_.drop("reasoning", "answer", "regenerations", "passed")
        good = cut(good)
        rows = good.select(key, F.lit(t).alias("turn_index"), "query", "reasoning", "answer", "category", "memory_kind", "regenerations", "passed")
        done = rows if done is None else done.unionByName(rows)
        history = good.select(key, F.concat("h", F.array(F.struct("query", F.col("reasoning").alias("think"), "answer"))).alias("h"))
    stats = done.agg(F.countDistinct(key).alias("n_conversations"), F.count("*").alias("n_turns"), F.coalesce(F.sum("regenerations"), F.lit(0)).alias("n_regenerations"), F.coalesce(F.sum((~F.col("passed")).cast("long")), F.lit(0)).alias("n_not_passed"), F.coalesce(F.sum((F.col("reasoning") == "").cast("long")), F.lit(0)).alias("n_without_reasoning"))
    started = seeds.agg(F.countDistinct(key).alias("n_seeds"))
    return done, started.crossJoin(stats).withColumn("n_dropped", F.col("n_seeds") - F.col("n_conversations"))  # one row each


def merged_stats(*parts: DataFrame) -> DataFrame:
    """One row: the sums of several runs' statistics."""
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return x.agg(*(F.sum(c).alias(c) for c in x.columns))


def stamped(records: DataFrame, dataset: str, models: dict[str, str]) -> DataFrame:
    """Records with the name of their data set and the models that made them."""
    pairs = [F.lit(v) for p in sorted(models.items()) for v in p]
    return records.withColumns({"dataset": F.lit(dataset), "factory_models": F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")})
