"""Preference turns (query, accepted, rejected) and completed conversations, all inside the row.

A side is STRUCT<think, answer>.  A null array counts as nothing delivered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

LEAST = 0.8  # share of the wanted turns that a conversation generated at once must bring


def fitted(turns: Column, n: Column | int, blank: Column, least: float = LEAST) -> Column:
    """The array brought to n turns: longer ones are cut, shorter ones filled with blanks; null below the least share."""
    n = n if isinstance(n, Column) else F.lit(n)
    have = F.coalesce(F.size(turns), F.lit(0))
    fill = F.array_repeat(blank, F.greatest(n - have, F.lit(0)))
    return F.when(turns.isNotNull() & (have >= F.ceil(n * least)) & (have > 0), F.slice(F.concat(turns, fill), F.lit(1), n))


def blank_turn() -> Column:
    return F.struct(*(F.lit("").alias(k) for k in ("query", "think", "answer")))


def blank_preference() -> Column:
    side = F.struct(F.lit("").alias("think"), F.lit("").alias("answer"))
    return F.struct(F.lit("").alias("query"), side.alias("accepted"), side.alias("rejected"))


def accepted_history(turns: Column) -> Column:
    """Interactions of the accepted sides: what later turns may see."""
    return F.transform(turns, lambda t: F.struct(t["query"].alias("query"), t["accepted"]["think"].alias("think"), t["accepted"]["answer"].alias("answer")))


def pairs(turns: Column) -> Column:
    """array<struct<position, prompt, chosen, rejected>>: each turn with the accepted conversation before it as its prompt."""

    def one(t: Column, i: Column) -> Column:
        before = F.transform(F.slice(turns, F.lit(1), i), lambda x: F.concat(F.lit("User: "), T.text(x["query"]), F.lit("\nAssistant: "), T.text(x["accepted"]["answer"])))
        prompt = F.array_join(F.concat(before, F.array(F.concat(F.lit("User: "), T.text(t["query"])))), "\n")
        return F.struct(i.alias("position"), prompt.alias("prompt"), T.text(t["accepted"]["answer"]).alias("chosen"), T.text(t["rejected"]["answer"]).alias("rejected"))

    return F.transform(turns, one)


def same_sides(turns: Column) -> Column:
    """Positions whose sides are the same text: such turns prefer nothing."""
    at = F.transform(turns, lambda t, i: F.when(F.trim(T.text(t["accepted"]["answer"])) == F.trim(T.text(t["rejected"]["answer"])), i))
    return F.array_compact(at)


def with_thinks(interactions: Column, thinks: Column) -> Column:
    """Interactions with their thinks filled in order; null unless there is one for each."""
    filled = F.zip_with(interactions, thinks, lambda x, t: F.struct(x["query"].alias("query"), t.alias("think"), x["answer"].alias("answer")))
    return F.when(F.size(interactions) == F.size(thinks), filled)


def one_think(interactions: Column, position: Column, think: Column) -> Column:
    """Interactions with the think at one position replaced."""
    return F.transform(interactions, lambda x, i: F.struct(x["query"].alias("query"), F.when(i == position, think).otherwise(x["think"]).alias("think"), x["answer"].alias("answer")))


def with_side(interactions: Column, other: Column, target: str = "rejected") -> Column:
    """Preference turns from interactions and as many answers of the other side; null unless the counts agree.

    target names the side that `other` (array<struct<think, answer>>) becomes; the interactions' own answers are the opposite one.
    """
    if target not in ("rejected", "accepted"):
        raise ValueError(f"unknown side {target!r}")

    def one(x: Column, o: Column) -> Column:
        own, new = (F.struct(T.text(v["think"]).alias("think"), T.text(v["answer"]).alias("answer")) for v in (x, o))
        yes, no = (own, new) if target == "rejected" else (new, own)
        return F.struct(x["query"].alias("query"), yes.alias("accepted"), no.alias("rejected"))

    return F.when(F.size(interactions) == F.size(other), F.zip_with(interactions, other, one))
