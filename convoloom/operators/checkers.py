"""Constraint checkers: a registry of Column builders by type and language.

`check(type, lang, answer, params)` is one expression.  An unknown type fails, as
does a type that is only registered by name for a language.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import patterns as P
from ..functions import text as T

Builder = Callable[[Column, dict], Column]


@dataclass(frozen=True)
class Checker:
    name: str
    lang: str
    build: Builder | None


REGISTRY: dict[tuple[str, str], Checker] = {}


def register(name: str, build: Builder | None, lang: str = "*") -> None:
    """build=None stands for a known type that is not implemented; it always fails."""
    REGISTRY[name, lang] = Checker(name, lang, build)


def registered(lang: str = "*") -> list[str]:
    return sorted({n for n, x in REGISTRY if x in (lang, "*")})


def check(name: str, answer: Column, params: dict | None = None, lang: str = "en") -> Column:
    """BOOLEAN: does the answer satisfy the constraint; null answers count as empty."""
    c = REGISTRY.get((name, lang)) or REGISTRY.get((name, "*"))
    if c is None or c.build is None:
        return F.lit(False)
    return F.coalesce(c.build(T.text(answer), params or {}), F.lit(False))


def verify(name: str, answer: Column, params: dict | None = None, lang: str = "en", verifier: str = "programmatic") -> Column:
    """Constraints that are not checked by program pass as skipped."""
    return check(name, answer, params, lang) if verifier in ("programmatic", "hybrid") else F.lit(True)


def conflict(a: str, b: str) -> bool:
    """Two types that can't hold for one answer; a type never conflicts with itself."""
    return a != b and any(a in g and b in g for g in (P.FORM_CONSTRAINTS, P.START_CONSTRAINTS))


def _within(n: Column, least, most) -> Column:
    ok = F.lit(True)
    if most is not None:
        ok = ok & (n <= most)
    if least is not None:
        ok = ok & (n >= least)
    return ok


def _unfenced(a: Column) -> Column:
    t = F.regexp_replace(a, r"^\s+|\s+$", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?\s*```[^\n]*$", "")).otherwise(t)


def _json(a: Column, p: dict) -> Column:
    t = F.regexp_replace(_unfenced(a), r"^\s+|\s+$", "")
    ok = T.is_json(t)
    top = {"object": "{", "array": "["}.get(p.get("top_type", ""))
    return ok & t.startswith(top) if top else ok


def _table(a: Column, p: dict) -> Column:
    ls = T.lines(a)
    row = F.exists(ls, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    return row & F.exists(ls, lambda x: x.rlike(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"))


def _bullets(a: Column, p: dict) -> Column:
    n = T.bullets(a)
    if p.get("n") is not None:
        return (n == p["n"]) & _within(n, p.get("min"), p.get("max"))
    if p.get("min") is None and p.get("max") is None:
        return n > 0
    return _within(n, p.get("min"), p.get("max"))


def _present(a: Column, value: str, match: str) -> Column:
    want, have = T.normalised(F.lit(str(value))), T.normalised(a)
    if match == "fuzzy":
        x, y = F.array_distinct(F.split(want, " ")), F.array_distinct(F.split(have, " "))
        return (want != "") & (F.size(F.array_intersect(x, y)) / F.size(x) >= 0.5)
    return (want != "") & F.contains(have, want)


def _recall(a: Column, p: dict) -> Column:
    if p.get("value") is None:
        return F.lit(False)
    return ~T.has(a, P.RECALL_REFUSAL) & _present(a, p["value"], p.get("match", "exact"))


def _update(a: Column, p: dict) -> Column:
    ok = _recall(a, p)
    if p.get("match", "exact") == "exact":
        for old in p.get("stale_values") or []:
            ok = ok & ~_present(a, old, "exact")
    return ok


def _initial(s: Column) -> Column:
    return F.lower(F.regexp_extract(s, r"(\p{L})", 1))


def _first_letter(a: Column, p: dict) -> Column:
    letter = str(p.get("letter", "")).lower()
    s = T.sentences(a)
    return (F.size(s) > 0) & F.forall(s, lambda x: _initial(x) == letter) if letter else F.lit(False)


def _alphabetical(a: Column, p: dict) -> Column:
    def ordered(i: Column) -> Column:
        n = F.greatest(F.size(i) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(i, F.lit(1), n), F.slice(i, F.lit(2), n), lambda x, y: (x < y) if p.get("strict") else (x <= y))
        return (F.size(i) >= 2) & F.forall(i, lambda x: x != "") & F.forall(pairs, lambda x: x)

    return T.let(F.transform(T.sentences(a), _initial), ordered)


def _words_per_sentence(a: Column, p: dict) -> Column:
    s = T.sentences(a)
    return (F.size(s) > 0) & F.forall(s, lambda x: T.word_count(x) <= p["max_words"]) if p.get("max_words") is not None else F.lit(False)


def _forbidden(a: Column, p: dict) -> Column:
    token = str(p.get("token", "")).strip()
    return ~a.rlike(r"(?iu)\b\Q" + token.replace("\\E", "") + r"\E\b") if token else F.lit(False)


@F.pandas_udf(K.BooleanType())
def _parses_yaml(text: pd.Series) -> pd.Series:
    import yaml  # without a parser on the executors the query fails; silence would look like bad answers

    def one(t: str) -> bool:
        try:
            x = yaml.safe_load(t)
        except (yaml.YAMLError, ValueError, RecursionError):
            return False
        return x is not None and not isinstance(x, str)

    return text.map(one)


def _yaml(a: Column, p: dict) -> Column:
    """A document that is more than a bare string; an error where no YAML parser is installed on the executors."""
    return _parses_yaml(_unfenced(a))


register("json_valid", _json)
register("yaml_valid", _yaml)
register("markdown_table", _table)
register("markdown_format", lambda a, p: a.rlike(r"(?m)^\s*#{1,6}\s+\S|^\s*(?:[-*+]|\d+[.)])\s+\S|\*\*[^*\n]+\*\*|__[^_\n]+__"))
register("length_tokens", lambda a, p: _within(T.word_count(a), p.get("min_words"), p.get("max_words")))
register("n_bullets", _bullets)
register("n_lines", lambda a, p: T.nonempty_lines(a) == p["n"] if p.get("n") is not None else F.lit(True))
register("fact_recall", _recall)
register("fact_update", _update)
register("first_letter", _first_letter, "en")
register("max_words_per_sentence", _words_per_sentence, "en")
register("forbidden_token", _forbidden, "en")
register("no_gendered_pronouns", lambda a, p: ~F.arrays_overlap(F.regexp_extract_all(F.lower(a), F.lit(r"[\p{L}\p{N}_']+"), 0), F.array(*map(F.lit, P.GENDERED_PRONOUNS))), "en")
register("alphabetical_sentence_starts", _alphabetical, "en")
register("limerick_structure", lambda a, p: T.nonempty_lines(a) == 5, "en")
for _lang in ("pl", "de", "fr", "es"):
    for _name in ("first_letter", "max_words_per_sentence", "forbidden_token", "no_gendered_pronouns", "alphabetical_sentence_starts", "limerick_structure"):
        register(_name, None, _lang)
