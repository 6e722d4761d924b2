"""Parsers of semi-structured model output, as Arrow-batched functions.

They need a scan that respects strings and escapes, which built-in expressions
can't do.  Model output is only ever parsed as JSON or as a Python literal; it is
never evaluated.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as T_

AXES = (
    "instruction_following", "coherence", "naturalness", "role_consistency", "recall_fidelity", "appropriateness", "reasoning_quality",
    "reasoning_answer_consistency", "sycophancy_resistance", "factual_grounding", "user_query_quality", "user_query_difficulty",
)
SCORES = ("memory_score", "instruction_score", "freshness_score", "overall_score")
JUDGMENT = T.StructType(
    [
        *(T.StructField(s, T.IntegerType()) for s in SCORES),
        T.StructField("confidence", T.StringType()),
        T.StructField("issues", T.ArrayType(T.StringType())),
        T.StructField("rationale", T.StructType([T.StructField(k, T.StringType()) for k in ("memory", "instruction", "freshness")])),
    ]
)
FLAG = T.StructType([T.StructField("turn_index", T.IntegerType()), T.StructField("dimension", T.StringType()), T.StructField("severity", T.IntegerType()), T.StructField("evidence", T.StringType())])
RUBRIC = T.StructType([*(T.StructField(a, T.IntegerType()) for a in AXES), T.StructField("flagged_turns", T.ArrayType(FLAG)), T.StructField("notes", T.StringType())])
INTERACTIONS = T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("query", "think", "answer")]))

_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def objects(text: str) -> list[str]:
    """Every balanced object of the text, by its first brace; braces in strings don't count.

    One pass with a stack of open braces, instead of one pass per brace.
    """
    stack: list[int] = []
    found: list[tuple[int, int]] = []
    for m in _TOKENS.finditer(text):
        c = m.group()
        if c == "{":
            stack.append(m.start())
        elif c == "}" and stack:
            found.append((stack.pop(), m.end()))
    return [text[a:b] for a, b in sorted(found)]


def first_object(text: str | None) -> dict | None:
    """The first balanced object that parses as JSON."""
    for s in objects(text or ""):
        try:
            x = json.loads(s)
        except ValueError:
            continue
        if isinstance(x, dict):
            return x
    return None


def valid_judgment(x: object) -> bool:
    """The judgment's schema: exactly its keys, four whole scores of 1 to 10, a known confidence, at most five issues, three rationale texts."""
    if not isinstance(x, dict) or set(x) != {*SCORES, "confidence", "issues", "rationale"}:
        return False
    if any(type(x[s]) is not int or not 1 <= x[s] <= 10 for s in SCORES):
        return False
    r = x["rationale"]
    return (
        x["confidence"] in ("low", "medium", "high")
        and isinstance(x["issues"], list)
        and len(x["issues"]) <= 5
        and all(isinstance(i, str) for i in x["issues"])
        and isinstance(r, dict)
        and set(r) == {"memory", "instruction", "freshness"}
        and all(isinstance(v, str) for v in r.values())
    )


def judgment(text: str | None) -> dict | None:
    """The first candidate that parses and fits the schema: the whole text, else its objects."""
    t = (text or "").strip()
    for s in dict.fromkeys([t, *objects(t)]):
        try:
            x = json.loads(s)
        except ValueError:
            continue
        if valid_judgment(x):
            return x
    return None


def _whole(x: object, default: int | None = None) -> int | None:
    try:
        return int(x)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def rubric(text: str | None) -> dict | None:
    """Axes rounded half to even and clamped to 1..10; null without any axis.  Booleans are no numbers."""
    x = first_object(text)
    if x is None:
        return None
    out: dict = {a: max(1, min(10, round(v))) for a in AXES if isinstance(v := x.get(a), int | float) and not isinstance(v, bool)}
    if not out:
        return None
    flags = []
    for f in x.get("flagged_turns") if isinstance(x.get("flagged_turns"), list) else []:
        if isinstance(f, dict) and (i := _whole(f.get("turn_index"))) is not None:
            flags.append({"turn_index": i, "dimension": str(f.get("dimension", "")).strip(), "severity": max(1, min(3, _whole(f.get("severity"), 1) or 1)), "evidence": str(f.get("evidence", ""))[:200]})
    return {**{a: out.get(a) for a in AXES}, "flagged_turns": flags, "notes": str(x.get("notes") or "")[:200]}


def literal(text: str | None) -> object:
    """A list or dict written as JSON or as a Python literal, perhaps fenced; a list cut off after an element is closed there."""
    t = re.sub(r"^\s*```[\w-]*\s*|\s*```\s*$", "", text or "").strip()
    tries = [t]
    if t.startswith("[") and "}" in t:
        tries.append(t[: t.rfind("}") + 1] + "]")
    for s in tries:
        for parse in (json.loads, ast.literal_eval):
            try:
                x = parse(s)
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                continue
            if isinstance(x, list | dict):
                return x
    return None


def interactions(text: str | None) -> list[dict] | None:
    """Interactions of a parsed list; entries that are no objects are left out."""
    x = literal(text)
    if isinstance(x, dict):
        x = x.get("interactions", [x])
    if not isinstance(x, list):
        return None
    return [{k: None if e.get(k) is None else str(e[k]) for k in ("query", "think", "answer")} for e in x if isinstance(e, dict)]


def _side(x: object) -> dict:
    x = x if isinstance(x, dict) else {}
    return {k: str(x.get(k, "")) for k in ("think", "answer")}


def preferences(text: str | None) -> list[dict] | None:
    """Preference turns of a parsed list or single object; an entry without query, accepted and rejected is left out."""
    x = literal(text)
    if isinstance(x, dict):
        x = [x]
    if not isinstance(x, list):
        return None
    return [{"query": str(e["query"]), "accepted": _side(e["accepted"]), "rejected": _side(e["rejected"])} for e in x if isinstance(e, dict) and {"query", "accepted", "rejected"} <= set(e)]


def strings(text: str | None) -> list[str] | None:
    """A parsed list of texts; an object stands for its think or answer, other entries for themselves as text."""
    x = literal(text)
    if not isinstance(x, list):
        return None
    return [str(e.get("think", e.get("answer", ""))) if isinstance(e, dict) else str(e) for e in x]


THINK_LEAD = 21  # characters before the list where a model thinks first


def items(text: str | None) -> list[dict] | None:
    """Generated items: tuples (query, answer) or (query, answer, [(query, answer), ...]); None if the text holds no such list.

    Missing brackets at either end are added; an item of another form spoils the whole list.
    """
    if text is None:
        return None
    t = text[THINK_LEAD:] if "<think>" in text else text
    t = t if t.rstrip().endswith("]") else t.rstrip() + "]"
    t = t if t.lstrip().startswith("[") else "[" + t.lstrip()
    try:
        x = ast.literal_eval(t.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None
    out = []
    for e in x if isinstance(x, list) else [None]:
        if not isinstance(e, tuple | list) or len(e) not in (2, 3):
            return None
        follow = list(e[2]) if len(e) == 3 else []
        if not all(isinstance(f, tuple | list) and len(f) == 2 for f in follow):
            return None
        out.append({"query": str(e[0]), "answer": str(e[1]), "interactions": [{"query": str(q), "answer": str(a)} for q, a in follow]})
    return out


def bleu4(reference: str, candidate: str) -> float:
    """BLEU over character n-grams up to four, equal weights, no smoothing: 0 if any order has no match."""
    import math
    from collections import Counter

    if len(candidate) < 4:
        return 0.0
    total = 0.0
    for n in range(1, 5):
        c = Counter(candidate[i : i + n] for i in range(len(candidate) - n + 1))
        r = Counter(reference[i : i + n] for i in range(len(reference) - n + 1))
        hit = sum(min(v, r[g]) for g, v in c.items())
        if not hit:
            return 0.0
        total += math.log(hit / sum(c.values())) / 4
    short = min(0.0, 1 - len(reference) / len(candidate))
    return math.exp(short + total)


def keeps_topics(query: str | None, answer: str | None, follow: list[dict] | None, limit: float = 0.45) -> bool:
    """The last interaction returns to the first topic, and none between belongs to it.

    Fewer than two interactions have no middle and fail.
    """
    if follow is None or len(follow) < 2:
        return False
    show = lambda q, a: f"[Q] {(q or '').strip()} [A] {(a or '').strip()}"
    first, last = show(query, answer), show(follow[-1]["query"], follow[-1]["answer"])
    middle = [show(x["query"], x["answer"]) for x in follow[:-1]]
    ends = (bleu4(last, first) + bleu4(first, last)) / 2
    near = [bleu4(first, m) for m in middle], [bleu4(last, m) for m in middle]
    means = [sum(v) / len(v) for v in near]
    return all(ends > m and m <= limit for m in means) and max(max(near[0]), max(near[1])) <= ends


@F.pandas_udf(JUDGMENT)
def parse_judgment(text: pd.Series) -> pd.DataFrame:
    rows = [judgment(t) or {} for t in text]
    return pd.DataFrame({f.name: [r.get(f.name) for r in rows] for f in JUDGMENT})


@F.pandas_udf(T.IntegerType())
def count_objects(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(objects(t or "")))


@F.pandas_udf(RUBRIC)
def parse_rubric(text: pd.Series) -> pd.DataFrame:
    rows = [rubric(t) or {} for t in text]
    return pd.DataFrame({f.name: [r.get(f.name) for r in rows] for f in RUBRIC})


@F.pandas_udf(INTERACTIONS)
def parse_interactions(text: pd.Series) -> pd.Series:
    return text.map(interactions)


@F.pandas_udf(T.BooleanType())
def topic_filter(query: pd.Series, answer: pd.Series, follow: pd.Series) -> pd.Series:
    return pd.Series([keeps_topics(q, a, None if f is None else list(f)) for q, a, f in zip(query, answer, follow, strict=True)])


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SIDE = _texts("think", "answer")
PREFERENCES = T.ArrayType(T.StructType([T.StructField("query", T.StringType()), T.StructField("accepted", SIDE), T.StructField("rejected", SIDE)]))
ITEMS = T.ArrayType(T.StructType([*_texts("query", "answer").fields, T.StructField("interactions", T.ArrayType(_texts("query", "answer")))]))


@F.pandas_udf(PREFERENCES)
def parse_preferences(text: pd.Series) -> pd.Series:
    return text.map(preferences)


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_strings(text: pd.Series) -> pd.Series:
    return text.map(strings)


@F.pandas_udf(ITEMS)
def parse_items(text: pd.Series) -> pd.Series:
    return text.map(items)


def greedy_object(c: Column) -> Column:
    """The text from the first brace to the last, if it is a JSON object; else null."""
    s = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(T_.is_json(s), s)


def response_metadata(c: Column) -> Column:
    """struct<finish_reason, prompt_tokens, completion_tokens, total_tokens, reasoning_tokens> of a chat response as JSON; what is missing is null."""
    of = lambda p: F.get_json_object(c, p)
    number = lambda n, p: F.try_to_number(of(p), F.lit("999999999999")).cast("long").alias(n)
    names = {n: f"$.usage.{n}" for n in ("prompt_tokens", "completion_tokens", "total_tokens")} | {"reasoning_tokens": "$.usage.completion_tokens_details.reasoning_tokens"}
    return F.struct(of("$.choices[0].finish_reason").alias("finish_reason"), *(number(n, p) for n, p in names.items()))


def response_content(c: Column) -> Column:
    """The text of a chat response: its content, the text parts of a content list, or a reasoning field that looks like an object; else empty."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    at = "$.choices[0].message"
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(F.try_variant_get(v, f"{at}.content", "variant"))
    parts = F.from_json(F.get_json_object(c, f"{at}.content"), "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    field = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"{at}.{n}", "variant")) == "STRING", strip(F.get_json_object(c, f"{at}.{n}")))
    like = lambda x: F.when(x.startswith("{") & x.endswith("}"), x)
    return F.when(kind == "STRING", strip(F.get_json_object(c, f"{at}.content"))).when(kind.startswith("ARRAY"), strip(F.coalesce(listed, F.lit("")))).otherwise(F.coalesce(like(field("reasoning_content")), like(field("reasoning")), F.lit("")))


FACTS = "array<struct<label:string,value:string,new_value:string>>"


def directive(reply: Column, query: Column) -> Column:
    """struct<domain, topic, action, sensitivity, facts> of a curator's reply; null if the reply holds no object.

    Missing parts have defaults; an action that begins with skip skips, a sensitivity that begins with sens is sensitive.
    """
    o = greedy_object(reply)
    word = lambda k: F.lower(F.trim(F.coalesce(F.get_json_object(o, f"$.{k}"), F.lit(""))))
    topic = F.trim(F.coalesce(F.get_json_object(o, "$.topic"), F.lit("")))
    return F.when(
        o.isNotNull(),
        F.struct(
            F.when(word("domain") == "", "general").otherwise(word("domain")).alias("domain"),
            F.when(topic == "", T_.topic(query)).otherwise(topic).alias("topic"),
            F.when(word("action").startswith("skip"), "skip").otherwise("keep").alias("action"),
            F.when(word("sensitivity").startswith("sens"), "sensitive").otherwise("none").alias("sensitivity"),
            F.from_json(F.get_json_object(o, "$.facts"), FACTS).alias("facts"),
        ),
    )
