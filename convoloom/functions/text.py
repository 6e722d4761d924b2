"""Text functions as Column expressions; null in gives the stated default, never an error.

Every function is one built-in expression tree, so it stays inside code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def text(c: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def any_of(patterns: list[str] | str) -> str:
    """One case-blind alternative of several patterns."""
    return "(?i)" + ("|".join(f"(?:{p})" for p in patterns) if isinstance(patterns, list) else patterns)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only: the first 32 bits of an MD5; the same on any cluster."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def has(c: Column, patterns: list[str] | str) -> Column:
    return text(c).rlike(any_of(patterns))


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text(c), r"[\s]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def evidence(c: Column, n: int = 100) -> Column:
    return F.substring(collapsed(c), 1, n)


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script; combining marks end a run."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(r"[\p{L}\p{N}_]+"), 0)


def word_count(c: Column) -> Column:
    """Words that may hold inner apostrophes and hyphens; 0 for null."""
    return F.size(F.regexp_extract_all(text(c), F.lit(r"[\p{L}\p{N}_]['\p{L}\p{N}_-]*"), 0))


def sentences(c: Column) -> Column:
    s = F.split(collapsed(c), r"(?<=[.!?])\s+")
    return F.filter(s, lambda x: x.rlike(r"[^\s\p{Z}]"))


def lines(c: Column) -> Column:
    return F.split(text(c), r"\r\n|\n|\r")


def nonempty_lines(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.rlike(r"[^\s\p{Z}]")))


def bullets(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\S")))


def is_json(c: Column) -> Column:
    """Exactly one JSON value.  The parser stops after the first value, so the text must parse inside a list and inside an object."""
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull()
    return F.coalesce(inside("[", "]") & inside('{"a":', "}"), F.lit(False))


def normalised(c: Column) -> Column:
    """Lower case, other characters than letters, digits and underscores as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}_]+", " "))


def ngrams(w: Column, n: int) -> Column:
    """All n-word grams of an array; empty if it is shorter."""

    def grams(v: Column) -> Column:
        return F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.concat_ws(" ", *(F.element_at(v, i + k) for k in range(n))))).otherwise(F.array().cast("array<string>"))

    return let(w, grams)


def _repeated(g: Column) -> Column:
    return let(g, lambda v: F.when(F.size(v) < 4, 0.0).otherwise(1 - F.size(F.array_distinct(v)) / F.size(v)))


def repeat_ratio(c: Column) -> Column:
    """1 - distinct / all word trigrams; 0 below six words."""
    return _repeated(ngrams(words(c), 3))


def _share(x: Column, y: Column, whole: Callable[[Column, Column, Column], Column]) -> Column:
    """Shared entries of two sets over `whole` of their sizes; 0 if that is 0."""

    def body(z: Column) -> Column:
        a, b, k = F.size(z["a"]), F.size(z["b"]), F.size(F.array_intersect(z["a"], z["b"]))
        return F.when(whole(a, b, k) == 0, 0.0).otherwise(k / whole(a, b, k))

    return let(F.struct(x.alias("a"), y.alias("b")), body)


def overlap(a: Column, b: Column) -> Column:
    """Shared word bigrams over the smaller set; 0 if either has none."""
    return _share(F.array_distinct(ngrams(words(a), 2)), F.array_distinct(ngrams(words(b), 2)), lambda x, y, k: F.least(x, y))


def jaccard(a: Column, b: Column) -> Column:
    return _share(F.array_distinct(words(a)), F.array_distinct(words(b)), lambda x, y, k: x + y - k)


def degenerate(c: Column) -> Column:
    """Six or more short units of which more than two fifths are repeats."""
    u = F.filter(F.transform(F.split(text(c), r"[\n.;]+"), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 3)
    return let(u, lambda v: (F.size(v) >= 6) & ((1 - F.size(F.array_distinct(v)) / F.size(v)) > 0.4))


def restarts(c: Column) -> Column:
    return F.regexp_count(text(c), F.lit("(?im)" + P.RESTART))


def turn_index_leak(c: Column) -> Column:
    return text(c).rlike(P.TURN_INDEX_STRICT) | has(c, P.TURN_INDEX_CUE)


def flow_list(c: Column) -> Column:
    return F.regexp_count(text(c), F.lit("(?im)" + P.FLOW_LINE)) >= 2


def first_match(c: Column, patterns: list[str], n: int = 50) -> Column:
    """The text matched by the first pattern of the list that matches; null if none does."""
    found = [F.when(has(c, p), F.substring(F.regexp_extract(text(c), "(?i)(" + p + ")", 1), 1, n)) for p in patterns]
    return F.coalesce(*found)


def trailing_artifact(c: Column) -> Column:
    t = F.rtrim(F.regexp_replace(text(c), r"\s+$", ""))
    tail = F.lower(F.regexp_extract(t, P.ARTIFACT_TAIL, 1))
    return t.rlike(P.ARTIFACT_KNOWN) | ((tail != "") & ~tail.isin(*P.ARTIFACT_ALLOWED))


def specifics(c: Column) -> Column:
    """array<struct<name, matched>> of the classes of checkable specifics in a text, in fixed order."""
    each = [F.struct(F.lit(n).alias("name"), F.substring(F.regexp_extract(text(c), "(?i)(" + p + ")", 1), 1, 50).alias("matched")) for n, p in P.SPECIFICS.items()]
    return F.filter(F.array(*each), lambda x: x["matched"] != "")


def guarded_markers(c: Column, patterns: list[str]) -> Column:
    """First matches of the patterns, but for those with a negation shortly before."""
    out = []
    for p in patterns:
        before = F.regexp_extract(text(c), "(?is)^(.*?)(?:" + p + ")", 1)
        hit = F.regexp_extract(text(c), "(?i)(" + p + ")", 1)
        out.append(F.when(has(c, p) & ~F.right(before, F.lit(P.NEGATION_REACH)).rlike("(?i)" + P.NEGATION), F.substring(hit, 1, 50)))
    return F.array_compact(F.array(*out))


def reasoning_defect(c: Column) -> Column:
    """The first objective defect of a reasoning text; null if it has none."""
    return (
        F.when(has(c, P.HARNESS), "harness_leak").when(turn_index_leak(c), "turn_index").when(flow_list(c), "flow_list").when(degenerate(c), "degenerate").when(restarts(c) >= P.RESTARTS_FAIL, "restart_spiral")
    )


def quality(c: Column, max_repeat: float = 0.5) -> Column:
    """Why a text fails the general quality gate; null if it passes."""
    t = F.trim(text(c))
    return F.when(F.length(t) < 8, "too_short").when(F.size(words(t)) < 2, "too_few_words").when(has(t, P.REFUSAL), "refusal").when(repeat_ratio(t) > max_repeat, "repetition")


def domain(c: Column) -> Column:
    """The domain with most keyword hits; the first one of equals, `general` without hits."""
    low = F.lower(text(c))
    hits = [sum((F.when(F.contains(low, F.lit(k)), 1).otherwise(0) for k in kws), F.lit(0)) for kws in P.DOMAINS.values()]
    best = F.array_max(F.array(*(F.struct(h.alias("h"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, h) in enumerate(zip(P.DOMAINS, hits, strict=True)))))
    return F.when(best["h"] > 0, best["n"]).otherwise("general")


def topic(c: Column) -> Column:
    """The first six words that are no stopwords; else the first six words; else `this topic`."""
    w = F.regexp_extract_all(text(c), F.lit(r"[A-Za-z0-9']+"), 0)
    kept = F.filter(w, lambda x: ~F.lower(x).isin(*P.TOPIC_STOPWORDS))
    six = lambda a: F.nullif(F.array_join(F.slice(a, 1, 6), " "), F.lit(""))
    return F.coalesce(six(kept), six(w), F.lit("this topic"))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^A-Za-z0-9._-]", "_")


def think_blocks(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"(?is)<think\s*>(.*?)</think\s*>"), 1)


def parse_think(c: Column) -> Column:
    """struct<reasoning, answer, well_formed>: well formed means exactly one block with content; else all of it is answer."""
    blocks = think_blocks(c)
    inner = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(blocks, F.lit(1)), F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    good = (F.size(blocks) == 1) & ~inner.rlike(r"^(?:\.{0,3}|…)$")
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)</?think\s*>", ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rest = bare(F.regexp_replace(text(c), r"(?is)<think\s*>.*?</think\s*>", ""))
    return F.struct(F.when(good, inner).alias("reasoning"), F.when(good, rest).otherwise(bare(text(c))).alias("answer"), good.alias("well_formed"))


def without_artifact(c: Column) -> Column:
    """A junk token glued to the end removed: after a sentence end, after a word and a point (`write.s`), or bare; file endings stay."""
    t = F.regexp_replace(text(c), r"\s+$", "")
    glued = F.regexp_replace(t, r"(?<=[.!?*)\]\"'])\s*(?:" + P.ARTIFACT_JUNK + r")\s*$", "")
    tail = F.regexp_extract(t, P.ARTIFACT_TAIL, 1)
    cut = F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(tail) - 1), F.lit("."))
    bare = F.regexp_replace(t, r"\s+(?:" + P.ARTIFACT_JUNK + r")\s*$", "")
    return F.when(glued != t, F.regexp_replace(glued, r"\s+$", "")).when((tail != "") & ~F.lower(tail).isin(*P.ARTIFACT_ALLOWED), cut).otherwise(bare)


def sanitize(c: Column) -> Column:
    """Reasoning with the reserved phrase replaced, a glued junk token and mechanical closing phrases removed; never emptied, null stays null."""
    t = without_artifact(F.regexp_replace(text(c), r"(?i)\bstanding (instruction)", "ongoing $1"))
    s = F.regexp_replace(F.regexp_replace(t, P.CLOSING_PHRASES, ""), r"\s+$", "")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(c.isNull(), F.lit(None)).otherwise(F.when(strip(s) == "", strip(t)).otherwise(strip(s)))


def prompt_echo(c: Column) -> Column:
    """Does a simulated user message repeat its own instructions?"""
    return has(c, P.PROMPT_ECHO)


def references_prior(c: Column, topic_: Column) -> Column:
    """Does the text name a word of the topic (stopwords aside) or point back in words?"""
    low = F.lower(text(c))
    w = F.filter(F.regexp_extract_all(F.lower(text(topic_)), F.lit(r"[a-z0-9']+"), 0), lambda x: ~x.isin(*P.TOPIC_STOPWORDS, *P.MORE_STOPWORDS))
    return F.exists(w, lambda x: F.contains(low, x)) | low.rlike(P.BACK_REFERENCE)


def segment_response(field: Column, content: Column, source: str = "auto") -> Column:
    """struct<reasoning, answer, well_formed> of a response with an optional reasoning field.

    `auto` takes the field if it says something, else a think block in the content; `field`
    and `inline` only ever look at one of them.  Think tags never stay in an answer.
    """
    if source not in ("auto", "field", "inline"):
        raise ValueError(f"unknown source {source!r}")
    inline = parse_think(content)
    if source == "inline":
        return inline
    strip = lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    said = strip(text(field))
    empty = F.lower(said).isin(*P.EMPTY_REASONING)
    answer = strip(F.regexp_replace(F.regexp_replace(text(content), r"(?is)<think\s*>.*?</think\s*>", ""), r"(?i)</?think\s*>", ""))
    own = F.struct(F.when(~empty, said).otherwise("").alias("reasoning"), answer.alias("answer"), (~empty).alias("well_formed"))
    return own if source == "field" else F.when(~empty, own).otherwise(inline)


def harness_match(c: Column) -> Column:
    """The first leaked phrase of the instructions; null without one."""
    return first_match(c, P.HARNESS, 80)
