"""Problem 6: text cut off by field limits.

Method: self-join by prefix, at two lengths.  (a) Distinct values are range-sorted; a
value that is a strict prefix of the next one is a cut copy of it.  (b) The last
words of a value without an end mark are looked up among the passages of all values
that begin with the same words (a hash of the three words before, names and numbers
masked): in the longer copies the last word goes on, or the sentence goes on after
it, or the sentence ends there.  The copies vote.

What no copy can show is a class of its own (`structure`): an object, table or code
block that is never closed, a broken character, an ellipsis as the end.  A last
sentence that stays open behind finished ones and has no copy is `open`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bloom import Bloom
from .passages import alone, passages, spelled
from .residue import residue_fields
from .tails import CUT, ENDED, ending, open_tail, word_break
from .values import KEY, mrl_answers, thinks
from .words import chunks, mix

PREFIX_CHARS = 32  # values share a hash of so many first characters; shorter ones meet the beginnings of all values
MIN_LONGER = 0.5  # share of a passage's copies that go on where the value stops
PHRASE_WORDS = 3  # so many whole words can be a complete text of their own
EVIDENCE = ("value", "passage", "structure", "open")
#: Reported reasons that name a limit.
LIMITS = ("length", "max_tokens")

_SIGNATURE = re.compile(r"(?:regards|yours|sincerely|thanks|cheers|best|grüße|cordialement|saludos|pozdrawiam)\W*$|,\s*$", re.I)
_LIST_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_NAME_IN = re.compile(r"\w*[A-ZÀ-ÖØ-ÞŁŚŻŹĆŃ]\w*(?:-\d+)?")
_LABEL = re.compile(r"^[^\W\d_][\w .'’-]{0,30}(?::|=)\s+\S|^--|^\*\*|^>")


def judge(text: str, query: str | None = None) -> str:
    """`structure`, `ended`, `open` (finished sentences, then an open one), `dangling` (one open sentence that stops at a word which needs another) or `maybe`.

    A text that only repeats its query is complete whatever its end.
    """
    e = ending(text)
    if e == CUT:
        return "structure"
    if e == ENDED:
        return "ended"
    t = text.strip()
    lines = t.split("\n")
    line = lines[-1].strip()
    tail = open_tail(t)
    n = len(tail.split())
    if query and re.sub(r"\W+", " ", query).strip().lower().endswith(re.sub(r"\W+", " ", tail).strip().lower()) and 2 * len(tail) > len(query):
        return "ended"
    if len(tail) < len(line):
        return "open"
    if len(lines) > 1:
        if _LABEL.match(line) or (n <= 5 and _SIGNATURE.search(lines[-2].strip())):
            return "ended"
        if _LIST_ITEM.match(line):
            tail = _LIST_ITEM.sub("", line)
            n = len(tail.split())
            if n <= 3:
                return "ended"
    return "dangling" if n >= 2 and word_break(tail) else "maybe"


def may_be_open(text: Column) -> Column:
    """False for values that surely end well: an end mark, no structure.  Evaluated in the JVM."""
    return ~text.rlike(r"[.!?][\"'”’»)\]*_`]*[\s​﻿]*$") | text.rlike(r"```|[{|…�]")


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values that aren't surely finished, with the contexts and the spelling of their last word; short: so few words that they may be a complete answer."""
    for big in batches:
        for pdf in chunks(big, "text"):
            pdf = pdf.assign(state=[judge(t, q) for t, q in zip(pdf["text"], pdf["query"], strict=True)])
            pdf = pdf[pdf["state"] != "ended"].reset_index(drop=True)
            if not len(pdf):
                continue
            p = passages([t.strip() for t in pdf["text"]])
            i = np.searchsorted(p.row, np.arange(len(pdf)), "right") - 1  # the last word of each value
            has = (i >= 0) & (p.row[np.maximum(i, 0)] == np.arange(len(pdf))) if len(p.row) else np.zeros(len(pdf), bool)
            key, loose, plain, last = *(np.zeros(len(pdf), np.int64) for _ in range(3)), np.full(len(pdf), None, object)
            for to, of in ((key, p.key), (loose, p.loose), (plain, alone(p))):
                to[has] = of[i[has]].view(np.int64)
            last[has] = spelled(p, i[has])
            short = (pdf["state"] == "maybe") & (pdf["text"].str.split().str.len() <= PHRASE_WORDS)
            yield pdf.assign(key=key, loose=loose, plain=plain, last=last, short=short)


_SEEN = "k long, word string, ended boolean, n long"


def _copies(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, word, ended, n): passages of all values with a wanted context, counted by their next word and whether the sentence ends after it.

    Passages without a wanted context are dropped in the scan by the Bloom filter; the others
    are counted per batch before they are shuffled, so a hot context sends its distinct next
    words only.  Last words of open values are no evidence.
    """
    known_ = Bloom(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for pdf in chunks(big, "text"):
                p = passages(pdf["text"].tolist())
                known = p.ended | ~p.last
                out = []
                for keys, ok in ((p.key, known), (p.loose, known & (p.loose != p.key)), (alone(p), known & ~p.masked)):
                    i = np.flatnonzero(ok)
                    i = i[known_.may_hold(keys[i])]
                    if len(i):
                        with np.errstate(over="ignore"):
                            same = mix(keys[i] * np.uint64(31) + mix(p.word[i] * np.uint64(2) + p.ended[i]))
                        _, at, n = np.unique(same, return_index=True, return_counts=True)
                        i = i[at]
                        out.append(pd.DataFrame({"k": keys[i].view(np.int64), "word": spelled(p, i), "ended": p.ended[i], "n": n}))
                if out:
                    yield pd.concat(out)

    return values.select("text").mapInPandas(run, _SEEN).groupBy("k", "word", "ended").agg(F.sum("n").alias("n"))


def _told(values: DataFrame, open_: DataFrame) -> DataFrame:
    """(key, loose, last, longer, inside): for each last word in its context, the share of copies that go on, whether most go on within the word, and (for short values) whether the word stands anywhere as a whole.

    Copies with the very first word of the sentence decide; without any, those with another name there.
    """
    asked = open_.filter(F.col("last").isNotNull()).groupBy("key", "loose", "plain", "last").agg(F.max("short").alias("short"))
    by = lambda k, of=asked: of.select(F.col(k).alias("k"), "last")
    wanted = by("key").unionByName(by("loose")).unionByName(by("plain", asked.filter("short"))).distinct()
    seen = _copies(values, wanted.select("k").distinct())
    same, inside = F.col("word") == F.col("last"), (F.col("word") != F.col("last")) & ~F.col("last").isin("N", "0") & F.col("word").startswith(F.col("last"))
    votes = (
        seen.join(wanted, "k")
        .filter(same | inside)
        .groupBy("k", "last")
        .agg(F.sum("n").alias("all"), F.sum(F.when(inside | ~F.col("ended"), F.col("n")).otherwise(0)).alias("on"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("in"))
    )
    each = votes.select("k", "last", (F.col("on") / F.col("all")).alias("longer"), (2 * F.col("in") > F.col("all")).alias("within"))
    one = lambda k, tag: each.select(F.col("k").alias(k), "last", *(F.col(c).alias(f"{c}_{tag}") for c in ("longer", "within")))
    j = asked.join(one("key", "a"), ["key", "last"], "left").join(one("loose", "b"), ["loose", "last"], "left")
    whole = seen.select(F.col("k").alias("plain"), F.col("word").alias("last")).distinct().withColumn("whole", F.lit(True))
    return j.join(whole, ["plain", "last"], "left").select("key", "loose", "last", F.coalesce("longer_a", "longer_b").alias("longer"), F.coalesce("within_a", "within_b").alias("within"), F.coalesce("whole", F.lit(False)).alias("whole"))


def _inside(text: str, longer: str) -> bool:
    """Does `text`, a strict prefix of `longer`, stop inside a word of it?"""
    return text[-1:].isalnum() and longer[len(text)].isalnum()


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted distinct texts: those that are a prefix of their successor, and the partition's first and last text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, whole, out = None, False, []
    for pdf in batches:
        for t, w in zip(pdf["text"], pdf["whole"], strict=True):
            if last is None:
                out.append(("first", part, t, w, False))
            elif whole and t.startswith(last):
                out.append(("hit", part, last, True, _inside(last, t)))
            last, whole = t, w
        yield pd.DataFrame(out, columns=["kind", "part", "text", "whole", "inside"])
        out = []
    if last is not None:
        yield pd.DataFrame([("last", part, last, whole, False)], columns=["kind", "part", "text", "whole", "inside"])


def _extended(values: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(text, inside): distinct values that are a strict prefix of another value; inside: the successor goes on within the word.

    Values of less than PREFIX_CHARS characters are looked up among the distinct beginnings of
    all values, which show whether there is a longer one; other values enter whole if they
    share a hash of their first characters with a candidate.  All are range-sorted; in sorted order any strict extension of a value makes the next
    distinct text one.  No pairs are formed, and a range split can halve any group of
    equal beginnings.  The last text of a partition meets the first of the next in a
    table of two rows a partition.
    """
    from pyspark.sql import Window

    key = F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("k")
    t = values.filter(F.length("text") >= PREFIX_CHARS).select("text", key)
    if candidates is not None:
        t = t.join(candidates.filter(F.length("text") >= PREFIX_CHARS).select(key).distinct(), "k", "left_semi")
    # A beginning that is no value itself isn't whole.
    begin = values.select(F.substring("text", 1, PREFIX_CHARS).alias("text"), (F.length("text") <= PREFIX_CHARS).alias("whole"))
    texts = begin.unionByName(t.select("text", F.lit(True).alias("whole"))).groupBy("text").agg(F.max("whole").alias("whole"))
    found = cut(texts.repartitionByRange("text").sortWithinPartitions("text").mapInPandas(_neighbours, "kind string, part int, text string, whole boolean, inside boolean"))
    nxt = F.lead("text").over(Window.orderBy("part", F.col("kind") == "last"))
    edges = found.filter("kind <> 'hit'").withColumn("next", nxt).filter((F.col("kind") == "last") & F.col("whole") & F.col("next").startswith(F.col("text")))
    letter = r"[\p{L}\p{N}]"
    over = F.col("text").rlike(letter + "$") & F.substring("next", F.length("text") + 1, F.lit(1)).rlike(letter)
    return found.filter("kind = 'hit'").select("text", "inside").unionByName(edges.select("text", over.alias("inside")))


def _cut_copies(values: DataFrame) -> DataFrame:
    """(text): distinct values that are a strict prefix of another value."""
    return _extended(values).select("text")


def cut_evidence(values: DataFrame) -> DataFrame:
    """Rows of `values` (key columns, query, text) whose text is cut off, each distinct row once, with `evidence`.

    `value`: a strict prefix of a longer value.  `passage`: copies of its last words go on.
    `structure` and `open`: signs in the text, without a copy that shows it; copies that end where the
    value ends don't acquit it, as they can't know what the value lost.

    Null and blank texts are not cut.  Very long texts are read whole.  A value of up to PHRASE_WORDS
    whole words may be a complete answer (a name, an object) although longer texts begin with it; it must
    stop inside its last word, and what is left of that must be no word of its own; but with a reported
    limit (column `limited`, optional) it is enough that longer texts begin with it.  A single word is not decided, as names go on in longer names.
    """
    cols = values.columns
    open_ = values.filter(may_be_open(F.col("text"))).distinct()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema.fields), "state string, key long, loose long, plain long, last string, short boolean"])
    judged = cut(open_.mapInPandas(_judge, schema))
    asked = judged.filter(F.col("state") != "structure")
    told = _told(values, asked)
    copies = _extended(values, asked).withColumn("copied", F.lit(True))
    n = F.size(F.split(F.trim("text"), r"\s+"))
    j = judged.join(told, ["key", "loose", "last"], "left").join(copies, "text", "left")
    limited = F.coalesce(F.col("limited"), F.lit(False)) & (n > 1) if "limited" in cols else F.lit(False)
    phrase = (F.col("state") == "maybe") & (n <= PHRASE_WORDS) & ~limited
    value = F.col("copied") & (~phrase | (F.col("inside") & (n > 1)))
    passage = (F.col("longer") >= MIN_LONGER) & (~phrase | (F.col("within") & ~F.col("whole") & (n > 1)))
    evidence = (
        F.when(F.col("state") == "structure", "structure")
        .when(F.coalesce(value, F.lit(False)), "value")
        .when(F.coalesce(passage, F.lit(False)), "passage")
        .when(F.col("state").isin("open", "dangling"), "open")
    )
    return j.withColumn("evidence", evidence).filter("evidence IS NOT NULL").select(*cols, "evidence")


def cut_values(values: DataFrame) -> DataFrame:
    """Rows of `values` whose text is cut off, each distinct row once."""
    return cut_evidence(values).drop("evidence")


def reported() -> Column:
    """Does the reply's _finish_reason name a limit, however it is spelled?"""
    return F.coalesce(F.lower(F.trim("_finish_reason")).isin(*LIMITS), F.lit(False))


def judge_texts(judge_log: DataFrame, *more: str) -> DataFrame:
    """Rationale texts and quoted replies of the judge log, one row each; every seq counts."""
    r = F.col("judgment.rationale")
    quoted = F.when(F.col("error_type").isin("ValueError", "JSONDecodeError") & F.col("error").contains(": "), F.regexp_replace("error", r"^[^:]{0,60}: ", ""))
    texts = F.explode(F.array(r["memory"], r["instruction"], r["freshness"], quoted))
    return judge_log.select(F.lit("judge_log").alias("tbl"), F.col("seq").alias("row_key"), F.lit(-1).alias("pos"), *more, reported().alias("limited"), F.lit(None).cast("string").alias("query"), texts.alias("text"))


def all_values(mrl: DataFrame, completions: DataFrame, judge_log: DataFrame) -> DataFrame:
    s = "_subset"
    a = mrl_answers(mrl, s)
    t = thinks(completions, s).drop("conv_mode")
    own = a.unionByName(t).withColumn("limited", F.lit(False))
    return own.unionByName(judge_texts(judge_log, s)).filter(F.length("text") > 0)


def truncation_evidence(mrl: DataFrame, completions: DataFrame, judge_log: DataFrame) -> DataFrame:
    """(tbl, row_key, pos, evidence) of cut values, each once; fields with residue (problem 1) are left out."""
    order = F.array(*map(F.lit, EVIDENCE))
    found = cut_evidence(all_values(mrl, completions, judge_log).drop("_subset")).groupBy(*KEY).agg(F.min(F.array_position(order, F.col("evidence"))).cast("int").alias("e"))
    bad = residue_fields(mrl).filter(F.col("field_name") == "answer").select(F.lit("mrl_records").alias("tbl"), F.col("record_id").alias("row_key"))
    return found.join(bad, ["tbl", "row_key"], "left_anti").select(*KEY, F.element_at(order, F.col("e")).alias("evidence"))


def truncated_values(mrl: DataFrame, completions: DataFrame, judge_log: DataFrame) -> DataFrame:
    """(tbl, row_key, pos) of cut values, each once."""
    return truncation_evidence(mrl, completions, judge_log).select(*KEY)


def truncation_rates(mrl: DataFrame, completions: DataFrame, judge_log: DataFrame) -> DataFrame:
    """(tbl, _subset, n_values, n_cut, cut_rate, n_reported, n_confirmed); values without a subset are reported under null.

    n_reported: replies of the judge log whose _finish_reason names a limit, however it is
    spelled; n_confirmed: those of them that were found cut.  Both are 0 for the other tables.
    """
    keys = all_values(mrl, completions, judge_log).select(*KEY, "_subset").distinct()
    said = judge_log.filter(reported()).select(F.lit("judge_log").alias("tbl"), F.col("seq").alias("row_key"), F.lit(-1).alias("pos"), "_subset").distinct()
    each = (
        keys.select(*KEY, "_subset", F.lit(1).alias("v"), F.lit(0).alias("r"))
        .unionByName(said.select(*KEY, "_subset", F.lit(0).alias("v"), F.lit(1).alias("r")))
        .groupBy(*KEY, "_subset")
        .agg(F.max("v").alias("v"), F.max("r").alias("r"))
        .join(truncated_values(mrl, completions, judge_log).withColumn("c", F.lit(1)), list(KEY), "left")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    n = each.groupBy("tbl", "_subset").agg(total("v").alias("n_values"), total(F.col("c") * F.col("v")).alias("n_cut"), total("r").alias("n_reported"), total(F.col("r") * F.col("c")).alias("n_confirmed"))
    return n.select("tbl", "_subset", "n_values", "n_cut", F.round(F.col("n_cut") / F.nullif("n_values", F.lit(0)), 4).alias("cut_rate"), "n_reported", "n_confirmed")
