"""Problem 5: repetition inside a single document.

Method: repetition coverage.  Rolling hashes of several n-gram lengths in numpy
measure the words and characters that lie in n-grams, sentences and lines seen
earlier in the same value.  One map over Arrow batches; no shuffle but for the
removal of repeated deliveries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .values import KEY, long_values
from .words import chunks, grams, mix, occurrence, words

LENGTHS = (3, 5, 10)
MIN_SHARE = 0.4
MEASURES = "n_words int, repeated_share double, " + ", ".join(f"share_{n}grams double" for n in LENGTHS) + ", share_lines double, repeated_chars long"


def _numbering(w, texts: list[str]) -> np.ndarray:
    """Words that only number a line: digits first in their line with `.`, `)` or `:` behind."""
    out = np.zeros(len(w.hash), bool)
    c, base = w.chars, w.at[w.row]
    s, e = w.start + base, w.end + base
    digit = (c[s] >= 48) & (c[s] <= 57) & (e - s <= 4) & (c[e - 1] >= 48) & (c[e - 1] <= 57)
    digit &= np.isin(c[np.minimum(e, len(c) - 1)], [46, 41, 58])
    for i in np.flatnonzero(digit):
        j = s[i] - 1
        while j >= base[i] and c[j] in (32, 9, 42, 35, 45):
            j -= 1
        out[i] = j < base[i] or c[j] == 10
    return out


def _runs(w, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of text between stops: hash, first word and one past the last word of each."""
    if not len(w.hash):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    count = np.concatenate(([0], np.cumsum(stop)))
    piece = count[w.start + w.at[w.row]] + w.row * np.int64(1)
    new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (w.row[1:] != w.row[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(piece)]))
    k = np.arange(len(piece)) - first[np.cumsum(new) - 1]
    with np.errstate(over="ignore"):
        term = mix(w.hash + mix(k.astype(np.uint64) + np.uint64(7)))
        h = np.add.reduceat(term, first)
    return h, first, last


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Shares of repeated words for each text; null, empty and wordless texts have share 0."""
    n = len(texts)
    w = words(texts)
    number = _numbering(w, texts)
    if number.any():
        keep = ~number
        w.hash, w.row, w.start, w.end = w.hash[keep], w.row[keep], w.start[keep], w.end[keep]
        w.first = np.searchsorted(w.row, np.arange(n + 1))
    total = np.diff(w.first)
    covered = np.zeros(len(w.hash), bool)
    out: dict[str, np.ndarray] = {"n_words": total}

    def mark(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        step = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(step, begin, 1)
        np.add.at(step, end, -1)
        return np.cumsum(step[:-1]) > 0

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(w.row[flag], minlength=n) / np.maximum(total, 1)

    for k in LENGTHS:
        h, at = grams(w, k)
        again = at[occurrence(h, w.row[at]) > 0]
        flag = mark(again, again + k)
        out[f"share_{k}grams"] = share(flag)
        covered |= flag
    line_stop = w.chars == 10
    sentence_stop = line_stop | np.isin(w.chars, [46, 33, 63, 8230])
    for stop, name in ((line_stop, "share_lines"), (sentence_stop, "")):
        h, first, last = _runs(w, stop)
        again = occurrence(h, w.row[first]) > 0
        flag = mark(first[again], last[again])
        if name:
            out[name] = share(flag)
        covered |= flag
    out["repeated_share"] = share(covered)
    out["repeated_chars"] = np.bincount(w.row[covered], weights=(w.end - w.start)[covered], minlength=n).astype(np.int64)
    return out


def _map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for big in batches:
        for pdf in chunks(big, "text"):
            m = measure(pdf["text"].tolist())
            yield pdf.drop(columns="text").assign(**m)[[*pdf.columns.drop("text"), *(x.split()[0] for x in MEASURES.split(", "))]]


def repetition_shares(values: DataFrame) -> DataFrame:
    """Repetition measures of each row's `text`; all other columns are kept.

    Null and empty texts get 0 words and share 0; a text of one word can't repeat.
    Repeated rows give repeated results.
    """
    kept = [f for f in values.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), MEASURES])
    return values.select(*(F.col(f"`{f.name}`") for f in kept), "text").mapInPandas(_map, schema)


def repeated_values(mrl: DataFrame, completions: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(tbl, row_key, pos) of the values whose repeated share is at least `min_share`, each once."""
    return repetition_shares(long_values(mrl, completions)).filter(F.col("repeated_share") >= min_share).select(*KEY).distinct()
