"""Vectorised words: maximal runs of letters or digits, compared without regard to case.

A batch of texts becomes a few flat numpy arrays; no Python loop runs per word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


CODES = 0x110000
LETTERS = 0x40000  # no letters or digits lie beyond


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter or digit; its lower-case code point."""
    chars = np.arange(LETTERS, dtype="<u4").view("<U1")
    alnum, lower = np.zeros(CODES, bool), np.arange(CODES, dtype=np.uint32)
    alnum[:LETTERS] = np.char.isalnum(chars)
    lower[:LETTERS] = np.where(alnum[:LETTERS], np.char.lower(chars).astype("<U1").view("<u4"), lower[:LETTERS])
    lower[0x130] = 0x130  # the one letter whose small form is two characters
    return alnum, lower


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        p = np.full(n, _BASE, np.uint64)
        q = np.full(n, _BASE_INV, np.uint64)
        p[0] = q[0] = 1
        return np.multiply.accumulate(p), np.multiply.accumulate(q)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def word_table() -> np.ndarray:
    return code_tables()[0]


def hash_runs(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run code[start:end]."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, q = _powers(1 << max(12, int(len(code)).bit_length()))
    with np.errstate(over="ignore"):
        run = np.concatenate(([np.uint64(0)], np.cumsum(mix(code.astype(np.uint64) + np.uint64(11)) * p[: len(code)], dtype=np.uint64)))
        return mix((run[end] - run[start]) * q[start])


@dataclass
class Words:
    hash: np.ndarray  # one 64-bit hash a word
    row: np.ndarray  # the text's position in the batch
    start: np.ndarray  # code point offset within the text
    end: np.ndarray
    first: np.ndarray  # position of each text's first word; one more entry at the end
    chars: np.ndarray  # lower-cased code points of the whole batch
    at: np.ndarray  # offset of each text in chars


def words(texts: list[str]) -> Words:
    """All words of the texts; null counts as empty."""
    texts = [t or "" for t in texts]
    n = len(texts)
    joined = "\0".join(texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    alnum, lower = code_tables()
    ok = alnum[raw]
    code = lower[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    length = np.fromiter(map(len, texts), np.int64, n) + 1
    at = np.concatenate(([0], np.cumsum(length)))
    row = np.searchsorted(at, start, "right") - 1
    h = hash_runs(code, start, end)
    first = np.searchsorted(row, np.arange(n + 1))
    return Words(h, row, start - at[row], end - at[row], first, code, at)


def occurrence(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each entry, how often the same key came earlier in the same row."""
    if not len(keys):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        k = mix(keys + mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(k, kind="stable")
    s = k[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - begin
    return out


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word grams that lie within one text, and the position of their first word."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = w.hash[:m].copy()
        for i in range(1, n):
            h = h * _BASE + w.hash[i : m + i]
    keep = np.flatnonzero(w.row[:m] == w.row[n - 1 :])
    return mix(h[keep]), keep


def blocks(rows, size: int = 500):
    """Slices of at most `size` rows of a pandas frame, so that arrays stay small whatever the Arrow batch."""
    for i in range(0, len(rows), size):
        yield rows.iloc[i : i + size]


def chunks(pdf, column: str, limit: int = 2_000_000, most: int = 5_000):
    """Slices of the frame of about `limit` characters of the column, at least one row each."""
    begin = total = 0
    for i, t in enumerate(pdf[column]):
        n = len(t) if isinstance(t, str) else 0
        if i > begin and (total + n > limit or i - begin >= most):
            yield pdf.iloc[begin:i]
            begin, total = i, 0
        total += n
    if begin < len(pdf):
        yield pdf.iloc[begin:]
