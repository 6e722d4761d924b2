"""Passages of a text as numbers: every word with the three words before it.

A batch of texts becomes flat numpy arrays.  Words are maximal runs of letters or
digits in lower case; names (capitalised words inside a sentence) and numbers are
masked, so that passages that differ in them alone are copies of each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import code_tables, hash_runs, mix

CONTEXT = 3
NAME, NUMBER, START = np.uint64(11), np.uint64(22), np.uint64(33)
_STOPS = np.array([46, 33, 63, 0x2026, 0x3002, 0xFF01, 0xFF1F], np.uint32)
_BREAKS = np.array([0, 10, 13], np.uint32)
_SPACES = np.array([0, 9, 10, 13, 32, 0xA0], np.uint32)
_CLOSERS = np.array([34, 39, 41, 42, 93, 95, 96, 0xBB, 0x2019, 0x201D], np.uint32)


@dataclass
class Passages:
    row: np.ndarray  # the text's position in the batch
    key: np.ndarray  # hash of the words before, in the same sentence
    loose: np.ndarray  # the same with a capitalised first word of the sentence masked too
    word: np.ndarray  # hash of the word, masked
    masked: np.ndarray  # is the word a name or a number
    start: np.ndarray  # place in `chars`
    end: np.ndarray
    ended: np.ndarray  # an end mark follows the word
    last: np.ndarray  # the line ends after the word, without an end mark
    chars: np.ndarray  # lower-cased code points of the batch


def _text(t: str | None) -> str:
    return t or ""


def _before(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the CONTEXT words before each word; `place` is the word's number in its sentence."""
    key = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(CONTEXT, 0, -1):
            prev = np.concatenate((np.full(min(k, len(h)), START), h[:-k])) if len(h) else h
            key = mix(key * np.uint64(31) + np.where(place >= k, prev, START))
    return key


def passages(texts: list[str]) -> Passages:
    """All words of the texts with their contexts; null counts as empty."""
    raw = np.frombuffer(("\0".join(map(_text, texts)) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    alnum, lower = code_tables()
    ok = alnum[raw]
    chars = lower[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).view(np.int8)))
    s, e = edge[::2], edge[1::2]
    breaks = np.isin(raw, _BREAKS)
    after = np.concatenate((raw[1:], [np.uint32(0)]))
    stop = breaks | (np.isin(raw, _STOPS) & (np.isin(after, _SPACES) | np.isin(after, _CLOSERS)))
    row = np.searchsorted(np.cumsum(np.fromiter(map(len, map(_text, texts)), np.int64, len(texts)) + 1), s, "right")
    sentence = np.cumsum(stop)[s] if len(s) else np.zeros(0, np.int64)
    first = np.concatenate(([True], sentence[1:] != sentence[:-1])) if len(s) else np.zeros(0, bool)
    at = np.arange(len(s))
    place = at - np.maximum.accumulate(np.where(first, at, 0)) if len(s) else at
    exact = hash_runs(chars, s, e)
    upper = raw[s] != chars[s]
    digit = (raw[s] >= 48) & (raw[s] <= 57)
    h = np.where(digit, NUMBER, np.where(upper & ~first, NAME, exact))
    loose = np.where(upper & first, NAME, h)
    follow = raw[np.minimum(e, len(raw) - 1)]
    # After the word come closing signs at most, then an end mark or the end of the line.
    end = e.copy()
    for _ in range(2):
        end = np.where(np.isin(raw[np.minimum(end, len(raw) - 1)], _CLOSERS), end + 1, end)
    mark = raw[np.minimum(end, len(raw) - 1)]
    ended = np.isin(mark, _STOPS) & stop[np.minimum(end, len(raw) - 1)]
    return Passages(row, _before(h, place), _before(loose, place), h, digit | (upper & ~first), s, e, ended, np.isin(follow, _BREAKS), chars)


def alone(p: Passages) -> np.ndarray:
    """Hash of each word without its context."""
    with np.errstate(over="ignore"):
        return mix(p.word + np.uint64(77))


def spelled(p: Passages, i: np.ndarray) -> list[str]:
    """The words at i as text; a name is `N` and a number `0`."""
    number = p.word == NUMBER
    return ["0" if number[k] else "N" if p.masked[k] else p.chars[p.start[k] : p.end[k]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for k in i]
