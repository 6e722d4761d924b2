"""Undo common disguises of words, vectorised over a batch of texts.

Look-alike letters, invisible characters, digits and signs for letters, stretched
letters and letters set apart are brought back to plain lower-case words.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

# Letters of other alphabets that look like Latin ones.
_LOOKALIKE = dict(
    zip(
        "аеорсухкмтвніјѕԁһԛԝбАЕОРСУХКМТВНІЈЅВΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικτυχ",
        "aeopcyxkmtbhijsdhqwbAEOPCYXKMTBHIJSBABEZHIKMNOPTYXaopviktux",
        strict=True,
    )
)
# Digits and signs that stand for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "i", "€": "e"}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: plain lower-case letter, kind (0 other, 1 letter, 2 digit, 3 sign for a letter), drop, letter meant."""
    n = 0x10000
    plain = np.arange(n, dtype=np.uint32)
    kind = np.zeros(n, np.uint8)
    drop = np.zeros(n, bool)
    meant = np.arange(n, dtype=np.uint32)
    for i in range(n):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        cat = unicodedata.category(c)
        if cat in ("Cf", "Mn", "Me") or c == "­":
            drop[i] = True
            continue
        x = _LOOKALIKE.get(c, c)
        if len(k := unicodedata.normalize("NFKC", x)) == 1:
            x = k
        if len(k := x.lower()) == 1:
            x = k
        plain[i] = meant[i] = ord(x)
        kind[i] = 1 if cat[0] == "L" else 2 if cat == "Nd" else 0
        if c in _LEET:
            kind[i] = kind[i] or 3
            meant[i] = ord(_LEET[c])
    return plain, kind, drop, meant


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def plain(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, source positions) of a batch joined by NUL; NULs stay."""
    table, kinds, drop, meant = _tables()
    small = np.where(raw < 0x10000, raw, 32).astype(np.uint32)
    at = np.flatnonzero(~drop[small])
    small = small[at]
    c, kind = table[small], kinds[small]
    # Digits and signs inside words that also hold letters.
    s, e = _runs(kind > 0)
    if len(s):
        letters = np.add.reduceat((kind == 1).astype(np.int64), s)
        others = np.add.reduceat((kind >= 2).astype(np.int64), s)
        # A closing exclamation mark is no letter.
        last = kind[e - 1] == 3
        mixed = (letters > 0) & (others > 0)
        inner = others - last.astype(np.int64)
        signs = (letters == 0) & (np.add.reduceat(np.isin(small, [36, 64]).astype(np.int64), s) > 0) & (e - s <= 4)
        word = np.repeat((mixed & (inner > 0)) | signs, e - s)
        end = np.repeat(e - 1, e - s)
        pos = np.concatenate([np.arange(a, b) for a, b in zip(s, e, strict=True)]) if len(s) < 64 else np.flatnonzero(kind > 0)
        swap = pos[word & (kind[pos] >= 2) & ~((pos == end) & (kind[pos] == 3))]
        c[swap] = meant[small[swap]]
    # Stretched letters: three or more of the same become one.
    same = np.concatenate(([False], (c[1:] == c[:-1]) & (kind[1:] > 0)))
    s, e = _runs(same)
    if len(s):
        long = (e - s) >= 2
        kill = np.zeros(len(c), bool)
        step = np.zeros(len(c) + 1, np.int64)
        np.add.at(step, s[long], 1)
        np.add.at(step, e[long], -1)
        kill = np.cumsum(step[:-1]) > 0
        letter = (c < 48) | (c > 57)
        keep = ~(kill & letter)
        c, at, kind = c[keep], at[keep], kind[keep]
    # Letters set apart by one character each: three or more single letters in a row.
    is_word = (kind == 1) | (kind == 2) | ((c >= 97) & (c <= 122))
    s, e = _runs(is_word)
    if len(s) > 2:
        single = (e - s == 1) & ~((c[s] >= 48) & (c[s] <= 57))
        near = (s[1:] - e[:-1] == 1) & single[1:] & single[:-1] & np.isin(c[e[:-1]], [32, 46, 45, 42, 95, 183])
        a, b = _runs(near)
        long = (b - a) >= 2
        if long.any():
            kill = np.zeros(len(c), bool)
            for x, y in zip(a[long], b[long], strict=True):
                kill[e[x:y]] = True
            c, at = c[~kill], at[~kill]
    return c, at
