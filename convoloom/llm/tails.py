"""Does a text end the way a finished text ends?  Pure functions on one value."""

from __future__ import annotations

import re

INVISIBLE = "​‌‍﻿ ⁠"
_STRIP = " \t\r\n\v\f" + INVISIBLE
_END = re.compile(r"[.!?。！？]+[\"'”’»)\]*_`🙂]*$")
_LISTED = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_CLOSED = re.compile(r"[)\]}>*`_\"”’»|]$")
_EMOJI = re.compile(r"[\U0001F300-\U0001FAFF☀-➿]$")
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"'”»)]*\s+")
_LABELLED = re.compile(r"^[^\W\d_][\w .'’-]{0,30}(?::|=)\s+\S")
_CUT_WORDS = frozenset(
    # Function words after which no finished text stops.
    "a an the of to in on at by for from with and or but nor as than that which who whose into under over between "
    "is are was were be been has have had will would can could should my your his her its our their this these those "
    "der die das den dem des ein eine einer eines und oder aber von zu mit für auf bei aus nach dass weil "
    "le la les un une des du de et ou mais à au aux dans par pour avec que qui dont sur "
    "el los las una unos unas y o pero del al en por para con que se "
    "i oraz lub ale z w na do od po za przez że który która które".split()
)

CUT, OPEN, ENDED = 2, 1, 0


def _unclosed(line: str) -> bool:
    """An object or list opened in the line is not closed by its end (strings respected)."""
    depth, quote, skip = 0, "", False
    for c in line:
        if skip:
            skip = False
        elif quote:
            if c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        elif c == '"':
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return depth > 0


def ending(text: str) -> int:
    """CUT: the end shows a break; OPEN: no end mark, could be a break; ENDED: a finished text.

    Null, empty and blank values are ENDED: they are empty, not broken off.
    """
    t = (text or "").rstrip(_STRIP)
    if not t.strip(_STRIP):
        return ENDED
    if t.endswith("�") or t.endswith("…"):
        return CUT
    if t.count("```") % 2:
        return CUT
    if t.endswith("```"):
        return ENDED
    line = t[t.rfind("\n") + 1 :].strip(_STRIP)
    if line.startswith("|"):
        first = next(x for x in t.split("\n") if x.strip().startswith("|"))
        return ENDED if line.endswith("|") and line.count("|") >= first.count("|") else CUT
    last = _SENTENCE.split(line)[-1]
    at = last.find("{")
    if at < 0 or last[at : at + 2] in ("{{", "{}"):
        at = last.find("[{")
    if at >= 0 and re.match(r"[\[{]\s*[\"'\[{]", last[at:] + '"'):
        return CUT if _unclosed(last[at:]) else ENDED
    if _END.search(line) or _EMOJI.search(line):
        return ENDED
    if _LISTED.match(line):
        return OPEN
    if line != t and not line.startswith(">") and (_LABELLED.match(line) or line.startswith("--") or line.startswith("**")):
        return OPEN
    if _CLOSED.search(line):
        return ENDED
    return OPEN


def open_tail(text: str) -> str:
    """The last sentence of the last line."""
    t = (text or "").rstrip(_STRIP)
    line = t[t.rfind("\n") + 1 :].strip(_STRIP)
    return _SENTENCE.split(line)[-1]


def word_break(tail: str) -> bool:
    """The tail stops at a comma or right after a word that must be followed by another."""
    if tail[-1:] in ",;(-–":
        return True
    words = tail.split()
    return len(words) > 1 and words[-1].lower() in _CUT_WORDS
