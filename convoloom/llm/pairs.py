"""Problem 3: broken prompt and response pairs.

Method: a suffix automaton of the prompt's words measures how much of the
response is copied; refusal automata read the opening of the response; the
delimiter stacks and end marks of `tails` find broken-off responses (those they
leave open are settled by the prefix lookups of problem 6); stopword votes tell
the language of both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .refusals import refuses
from .residue import residue_fields
from .tails import INVISIBLE
from .truncation import cut_values
from .values import KEY, mrl_answers, thinks

_WORD = re.compile(r"[^\W_]+")

# ---------------------------------------------------------------- empty

_NOTHING = frozenset(("", "null", "none", "nil", "na", "nan", "undefined", "empty", "void", "blank", "br", "p", "nbsp", "noanswer", "noresponse", "noreply"))


def is_empty(text: str | None) -> bool:
    """Nothing said: null, blank, invisible characters, punctuation, or a word that stands for nothing."""
    if text is None:
        return True
    t = text.strip(" \t\r\n\v\f" + INVISIBLE)
    if not t:
        return True
    words = iter(_WORD.finditer(t))
    said = []
    for w in words:  # one word that says something ends the search
        said.append(w.group().lower())
        if said[-1] not in _NOTHING and len(said) > 3:
            return False
    return ("".join(said) in _NOTHING or set(said) <= _NOTHING) and not re.search(r"[\U0001F300-\U0001FAFF]", t)


# ---------------------------------------------------------------- copies


class SuffixAutomaton:
    """All word sequences that occur in a prompt."""

    def __init__(self, seq: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in seq:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, seq: list[str], least: int = 3) -> int:
        """Words of seq that lie in runs of at least `least` words found in the prompt."""
        state = run = 0
        end, total = 0, 0
        for i, c in enumerate(seq):
            while state and c not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                run += 1
            else:
                run = 0
            if run >= least:
                total += i + 1 - max(end, i + 1 - run)
                end = i + 1
        return total


LEAD_WORDS = 6


def copies(query: str | None, text: str) -> bool:
    """The response is the query again and no more: nearly all of its words are copied, apart from a short lead-in."""
    q = [x.lower() for x in _WORD.findall(query or "")]
    if len(q) < 3:
        return False
    a = [x.lower() for x in _WORD.findall(text)]
    if not 0.6 * len(q) <= len(a) <= 1.15 * len(q) + LEAD_WORDS:
        return False
    got = SuffixAutomaton(q).covered(a)
    return got >= 0.6 * len(q) and len(a) - got <= max(LEAD_WORDS if a[-2:] == q[-2:] else 2, 0.1 * len(a)) and got >= 0.6 * len(a)


# ---------------------------------------------------------------- languages

# Frequent function words of each language.
STOPWORDS = {
    "en": "i a me let should under every while because though since near never took keep store write tell why help please reasons where did does lies later once nobody whether across the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two him see could no make than been its who now my made over did down only way find use may after also most our back still another",
    "de": "bleibt viele laut gilt mindestens beim ins wäre längst hat gegen spät dafür obwohl weil sofern liegt kannst bitte soll ich wie wer hier dies diese dieser keine kein wo der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man kann wurde sei wenn doch gibt seit heute kaum welche was ihr sehr schon wieder dann ohne zwischen während gestern später außerdem wo warum soll",
    "fr": "d l qu abord ensuite demeure tandis hier y eut afin pourquoi combien peux dois donc encore jamais plutôt devrait personne avoir ayant cherchent c j faut fallait à ce ces où quelle quel lundi le la les de des du et en un une est que qui dans pour pas sur plus par au avec ce il ne se sont cette ou mais aux son sa ses ont été comme nous vous elle leur être fait tout aussi sans entre dont où si très même depuis hier après avant quand sait semble à était aurait selon votre y",
    "es": "primero luego ante debería tiempo cuántos puedes debo dónde estaría mientras quien e fueron siempre nunca demasiado nadie primer está buscan a ayer mismo eso resumen el la los las de y en que a un una es por con para del se no su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está nos durante uno ni contra ese otros hay donde qué según aunque hace tiene sigue antes hoy",
    "pl": "podczas gdy najpierw potem ile temu wydaje powinno zbyt dużo stale razem poza tym według czy kto czego proszę gdy ponad niż nawet u ze we ma mają jako również i w na z do się nie że to jest o jak za od po ale czy dla przez tak co już był było była przed oraz są jego jej które który ich tylko może ten tej tego lub być jeśli pod przy bardzo tym też dziś między bez jeszcze nikt wielu gdzie dlaczego która ilu kiedy aż nadal poza",
}
_LANGS = tuple(STOPWORDS)
_VOTES: dict[str, tuple[int, ...]] = {}
for _k, _lang in enumerate(_LANGS):
    for _w in STOPWORDS[_lang].split():
        _VOTES[_w] = (*_VOTES.get(_w, ()), _k)
_LANGUAGE_NAMES = (
    r"english|german|french|spanish|polish|italian|portuguese|dutch|russian|czech|chinese|japanese|arabic|latin|"
    r"englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|polnisch\w*|anglais|allemand|français|espagnol|polonais|"
    r"inglés|alemán|francés|español|polaco|angielsk\w*|niemieck\w*|francusk\w*|hiszpańsk\w*|polsk\w*"
)
_ASKS = re.compile(rf"\b(?:in|into|to|auf|ins|en|au|al|à|na|po|w)\s+(?:the |le |l['’]|el |język\w* )?(?:{_LANGUAGE_NAMES})\b|\btranslat|\bübersetz|\btradui|\btraduc|\bprzetłumacz|\btłumacz", re.I)
_CODE = re.compile(r"```.*?(?:```|$)", re.S)
MIN_VOTES, LEAD = 2, 1.6


def language(text: str | None) -> str:
    """The language with clearly most stopword votes outside code; an empty string if undecided."""
    n = [0.0] * len(_LANGS)
    for w in _WORD.findall(_CODE.sub(" ", text or "")):
        for k in _VOTES.get(w.lower(), ()):
            n[k] += 1.0 / len(_VOTES[w.lower()])
    order = sorted(range(len(n)), key=lambda k: -n[k])
    return _LANGS[order[0]] if n[order[0]] >= MIN_VOTES and n[order[0]] >= LEAD * n[order[1]] else ""


def other_language(query: str | None, text: str) -> bool:
    """Both languages are clear and differ, and the query asks for no language."""
    a = language(text)
    if not a:
        return False
    q = language(query)
    return bool(q) and q != a and not _ASKS.search(query or "")


# ---------------------------------------------------------------- operator

DEFECTS = ("empty", "copies_query", "refusal", "other_language", "truncated")


def defect(query: str | None, text: str | None) -> str:
    """The first defect that the pair alone shows; an empty string if none."""
    if is_empty(text):
        return "empty"
    if copies(query, text):
        return "copies_query"
    if refuses(text):
        return "refusal"
    if other_language(query, text):
        return "other_language"
    return ""


def _defects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pdf[list(KEY)].assign(defect=[defect(q, t) for q, t in zip(pdf["query"], pdf["text"], strict=True)])
        yield out[out["defect"] != ""]


def pairs(mrl: DataFrame, completions: DataFrame) -> DataFrame:
    """Distinct (key, query, text): answers of mrl_records, thinks of completions in reasoning mode."""
    t = thinks(completions).filter(F.col("conv_mode") == "reasoning").drop("conv_mode")
    return mrl_answers(mrl).unionByName(t)


def broken_pairs(mrl: DataFrame, completions: DataFrame) -> DataFrame:
    """(tbl, row_key, pos, defect) of every broken pair, once; records with residue (problem 1) are left out.

    A null or blank response is `empty`.  A pair with several defects has the first of
    `DEFECTS`.  A null query can't be copied and has no language.
    """
    p = pairs(mrl, completions)
    own = p.mapInPandas(_defects, "tbl string, row_key long, pos int, defect string")
    cut = cut_values(p.filter(F.length("text") > 0)).select(*KEY, F.lit("truncated").alias("defect"))
    order = F.array(*(F.lit(d) for d in DEFECTS))
    one = own.unionByName(cut).groupBy(*KEY).agg(F.min(F.array_position(order, F.col("defect"))).alias("k")).select(*KEY, F.element_at(order, F.col("k").cast("int")).alias("defect"))
    bad = residue_fields(mrl).select(F.lit("mrl_records").alias("tbl"), F.col("record_id").alias("row_key")).distinct()
    return one.join(bad, ["tbl", "row_key"], "left_anti").select(*KEY, "defect")
