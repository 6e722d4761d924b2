"""Problem 1: template residue and error-page text.

Method: message templates by a fixed-depth prefix tree.  The lines and sentences of
all fields, names and numbers masked, meet in the leaves of one tree over the whole
collection (number of words, then the first words); within a leaf, forms that agree
in most words become one template.  Leaves are groups of a shuffle, so the tree has
no size limit; a large leaf is mined in parts whose templates are merged.

Every template is classified once, from its wording and its statistics, and its
verdict goes back to all messages.  Unresolved slots inside ordinary text are found
separately.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .refusals import refuses

DEPTH = 3
SIMILARITY = 0.6
SPLIT = 2048  # distinct forms of a leaf that are mined in one part
ANY = "<*>"
TYPICAL = 1.2  # mean log odds from which the words of a template are typical of residue
MIN_MESSAGES = 2  # messages that carry a template which is judged by its statistics

# ---------------------------------------------------------------- messages

_SPLIT = re.compile(r"[\r\n]+|(?<=[.!?…])\s+(?=[^\s])")
_TOKEN = re.compile(r"\s+")


def messages(text: str) -> list[str]:
    """Lines and sentences of a text, without blank ones."""
    return [s for s in (x.strip() for x in _SPLIT.split(text or "")) if s]


# ---------------------------------------------------------------- verdicts

# The wording of notices, error pages and filler in the five languages of the data.
_SCRIPT = r"(?:java ?script|js|scripts?(?: execution)?(?: and cookies)?|skript\w*|skrypt\w*|cookies)"
_SCRIPT_NOTICES = [
    rf"^(?:please |you must |you need to )?(?:enable|activate|allow|turn on|switch on) {_SCRIPT}\b",
    rf"\b{_SCRIPT} (?:is|are|must be) (?:switched|turned) (?:off|on)\b|\b{_SCRIPT} (?:is|are) (?:disabled|blocked|not enabled)\b",
    rf"^(?:this|the) (?:page|site|app|application|content|website) (?:requires|needs) {_SCRIPT}\b",
    rf"^we are sorry,? but .{{0,80}}\b(?:needs|requires) {_SCRIPT}\b",
    rf"\bdoes(?: not|n't|n’t) work (?:properly )?without {_SCRIPT}\b",
    rf"^your browser (?:blocks|does not support|has disabled|is blocking) {_SCRIPT}\b",
    rf"^you need {_SCRIPT} to \w+",
    r"^checking your browser\b|^verifying (?:that )?you are human\b",
    rf"^(?:bitte )?aktivieren sie {_SCRIPT}|\bnur mit (?:eingeschaltete[nm]|aktivierte[nm]) {_SCRIPT}",
    rf"^(?:veuillez )?activer {_SCRIPT}|^veuillez activer\b.{{0,30}}{_SCRIPT}|(?:nécessite|requiert) {_SCRIPT}",
    rf"^(?:necesita|debe|por favor,?)?\s*(?:activar|active|activa|habilitar|habilite) {_SCRIPT}",
    rf"\b(?:włącz|włączyć|wymaga\w*)\b.{{0,30}}{_SCRIPT}",
]
_STATUS = (
    r"(?:bad request|unauthori[sz]ed|forbidden|not found|method not allowed|request time-?out|too many requests|internal server error|"
    r"not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|unknown error|gone|payment required|conflict)"
)
_REQUEST = r"(?:\s*[-–,(]?\s*(?:request|ray|reference|incident|trace|id|code)\b.*)?"
_ERROR_PAGES = [
    rf"^(?:error|http|status|http error|http status)?\s*[1-5]\d\d\s*[-–:(]?\s*\(?{_STATUS}\)?{_REQUEST}[.!]*$",
    rf"^(?:error|http|http error|status code:?)\s*[1-5]\d\d{_REQUEST}[.!]*$",
    rf"^{_STATUS}{_REQUEST}[.!]*$",
    r"^<html\b|<title>|^<head\b|^<body\b|^<center>|^<h1>",
    r"^(?:the )?server (?:at )?.{0,60}(?:answered|responded|replied) with (?:status|code)\b",
    r"^(?:access denied|permission denied|sign in to continue|log ?in to continue|your session has (?:expired|ended)|session expired|you have been (?:blocked|logged out|signed out))\b(?! (?:by|in|and|for) )",
    r"^you are not (?:allowed|authori[sz]ed) to (?:view|access|see) (?:this|the) (?:page|content|site|resource)\b",
    r"^application error\b.{0,80}(?:occurred|exception)",
    r"^(?:.{0,20}[,:!] ?)?(?:an )?(?:unexpected|unknown|internal) error (?:has )?(?:occurred|happened)\b",
    r"^(?:(?:we are |we’re |we're )?(?:so )?sorry|oops|whoops|uh-oh|hm+)\b[,:!.]? ?(?:but )?(?:something went wrong|an? (?:unexpected |internal )?error|(?:this|the) (?:page|content|site|server)\b.{0,60}\b(?:not|could|does|cannot|can't|isn't)\b|we could not (?:reach|load|find))",
    r"^(?:something went wrong|this page could not be loaded|this page (?:isn't|is not) available|this content is not available|the page you are looking for\b|we could not (?:reach|load|find) the (?:server|page|content))",
    r"^(?:rate limit exceeded|too many requests|quota exceeded)\b",
    r"^no healthy upstream\b|^upstream connect error\b|^connection to (?:backend|server|upstream) .{0,40}(?:refused|failed|timed out|reset)|^(?:connection|request) (?:timed out|refused|reset)\b",
    r"^(?:oops|whoops)!$",
    r"^traceback (?:id\b|\(most recent)|^(?:worker|process|task|job) (?:\d+ )?(?:timed out|crashed|was killed)\b",
    r"^.{0,60}\bis (?:currently |temporarily )?(?:down|closed|offline|unavailable) for (?:scheduled |planned )?maintenance\b|^(?:scheduled|planned) maintenance\b",
    r"^ha ocurrido un error\b|^se ha producido un error\b|^error (?:inesperado|del servidor)\b|^página no encontrada\b|^acceso denegado\b|^servicio no disponible\b",
    r"^une erreur (?:\w+ )?(?:est survenue|s[’']est produite)\b|^page introuvable\b|^accès refusé\b|^service indisponible\b|^erreur (?:du serveur|inattendue|interne)\b",
    r"^(?:es ist )?ein (?:unerwarteter )?fehler (?:ist )?aufgetreten\b|^es ist ein (?:\w+ )?fehler aufgetreten\b|^seite nicht gefunden\b|^zugriff verweigert\b|^der server (?:ist|antwortet) .{0,40}(?:nicht|überlastet)|^interner (?:server)?fehler\b",
    r"^wystąpił (?:nieoczekiwany )?błąd\b|^nie znaleziono strony\b|^strona nie (?:istnieje|została znaleziona)\b|^odmowa dostępu\b|^błąd serwera\b",
]
_PART = r"(?:text|content|paragraph|copy|answer|caption|title|heading|description|reply|response|question|prompt|query)"
_FILLER = [
    rf"^(?:your |the |sample |placeholder |example |dummy |mock |temporary |filler |test |insert )*{_PART} (?:goes|comes|will (?:go|be)) here\b",
    rf"^(?:sample|placeholder|example|dummy|mock|temporary|filler|test|default) {_PART}\b\s*\d*\s*(?:[.!]*$|\(|for layout|, ?replace|[-–:] ?replace|goes|to be)",
    rf"^your {_PART} here\b|^(?:insert|enter|add|write|type) (?:your )?{_PART} here\b",
    r"^(?:content|text|answer|description|more) (?:is )?coming soon\b|^(?:under construction|to be (?:written|added|completed|announced))\W*$",
    r"^(?:contenu|texte|réponse|paragraphe) (?:à venir|d[’']exemple|à remplacer|à compléter|provisoire|ici)\b|^(?:contenido|texto|respuesta|párrafo) (?:pendiente|de ejemplo|de relleno|de prueba|aquí|provisional)\b|^aquí va (?:el|la|su|tu) (?:texto|contenido|respuesta)\b|^ici (?:viendra|le|votre) .{0,20}(?:texte|contenu|réponse)",
    r"^(?:inhalt|text|antwort|beschreibung) (?:folgt|kommt)\b|^(?:beispieltext|platzhalter\w*|blindtext|mustertext|fülltext)\b|^hier (?:steht|kommt|folgt|erscheint) .{0,24}(?:text|inhalt|antwort)\b",
    r"^(?:tu|tutaj) (?:pojawi się|będzie|wpisz) .{0,24}(?:tekst|treść|odpowiedź)|^(?:treść|tekst) (?:wkrótce|zastępcz\w+|przykładow\w+|tymczasow\w+)|^przykładow\w+ (?:tekst|treść)",
    r"^(?:todo|fixme|tbd|tba|t\.b\.d\.?|to do|xxx)\b\W*$",
    r"^(?:todo|fixme|tbd|tba|t\.b\.d\.?|to do)\b\.?\s*(?:[:(–-]|(?:add|write|fill|insert|finish|complete|check|replace|describe)\b)",
]
_LOREM = frozenset(
    # The usual Latin dummy text.
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_JUNK = frozenset("asdf asdfasdf asd qwer qwerty qwertz jkl sdfg foo bar baz qux aaa bbb zzz xxx xxxx test testing 123 1234 12345 blah bla hjkl lol abc".split())
_ALL = [(k, re.compile("|".join(f"(?:{p})" for p in v), re.I)) for k, v in (("script", _SCRIPT_NOTICES), ("error", _ERROR_PAGES), ("filler", _FILLER))]
#: Talk about such texts: a question, or a sentence that mentions a notice, a page or a word instead of being one.
_TALK = re.compile(r"\?[\"'”’)]*$|\b(?:a notice|means|says that|usually|come from|as a dummy|tells? (?:me|you|us)|for example|such as|when they are|what does|should i|how do)\b", re.I)
_FIRST_PERSON = re.compile(r"\b(?:i|my|me|ich|mein\w*|je|moi|mon|ma|yo|mi|ja|mój|moja)\b", re.I)
_TAG = re.compile(r"</?noscript>|<!--.*?-->", re.I)


def verdict(message: str) -> str:
    """`script`, `error` or `filler` for a message that is such a text as a whole; else an empty string."""
    s = _TAG.sub(" ", message.replace(ANY, "0")).strip(" \t>*_`\"'“”#|")
    if not s:
        return ""
    tokens = [t for t in re.split(r"\W+", s.lower()) if t]
    if not tokens:
        return ""
    latin = sum(t in _LOREM for t in tokens)
    if len(tokens) >= 3 and latin >= 0.7 * len(tokens) and {"lorem", "ipsum", "dolor", "amet"}.union(x for x in _LOREM if len(x) > 4) & set(tokens):
        return "filler"
    junk = sum(t in _JUNK or t.isdigit() for t in tokens)
    if junk == len(tokens) and sum(t in _JUNK for t in tokens) >= 1 and (len(tokens) >= 2 or tokens[0] not in ("test", "123", "abc", "bar")):
        return "filler"
    if _TALK.search(s):
        return ""
    for kind, pattern in _ALL:
        if pattern.search(s):
            return kind
    return ""


# ---------------------------------------------------------------- templates

_DIGIT = re.compile(r"\d")
_STATUS_TOKEN = re.compile(r"\W*[1-5]\d\d\W*")
_BEFORE_STATUS = frozenset(("status", "error", "http", "code", "(code"))


def masked(message: str) -> list[str]:
    """Tokens of a message; names behind the first token and tokens with a digit become wildcards, a status number stays."""
    tokens = _TOKEN.split(message)
    out = []
    for i, t in enumerate(tokens):
        if i and len(t) > 4 and t[0].isupper() and t[1].islower() and not signal(t):
            t = ANY
        elif _DIGIT.search(t) and "<" not in t and not (_STATUS_TOKEN.fullmatch(t) and (i == 0 or tokens[i - 1].lower() in _BEFORE_STATUS)):
            t = ANY
        out.append(t)
    return out


#: Words on which a verdict can rest, taken from the verdicts' own patterns; a template keeps them as they are.
_SIGNALS = {w for v in (_SCRIPT_NOTICES, _ERROR_PAGES, _FILLER) for p in v for w in re.findall(r"[a-zà-ż]{4,}", p.lower())} | {"javascript", "skripten", "skripte", "skryptów", "skrypty", "js", "tbd", "tba", "http", "sign", "log"} | set("here means usually dummy notice text continue unauthorized unauthorised authorized authorised".split())
_EDGES = " \t.,;:!?()[]{}<>*_`\"'“”’#|-–/"


_EDGE_RUNS = "^[{0}]+|[{0}]+$".format(re.sub(r"([\[\]\\^\-&])", r"\\\1", _EDGES))


@lru_cache(maxsize=1 << 16)
def signal(token: str) -> bool:
    """Can a verdict rest on this token: a word of the patterns, a question mark, a tag, a status number."""
    return token != ANY and ("?" in token or token[0] == "<" or _STATUS_TOKEN.fullmatch(token) is not None or token.strip(_EDGES).lower().split("-")[0] in _SIGNALS or token.strip(_EDGES).lower() in _SIGNALS)


class Leaf:
    """Templates of one leaf: token lists of one length with the same first tokens.

    Signal tokens are never replaced by a wildcard, so messages with different
    signals never share a template; templates are kept by their signals.
    """

    def __init__(self, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.templates: list[list[str]] = []
        self.by_signals: dict[tuple, list[int]] = {}

    def add(self, tokens: list[str]) -> int:
        """The number of the template that takes the message; the template may become more general."""
        known = self.by_signals.setdefault(tuple((i, t) for i, t in enumerate(tokens) if signal(t)), [])
        need = self.similarity * len(tokens)
        for k in known:
            t = self.templates[k]
            if sum(map(eq, t, tokens)) >= need:
                for i, (a, b) in enumerate(zip(t, tokens, strict=True)):
                    if a != b:
                        t[i] = ANY
                return k
        self.templates.append(list(tokens))
        known.append(len(self.templates) - 1)
        return known[-1]


# ---------------------------------------------------------------- slots

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_ ][A-Za-z0-9]+){0,3}"
_TAGS = "a|b|i|u|p|br|hr|em|li|ol|ul|td|th|tr|h[1-6]|div|pre|html|head|body|span|code|table|title|strong|center|script|style|noscript|think|answer|img|link|meta|s|sub|sup|small|button|form|input|label|section"
_SLOTS = [
    rf"\{{\{{-?\s*{_NAME}\s*-?\}}\}}",
    rf"\$\{{\s*{_NAME}\s*\}}",
    rf"\{{%\s*{_NAME}\s*%\}}",
    rf"(?<![\w\\{{$%])\{{{_NAME}\}}",
    rf"<<\s*{_NAME}\s*>>",
    rf"<\|\s*{_NAME}\s*\|>",
    rf"(?<!<)<(?!/?(?:{_TAGS})>){_NAME}>",
    rf"\[\[\s*{_NAME}\s*\]\]",
    r"\[(?:INSERT|ENTER|ADD|YOUR|FILL IN)\b[^\]\n]{0,40}\]",
    r"(?<![\w\])\[])\[(?=[^\]]*[A-Za-z]{3})(?:[a-z]+(?:[_ ][a-z0-9]+){0,3}|[A-Z]+(?:[_ ][A-Z0-9]+){0,3})\](?![\(\[])",
    rf"@@\s*{_NAME}\s*@@",
    rf"(?<![\w.])__(?!init__|main__|name__ ==|file__){_NAME}__(?!\w)",
    rf"%\({_NAME}\)[sdif]",
    rf"(?<![\w$])\${_NAME}\$(?!\w)",
    rf"(?<![\w#&])#(?!\s){_NAME}#(?!\w)",
    r"(?<=\s)(?:\{\}|\{0\}|%s|%d)(?=[\s.,;:!?]|$)|^(?:\{0\}|%s|%d)(?=\s)",
]
SLOT = re.compile("|".join(f"(?:{p})" for p in _SLOTS))
#: What any slot must hold; evaluated in the JVM to spare most texts the patterns above.
SLOT_HINT = r"[{<\[$#]|__|@@|%[(sd]"
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.S)
_ASKED = re.compile(r"\bplaceholders?\b|\btemplates?\b|\b(?:first_?name|named?) fields?\b|\bformat (?:a|the) (?:float|number|string|date)|\bfill in later\b|\bcurly braces?\b|\bf-strings?\b|\bplatzhalter\b|\bvorlage\b|\bmodèle de (?:mail|lettre)\b|\bplantilla\b|\bszablon\w*", re.I)


def has_slot(text: str, query: str | None) -> bool:
    """An unresolved slot outside code, in a text whose query does not ask for placeholders.

    `query` is the query of the record (the text itself, when the query is judged).
    """
    if not text:
        return False
    plain = _CODE.sub(" ", text)
    if not SLOT.search(plain):
        return False
    return not _ASKED.search(_CODE.sub(" ", query or ""))


# ---------------------------------------------------------------- operator

_PARSED = "record_id long, field_name string, form string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every message of a field once, in its masked form."""
    for pdf in batches:
        out = []
        for rid, field, text in zip(pdf["record_id"], pdf["field_name"], pdf["text"], strict=True):
            out += [(rid, field, m) for m in dict.fromkeys(" ".join(masked(m)) for m in messages(text))]
        yield pd.DataFrame(out, columns=["record_id", "field_name", "form"])


def _grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (leaf, part, form) sorted by these -> the same with the form's template.  One leaf at a time is held."""
    at, leaf, rows, out = None, Leaf(), [], []

    def close() -> None:
        names = [" ".join(t) for t in leaf.templates]
        out.extend((*r, names[k]) for r, k in rows)

    def done() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["leaf", "part", "form", "n_messages", "template"])

    for pdf in batches:
        for r in zip(pdf["leaf"], pdf["part"], pdf["form"], pdf["n_messages"], strict=True):
            if r[:2] != at:
                close()
                at, leaf, rows = r[:2], Leaf(), []
            rows.append((r, leaf.add(r[2].split(" "))))
        if len(out) > 20_000:
            yield done()
            out = []
    close()
    yield done()


def _grown(forms: DataFrame) -> DataFrame:
    """Distinct (leaf, part, form) with n_messages and template."""
    return forms.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "form").mapInPandas(_grow, "leaf string, part int, form string, n_messages long, template string")


def fields(mrl: DataFrame) -> DataFrame:
    """(record_id, field_name, text, asked): one row per distinct non-blank field; repeated deliveries fall together."""
    pair = F.explode(F.array(F.struct(F.lit("query").alias("field_name"), F.col("query").alias("text")), F.struct(F.lit("answer").alias("field_name"), F.col("answer").alias("text"))))
    return mrl.select("record_id", F.col("query").alias("asked"), pair.alias("f")).select("record_id", "f.field_name", "f.text", "asked").filter(F.length("text") > 0)


def parsed(mrl: DataFrame) -> DataFrame:
    """(record_id, field_name, form): the messages of all fields."""
    return fields(mrl).select("record_id", "field_name", "text").mapInPandas(_parse, _PARSED)


def _own(named: DataFrame) -> DataFrame:
    """A form whose template has fewer than three fixed words, or less than two thirds of them fixed, is its own template."""
    t = F.split("template", " ")
    fixed = F.size(F.filter(t, lambda x: x != ANY))
    general = (fixed < 3) | (3 * fixed < 2 * F.size(t))
    return named.select(F.when(general, F.col("form")).otherwise(F.col("template")).alias("template"), "form", "n_messages")


def templates(messages_: DataFrame) -> DataFrame:
    """(template, form, n_messages): every distinct form with the template that it belongs to.

    A leaf of many forms is dealt into parts, which are mined apart; then its templates are mined by the
    same rule, in one part if they are few by now.  So a part never holds many more than SPLIT forms, and
    only in a leaf of thousands of unlike templates some may stay unmerged.  A form whose template
    is too general to tell is its own template.
    """
    w = F.split("form", " ")
    forms = messages_.groupBy("form").agg(F.count("*").alias("n_messages")).withColumn("leaf", F.concat_ws(" ", F.size(w), F.slice(w, 1, DEPTH)))

    def dealt(rows: DataFrame) -> DataFrame:
        large = rows.groupBy("leaf").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).filter("parts > 1")
        part = F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("form"), F.col("parts")).cast("int"))
        return rows.join(large, "leaf", "left").select("leaf", part.alias("part"), "form", "n_messages")

    first = cut(_grown(dealt(forms)))
    if not first.filter("part > 0").limit(1).count():
        return _own(first.select("form", "n_messages", "template"))
    again = first.filter("part > 0").select("leaf", F.col("template").alias("form"), F.lit(0).cast("long").alias("n_messages")).distinct()
    whole = _grown(dealt(again)).select("leaf", F.col("form").alias("template"), F.col("template").alias("whole"))
    named = first.join(whole, ["leaf", "template"], "left").select("form", "n_messages", F.coalesce("whole", "template").alias("template"))
    return cut(_own(named))


def classified(templates_: DataFrame) -> DataFrame:
    """(template, n_messages, kind) of the templates that are residue, each judged once.

    First by wording: `script`, `error` or `filler`.  Then by statistics: a template that at
    least MIN_MESSAGES messages carry is a `notice`, whatever its wording, if its words are as a
    whole typical of those: mean log odds of at least TYPICAL, over at least three known words;
    words that two residue templates don't share count -1, and the template itself is left out
    of the counts, which are over residue and templates of MIN_MESSAGES messages.  Talk about notices, refusals and the first person are none.
    """
    t = cut(templates_.groupBy("template").agg(F.sum("n_messages").alias("n_messages")).withColumn("kind", _verdicts("template")))
    plain = F.transform(F.split(F.lower("template"), " "), lambda x: F.regexp_replace(x, _EDGE_RUNS, ""))
    words_ = F.array_distinct(F.filter(plain, lambda x: x.rlike(r"\D")))
    # Ordinary messages that come once are no templates: they don't count.
    held = t.filter((F.col("kind") != "") | (F.col("n_messages") >= MIN_MESSAGES))
    bag = held.select("template", "n_messages", "kind", F.size(words_).alias("size"), F.explode(words_).alias("word"))
    yes = (F.col("kind") != "").cast("int")
    known = bag.groupBy("word").agg(F.sum(yes).alias("p"), F.sum(1 - yes).alias("q")).filter("p > 1")
    total = held.agg(F.sum(yes).alias("np"), F.sum(1 - yes).alias("nq"))  # one row
    smooth = lambda n, of: F.log((n + 0.1) / (of + 0.2))
    odds = known.crossJoin(total).select("word", F.least(F.lit(5.0), F.greatest(F.lit(-3.0), smooth(F.col("p"), F.col("np")) - smooth(F.greatest(F.col("q") - 1, F.lit(0)), F.col("nq") - 1))).alias("w"))
    asked = bag.filter((F.col("kind") == "") & (F.col("size") > 2))
    score = asked.join(odds, "word").groupBy("template", "n_messages", "size").agg(F.sum("w").alias("w"), F.count("*").alias("k"))
    notice = score.filter((F.col("k") > 2) & (F.col("w") - (F.col("size") - F.col("k")) >= TYPICAL * F.col("size"))).filter(~_says("template"))
    return t.filter("kind <> ''").unionByName(notice.select("template", "n_messages", F.lit("notice").alias("kind")))


@lru_cache(maxsize=1 << 16)
def _hint(token: str) -> bool:
    """Every message with a verdict holds such a token or opens with a note; spares the others the patterns."""
    t = token.strip(_EDGES).lower()
    return signal(token) or t in _JUNK or (len(t) > 4 and t in _LOREM)


_NOTE = re.compile(r"\W*(?:to do|t\.b\.d)\b", re.I)


@F.pandas_udf(T.StringType())
def _verdicts(template: pd.Series) -> pd.Series:
    return template.map(lambda t: verdict(t) if any(map(_hint, t.split(" "))) or _NOTE.match(t) else "")


@F.pandas_udf(T.BooleanType())
def _says(template: pd.Series) -> pd.Series:
    """Does somebody speak in it: talk about a notice, a refusal, the first person."""
    return template.map(lambda t: bool(_TALK.search(t) or _FIRST_PERSON.search(t)) or refuses(t))


@F.pandas_udf(T.BooleanType())
def _slots(text: pd.Series, asked: pd.Series) -> pd.Series:
    return pd.Series([has_slot(t, q) for t, q in zip(text, asked, strict=True)])


def residue(mrl: DataFrame) -> DataFrame:
    """(record_id, field_name, kind): fields that hold residue, once per kind (`slot`, `script`, `error`, `filler`, `notice`).

    Null, empty and blank fields are no cases.  Repeated deliveries count once.
    Parsed messages, templates and their verdicts are checkpointed, so that each is made once.  Verdicts travel by an inner join
    of the forms of residue templates with the messages; messages of one form are salted over 16 keys.
    """
    salt = 16
    mined = cut(parsed(mrl))
    known = templates(mined)
    judged = known.join(classified(known).select("template", "kind"), "template").select(F.xxhash64("form").alias("f"), "kind")
    told = judged.select("f", "kind", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("s"))
    said = mined.select("record_id", "field_name", F.xxhash64("form").alias("f"), F.pmod(F.xxhash64("record_id"), F.lit(salt)).cast("int").alias("s"))
    hit = said.join(told, ["f", "s"]).select("record_id", "field_name", "kind")
    slots = fields(mrl).filter(F.col("text").rlike(SLOT_HINT)).filter(_slots("text", "asked")).select("record_id", "field_name", F.lit("slot").alias("kind"))
    return hit.unionByName(slots).distinct()


def residue_fields(mrl: DataFrame) -> DataFrame:
    """(record_id, field_name) of all residue, each once."""
    return residue(mrl).select("record_id", "field_name").distinct()
