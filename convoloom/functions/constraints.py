"""Texts around constraints: what a request for one must mention, and how one is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of which a request for a constraint holds one; `{}` is the lower-case parameter named beside them.
MARKERS = {
    "json_valid": (None, ("json",)), "yaml_valid": (None, ("yaml",)), "markdown_table": (None, ("table",)), "markdown_format": (None, ("markdown",)),
    "alphabetical_sentence_starts": (None, ("alphabet",)), "no_gendered_pronouns": (None, ("pronoun", "gender")), "limerick_structure": (None, ("limerick",)),
    "first_letter": ("letter", ("'{}'", "letter {}", "start with {}")), "forbidden_token": ("token", ("'{}'", "{}", "the word")),
    "max_words_per_sentence": ("max_words", ("{}", "per sentence", "short sentence")),
    "length_tokens": ("max_words", ("{}", "word", "shorter", "concise", "compress", "trim")), "n_bullets": ("n", ("{}", "bullet")),
}

#: How a constraint is asked for; `{}` is its parameter.
REQUESTS = {
    "json_valid": (None, "give that answer again as one valid JSON object"), "yaml_valid": (None, "give that answer again as valid YAML"),
    "markdown_table": (None, "put that answer into a markdown table"), "markdown_format": (None, "set that answer in markdown, with headings and bullets"),
    "first_letter": ("letter", "say that again so that each sentence begins with the letter '{}'"), "alphabetical_sentence_starts": (None, "say that again with sentences in alphabetical order of their first letters"),
    "max_words_per_sentence": ("max_words", "say that again in sentences of no more than {} words"), "forbidden_token": ("token", "say that again without the word '{}'"),
    "no_gendered_pronouns": (None, "say that again without gendered pronouns"), "length_tokens": ("max_words", "say that again in no more than {} words"),
    "n_bullets": ("n", "sum that up in {} bullet points"), "limerick_structure": (None, "turn that into a limerick"),
}
FALLBACK = "revise that answer"


def _filled(template: str, value: Column) -> Column:
    before, brace, after = template.partition("{}")
    return F.concat(F.lit(before), value, F.lit(after)) if brace else F.lit(template)


def _param(params: Column, name: str | None) -> Column:
    return F.lit("") if name is None else F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(""))


def markers(kind: Column, params: Column) -> Column:
    """array<string> for a constraint type and its parameters (map<string, string>); empty for an unknown type."""
    out = F.array().cast("array<string>")
    for name, (param, words) in reversed(MARKERS.items()):
        out = F.when(kind == name, F.array(*(_filled(w, F.lower(_param(params, param))) for w in words))).otherwise(out)
    return out


def request(kind: Column, params: Column) -> Column:
    """The wording that asks for a constraint."""
    out = F.lit(FALLBACK)
    for name, (param, words) in reversed(REQUESTS.items()):
        out = F.when(kind == name, _filled(words, _param(params, param))).otherwise(out)
    return out
