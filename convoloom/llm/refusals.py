"""Does a response refuse?  Pure functions on one value."""

from __future__ import annotations

import re

from .tails import INVISIBLE

# How refusals are worded in the five languages of the data.
_SORRY = r"(?:(?:i(?:['’]m| am) (?:so |very |really )?sorry|i apologi[sz]e|sorry|apologies|unfortunately|regrettably|my apologies|thank you[^.]{0,30}|\w+ put)[,.]?\s*(?:but|however)?[,.]?\s*)?"
_CANNOT = r"(?:can(?:not|['’]t| not)|could not|am (?:not able|unable) to|['’]m (?:not able|unable) to|must (?:refuse|decline)(?: to)?|have to (?:refuse|decline)(?: to)?|refuse to|decline to|won['’]t|will not|would rather not|['’]d rather not|do(?: not|n['’]t)|may not|am not (?:allowed|permitted) to|['’]m not (?:allowed|permitted) to)"
_HELP = r"(?:help|assist|discuss|answer|respond|reply|comment|continue|go into|talk|speak|provide|share|give|write|reason|think|disclose|reveal|explain|be (?:saying|able|discussing|providing)|say|offer|produce|comply|fulfil|fulfill|do that|engage|show)"
_REFUSALS = [
    rf"^{_SORRY}(?:as an? (?:ai|language|large language)[\w ]*,? )?i ?{_CANNOT} {_HELP}\b",
    rf"^{_SORRY}i (?:have to|must) (?:decline|refuse)\b",
    rf"^{_SORRY}as an? (?:ai|language|large language)[\w ]*,? i ?(?:{_CANNOT}|am|['’]m)\b",
    rf"^{_SORRY}it is not possible for me to {_HELP}\b",
    rf"^{_SORRY}my (?:guidelines|rules|policies|instructions|programming|usage rules) (?:do(?: not|n['’]t) (?:allow|let|permit)|prevent|forbid|keep|prohibit|stop)\b",
    rf"^{_SORRY}(?:no (?:answer|reasoning|reply|response|comment|help) (?:can|will|may) be (?:given|provided|offered))\b",
    rf"^{_SORRY}(?:talking|speaking|reasoning|answering|commenting|writing|thinking)\b.{{0,120}}\bgoes against my\b",
    rf"^{_SORRY}that (?:is|['’]s|falls) (?:not something i|outside)\b",
    r"^(?:es tut mir leid|tut mir leid|leider|entschuldigung)\b.{0,80}\b(?:darf|kann|möchte|werde) ich\b.{0,40}\bnicht\b|^(?:es tut mir leid|tut mir leid|leider|entschuldigung)\b.{0,60}\bich (?:darf|kann)\b|^dabei kann ich (?:leider )?nicht\b|^als (?:sprachmodell|ki)\b.{0,60}\bnicht\b|^(?:das|diese frage|darüber) (?:darf|kann|möchte) ich (?:leider )?nicht\b|^ich (?:kann|darf) (?:ihnen |dir )?(?:dabei |darauf |dazu |diese frage )?(?:leider )?nicht (?:helfen|antworten|beantworten|sagen)",
    r"^(?:je suis désolée?|désolée?|malheureusement|je regrette)\b.{0,40}\bje ne (?:peux|puis|suis)\b|^je ne (?:peux|puis) (?:pas )?(?:vous |t['’])?(?:répondre|aider|continuer|en parler)|^je ne suis pas en mesure\b|^en tant que (?:modèle|ia|intelligence)\b.{0,60}\b(?:ne|pas)\b|^il ne m['’]est pas possible\b",
    r"^(?:lo siento|lo lamento|lamentablemente|perdona|disculpa)\b.{0,30}\bno (?:puedo|me es posible|estoy)\b|^como (?:modelo de lenguaje|ia|modelo)\b.{0,30}\bno\b|^no (?:puedo|me es posible) (?:ayudar|responder|contestar|hablar|continuar)|^no estoy en condiciones\b",
    r"^(?:przykro mi|przepraszam|niestety)\b.{0,30}\bnie (?:mogę|jestem|wolno)\b|^nie mogę (?:odpowiedzieć|pomóc|o tym|kontynuować)|^jako (?:model|sztuczna)\b.{0,60}\bnie\b|^nie (?:jestem w stanie|wolno mi)\b",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in _REFUSALS), re.I)
_STOP = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+")
#: Sentences that may follow a refusal.
_POLITE = re.compile(r"^(?:thank you|thanks|please|is there|you may|you could|let me know|feel free|if you|i hope|sorry|instead|maybe|danke|bitte|merci|gracias|dziękuję|perhaps)\b|\binstead\b|\bunderstanding\b|\?$", re.I)


def refuses(text: str) -> bool:
    """The response opens with a refusal and goes on with courtesies at most."""
    t = text.strip(" \t\r\n\"'“”*>_" + INVISIBLE)
    if not _REFUSAL.match(t):  # all patterns stand at the beginning
        return False
    rest = [s for s in _STOP.split(t)[1:] if s.strip()]
    real = [s for s in rest if not _POLITE.search(s.strip()) and not _REFUSAL.match(s.strip())]
    return len(real) <= 1 and not t.startswith(("cannot", "can't"))
