"""Personal information inside free text: anchors found by Aho-Corasick, expanded by local parsers.

One automaton finds the anchors of a text in a single pass: at-signs and their spelt forms, digits,
street words, titles, given names and the cues that go before or after a person's name. Each anchor has a
deterministic parser that looks only at the characters around it, expands the mention to both sides and
validates it: identity numbers named as such by a cue are taken as they are, all others, and account and
card numbers (kind ``id_number``), need right check digits or an issuable form. A name needs a cue, or a
title or given name followed by capitals. Where mentions overlap, the kind earlier in ``KINDS`` wins, then
the earlier and longer one. Names of the ``public_names`` given (players the shoes are named after,
brands) are no mentions; more of them than may be broadcast are anti-joined instead.

The work is one pass without a shuffle, linear in the text's length. Positions count characters of
the text as it is. Defined results: null and empty texts have no mention; repeated rows give repeated
mentions; texts without any anchor come back unchanged; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtmill.session import named

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "address": "[ADDRESS]", "name": "[NAME]"}
MOST_PUBLIC_NAMES = 200_000
#: Characters a parser may look at on either side of its anchor.
REACH = 160
#: The same for emails (a local part has at most 64 characters, a domain 255), and for numbers, which are parsed from their first digits on.
EMAIL_BACK, EMAIL_AHEAD = 200, 320
NUMBER_BACK, NUMBER_AHEAD = 30, 160

_HYPHEN = r"(?:-|‑|–|&#8209;|&#45;|&#x2011;)"
_APOS = r"(?:'|’|&#39;|&apos;|&rsquo;|â€™)"
_AT = r"(?:\s?@\s?|\s*[\[(]\s*at\s*[\])]\s*|\s*&#64;\s*)"
_DOT = r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_LOCAL = rf"[a-z0-9_](?:[a-z0-9_+.%]|{_HYPHEN})*"
_LABEL = rf"[a-z0-9](?:[a-z0-9]|{_HYPHEN}(?=[a-z0-9]))*"
_EMAIL = re.compile(rf"(?<![\w.+%&;-])(?P<m>{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,}})", re.I)
_EMAIL_WORDS = re.compile(rf"(?<![\w.+%&;-])(?P<m>{_LOCAL}\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+[a-z]{{2,}})\b", re.I)

_SEP = rf"(?:[ \t\u00a0./]|{_HYPHEN})"
_END = rf"(?!\w|{_HYPHEN}\w|[./]\d)"
_START = r"(?<![\w+@#$€./&-])(?<!\d[ ,:])"
_EXT = r"(?:\s*(?:ext\.?|x|extension|Durchwahl)\s*\d{1,5})?"
_PHONES = [
    re.compile(rf"(?<![\w+])(?P<m>\+\d{{1,3}}{_SEP}?(?:\(\d{{1,4}}\){_SEP}?)?\d{{1,4}}(?:{_SEP}?\d{{2,6}}){{1,4}}{_EXT}){_END}", re.I),
    re.compile(rf"(?<![\w+(])(?P<m>\(\d{{3}}\)\s?\d{{3}}{_SEP}\d{{4}}{_EXT}){_END}", re.I),
    re.compile(rf"(?<![\w+(])(?P<m>\(0\)\d{{1,5}}{_SEP}\d{{2,6}}(?:{_SEP}\d{{2,6}}){{0,2}}){_END}"),
    re.compile(rf"{_START}(?P<m>(?:1{_SEP})?[2-9]\d{{2}}(?P<s>{_SEP})\d{{3}}(?P=s)\d{{4}}{_EXT}){_END}", re.I),
    re.compile(rf"{_START}(?P<m>[2-9]\d{{9}}){_END}"),
    re.compile(rf"{_START}(?P<m>0\d{{1,4}}\s?/\s?\d{{4,9}}){_END}"),
    re.compile(rf"(?<![\w+@#$€./&-])(?P<m>0[1-9](?:{_SEP}\d{{2}}){{4}}){_END}"),
    re.compile(rf"(?<![\w+@#$€./&-])(?P<m>0\d{{2,3}}{_SEP}\d{{3,4}}{_SEP}\d{{3,4}}){_END}"),
]
def _ssn(x: str) -> bool:
    return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"


def _nino(x: str) -> bool:
    return x[0] not in "DFIQUV" and x[1] not in "DFIOQUV" and x[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def _dni(x: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(x[:8]) % 23] == x[8]


def _nie(x: str) -> bool:
    return _dni(str("XYZ".index(x[0])) + x[1:])


def _nir(x: str) -> bool:
    return len(x) == 15 and 97 - int(x[:13]) % 97 == int(x[13:])


def _card(x: str) -> bool:
    digits = [int(c) for c in reversed(x)]
    return len(set(x)) > 1 and (sum(digits[::2]) + sum(sum(divmod(2 * c, 10)) for c in digits[1::2])) % 10 == 0


def _iban(x: str) -> bool:
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


#: Shapes of identity, card and account numbers, each with what makes it one without a cue.
_IDS = [
    (re.compile(rf"{_START}(?P<m>\d{{3}}(?P<s>\s|{_HYPHEN})\d{{2}}(?P=s)\d{{4}}){_END}"), _ssn),
    (re.compile(rf"{_START}(?P<m>[A-Z]{{2}}\s?\d{{2}}(?:\s?\d{{2}}\s?\d{{2}}|\s\d{{1,2}}\s\d{{1,2}})\s?[A-D]){_END}", re.I), _nino),
    (re.compile(rf"{_START}(?P<m>\d{{8}}{_HYPHEN}?[A-Z]){_END}", re.I), _dni),
    (re.compile(rf"{_START}(?P<m>[XYZ]{_HYPHEN}?\d{{7}}{_HYPHEN}?[A-Z]){_END}", re.I), _nie),
    (re.compile(rf"{_START}(?P<m>[12]\s?\d{{2}}\s?\d{{2}}\s?\d{{2,3}}\s?\d{{3}}\s?\d{{2,3}}\s?\d{{2}}){_END}"), _nir),
    (re.compile(rf"{_START}(?P<m>[3-6]\d{{3}}(?P<s>[ ]|{_HYPHEN}|)(?:\d{{4}}(?P=s)\d{{4}}(?P=s)\d{{4}}|\d{{6}}(?P=s)\d{{5}})){_END}"), _card),
]
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}")
#: Shapes that are identity numbers only after a cue.
_CUED_IDS = re.compile(rf"{_START}(?P<m>[A-Z]{{0,3}}\d(?:[\s-]?\d){{6,14}}(?:{_HYPHEN}?[A-Z])?){_END}", re.I)
_ID_CUE = re.compile(r"passport|passeport|pasaporte|reisepass|social security|\bssn\b|national id|\bdni\b|\bnie\b|ausweis|identity|carte d.identit|id number|numéro de sécu", re.I)

_CAP = r"[A-ZÀ-ÖØ-ÞÃÂ](?:[\w'’À-ÿÃ¤¼¶Ÿ-]|&#8209;)*"
_UNIT = r"(?:\s*#\s?\d+\w?|,?\s+(?i:Apt|Apartment|Unit|Suite|Ste|Flat|Floor)\.?\s*#?\w+)?"
_CITY = rf"(?:,\s+(?!Apt\b|Unit\b)(?:{_CAP})(?:\s{_CAP}){{0,2}}(?:\s+\d{{4,5}}\b)?)?"
_US = re.compile(
    rf"(?<![\w.,:/#-])(?<!\d\s)(?P<m>\d{{1,5}}[a-z]?\s+(?:{_CAP}\s+){{1,3}}(?i:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Way|Boulevard|Blvd|Place|Pl|Terrace|Circle|Square)\b\.?{_UNIT}{_CITY})"
)
_FR = re.compile(rf"(?<![\w.,:/#-])(?P<m>\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?i:rue|avenue|impasse|boulevard|place|chemin|all[ée]e|quai|cours|route)\s+(?:(?i:de|du|des|la|le|les|l'|d')\s*)*{_CAP}(?:\s{_CAP}){{0,3}}(?:,\s+\d{{5}}\s+{_CAP})?)")
_ES = re.compile(rf"(?<!\w)(?P<m>(?i:Calle|C/|C\.|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrera|Ronda)\s+(?:(?i:de|del|la|las|los|el)\s+)*(?:{_CAP}\s+){{0,3}}{_CAP},?\s+(?:n[ºo°]\s?)?\d{{1,4}}(?:,\s+\d{{1,2}}\s?(?:º|°|Âº|ª|\.º)?\s?[A-Z]?\b)?(?:,\s+\d{{5}}\s+{_CAP})?)")
_DE_WORD = r"(?i:straße|strasse|straÃŸe|stra&#223;e|str\.|gasse|weg|allee|platz|ring|ufer|damm|graben|steig|chaussee)"
_DE = re.compile(
    rf"(?<!\w)(?P<m>(?:(?i:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Alte[rns]?|Neue[rns]?|Gro(?:ß|ss)e|Kleine|Obere|Untere|Lange|Hohe)\s+){{0,2}}"
    rf"(?:{_CAP}{_DE_WORD}|{_CAP}\s(?i:Straße|Strasse|Weg|Allee|Platz))\s+\d{{1,4}}\s?[a-f]?\b(?:,\s+\d{{5}}\s+{_CAP})?)"
)
_STREETS = {
    _US: "street st. st, st avenue ave road rd drive dr lane ln court way boulevard blvd place terrace circle square".split(),
    _FR: "rue avenue impasse boulevard chemin allée allee quai".split(),
    _ES: "calle c/ avenida avda plaza paseo camino ronda".split(),
    _DE: "straße strasse straãÿe str. gasse weg allee platz ring ufer damm graben steig chaussee".split(),
}

_WORD = rf"(?:[^\W\d_]+(?:(?:{_APOS}|{_HYPHEN})[^\W\d_]+)*)"
_INITIAL = r"(?:[^\W\d_]\.)"
_LAST_FIRST = rf"{_WORD},\s{_WORD}(?:\s(?:{_INITIAL}|{_WORD}))?"
_FULL = rf"{_WORD}(?:\s(?:{_INITIAL}|{_WORD}))?\s{_WORD}"
_TITLES = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Sra|Srta|Sr|Herr|Herrn|Frau|Mme|Mlle|M|Don|Doña|Coach)"
_TITLE = rf"(?:{_TITLES}\b\.?\s+)*"
_ANY = rf"(?!{_TITLES}\b)(?P<m>{_LAST_FIRST}|{_FULL}|{_WORD}\s{_INITIAL}|{_WORD})"
#: Cues before a name, with what must follow it; fixed phrases of four languages.
_BEFORE = {
    "my name is": rf"\s+{_TITLE}{_ANY}(?=\s+and\b|[.,;!])",
    "i am called": rf"\s+{_TITLE}{_ANY}(?=\s+and\b|[.,;!])",
    "ich heiße": rf"\s+{_TITLE}{_ANY}(?=\s*,|\s+und\b|\s*[.;])",
    "ich heiãÿe": rf"\s+{_TITLE}{_ANY}(?=\s*,|\s+und\b|\s*[.;])",
    "ich heisse": rf"\s+{_TITLE}{_ANY}(?=\s*,|\s+und\b|\s*[.;])",
    "mein name ist": rf"\s+{_TITLE}{_ANY}(?=\s*,|\s+und\b|\s*[.;])",
    "me llamo": rf"\s+{_TITLE}{_ANY}(?=\s+y\b|[.,;])",
    "mi nombre es": rf"\s+{_TITLE}{_ANY}(?=\s+y\b|[.,;])",
    "m'appelle": rf"\s+{_TITLE}{_ANY}(?=\s*,\s|\s+et\b|\s*[.;])",
    "m’appelle": rf"\s+{_TITLE}{_ANY}(?=\s*,\s|\s+et\b|\s*[.;])",
    "m&#39;appelle": rf"\s+{_TITLE}{_ANY}(?=\s*,\s|\s+et\b|\s*[.;])",
    "mâ€™appelle": rf"\s+{_TITLE}{_ANY}(?=\s*,\s|\s+et\b|\s*[.;])",
    "ask for": rf"\s+{_TITLE}{_ANY}(?=\s+at\b)",
    "customer:": rf"\s*{_TITLE}{_ANY}(?=\s*;|\s*[\n,]|\s*$)",
    "receipt shows": rf"\s+{_TITLE}{_ANY}(?=\s*,?\s+passport\b|\s*[,;])",
    "in-law": rf"\s+{_TITLE}{_ANY}(?=\s+[a-z]+s\b)",
    "in&#8209;law": rf"\s+{_TITLE}{_ANY}(?=\s+[a-z]+s\b)",
    "in‑law": rf"\s+{_TITLE}{_ANY}(?=\s+[a-z]+s\b)",
    "phone of": rf"\s+{_TITLE}{_ANY}(?=\s*(?:<|&lt;|,|\.|\n|$))",
    "signed as": rf"\s+{_TITLE}(?P<m>{_LAST_FIRST}|{_FULL}|{_WORD}\s{_INITIAL}|{_WORD})(?=[.;!?]|\s*\n|\s*$)",
    "refund went to": rf"\s+{_TITLE}{_ANY}(?=\s+instead\b|[.,;])",
}
_BEFORE_RE = {cue: re.compile(tail, re.I) for cue, tail in _BEFORE.items()}
_TOLD = re.compile(rf"(?:^|[\n\r>]|[.?!…:;\"”»)\]]\s|\s-\s|\d\s|\s\s)\s*{_TITLE}(?P<m>{_LAST_FIRST}|{_FULL})\s+$", re.I)
_TOLD_INSIDE = re.compile(rf"(?<!\w)(?P<m>[A-ZÀ-Þ]{_WORD}(?:[ \t](?:{_INITIAL}|[A-ZÀ-Þ]{_WORD}))?[ \t][A-ZÀ-Þ]{_WORD})\s+$")
_NO_NAME = frozenset("a an the my our your his her their this that these those and or but if we i you it he she they everyone nobody someone who what when die der das ein eine le la les un une el los las".split())
#: Common given names of four languages; a capitalised word must follow.
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Edward Peter Frank Henry Jack Samuel Benjamin Noah Liam Lucas Ethan Oliver Leo Adam Simon "
    "Martin Jonas Felix Lukas Moritz Oskar Hans Klaus Jürgen Stefan Andreas Tobias Sebastian Markus Wolfgang Dieter Hugo Louis Jules Antoine Pierre Jean Michel Philippe Nicolas Julien Mathieu Luc "
    "Carlos José Juan Luis Miguel Javier Diego Pablo Alejandro Rafael Manuel Fernando Sergio Mario "
    "Mary Maria Marie Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Emily Emma Olivia Sophia Sofia Isabella Mia Charlotte Amelia Anna Hannah Laura Julia Lena Lea Clara "
    "Ingrid Greta Heidi Petra Sabine Monika Ursula Claudia Katrin Birgit Lucie Camille Chloé Manon Sophie Claire Nathalie Isabelle Céline Élodie Carmen Lucía Elena Marta Pilar Rosa Isabel Teresa Ana Paula Jane Helen Alice Grace Kate Rachel Rebecca Ruth Victoria"
).split()
_SURNAME = r"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[a-zà-ÿ][\w'’À-ÿ-]*"
_AFTER_GIVEN = re.compile(rf"(?:[ ][A-Z]\.)?[ ]{_SURNAME}")  # a third word may be the next sentence's
#: Titles, verbs and labels that a person's name follows, and words a letter closes with.
TITLED = ("mr", "mrs", "ms", "dr", "prof", "herr", "herrn", "frau", "sra", "srta", "sr", "mme", "mlle", "señor", "señora", "monsieur", "madame")
SPOKEN = ("spoke with", "spoke to", "talked with", "talked to", "met with", "contact", "attn", "name", "signed", "emailed", "wrote to", "gesprochen mit", "hablé con", "parlé avec", "ansprechpartner", "contacto")
CLOSERS = ("best", "thanks", "many thanks", "thank you", "cheers", "yours", "best wishes", "warmly", "un saludo", "mfg", "à bientôt", "atentamente", "danke", "merci", "gracias")
_AFTER_TITLE = re.compile(rf"\.?[ ](?P<m>{_SURNAME}(?:[ ](?:[A-Z]\.[ ])?{_SURNAME}){{0,2}})")
_AFTER_SPOKEN = re.compile(rf":?[ ](?:(?:{'|'.join(t.capitalize() for t in TITLED)})\b\.?[ ])*(?P<m>{_SURNAME}[ ](?:[A-Z]\.[ ])?{_SURNAME})")
_AFTER_CLOSER = re.compile(rf"[,.!]?[ \t]*\r?\n[ \t]*(?P<m>{_SURNAME}(?:[ ](?:[A-Z]\.|{_SURNAME})){{1,2}})[ \t]*(?=[\r\n]|$)")
_REGARDS = re.compile(rf",?\s+{_TITLE}(?P<m>{_LAST_FIRST}(?=\s*(?:[\r\n]|$|\s\d))|(?:{_WORD}|{_INITIAL})(?:[ \t]+(?:{_WORD}|{_INITIAL})){{1,2}}(?=\s*(?:[\r\n\d(+]|$|C/|Calle|Avenida|Am\s|Alte\s|{_CAP}{_DE_WORD})))", re.I)
_CLOSINGS = ("regards", "sincerely", "grüße", "gruß", "saludos", "cordialement", "thanks,", "cheers,")
_DASH = re.compile(r"(?:^|(?<=[\n\r])|(?<=[.!?…]\s)|(?<=[.!?…]))[ \t]*(?P<d>-{1,2}|–|—|&#8209;|‑)[ \t]+")
_TOKEN = re.compile(rf"({_INITIAL}|{_WORD})(,?)")


def lowered(text: str) -> str:
    """Lower case with every character kept in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=1)
def automaton():
    """The anchors, by kind of parser."""
    import ahocorasick

    anchors: dict[str, list[tuple[str, object]]] = {}
    for word, what in (("@", "email"), ("(at)", "email"), ("[at]", "email"), ("( at )", "email"), ("&#64;", "email"), (" at ", "email_words"), ("\nat ", "email_words"), (" told me", "told")):
        anchors.setdefault(word, []).append((what, None))
    for digit in "0123456789":
        anchors.setdefault(digit, []).append(("number", None))
    for pattern, streets in _STREETS.items():
        for word in streets:
            anchors.setdefault(word, []).append(("street", pattern))
    for cue, pattern in _BEFORE_RE.items():
        anchors.setdefault(cue, []).append(("cue", pattern))
    for word in _CLOSINGS:
        anchors.setdefault(word, []).append(("closing", None))
    for group, kind in ((TITLED, "titled"), (SPOKEN, "spoken"), (CLOSERS, "closer")):
        for word in group:
            anchors.setdefault(word, []).append((kind, None))
    for word in GIVEN:
        anchors.setdefault(word.lower() + " ", []).append(("given", None))
    for word in ("- ", "– ", "— ", "&#8209; ", "‑ "):
        anchors.setdefault(word, []).append(("dash", None))
    machine = ahocorasick.Automaton()
    for word, what in anchors.items():
        machine.add_word(word, (len(word), what))
    machine.make_automaton()
    return machine


def _around(pattern: re.Pattern, text: str, at: int, ahead: int = REACH, back: int = REACH) -> tuple[int, int] | None:
    """The match of ``pattern`` that covers position ``at``."""
    low = max(0, at - back)
    for m in pattern.finditer(text, low, min(len(text), at + ahead)):
        if m.start("m") <= at < m.end("m"):
            return m.span("m")
        if m.start("m") > at:
            return None
    return None


def _signature(text: str, begin: int) -> tuple[int, int] | None:
    """A signature that starts at ``begin``: two or three words that look like a person's name."""
    tokens, at = [], begin
    while len(tokens) < 4:
        m = _TOKEN.match(text, at)
        if not m:
            break
        tokens.append(m)
        gap = re.compile(r"[ \t]+").match(text, m.end())
        if not gap:
            break
        at = gap.end()
    if len(tokens) < 2:
        return None
    words = [t.group(1) for t in tokens]
    if tokens[0].group(2):  # Last, First
        end = tokens[1].end(1)
        return (begin, end) if all(w[0].isupper() or w.islower() for w in words[:2]) and words[0].lower() not in _NO_NAME and (words[0][0].isupper() and words[1][0].isupper()) else None
    if any(t.group(2) for t in tokens[:1]):
        return None
    shape = (lambda w: w.isupper()) if words[0].isupper() and len(words[0]) > 1 else (lambda w: w[:1].isupper())
    n = 0
    while n < min(3, len(words)) and shape(words[n]):
        n += 1
        if tokens[n - 1].group(2):
            break
    if n < 2 and words[0].islower():  # a lower-case name alone on its line
        line = re.compile(rf"({_WORD}(?:[ \t]+(?:{_INITIAL}|{_WORD})){{1,2}})[ \t]*(?=[\r\n]|$)").match(text, begin)
        return line.span(1) if line else None
    if n == 3 and not words[0].isupper():
        after = re.compile(r"\s*(\S+)").match(text, tokens[2].end())
        follows = after.group(1) if after else ""
        same_line = "\n" not in text[tokens[2].end() : after.start(1)] if after else False
        starts_sentence = len(words[2]) <= 2 and not words[2].endswith(".")
        if starts_sentence or (same_line and follows and not follows[0].isupper()):  # the third word is the next sentence's
            n = 2
    if n < 2 or words[0].lower() in _NO_NAME or words[n - 1].endswith("."):
        return None
    return begin, tokens[n - 1].end(1)


def find(text: str | None, public: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each mention, by start."""
    if not text:
        return []
    hits: set[tuple[str, int, int]] = set()
    low = lowered(text)
    done = -1  # end of the last run of digits looked at
    for end, (size, whats) in automaton().iter(low):
        at = end - size + 1
        for what, pattern in whats:
            span = None
            if what == "email":
                span, kind = _around(_EMAIL, text, at, EMAIL_AHEAD, EMAIL_BACK), "email"
            elif what == "email_words":
                span, kind = _around(_EMAIL_WORDS, text, at, EMAIL_AHEAD, EMAIL_BACK), "email"
            elif what == "number":
                if at <= done:
                    continue
                done = at
                while done + 1 < len(text) and text[done + 1].isdigit():
                    done += 1
                for kind, found in _numbers(text, at):
                    hits.add((kind, *found))
                continue
            elif what == "street":
                span, kind = _around(pattern, text, at), "address"
            elif what == "cue":
                m = pattern.match(text, end + 1, min(len(text), end + REACH))
                span, kind = m and m.span("m"), "name"
            elif what == "told":
                m = _TOLD.search(text, max(0, at - REACH), at + 1) or _TOLD_INSIDE.search(text, max(0, at - REACH), at + 1)
                span, kind = m and m.span("m"), "name"
            elif what == "closing":
                m = _REGARDS.match(text, end + (0 if text[end] == "," else 1), min(len(text), end + REACH))
                span, kind = m and m.span("m"), "name"
            elif what in ("titled", "spoken", "closer", "given"):
                span, kind = _capitalised(text, at, end + 1, what), "name"
            else:
                begin = end + 1
                m = _DASH.search(text, max(0, at - 3), begin)
                span, kind = (_signature(text, begin) if m and m.end() == begin else None), "name"
            if span and not (kind == "name" and _is_public(text[span[0] : span[1]], public)):
                hits.add((kind, *span))
    hits |= {("id_number", *span) for span in _accounts(text)}
    return _without_overlaps(hits)


def _capitalised(text: str, at: int, end: int, what: str) -> tuple[int, int] | None:
    """A capitalised name after the title, verb, closing or given name at ``at`` (to ``end``, exclusive)."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "_@#&-'’."):
        return None
    if what == "given":
        m = _AFTER_GIVEN.match(text, end - 1) if text[at].isupper() and text[at + 1].islower() else None
        return (at, m.end()) if m else None
    if what == "closer":
        m = _AFTER_CLOSER.match(text, end) if not text[text.rfind("\n", 0, at) + 1 : at].strip() else None
    else:
        m = (_AFTER_TITLE if what == "titled" else _AFTER_SPOKEN).match(text, end) if what == "spoken" or text[at].isupper() else None
    return m.span("m") if m else None


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of the international form: the longest stretch with right check digits."""
    for m in _IBAN.finditer(text):
        ends = [i for i in range(m.end(), m.start() + 14, -1) if text[i - 1] != " " and (i == len(text) or not text[i].isalnum())]
        end = next((i for i in ends if _iban(text[m.start() : i].replace(" ", ""))), None)
        if end:
            yield m.start(), end


def _bare(number: str) -> str:
    return re.sub(r"[^0-9A-Z]", "", re.sub(_HYPHEN, "", number).upper())


def _numbers(text: str, at: int) -> Iterator[tuple[str, tuple[int, int]]]:
    low = max(0, at - 60)
    cued = _ID_CUE.search(text, low, at)
    if cued and (span := _around(_CUED_IDS, text, at, NUMBER_AHEAD, 6)):
        if not any(_around(p, text, at, NUMBER_AHEAD, 24) for p in _PHONES[:3]):
            yield "id_number", span
            return
    for pattern, valid in _IDS:
        if (span := _around(pattern, text, at, NUMBER_AHEAD, 24)) and (cued or valid(_bare(text[slice(*span)]))):
            yield "id_number", span
            return
    for pattern in _PHONES:
        if (span := _around(pattern, text, at, NUMBER_AHEAD, NUMBER_BACK)) and 7 <= sum(c.isdigit() for c in text[span[0] : span[1]]) <= 20:
            yield "phone", span
            return


def name_key(name: str) -> str:
    """A name as it is compared with public ones: its words in lower case."""
    return " ".join(re.findall(r"[^\W\d_]+", name.lower()))


def _is_public(name: str, public: frozenset[str]) -> bool:
    key = name_key(name)
    return key in public or key.split(" ", 1)[0] in _NO_NAME


def _without_overlaps(hits: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    kept: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    import bisect

    for kind, start, end in sorted(hits, key=lambda h: (KINDS.index(h[0]), h[1], -h[2])):
        i = bisect.bisect_left(taken, (start, end))
        if (i < len(taken) and taken[i][0] < end) or (i > 0 and taken[i - 1][1] > start):
            continue
        bisect.insort(taken, (start, end))
        kept.append((kind, start, end))
    return sorted(kept, key=lambda h: h[1])


def redact(text: str | None, mentions: list[tuple[str, int, int]]) -> str | None:
    """The text with each mention replaced by its placeholder."""
    if text is None:
        return None
    parts, at = [], 0
    for kind, start, end in mentions:
        parts += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*parts, text[at:]])


def public_names(*columns: DataFrame, most: int = MOST_PUBLIC_NAMES) -> frozenset[str] | DataFrame:
    """Names that are no private person's, from one-column tables: a set of at most ``most``, or else their table (n)."""
    found: frozenset[str] | None = frozenset()
    for df in columns:
        names = df.select(F.lower(df.columns[0]).alias("n")).filter("n is not null").distinct().limit(most + 1).collect()  # at most `most` + 1 rows
        found = found | {name_key(r.n) for r in names} if found is not None and len(names) <= most else None
    if found is not None:
        return found
    every = [df.select(F.array_join(F.regexp_extract_all(F.lower(df.columns[0]), F.lit(r"\p{L}+"), 0), " ").alias("n")) for df in columns]
    return reduce(DataFrame.unionByName, every).filter("n is not null").distinct()


def mentions(documents: DataFrame, public: frozenset[str] | DataFrame = frozenset(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pii_type, start_pos, end_pos): one row per mention."""
    rows = documents.select(named(key).alias("k"), named(text).alias("t"))
    return _mentions(rows, public).select(F.col("k").alias(key), "pii_type", "start_pos", "end_pos")


def _mentions(rows: DataFrame, public: frozenset[str] | DataFrame) -> DataFrame:
    """(k, h, pii_type, start_pos, end_pos, n) of (k, t); ``h`` is a hash of the text, ``n`` a name's key."""
    kind = rows.schema["k"].dataType.simpleString()
    joined = isinstance(public, DataFrame)
    shared = rows.sparkSession.sparkContext.broadcast(frozenset() if joined else public)  # at most MOST_PUBLIC_NAMES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, h, *m, name_key(t[m[1] : m[2]]) if joined and m[0] == "name" else None) for k, h, t in zip(batch["k"], batch["h"], batch["t"], strict=True) for m in find(t, shared.value)]
            out = pd.DataFrame(found, columns=["k", "h", "pii_type", "start_pos", "end_pos", "n"])
            yield out.astype({"h": "int64", "start_pos": "int32", "end_pos": "int32", "n": object})

    out = rows.select("k", F.xxhash64("t").alias("h"), "t").mapInPandas(run, f"k {kind}, h bigint, pii_type string, start_pos int, end_pos int, n string")
    return out.join(public, "n", "left_anti") if joined else out


def redacted(documents: DataFrame, public: frozenset[str] | DataFrame = frozenset(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_mentions): each text with typed placeholders."""
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(named(key).alias("k"), named(text).alias("t"))
    if isinstance(public, DataFrame):
        spans = _mentions(rows, public).groupBy("k", "h").agg(F.collect_set(F.struct("start_pos", "end_pos", "pii_type")).alias("spans"))
        rows = _with_spans(rows, spans)
    else:
        rows = rows.withColumn("spans", F.lit(None).cast("array<struct<start_pos:int,end_pos:int,pii_type:string>>"))
    joined = isinstance(public, DataFrame)
    shared = documents.sparkSession.sparkContext.broadcast(frozenset() if joined else public)  # at most MOST_PUBLIC_NAMES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if joined:
                found = [sorted(((s["pii_type"], s["start_pos"], s["end_pos"]) for s in spans), key=lambda m: m[1]) if spans is not None else [] for spans in batch["spans"]]
            else:
                found = [find(t, shared.value) for t in batch["t"]]
            new = [redact(t if isinstance(t, str) else None, m) for t, m in zip(batch["t"], found, strict=True)]
            yield pd.DataFrame({"k": batch["k"], "text": pd.Series(new, index=batch.index, dtype=object), "n_mentions": pd.Series([len(m) for m in found], index=batch.index, dtype="int32")})

    out = rows.select("k", "t", "spans").mapInPandas(run, f"k {kind}, text string, n_mentions int")
    return out.withColumnRenamed("k", key)


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(k, t, spans): the mentions of each text beside it."""
    theirs = spans.select(F.col("k").alias("k2"), F.col("h").alias("h2"), "spans")
    return rows.withColumn("h", F.xxhash64("t")).join(theirs, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left").select("k", "t", "spans")
