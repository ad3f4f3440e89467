"""Personal information inside free text: weak labelers, expectation-maximisation, a span classifier, placeholders.

Candidates of each kind come from generous patterns over the whole text; a name or an address may go on in the next line.
Six labelers vote +1, -1 or 0 (abstain) on each: the exact format (for names a gazetteer of given names), words of the
context, signs against the kind, the words before and the words after, whose votes are learned from the corpus itself by
how many of the candidates next to them are sure ones, and one sign of the kind's own (for names the first name's company).

Candidates are counted by kind and votes, a table of a few hundred rows whatever the size of the corpus. On it
expectation-maximisation estimates how reliable each labeler is and with that the probability of each pattern of votes. A
logistic regression over features of the span and its neighbours (shape, character n-grams, words beside it) and the votes is
trained on these probabilities, on at most ``sample_rows`` candidates (the least hashes of their places) that a labeler
votes on. It decides every candidate. Of candidates that overlap, the first by kind (email, id_number, phone, address, name), probability and length
stays.

Null and empty texts hold nothing. A repeated doc_id is read once per row and its mentions count once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from . import linear

#: Given names go to all tasks; a longer list is refused, never cut.
MOST_NAMES = 1_000_000
KINDS = ("email", "id_number", "phone", "address", "name")

_LOCAL = r"[\w.%+\-]*[\w%+\-]"
_LABEL = r"[\w](?:[\w\-]*[\w])?"
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|AT|@|arroba|chez|ät)\s?[\])}>]\s?|\s(?:AT|at)\s(?=\S+\s?(?:[\[({]\s?dot|dot\b|DOT\b)))"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|\.|punkt|punto|point)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![\w.%+\-/:@]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|(?<=mailto:){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|(?<=[:=])(?<!//){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+")
_PHONE = re.compile(r"(?<![\w.+/\-])(?:\+|\(|\d)[\d()./ \-]{6,22}\d(?![\w])")
_ID = re.compile(
    r"(?<![\w\-+])(?:\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-D]|[A-Z]{1,2}[ \-]?\d{3}[ \-]?\d{4}|[A-Z]{2}\d{6,7}|\d{8}[ \-]?[A-Z]|[XYZ][ \-]?\d{7}[ \-]?[A-Z]|\d[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}(?:[ ]?\d{2})?|"
    r"\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}|[A-Z]\d{2}[A-Z0-9]{5,6}\d?|\d{9})(?![\w\-])"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*[\w](?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*"
_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Close|Avenue|Ave|Drive|Dr|Court|Ct|Way|Square|Sq|Terrace|Boulevard|Blvd|Crescent|Cres|Place|Row|Mews|Hill|Gardens|Grove|Parkway|Pkwy|Highway|Hwy|Walk)"
_DE = r"(?:Straße|Strasse|Str\.|Allee|Platz|Weg|Gasse|Ring|Damm|Ufer|Chaussee|Steig|Pfad)"
#: An abbreviated kind keeps its full stop; after any but the first one a capital letter or the line's end may begin a sentence.
_SHORT = r"(?:Blvd\.|(?:St|Rd|Ln|Ave|Dr|Ct|Sq|Cres|Pkwy|Hwy)\.(?=[,;:)]| [a-z]))"
_TAIL = r"(?:[a-z]| [a-d](?=[,.;:)\n]|$))?\b"
#: A blank, or the end of a line inside a mention.
_GAP = r"(?: |[ \t]?\n[ \t]?)"
#: Addresses that begin with the number, and those that end with it.
_NUMBER_FIRST = re.compile(
    rf"(?<![\w.,:\-])\d{{1,5}}[A-Za-z]?(?:-\d{{1,4}})?{_GAP}(?:[NSEW]\. )?(?:(?:{_CAP} ){{1,3}}|(?:{_CAP}{_GAP}){{1,3}})(?:{_SHORT}|{_EN}\b)|"
    rf"(?<![\w.,:\-])\d{{1,4}}(?: ?(?:bis|ter|[a-zA-Z]))?,?{_GAP}(?i:rue|avenue|impasse|place|boulevard|bd|allée|chemin|quai|cours|route|square|passage)(?: (?:de la|de l['’]|du|des|de|d['’]))?(?:{_GAP})?{_CAP}(?: {_CAP})*"
)
_NUMBER_LAST = re.compile(
    rf"(?<!\w)(?:Am|Im|An der|An den|Auf der|Auf dem|Hinter der|Hinter dem|Unter den|Zum|Zur|Beim){_GAP}{_CAP}(?:{_GAP}{_CAP})?{_GAP}\d{{1,4}}{_TAIL}|"
    rf"(?<!\w)(?:(?:Am|An der|Alte|Alter|Neue|Große|Kleine) )?(?:{_CAP}{_GAP}){{1,2}}{_DE}(?:\s|(?<=\.))\s?\d{{1,4}}{_TAIL}|(?<!\w)[A-ZÀ-ÖØ-Þ]\w+(?:str\.|straße|strasse|weg|allee|platz|gasse|ring|damm|ufer)(?:{_GAP})?\d{{1,4}}{_TAIL}|"
    rf"(?<!\w)(?:Calle|C/|Plaza|Pza\.|Avenida|Avda\.|Av\.|Paseo|Camino|Ronda|Travesía|Carrera|Rue|Avenue|Impasse)(?: (?:de la|de los|de las|del|de|des|du))?(?:{_GAP})?{_CAP}(?: {_CAP})*,? ?(?:n\.?º ?|núm\. ?)?\d{{1,4}}{_TAIL}"
)
_NUMBER = re.compile(r"(?<![\w.,:\-])\d")
_PARTICLE = r"(?:von der|von dem|von|van der|van den|van|de la|de|del|della|da|di|du|zu|zum|zur|ter|ten|le|la|dos|el|al|af|av)"
_INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
_FORWARD = re.compile(rf"(?=(?<![\w@.\-/#'’])({_CAP}(?: {_INITIAL})*(?: {_PARTICLE})?{_GAP}{_CAP})(?![\w@]|\.\w|-\w))")
_BACKWARD = re.compile(rf"(?=(?<![\w@.\-/#'’])((?:{_PARTICLE} )?{_CAP}, {_CAP}(?: {_INITIAL})*)(?![\w@]|\.\w|-\w))")
_LOWER = re.compile(rf"(?=(?<![\w@.\-/#'’`])([a-zà-öø-þ][\w'’]+(?:-\w+)?(?: [a-zA-Z]\.)*(?: {_PARTICLE})? [a-zà-öø-þ][\w'’]+(?:-\w+)*|[a-zà-öø-þ][\w'’]+(?:-\w+)?, [a-zà-öø-þ][\w'’]+(?:-\w+)*)(?![\w@`]|\.\w))")

_SMALL = re.compile(r"(?<![\w@.\-/#'’`])[a-zà-öø-þ][\w'’]+(?:-\w+)?")

#: What any candidate of a kind holds. Patterns are tried only where it stands.
_HINTS = {
    "email": re.compile(r"@|[\[({<]\s?(?i:at|arroba|chez|ät)\s?[\])}>]|\s(?:at|AT)\s(?=\S+\s?(?:[\[({]\s?dot|dot\b|DOT\b))"),
    "id_number": re.compile(r"\d(?:[ \-]?\d){5}|[A-Z]\d{2}[A-Z0-9]{5}"),
    "phone": re.compile(r"\d[\d()./ \-]{5,}\d"),
}
#: What an address that ends with its number holds. Fixed values.
_STREETS = (
    "traße trasse tr. Allee allee Platz platz Weg weg Gasse gasse Ring Damm damm Ufer ufer Chaussee Steig Pfad "
    "Calle C/ Plaza Pza. Avenida Avda. Av. Paseo Camino Ronda Travesía Carrera Rue Avenue Impasse"
).split() + [w + g for w in ("Am", "Im", "An der", "An den", "Auf der", "Auf dem", "Hinter der", "Hinter dem", "Unter den", "Zum", "Zur", "Beim", "ring") for g in " \n"]
_LINES = 4


def _places(text: str, words) -> Iterator[int]:
    for w in words:
        at = text.find(w)
        while at >= 0:
            yield at
            at = text.find(w, at + 1)


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of lines around kinds of streets: an address has fewer line ends than _LINES before and after its kind."""
    last = (0, -1)
    for at in sorted(_places(text, _STREETS)):
        if at < last[1]:
            continue
        begin, end = at, at
        for _ in range(_LINES + 1):
            begin = text.rfind("\n", 0, max(begin, 0)) if begin > 0 else -1
            end = text.find("\n", end + 1) if end >= 0 else -1
        begin, end = max(begin, 0), len(text) if end < 0 else end
        if begin <= last[1]:
            last = (last[0], max(end, last[1]))
        else:
            if last[1] >= 0:
                yield last
            last = (begin, end)
    if last[1] >= 0:
        yield last


_RUN = re.compile(r"[\w.%+\-]+")


def _emails(text: str) -> Iterator[re.Match]:
    """Matches around each sign or word for at: the local part is a run before it, a domain has at most 253 characters, spelled out
    not more than 600. No part of a text is looked at twice but for domains."""
    done = 0
    for h in _HINTS["email"].finditer(text):
        at = h.start()
        while at > done and text[at - 1] in " \t\n":
            at -= 1
        while at > done and not text[at - 1].isspace():
            at -= 1
        for run in _RUN.finditer(text, at, h.end()):
            if run.start() >= done and (m := _EMAIL.match(text, run.start(), min(len(text), h.end() + 600))):
                done = m.end()
                yield m
        done = max(done, h.start() + 1)  # a local part holds no sign for at


def _matches(kind: str, text: str) -> Iterator[re.Match]:
    if kind == "email":
        yield from _emails(text)
    elif kind == "address":
        found = [m for n in _NUMBER.finditer(text) if (m := _NUMBER_FIRST.match(text, n.start()))]
        found += [m for begin, end in _windows(text) for m in _NUMBER_LAST.finditer(text, begin, end)]
        done = 0
        for m in sorted(found, key=lambda m: m.start()):
            if m.start() >= done:
                done = m.end()
                yield m
    elif _HINTS[kind].search(text):
        yield from (_ID if kind == "id_number" else _PHONE).finditer(text)


_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|mailto|contact|reply|reach|repl|report|reporter|write|écri\w*|signalement|escrib\w*|correo|rückfragen|gemeldet|schreib\w*|signed-off-by|cc|author|invit\w*)\b"),
    "phone": re.compile(r"(?i)\b(?:ring|phone|call(?! chain)|tel|telefon\w*|téléphone|teléfono|pager|on call|reach|joignable|astreinte|anrufen|ausfall|llam\w+|mobile|fax|hotline|dial|guardia|rufnummer|numéro)\b"),
    "id_number": re.compile(r"(?i)(?:\bssn\b|social security|national insurance|\btax\b|passport|\bid\s?=|identifiant|ausweis\w*|steuer|\bdni\b|\bnie\b|\bnif\b|documento|sécurité sociale|seguridad social|identity|\bid card|personalausweis|reisepass|passeport|pasaporte|\bnir\b|insee|\bnino\b|versicherung)"),
    "address": re.compile(r"(?i)\b(?:address|adresse|ship|invoice|home|lives?|domicilio|wohnhaft|livraison|envío|ersatzgerät|someone at|dirección|anschrift|deliver\w*|floor|stock|planta|étage|house|office)\b"),
}
_AGAINST = {
    "email": re.compile(r"(?i)(?:\bgit\b|clone|ssh|\bicon\b|\bping\b|localhost|repository|://)"),
    "phone": re.compile(r"(?i)\b(?:build|version|offset|ratio|rfc|hash|slice|uuid|lines?|stride|node|ticket|ssn|rows?|tax|passport|release|commit dates?|insurance|port|identifiant|ausweisnummer|steuer-id|dni|documento|id=)\b"),
    "id_number": re.compile(r"(?i)\b(?:build|version|offset|ratio|rfc|hash|slice|uuid|lines?|stride|node|ticket|phone|ring|call|pager|tel|astreinte|joignable)\b"),
    "address": re.compile(r"(?i)\b(?:lanes? of|renderer|emitter|vector unit|road map|http)\b"),
}
_EXACT = {
    "email": re.compile(rf"^{_LOCAL}@{_LABEL}(?:\.{_LABEL})+$"),
    "phone": re.compile(r"^(?:\+\d{1,3}[ \-.]?(?:\(0?\d{1,4}\)[ \-.]?)?\d[\d \-.]{5,14}\d|00\d{2}[ \-]?\d[\d \-]{6,13}\d|(?:1[- .])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])\d{3}[-. ]\d{4}|\(0\d{1,4}\)[ \-/]?\d[\d \-]{4,10}\d|0\d{1,4}[/ \-]\d[\d \-]{4,10}\d)$"),
    "id_number": re.compile(r"^(?:\d{2} \d{3} \d{3} \d{3}|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2}\d{6}[A-D]|[A-Z]{2} \d{2} \d{2} \d{2} [A-D]|\d{8}-?[A-Z]|[A-Z]{2}\d{7}|[A-Z]{2} \d{3} \d{4}|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[XYZ]-?\d{7}-?[A-Z])$"),
    "address": re.compile(r"\d"),
}
#: Titles and sentence openers that are no part of a name. Fixed values.
_TITLES = frozenset("herr frau dr mr mrs ms miss prof professor sir madame monsieur mme mlle m señor señora sr sra don doña doctor ing dipl ask the a an and or der die das le la les el los las un une ein eine cc by from to with for dear hi hello thanks merci gracias danke signed".split())


#: What stands right before a person's name: a title or a line of credit.
_BLANKS = str.maketrans({c: " " for c in "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~§—–“”„«»"})
_CREDITED = re.compile(r"(?i)(?<![\w@])(?:mrs?\.|ms\.|dr\.|prof\.|herrn?|frau|monsieur|madame|mme\.?|mlle\.?|señora?|sra?\.|doña|@author|@maintainer|\w+-by:|author:|maintainer:) (?=[a-zà-öø-þ])")
_CREDIT = re.compile(r"(?i)(?:^|[\s(\"'#*/-])(?:mrs?\.?|ms\.?|dr\.?|prof\.?|herrn?|frau|monsieur|madame|mme\.?|mlle\.?|señora?|sra?\.|doña|@author|@maintainer|\w+-by:|author:|maintainer:|cc)\s+$")


def _name_parts(mention: str) -> tuple[str, str, bool]:
    """(given name, last word of the surname, whether the surname came first), in lower case."""
    if ", " in mention:
        surname, given = mention.split(", ", 1)
        return given.split()[0].lower(), surname.split()[-1].lower(), True
    words = mention.split()
    return words[0].lower(), words[-1].lower(), False


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The line's words before and after a span, and the whole line without it."""
    low, high = max(0, start - 80), min(len(text), end + 80)
    a, b = text.rfind("\n", low, start) + 1, text.find("\n", end, high)
    low, high = max(a, low), b if b >= 0 else high
    before = re.sub(r"^\s*(?:[-*]\s+|\d\d:\d\d\s+|(?:user|assistant):\s+)", "", text[low:start])
    return before, text[end:high], before + " " + text[end:high]


def _key(words: list[str]) -> str:
    return " ".join(re.sub(r"\d+", "0", w.lower()) for w in words)


def shape(mention: str) -> str:
    """Letters and digits by class, runs of one class short."""
    return re.sub(r"(.)\1{2,}", r"\1\1+", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", mention)).replace("\n", " "))


def span_features(kind: str, mention: str, left: list[str], right: list[str]) -> list[int]:
    """Places of what a span and its neighbours look like in the classifier's weights."""
    form = shape(mention)
    words = re.findall(r"\w+", mention.lower())
    out = ["", f"s {form}", f"l {_key(left[-1:])}", f"ll {_key(left)}", f"r {_key(right[:1])}", f"rr {_key(right)}", f"n {len(words)}", f"begin {form[:3]}", f"end {form[-3:]}", f"line {chr(10) in mention}"]
    if kind in ("name", "address"):
        long = max(words, key=len, default="")
        out += [f"w {w}" for w in words if not w.isdigit()] + [f"end {w[-3:]}" for w in words] + [f"g {long[i : i + 3]}" for i in range(len(long) - 2)]
    else:
        out += [f"g {form[i : i + 4]}" for i in range(len(form) - 3)] + [f"d {min(sum(c.isdigit() for c in mention), 16)}"]
    return linear.hashed([f"{kind} {x}" for x in out], DIMS)


def _own_sign(kind: str, mention: str, before: str, after: str) -> int:
    if kind == "email":
        domain = re.split(_AT, mention, maxsplit=1)[-1]
        if after[:1] == ":" and after[1:2].strip() or re.search(r"(?i)@\dx\.|\.(?:png|jpe?g|gif|svg|py|go|rs|c|h)$", mention) or before.endswith("://") or len(domain) < 4:
            return -1
        return 1 if before.endswith(("<", "mailto:", '"')) or re.search(r"[\[({<]\s?(?:at|dot)|\s(?:at|AT|@)\s", mention) else 0
    if kind == "phone":
        if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}|\d{4}-\d\d-\d\d.*|\d+\.\d+\.\d+\.\d+|\d{4}\.\d+\.\d+", mention):
            return -1
        return 1 if mention[0] in "+(" or mention.startswith(("0", "1-")) else 0
    if kind == "id_number":
        return -1 if re.fullmatch(r"\d{9}|\d{11}", mention) else 1 if re.search(r"[A-Z]", mention) else 0
    number = max(re.findall(r"\d+", mention), key=len)
    return -1 if len(number) > 4 or re.fullmatch(r"(?:19|20)\d\d", number) else 1 if re.search(r"\d[A-Za-z]\b|\b[NSEW]\. |\bbis\b", mention) else 0


def _strong(kind: str, mention: str) -> bool:
    if kind != "address":
        return bool(_EXACT[kind].search(mention))
    return bool(re.search(rf"{_EN}\.?$", mention) or re.match(r"\d+.*\s(?i:rue|avenue|impasse|place|boulevard)|Calle|C/|Plaza|Avenida|Avda|Paseo", mention) or re.search(r"(?:[Ss]tr\.|[Ss]traße|[Ww]eg|[Aa]llee)\s?\d", mention))


def _neighbours(before: str, after: str) -> tuple[list[str], list[str]]:
    left = re.findall(r"[\w'’.-]+|[^\w\s]", before)[-2:]
    if len(left) == 2 and left[0][-1] in ".!?":
        left = left[1:]
    return left, re.findall(r"[\w'’.-]+|[^\w\s]", after)[:2]


def candidates(text: str, given: frozenset[str]) -> list[tuple]:
    """(kind, start, end, mention, votes, left key, right key, first name, sure, features); null keys at a line's begin and end."""
    out, taken, low = [], [], text.lower()
    if len(low) != len(text):  # one letter has a longer small form
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    for kind in KINDS[:4]:
        for m in _matches(kind, text):
            start, end, mention = m.start(), m.end(), m[0]
            if kind == "phone" and (mention.count("(") != mention.count(")") or not 8 <= sum(c.isdigit() for c in mention) <= 15):
                continue
            if kind == "address":  # a word that announces an address is no part of it
                while (word := re.match(r"(\w+)\s+(?=\S+\s+\S)", mention)) and _CONTEXT[kind].fullmatch(word[1]):
                    start, mention = start + word.end(), mention[word.end() :]
            before, after, _ = _around(text, start, end)
            near = before[-45:] + " § " + after[:45]
            left, right = _neighbours(before, after)
            strong = _strong(kind, mention)
            votes = [int(strong), int(bool(_CONTEXT[kind].search(near))), -int(bool(_AGAINST[kind].search(before[-30:] + " " + after[:12]))), 0, 0, _own_sign(kind, mention, before, after)]
            out.append((kind, start, end, mention, votes, _key(left) or None, _key(right) or None, None, strong and votes[1] == 1 and votes[2] == 0, span_features(kind, mention, left, right)))
            taken.append((start, end))
    taken.sort()
    begins = [a for a, _ in taken]
    for pattern, found in ((_FORWARD, _FORWARD.finditer(text)), (_BACKWARD, _backward_names(text)), (_LOWER, _lower_names(text, low, given))):
        for m in found:
            start, end, mention = m.start(1), m.end(1), m[1]
            first, last, backward = _name_parts(mention)
            known = first in given or "-" in first and first.partition("-")[0] in given
            if first in _TITLES or last in _TITLES:
                continue
            before, after, _ = _around(text, start, end)
            left, right = _neighbours(before, after)
            i = bisect_left(begins, end)
            inside = any(b > start for _, b in taken[max(0, i - 8) : i])
            surname = re.sub(r"[^\w]", "", last)
            credit = -1 if len(surname) < 4 else 1 if _CREDIT.search(before) and not inside else 0
            form = -1 if inside or pattern is _LOWER or "\n" in mention else 1 if mention.isupper() or backward else 0
            out.append(("name", start, end, mention, [int(known), credit, form, 0, 0, 0], _key(left) or None, _key(right) or None, first, known, span_features("name", mention, left, right)))
    return out


_COMMA = re.compile(r", (?=[A-ZÀ-ÖØ-Þ])")


def _backward_names(text: str) -> Iterator[re.Match]:
    """Surname, given name: tried at the words before each comma."""
    for m in _COMMA.finditer(text):
        at = m.start()
        for _ in range(4):  # the surname and a particle of up to three words
            while at and not text[at - 1].isspace():
                at -= 1
            tried = at
            while tried < m.start() and not text[tried].isalpha():
                tried += 1
            name = _BACKWARD.match(text, tried)
            if name and name.start(1) + len(name[1].split(", ")[0]) == m.start():
                yield name
            if not at or text[at - 1] == "\n":
                break
            at -= 1


#: Words before a name: titles and lines of credit. Fixed values.
_CUES = ("mr", "ms", "dr.", "prof.", "herr", "frau", "monsieur", "madame", "mme", "mlle", "señor", "sra.", "sr.", "doña", "author", "maintainer", "-by:")


def _lower_names(text: str, low: str, given: frozenset[str]) -> Iterator[re.Match]:
    """Names in small letters: with a listed given name, or after a title or a line of credit."""
    for at in sorted(_places(low, _CUES)):
        while at and (low[at - 1].isalnum() or low[at - 1] == "_"):  # "-by:" ends a word
            at -= 1
        at -= at > 0 and low[at - 1] == "@"
        if (m := _CREDITED.match(text, at)) and (name := _LOWER.match(text, m.end())):
            yield name
    if len(given) <= 256 and not any(g in text for g in given):  # a short list is sought faster than words are cut
        return
    words = set(text.translate(_BLANKS).split())
    if words.isdisjoint(given) and not any("-" in w and w.partition("-")[0] in given for w in words):
        return
    for w in _SMALL.finditer(text):
        if w[0] in given or w[0].partition("-")[0] in given:
            if m := _LOWER.match(text, w.start()):
                yield m
            if text[w.start() - 2 : w.start()] == ", ":  # the surname first
                at = w.start() - 2
                while at and not text[at - 1].isspace():
                    at -= 1
                if m := _LOWER.match(text, at):
                    yield m


DIMS = 1 << 17
_CANDIDATE = "doc_id long, kind string, start int, stop int, mention string, v array<int>, left string, right string, first string, sure boolean, features array<int>"


def _candidate_rows(given: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["kind", "start", "stop", "mention", "v", "left", "right", "first", "sure", "features"]
        for b in batches:
            rows = [(doc, *c) for doc, text in zip(b.doc_id, b.text) for c in candidates(text, given)]
            yield pd.DataFrame(rows, columns=["doc_id", *names])

    return run


SALTS = 16


def looked_up(rows: DataFrame, known: DataFrame, key: list[str], default: int = 0) -> DataFrame:
    """``rows`` with the column vote of ``known`` (key and vote, each key once), ``default`` where there is none.

    A word that stands beside a third of all candidates is no single join key: rows are salted by their document and the
    votes repeated for each salt. Rows without a key get a key of their own, which meets nothing.
    """
    last = key[-1]
    own = F.coalesce(last, F.concat(F.lit("\0"), F.col("doc_id").cast("string"), F.lit(" "), F.col("start").cast("string")))
    salted = rows.withColumn("_key", own).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    votes = known.withColumnRenamed(last, "_key").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = [*key[:-1], "_key", "_salt"]
    return salted.join(votes.select(*on, "vote"), on, "left").fillna(default, ["vote"]).drop("_key", "_salt")


def company(rows: DataFrame, least: int, share: float) -> DataFrame:
    """side, kind, word, vote: what the words beside candidates say of these, by how many candidates beside them are sure."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in ("left", "right")]))
    counts = rows.select("kind", "sure", sides.alias("x")).where("x.word is not null").groupBy("x.side", "kind", "x.word").agg(F.count("*").alias("n"), F.sum(F.col("sure").cast("int")).alias("k"))
    vote = F.when((F.col("k") >= least) & (F.col("k") >= share * F.col("n")), 1).when((F.col("n") >= 20) & (F.col("k") == 0), -1)
    return counts.select("side", "kind", "word", vote.alias("vote")).where("vote is not null")


def with_company(rows: DataFrame, votes: DataFrame) -> DataFrame:
    for side in ("left", "right"):
        of = votes.where(F.col("side") == side).select("kind", F.col("word").alias(side), "vote")
        rows = looked_up(rows, of, ["kind", side]).withColumnRenamed("vote", f"{side}_vote")
    return rows


def spans(documents: DataFrame, given_names: DataFrame, least: int = 2, share: float = 0.3) -> DataFrame:
    """Every candidate span with its features and the votes, v0 to v5, of the labelers."""
    rows = given_names.where("given_name is not null").select(F.lower("given_name").alias("g")).distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"a list of more than {MOST_NAMES} given names is no gazetteer")
    given = frozenset(r.g for r in rows)
    found = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text").mapInPandas(_candidate_rows(given), _CANDIDATE)
    found = checkpointed(found)  # read several times below
    names, others = found.where("kind = 'name'").drop("features"), found.where("kind <> 'name'")
    near = (F.col("left_vote") == 1) | (F.col("right_vote") == 1)
    learned = with_company(names, company(names, least, share)).groupBy("first").agg(F.count("*").alias("n"), F.sum(near.cast("int")).alias("k"))
    first = learned.select("first", F.when((F.col("k") >= least) & (F.col("k") >= 0.5 * F.col("n")), 1).when((F.col("n") >= 5) & (F.col("k") < 0.1 * F.col("n")), -1).alias("vote")).where("vote is not null")
    again = looked_up(found.where("kind = 'name'"), first, ["first"]).withColumn("sure", F.col("sure") | (F.col("vote") == 1)).withColumnRenamed("vote", "v5")
    both = again.unionByName(others.withColumn("v5", F.col("v")[5]))
    voted = with_company(both, company(again.select("kind", "sure", "left", "right").unionByName(others.select("kind", "sure", "left", "right")), least, share))
    return voted.select("doc_id", "kind", "start", "stop", "mention", "features", *(F.col("v")[i].alias(f"v{i}") for i in range(3)), F.col("left_vote").alias("v3"), F.col("right_vote").alias("v4"), "v5")


VOTES = [f"v{i}" for i in range(6)]


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM for a two-class model with independent labelers: probability of each vote pattern, reliability of each labeler.

    It begins at the sum of votes. A few made-up observations, 2 in 1000 for each class, vote as they are meant to or
    abstain: where nearly all candidates are true ones, no class is made of those that one labeler abstains on.
    """
    p = linear.sigmoid(1.6 * votes.sum(axis=1) - 1.2)
    half = 0.001 * counts.sum() + 3
    for _ in range(rounds):
        w1, w0 = counts * p, counts * (1 - p)
        share = np.clip((w1.sum() + 1) / (counts.sum() + 2), 0.02, 0.98)
        logit = np.full(len(p), np.log(share / (1 - share)))
        for k in range(votes.shape[1]):
            for value, start1, start0 in ((-1, 1.0, half), (0, half, half), (1, half, 1.0)):
                hit = votes[:, k] == value
                logit[hit] += np.log((w1[hit].sum() + start1) / (w1.sum() + 2 * half + 1)) - np.log((w0[hit].sum() + start0) / (w0.sum() + 2 * half + 1))
        p = linear.sigmoid(logit)
    sure = np.array([(counts * np.where(votes[:, k] > 0, p, np.where(votes[:, k] < 0, 1 - p, 0))).sum() / max((counts * (votes[:, k] != 0)).sum(), 1) for k in range(votes.shape[1])])
    return p, sure


def vote_features(kind: str, votes) -> list[int]:
    return linear.hashed([f"{kind} v{i} {v}" for i, v in enumerate(votes) if v], DIMS)[1:]


def classify(labelled: DataFrame, sample_rows: int = 20_000) -> tuple[DataFrame, dict]:
    """The spans with the classifier's probability p, and the reliability of each kind's labelers."""
    spark = labelled.sparkSession
    labelled = checkpointed(labelled)  # read three times below
    patterns = labelled.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).toPandas().sort_values(["kind", *VOTES])  # at most 5 * 3**6 rows
    rows, learned = [], {}
    for kind, g in patterns.groupby("kind"):
        votes = g[VOTES].to_numpy(int)
        p, sure = estimate(votes, g.n.to_numpy(float))
        learned[kind] = {"reliability": sure.round(3).tolist()}
        rows += [(kind, *map(int, v), float(x)) for v, x in zip(votes, p)]
    table = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{v} int" for v in VOTES) + ", p double")
    sample = labelled.orderBy(F.xxhash64("doc_id", "start", "kind"), "doc_id", "start", "kind", "stop").limit(sample_rows)
    told = sample.join(F.broadcast(table), ["kind", *VOTES]).select("kind", *VOTES, "features", "p").toPandas()
    w = linear.fit([[*f, *vote_features(k, v)] for k, f, v in zip(told.kind, told.features, told[VOTES].to_numpy(int))], told.p.to_numpy(float), (told[VOTES] != 0).any(axis=1).to_numpy(float) + 1e-3, DIMS)  # where nobody votes nothing is taught
    handle = spark.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def probability(kind: pd.Series, features: pd.Series, *votes: pd.Series) -> pd.Series:
        weights = handle.value
        return pd.Series(linear.sigmoid(linear.scores([[*f, *vote_features(k, v)] for k, f, v in zip(kind, features, zip(*votes))], weights)))

    return labelled.withColumn("p", probability("kind", "features", *VOTES)).drop("features"), learned


def _resolve(found: list) -> list:
    """Spans without overlap: each is kept unless one before it in order overlaps; kept ones are searched by their place."""
    order = sorted(found, key=lambda s: (KINDS.index(s["kind"]), -round(s["p"], 6), s["start"] - s["stop"], s["start"]))
    starts: list[int] = []
    kept: list = []
    for s in order:
        i = bisect_left(starts, s["stop"])
        if not i or kept[i - 1]["stop"] <= s["start"]:
            i = bisect_left(starts, s["start"])
            starts.insert(i, s["start"])
            kept.insert(i, s)
    return kept


def mentions(documents: DataFrame, given_names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, spans: the accepted spans of each document that holds any, in order and without overlap."""
    scored, _ = classify(spans(documents, given_names))
    span = "array<struct<kind:string,start:int,stop:int,mention:string,p:double>>"

    @F.pandas_udf(span)
    def resolved(found: pd.Series) -> pd.Series:
        return pd.Series([_resolve(list(x)) for x in found])

    accepted = scored.where(F.col("p") > threshold)
    return accepted.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "start", "stop", "mention", "p")).alias("all")).select("doc_id", resolved("all").alias("spans"))


def redacted(documents: DataFrame, given_names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text with each mention replaced by a placeholder of its kind, n_mentions."""

    @F.pandas_udf("string")
    def replace(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(text, found):
            if t is not None and spans_ is not None:
                for s in sorted(spans_, key=lambda s: -s["start"]):
                    t = f"{t[: s['start']]}[{s['kind'].upper()}]{t[s['stop'] :]}"
            out.append(t)
        return pd.Series(out)

    joined = documents.where("doc_id is not null").select("doc_id", "text").join(mentions(documents, given_names, threshold), "doc_id", "left")
    return joined.select("doc_id", replace("text", "spans").alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_mentions"))
