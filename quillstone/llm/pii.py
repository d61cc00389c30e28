"""Personal information inside free text: found and replaced with typed placeholders.

High-recall generators propose overlapping candidate spans for e-mail addresses, telephone numbers, identity numbers,
postal addresses and names of people. One boosted-tree classifier per kind scores every candidate from the format of
the value and the words around it; thresholds are calibrated on held-out rows, and the heaviest set of spans that
don't overlap is redacted. The classifiers are trained here, on text written by a grammar of value formats and
contexts with known spans; the corpus contributes the frequency of its words, counted over all texts.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.boost import Boosted
from quillstone.llm.names import _FULL_OF, KINDS as BUSINESS_KINDS, LEGAL, SECTORS, SHORT_FORMS, fold as _fold
from quillstone.llm.places import STATES
from quillstone.runtime import cut, spread

fold = lru_cache(maxsize=200_000)(_fold)

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

# fixed values: given names that have no entry in the table of short forms
OTHER_GIVEN = (
    "aisha alasdair alice amelie ana anders andreas anita anna anneliese antoine ava beatrice birgit bjorn brigitte bruno camille carlos carmen cedric "
    "chiara claire claudia clement colin delphine diana diego dieter eloise emil emma enrique erik esme eva farid fatima felix fergus fiona florian "
    "gabriel georg gisela grace guenter gunter gustav hamish hanako hannah hans heike heinrich helena helga hugo ian ines ingrid irina ivan ivo "
    "jan jasmin jean joao jorge juan juergen julia julien jurgen karin karl karsten kenji kofi kurt lars laura leila lena linda lorcan louis lucia ludwig "
    "luis lukas manuel marco marek maria marie mario marta martin mateo mirela mohammed monika nadia natalia niamh nina noah nora olga olivier oscar otto "
    "pablo paul paula pedro pierre quentin rafael ravi renee rita rosa rudolf ruth sara sarah sean silvia simon siobhan sofia sophie sven "
    "thierry uwe vera wolfgang xanthe xavier yuki yves zoe"
).split()
GIVEN = set(SHORT_FORMS) | set(_FULL_OF) | set(OTHER_GIVEN)

# fixed values: words that stand before an identity number issued to a person, a telephone number, a person, an address; and before numbers of things and firms
CUE_WORDS = {
    "id": "passport|travel document|passeport|reisepass|pass|licence|license|driver licence|driving licence|driver's license|führerschein|fahrerlaubnis|permis|permis de conduire|ni|nino|national insurance|ssn|social security|soc sec|tfn|tax file"
    "|steuer-id|steueridentifikationsnummer|steuerliche id|sozialversicherungsnummer|rentenversicherungsnummer|sv-nummer|sv-nr|ausweis|ausweisnummer|personalausweis|perso|id|id card|photo id|national id|identity|identity card|identity document"
    "|resident permit|pièce d'identité|carte d'identité|cni|titre de séjour|sécurité sociale|insee|nir|medicare|reisepassnummer|führerscheinnummer|passnummer",
    "phone": "tel|tél|telefon|téléphone|phone|telephone|mobile|mob|cell|call|ring|text|sms|whatsapp|fax|dial|hotline|handy|mobil|durchwahl|rufnummer|portable|standard|switchboard|appeler|rappeler|joindre|joignable|téléphoner|reach|reached|phoned|unter|au|ph|office|desk|direct line|emergency|rückruf|anrufen|answers|answer|tried|try|number",
    "person": "contact|contact person|signed|fao|attn|attention|c/o|recipient|customer|buyer|neighbour|neighbor|supervisor|manager|driver|mr|mrs|ms|miss|dr|prof|herr|frau|mme|m|monsieur|madame|by|with|from|for|to|and|ask|tell|thank|demander|demandez|appeler|appelez|prévenir|meet|see|pay|name|witness|regards|sincerely|thanks|durch|von|mit|für|an|und|par|avec|pour|à|et|de|chez"
    "|empfänger|besteller|ansprechpartner|kontakt|zeuge|kunde|fahrer|destinataire|interlocuteur|témoin|client|sold to|ship to|bill to|deliver to|signed by|please|bitte|of|spoke with|w",
    "address": "address|anschrift|adresse|at|to|from|near|behind|lives at|living at|resides at|wohnhaft|wohnt in|umgezogen|livrer à|habite|domicile|an|à|au|deliver to|ship to|bill to|send to|moved to|moved from|moved|site|in|lieferadresse|lieferung an|demeurant|next door|point|was|is",
    "thing": "po|order|bestellung|bestellnummer|commande|quote|quotation|batch|lot|job|part|serial|s/n|track|tracking|waybill|parcel|shipment|container|account|acct|konto|compte|kundennummer|customer no|abn|acn|ein|vat|ust-id|ust-idnr|siret|siren|tva|hrb|invoice|inv|rechnung|facture|artikel|artikelnummer|article|référence|réf|ref|reference|item|sku|model|type"
    "|iso|din|en|spec|standard|norm|week|kw|weight|date|valid|clause|section|page|rev|version|receipt|iban|bsb|sort code|charge|kg|cartons|total|subtotal|tax|amount|bay|gate|ramp|rampe|quai|dock|halle|tor|docket|ticket|claim|booking|lieferschein|auftrag|company|roll|run|machine|engine|docs|doc",
}
# fixed values: words between a cue and its number
LINKS = set("no number nr nummer numéro n is number's ist est lautet".split())
# fixed values: what follows a value: what a person does, how one is reached, units, things named after people, remarks on a document
FOLLOWERS = {
    "does": "has had is was were will would can could called rang phoned said signed paid asked wants needs expects agreed confirmed refused waited came left wrote knows keeps holds owns lives and or hat hatte ist war wird möchte kann und a est sera était veut doit souhaite et refuse wishes may must shall",
    "reach": "tel tél telefon phone mobile mobil portable on at under unter au of from lives re about by for with instead first before when anrufen zurückrufen avant",
    "unit": "percent kg boxes cartons units pieces rolls pallets metres less pcs rev stück carton uhr h days",
    "thing": "street road avenue lane square park bridge hall hotel brand set model range series kit tool label edition line pump saw lamp drill mixer chair depot branch gmbh sarl ltd inc llc corp pty kg ag",
    "article": "the a an all every each any both der die das den alle le la les des un une its their",
    "note": "valid expires copy copied seen noted kept checked scanned gültig valable vu born expired issued",
}
STREET_KIND = (
    r"avenue|ave|av|boulevard|blvd|boulv|boul|bvd|bd|circuit|cct|close|court|crt|ct|crescent|cres|drive|drv|dr|highway|hwy|lane|ln|la|parade|pde|parkway|pkwy|pky|pwy|place|pl|road|rd|square|sq|street|str|st|terrace|tce|way"
)
FRENCH_KIND = r"rue|r|avenue|ave|av|boulevard|boul|bd|chemin|quai|impasse|allée|place|pl"
_STATE = "|".join(sorted((re.escape(k) for k in [*STATES, *STATES.values()] if len(k) > 1), key=len, reverse=True))
_POST = r"(?:[A-Za-z]{1,2}[0-9]{1,2}[A-Za-z]?\s?[0-9][A-Za-z]{2}|[0-9]{5}(?:-[0-9]{4})?|[0-9]{4})"
_W = r"[^\W\d_]"
_UNIT = r"(?:(?:unit|apt|apartment|suite|ste|flat)\.?\s*#?\s*[0-9]+[A-Za-z]?|#\s?[0-9]+)"

_AT = r"(?:@|\[\s?at\s?\]|\(\s?at\s?\))"
_DOT = r"(?:\.|\s*(?:\(\s?dot\s?\)|\[\s?dot\s?\]|\sdot\s)\s*)"
_HOST = rf"(?=[\w.-]*[A-Za-z])[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,24}}(?![\w])"
_EMAIL = [
    re.compile(rf"(?<![\w.+-])[A-Za-z0-9_](?:[\w.+-]*[\w+-])?\s*{_AT}\s*{_HOST}", re.I),
    re.compile(rf"(?<![\w.+-])[A-Za-z0-9_][\w+-]*(?:(?:\s+dot\s+|\.)[\w+-]+)*\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+(?!\w)", re.I),
    re.compile(rf"(?<![\w.+-])[A-Za-z0-9_][\w+-]*(?:(?:\s+dot\s+|\.)[\w+-]+)+\s*{_AT}\s*{_HOST}", re.I),
]
_AT_SIGN = re.compile(r"@|\bat\b", re.I)
_PHONE = re.compile(r"(?<![\w@.-])(?:(?:\+|00)[0-9]{1,3}[\s.-]?)?(?:\(0\)\s?)?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\s./-]{0,2}[0-9]{2,8}){1,5}(?![\w])")
_ID = re.compile(r"(?<![\w@.-])(?=[A-Za-z0-9 -]{0,60}[0-9])(?:[A-Za-z]{1,3}\s?-?)?[0-9]{1,11}(?:[ \n-]{1,2}(?:[0-9]{1,7}|[A-Za-z](?=[ \n-][0-9]))){0,6}[A-Za-z]?(?![\w])")
_ADDRESS = [
    # number, name, kind
    re.compile(rf"(?<![\w/#-])(?:(?:{_UNIT}\s?[,/]?\s+|u?[0-9]+\s?/\s?)?)[0-9]+\s?[A-Za-z]?[\s,]\s?(?:(?:north|south|east|west|[nsew])\.?\s+)?{_W}[\w'’-]*(?:\s{_W}[\w'’-]*){{0,2}}\s+(?:{STREET_KIND})\b\.?", re.I),
    # French: number, kind, name
    re.compile(rf"(?<![\w/#-])[0-9]+\s?[A-Za-z]?,?\s+(?:{FRENCH_KIND})\b\.?\s+{_W}[\w'’-]*", re.I),
    # German: name with kind, number
    re.compile(rf"(?<![\w-])(?:{_W}{{2,}}\s?)?{_W}+(?:\s?-\s?)?(?:straße|strasse|str|platz|pl|weg|wg|allee|gasse)\b\.?\s+[0-9]+\s?[A-Za-z]?\b", re.I),
    # number and name with no kind, borne out by a state and postcode
    re.compile(rf"(?<![\w/#-])(?:(?:{_UNIT}\s?[,/]?\s+|u?[0-9]+\s?/\s?)?)[0-9]+[A-Za-z]?\s+(?:(?:north|south|east|west|[nsew])\.?\s+)?{_W}{{3,}}(?:\s{_W}{{3,}})?(?:,?\s+{_UNIT})?\s*,\s*{_W}[\w' -]{{2,30}}?,?\s+(?:(?:{_STATE})\s+)?{_POST}\b", re.I),
]
_INITIALS = r"(?:[A-Z]\.?\s)"
_PERSON_GIVEN = re.compile(rf"(?<![\w@.+-])({_W}{{2,}})(?=\s+(?:{_W}\.?\s+)?{_W}{{4,}})")
_PERSON_INITIAL = re.compile(rf"(?<![\w@.+-])({_W})\.?\s(?:{_W}\.?\s)?({_W}{{4,}})(?!\w)")
_PERSON_COMMA = re.compile(rf"(?<![\w@.+-])({_W}{{4,}})\s?,\s?({_W}{{2,}})(?:\s({_W})\b\.?)?(?!\w)")
_AFTER_GIVEN = re.compile(rf"\s+(?:({_W})\.?\s+)?({_W}[\w'’]*(?:[-‐­¬]\s?\n\s?{_W}+)?)")
_COMMA_INITIAL = re.compile(rf"(?<![\w@.+-])({_W}{{4,}})\s?,\s?({_W})\.?(?:\s{_W}\.?)?(?![\w'])")


_BEFORE = re.compile(r"[^\W\d_]+(?:[-/'’][^\W\d_]+)*|[0-9]+")


class Cues:
    """Which sort of cue stands how near before a place, and what follows it: by looking up the words around."""

    names = tuple(CUE_WORDS)

    def __init__(self):
        self.before: dict[str, int] = {}
        for k, words in enumerate(CUE_WORDS.values()):
            for w in words.split("|"):
                self.before[w] = self.before.get(w, 0) | 1 << k
        self.longest = max(w.count(" ") + 1 for w in self.before)
        self.after: dict[str, int] = {}
        for k, words in enumerate(FOLLOWERS.values()):
            for w in words.split():
                self.after[w] = self.after.get(w, 0) | 1 << k

    def features(self, before: str, after: str) -> list[int]:
        """For each sort of cue its distance in words (0 next to the value, 4 for none); for each sort of follower whether it comes at once or soon."""
        words = [m.group().lower() for m in _BEFORE.finditer(before)][-7:]
        # what an elided article or preposition stands before
        words = [w if w in self.before else re.sub(r"^[dl]['’]", "", w) for w in words]
        gaps = [4] * len(CUE_WORDS)
        at = len(words)
        distance = 0
        while at > 0 and distance < 4:
            if words[at - 1] in LINKS and distance == 0:
                at -= 1
                continue
            mask = 0
            for n in range(1, self.longest + 1):
                if n <= at:
                    mask |= self.before.get(" ".join(words[at - n : at]), 0)
            for k in range(len(gaps)):
                if mask >> k & 1:
                    gaps[k] = min(gaps[k], distance)
            at -= 1
            distance += 1
        follow = [m.group().lower() for m in _BEFORE.finditer(after)][:2]
        first = self.after.get(follow[0], 0) if follow else 0
        second = self.after.get(follow[1], 0) if len(follow) > 1 else 0
        return gaps + [2 if first >> k & 1 else 1 if second >> k & 1 else 0 for k in range(len(FOLLOWERS))]


_CUES = Cues()
_BUSINESS = {a for t in (SECTORS, BUSINESS_KINDS) for w, ab in t.items() for a in (w, *ab.split())} | set(LEGAL) | {"sons", "bros", "daughters", "partners"}
_STREETS = set(re.findall(r"[a-z]+", STREET_KIND)) | {"straße", "strasse", "platz", "weg", "rue"}
# fixed values: common words, months and days, which never are a family or given name
_PLAIN = set(
    "the a an and or of to in on at by for with from after before until unless where when should if please leave contact call no not all any this that these those our your their my his her its we you they he she it is are was were be been have has had do does did will would can could may must"
    " mr mrs ms dr prof tel phone fax mobile email mail page date total price name number note notes general terms conditions invoice order"
    " der die das den dem des ein eine und oder nicht bitte wir sie er ist sind war hat durch mit von für auf aus bei nach herr frau le la les un une des du de et ou pour par avec sans sur dans est sont il elle nous vous monsieur madame"
    " monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz juni juli oktober dezember lundi mardi mercredi jeudi vendredi samedi dimanche".split()
)
_PRODUCT = set(FOLLOWERS["thing"].split())


def _shape(text: str) -> list[int]:
    d = re.sub(r"\D", "", text)
    groups = re.findall(r"\d+", text)
    return [
        min(len(d), 15), min(len(groups), 7), min(len(groups[0]) if groups else 0, 11), min(len(groups[-1]) if groups else 0, 11),
        int("+" in text[:2]), int(text.startswith("00")), int("(" in text), int("." in text), int("/" in text), int("-" in text), int(" " in text or "\n" in text),
    ]


def _phone_form(text: str) -> list[int]:
    d = re.sub(r"\D", "", text)
    if d.startswith("00"):
        d = d[2:]
    nanp = d[1:] if len(d) == 11 and d[0] == "1" else d
    return [
        int(len(nanp) == 10 and nanp[0] in "23456789" and nanp[3] in "23456789"), int(len(nanp) == 10 and nanp[3:6] == "555"),
        int(bool(re.match(r"^(?:61|44|33|49)", d)) and 10 <= len(d) <= 13), int(bool(re.match(r"^0[1-9]\d{8,10}$", d))),
        int(bool(re.match(r"^0(?:4|7)\d{8,9}$", d))), int(bool(re.match(r"^\d{3}-\d{2}-\d{4}$", text.strip()))), int(bool(re.match(r"^\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$", text.strip()))),
    ]


def _id_form(text: str) -> list[int]:
    t = re.sub(r"\s+", " ", text.strip())
    forms = (
        r"[A-Z]\d{7}", r"[A-Z]{2}\d{7}", r"[A-Z]\d{8}[A-Z]", r"[A-Z]{2}\d{6}[A-D]", r"[A-Z]{2}\d{9}", r"[A-Z]\d{4}-\d{5}", r"\d{3}[ -]?\d{2}[ -]?\d{4}", r"\d{4} \d{5}", r"\d{11}", r"\d{9}",
        r"\d{2} \d{6} [A-Z] \d{3}", r"[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?", r"\d{2}-\d{7}", r"\d{3}-\d{6}", r"\d{10}", r"\d{2} \d{3} \d{3} \d{3}", r"[A-Z]\d{4}-\d{7}", r"\d{3}-\d{3}-\d{4}(?:-[A-Z])?", r"\d{3}-\d{4}", r"\d{5}(?:-\d{4})?",
    )
    return [int(re.fullmatch(f, t, re.I) is not None) for f in forms]


def _case(word: str) -> int:
    return 3 if word.isupper() and len(word) > 1 else 2 if word[:1].isupper() else 1


class Words:
    """How usual a word is in the corpus: 0 unknown, 1 rare, 2 usual in lower case."""

    def __init__(self, usual: Iterable[str]):
        self.usual = set(usual)

    def rank(self, word: str) -> int:
        return int(word.lower() in self.usual)


def _by_lines(m: re.Match) -> list[tuple[int, int]]:
    """A match as it stands, and what of it lies on either side of a line end, since the two may be different numbers."""
    s, e = m.span()
    out = [(s, e)]
    value = m.group()
    for br in (i for i, ch in enumerate(value) if ch == "\n"):
        head, tail = value[:br].rstrip(" .-/("), value[br + 1 :].lstrip(" .-/)")
        if head:
            out.append((s, s + len(head)))
        if tail:
            out.append((e - len(tail), e))
    return out


_NAME = rf"{_W}[\w'’]*(?:-{_W}[\w'’]*)*"
_TAIL = re.compile(
    rf"(?:(?:\s+(?:north|south|east|west|[NSEW])\b\.?)?(?:[,\s]+{_UNIT})?)"
    rf"(?:[,;\s]+(?:(?:(?:{_STATE})\s+)?{_POST}\b(?:\s+{_NAME})?|{_NAME}(?:[ \n]{_NAME}){{0,2}}?(?:,?\s+(?:{_STATE}))?,?\s+{_POST}\b))?", re.I,
)


def _address_end(text: str, at: int) -> int:
    """Where an address goes on to after its street: direction, unit, and town with state and postcode where they follow."""
    m = _TAIL.match(text, at)
    return m.end() if m else at


_PAIR = re.compile(r"(?<![\w@.+-])(?=[^\W\d_a-zß-öø-ÿ])([^\W\d_]{2,})(?:\s+[^\W\d_]\.)?\s+(?=[^\W\d_a-zß-öø-ÿ])([^\W\d_]{3,}(?:-[^\W\d_]{3,})?)(?![\w])")


def candidates(text: str, words: Words) -> list[tuple[int, int, str]]:
    """Overlapping candidate spans ``(start, end, kind)``; meant to miss nothing."""
    out: set[tuple[int, int, str]] = set()
    for pattern in _EMAIL if _AT_SIGN.search(text) else ():
        for m in pattern.finditer(text):
            out.add((m.start(), m.end(), "email"))
    for m in _PHONE.finditer(text):
        # a sentence may end between two numbers
        stop = re.search(r"\d(?=\.\s)", m.group())
        for s, e in _by_lines(m) + ([(m.start(), m.start() + stop.end())] if stop else []):
            if 7 <= len(re.sub(r"\D", "", text[s:e])) <= 15:
                out.add((s, e, "phone"))
    for s, e in [x for m in _ID.finditer(text) for x in _by_lines(m)]:
        value = text[s:e]
        if 6 <= len(re.sub(r"\D", "", value)) <= 15:
            out.add((s, e, "id_number"))
            lead = re.match(r"(?:no|nr|id|abn|ein|ssn|tfn|po|ni|kw|iso|sku|n)[\s-]+(?=\S*\d)", value, re.I)
            if lead:
                out.add((s + lead.end(), e, "id_number"))
    for pattern in _ADDRESS:
        for m in pattern.finditer(text):
            end = _address_end(text, m.end())
            out.add((m.start(), end, "address"))
            if pattern is _ADDRESS[2] and (last := re.search(rf"(?<=\s){_W}[\w-]*(?:\s?-\s?\w+)?\.?\s+[0-9]+\s?[A-Za-z]?$", m.group())):
                out.add((m.start() + last.start(), end, "address"))
            # a unit or a number of something else may stand in front
            inner = re.search(r"(?<=[\s,/])[0-9]+[A-Za-z]?[\s,]", m.group()[1:])
            if inner and not re.match(rf"(?:{_UNIT}|u?[0-9]+\s?/)", m.group(), re.I):
                out.add((m.start() + 1 + inner.start(), end, "address"))
    for m in _PERSON_GIVEN.finditer(text):
        if fold(m.group(1)) in GIVEN:
            tail = _AFTER_GIVEN.match(text, m.end())
            if tail:
                out.add((m.start(1), tail.end(), "person"))
    for pattern in (_PERSON_COMMA, _COMMA_INITIAL):
        for m in pattern.finditer(text):
            if pattern is _COMMA_INITIAL or fold(m.group(2)) in GIVEN:
                out.add((m.start(), m.end(), "person"))
    for m in _PERSON_INITIAL.finditer(text):
        out.add((m.start(), m.end(), "person"))
    # two words in capitals of which neither is common may be a name that no list holds
    at = 0
    while m := _PAIR.search(text, at):
        at = m.end(1)
        a, b = m.group(1).lower(), m.group(2).lower()
        if a not in _PLAIN and b not in _PLAIN and b not in _STREETS and b not in _BUSINESS and a not in _BUSINESS and not (words.rank(a) or words.rank(b)):
            out.add((m.start(), m.end(), "person"))
    return sorted(out)


def features(text: str, start: int, end: int, kind: str, words: Words) -> list[int]:
    """Small integers: the value's format and the words around it."""
    value = text[start:end]
    base = _CUES.features(text[max(0, start - 60) : start], text[end : end + 40])
    if kind == "email":
        local = re.split(r"@|\bat\b|\[at\]|\(at\)", value, maxsplit=1, flags=re.I)[0]
        return [int("@" in value), int(re.search(r"\[\s?at|\(\s?at", value, re.I) is not None), int(re.search(r"\sdot\s", value, re.I) is not None), value.count("\n"), min(len(local), 15) // 3, int(words.rank(local.strip()) > 0), int(re.search(r"\d", local) is not None), *base]
    # numbers in the columns of a table
    columns = [int(re.search(r"\S\s{2,}\S", value) is not None), int(re.search(r"\s\d+\.\d\d$", value) is not None), int(re.search(r"\S[^\S\n]{2,}$", text[max(0, start - 3) : start]) is not None), int(re.match(r"\s{2,}\d", text[end : end + 12]) is not None)]
    if kind == "phone":
        return [*columns, *_shape(value), *_phone_form(value), *_id_form(value), value.count("\n"), int(text[max(0, start - 1) : start] in "-/#"), int(text[end : end + 1] == "-"), int(text[text.rfind("\n", 0, start) + 1 : start].strip() == "" and re.match(r"[ \t]*(?:\n|$)", text[end:]) is not None), *base]
    if kind == "id_number":
        letters = len(re.findall(r"[A-Za-z]", value))
        return [*columns, *_shape(value), *_id_form(value), *_phone_form(value), min(letters, 6), value.count("\n"), *base]
    line = text[text.rfind("\n", 0, start) + 1 : start].strip()
    rest = text[end : end + 60]
    if kind == "address":
        street = next((m.group() for m in (q.match(text, start) for q in (_ADDRESS[0], _ADDRESS[2], _ADDRESS[1], _ADDRESS[3])) if m and m.end() <= end), value)
        tail = re.sub(r"\s+", " ", rest)
        return [
            int(re.match(rf"^[,\s]*(?:{_UNIT})?[,\s]*[\w' -]{{0,34}},?\s*(?:(?:{_STATE})\b\s*)?{_POST}\b", tail, re.I) is not None), int(re.search(rf"(?<![\w]){_POST}(?:\s+{_NAME})?\s*$", value[len(street) :] if len(street) < len(value) else value) is not None),
            int(re.match(rf"(?:{_UNIT}|u?[0-9]+\s?/)", value, re.I) is not None), int(re.search(rf"\b(?:{STREET_KIND})\b\.?$", street, re.I) is not None),
            int(re.match(rf"[0-9]+\s?[A-Za-z]?,?\s+(?:{FRENCH_KIND})\b", value, re.I) is not None), int(re.search(r"(?:straße|strasse|str|platz|pl|weg|wg|allee|gasse)\b\.?\s+[0-9]+", value, re.I) is not None),
            int(not line), min(len(re.findall(r"\w+", street)), 9), sum(words.rank(w) for w in re.findall(rf"{_W}{{4,}}", street) if w.lower() not in _STREETS), int(re.match(r"[0-9]{5,}", value) is not None),
            int(re.search(r"\d\s+(?:percent|kg|units|cartons|march|days)", value, re.I) is not None), value.count("\n"),
            int(re.match(rf"{_W}+\s+{_W}", value) is not None), int(re.match(r"[A-Z]\w+\s+[a-z]", value) is not None), *base,
        ]
    found = re.findall(rf"{_W}+", value)
    long = [w for w in found if len(w) > 1] or found
    given = [int(fold(w) in GIVEN) for w in long]
    comma = "," in value
    family = long[0] if comma else long[-1]
    first = long[-1] if comma else long[0]
    after = re.findall(r"^\W*(\w+)", rest)
    nxt = after[0].lower() if after and not re.match(r"^\s*[.;:\n]", rest) else ""
    nxt_line = after
    line_rest = rest.split("\n", 1)[0]
    return [
        int(re.match(r"^(?: \w+){0,4}\s{2,}\d", line_rest) is not None), int(re.search(r"\d[.,]\d\d\s*$", line_rest) is not None), int(re.match(r"^\s{2,}\S", line_rest) is not None), int(re.match(r"^(?:[^\S\n]+[^\W\d_]+){0,3}\s*\n\s*[0-9]+\s*(?:\n|$|\s{2})", rest) is not None),
        int(comma), min(len(found), 4), int(any(len(w) == 1 for w in found)), given[0], given[-1], _case(first), _case(family), int(_case(first) == _case(family)),
        words.rank(family), min(len(family), 15) // 2, int(family.lower() in _PLAIN or fold(family) in GIVEN), int(family.lower() in _STREETS), int(family.lower() in _BUSINESS or first.lower() in _BUSINESS),
        int(nxt in _BUSINESS), int(nxt in _STREETS or nxt in _PRODUCT), int(bool(nxt_line) and nxt_line[0].lower() in _BUSINESS), int(first.lower() in _PLAIN), int(not line), value.count("\n"),
        int(words.rank(first) > 0), int(bool(re.match(r"^\s*(?:\n|$)", rest))),
        int(re.search(rf"{_W}{{4,}}\s?,\s?$", text[max(0, start - 20) : start]) is not None), int(re.search(r"(?:^|[.!?:;/\n]\s*)$", text[max(0, start - 4) : start]) is not None),
        0 if not nxt_line else 3 if words.rank(nxt_line[0]) and nxt_line[0].islower() else 2 if nxt_line[0][0].isupper() else 1, int(re.match(r"^\s*[.,;:)(/]", rest) is not None), int(re.match(r"\s?:", rest) is not None),
        int(first.lower() in _CUES.before), 0 if not (ahead := re.search(r"(\w)\w*[^\S\n]$", text[max(0, start - 24) : start])) else 3 if ahead.group(1).isdigit() else 2 if ahead.group(1).isupper() else 1,
        int(re.search(r"\d[A-Za-z]?,?\s*(?:\w{1,8}\.?\s)?$", text[max(0, start - 14) : start]) is not None), int(re.match(r"^[,\s]*(?:[A-Z]{2,3},?\s+)?[A-Z]{0,2}\d", rest) is not None), *base,
    ]


def select(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The heaviest set of spans that don't overlap; of equal sets the one with the longer, then earlier spans."""
    spans = sorted(spans, key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in spans]
    best: list[tuple[float, int]] = [(0.0, 0)]
    take: list[bool] = []
    for n, (s, e, _, w) in enumerate(spans):
        k = bisect.bisect_right(ends, s, 0, n)
        mine = (best[k][0] + w, best[k][1] + e - s)
        take.append(mine > best[n])
        best.append(max(mine, best[n]))
    out, n = [], len(spans)
    while n:
        if take[n - 1]:
            out.append(spans[n - 1])
            n = bisect.bisect_right(ends, spans[n - 1][0], 0, n - 1)
        else:
            n -= 1
    return out[::-1]


class Finder:
    """Trained classifiers for all kinds."""

    def __init__(self, models: dict[str, Boosted], usual: Iterable[str]):
        self.models, self.words = models, Words(usual)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        rows: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}
        feats: dict[str, list[list[int]]] = {k: [] for k in KINDS}
        for n, text in enumerate(texts):
            for s, e, kind in candidates(text, self.words):
                rows[kind].append((n, s, e))
                feats[kind].append(features(text, s, e, kind, self.words))
        kept: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for kind in KINDS:
            if rows[kind]:
                model = self.models[kind]
                p = model.probability(np.asarray(feats[kind], np.int64))
                for (n, s, e), q in zip(rows[kind], p, strict=True):
                    if q >= model.threshold:
                        kept[n].append((s, e, kind, float(q)))
        return [select(k) for k in kept]


def redacted(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for s, e, kind, _ in spans:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------------------------------------------------------
# Spark

#: a word is usual from this share of the texts on; with it the list has at most (words in a text) / share entries
USUAL_SHARE = 1 / 2000
SPANS = "array<struct<start_at:int,end_at:int,kind:string,score:double>>"


def usual_words(texts: DataFrame) -> list[str]:
    """Lower-case words in at least ``USUAL_SHARE`` of all texts (three at least): plain words rather than names.

    Counted over every text. The list can't outgrow the mean number of distinct words of a text divided by the share.
    """
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}])(\p{Ll}{2,})(?![\p{L}])"), F.lit(1)))).alias("w"))
    total = texts.count()
    least = max(3, int(total * USUAL_SHARE))
    return [r[0] for r in words.groupBy("w").count().filter(F.col("count") >= least).select("w").collect()]


def find_spans(texts: DataFrame, key: str = "text") -> DataFrame:
    """``text, spans`` for distinct non-blank ``text``: the selected spans with their kinds and probabilities, in order. Another ``key`` column goes through instead of the text."""
    from quillstone.llm.pii_grammar import trained

    usual = usual_words(texts)
    shared = texts.sparkSession.sparkContext.broadcast((trained(), usual))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value)
        for f in frames:
            yield pd.DataFrame({key: f[key], "spans": finder.spans(f["text"].tolist())})

    return spread(texts).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``redacted`` and ``spans`` added: the text with a typed placeholder for each find.

    A null text stays null with no spans, an empty one stays empty; texts of any length are read whole; equal texts are
    read once and repeated rows kept. Columns named like the new ones are replaced.
    """
    own = df.drop("redacted", "spans").withColumn("__text", F.col(text_col).cast("string"))
    texts = own.select(F.col("__text").alias("text")).filter("trim(text) <> ''").distinct()
    found = find_spans(texts).select(F.col("text").alias("__text"), "spans")
    joined = own.join(found, "__text", "left")

    @F.pandas_udf("string")
    def fill(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            return t if t is None or s is None or not len(s) else redacted(t, [(x["start_at"], x["end_at"], x["kind"], x["score"]) for x in s])

        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)])

    return joined.withColumn("redacted", fill("__text", "spans")).withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})"))).drop("__text")


def found(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """``src, rec_id, start_at, kind`` of every find in notes and raw texts."""
    a = responses.select(F.lit("responses").alias("src"), F.col("response_id").cast("long").alias("rec_id"), F.col("notes").alias("text"))
    b = requests.select(F.lit("ai_requests").alias("src"), F.col("request_id").cast("long").alias("rec_id"), F.col("raw_text").alias("text"))
    rows = a.unionByName(b).filter("trim(text) <> ''").withColumn("h", F.md5("text"))
    # only a digest of the text is joined on
    texts = cut(rows.groupBy("h").agg(F.first("text").alias("text")))
    spans = find_spans(texts, "h").filter("size(spans) > 0")
    return rows.select("src", "rec_id", "h").distinct().join(spans, "h").select("src", "rec_id", F.explode("spans").alias("s")).select("src", "rec_id", F.col("s.start_at").alias("start_at"), F.col("s.kind").alias("kind")).distinct()
