"""Personal details in free text: find them and put typed placeholders in their place.

Candidates of five kinds are spotted in the whole text (white space runs taken as one
space). For each candidate several labelers vote: regular expressions of formats, gazetteers
(surnames, given names, towns and words of firms met in sure contexts, and the parts they are made
of) and context on either side. Expectation-maximisation over the vote patterns estimates how
reliable each labeler is, without any labelled data and without believing any beforehand; the
posteriors train one logistic span classifier per kind over votes, neighbouring words and
shape, which takes the decision on every candidate.

Gazetteers are counted over all documents; a title or role raises a candidate also where no
gazetteer has the name. Reliabilities and classifiers are fitted on at most ``FIT_DOCUMENTS``
documents chosen by hash of their id; the fitted model has a fixed bound in size and is applied to every
document. Null, empty and blank texts have no findings.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress, count, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut

#: Most documents that the model is fitted on.
FIT_DOCUMENTS = 3_000
#: Longest text that is fitted on, so that what reaches the driver is bounded; longer ones are searched like any other.
FIT_LONGEST = 50_000
#: Most entries of each gazetteer, far above the number of surnames of a country; bounds what every worker holds.
GAZETTEER = 1_000_000
#: How far the silence of a labeler that could speak for a candidate counts against it, once the rates are known.
SILENCE = 0.4
#: Hashed features of a classifier.
WIDTH = 1 << 14
#: Decisions and token classes that a worker remembers.
MEMO = 300_000
#: Characters of texts that are taken apart at once, about; a longer text is by itself.
AT_ONCE = 1 << 20
KINDS = ("email", "phone", "id", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

_U = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĘĚĞŁŃŇŐŒŘŚŞŠŢŤŮŰŹŻŽİ"
_WHITE = re.compile(r"\s{2,}|[^\S ]|^ ")
_WORD = re.compile(r"[^\W\d_]+(?:['’-](?![sS]\b)[^\W\d_]+)*")
# --- email -------------------------------------------------------------------------------
_AT = re.compile(r"@|[\[(][aA][tT][\])]")
_AT_DOT = re.compile(r" (?:at|AT) (?=[\w-]+ (?:dot|DOT) )")
_LOCAL = re.compile(r"[\w.+%'-]")
_MAIL = re.compile(r"mail|courriel|contact|kontakt|sent to|address|adresse|write|écri|schreib|[<(]$", re.I)
_DOMAIN = re.compile(r" ?[\w-]+(?:(?: ?[\[(]dot[\])] ?| dot |[.․])[\w-]+)*(?: ?[\[(]dot[\])] ?| dot |[.․])[A-Za-z]{2,}\b", re.I)
# --- numbers -----------------------------------------------------------------------------
_DIGITS = re.compile(r"[(+0-9](?:[+(]?\d| (?=\d\d ))(?:[\d./()-]| (?=[\d(–-])|–){5,}")
_PHONE = re.compile(
    r"\((?:\d{3,5}\) \d{3}-\d{4})\b|\d{3}(?:\.\d{3}\.\d{4}(?: ext\. ?\d{1,5})?|-\d{4})\b|00\d{9,13}\b|0\d{2} \d{3} \d{3}\b|0\d{2,4}/\d{3} ?\d{3,4}\b|0\d{3,4} [–-] \d{3} \d{3,4}\b|0\d{1,2}(?:\.\d{2,3}){3,4}\b"
    r"|\+\d{1,3}(?: \(0\)\d{1,4} \d{4,8}|(?: \d{2,4}){2,4}|-\d{2,4}-\d{4,8}|[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|(?:[ .-]?\d{2,4}){3,5})\b"
)
_ID = re.compile(r"\d{11}\b(?![/-]\d)|\d{6}[/-]\d{4}\b|\d{3}-\d{2}-\d{4}\b|\d{3}\.\d{3}\.\d{3}-\d{2}\b|\d \d{2} \d{2} \d{6}\b")
_LETTER_ID = re.compile(r"[A-Z](?:[A-Z] \d{2} \d{2} \d{2} [A-Z]|\d{8}|[A-Z]{2}-\d{6}-[A-Z])\b")
#: Where digits or a letter id may begin within a token; a run of digits that reaches the token's end may go on in the next.
_DIGITS_START = re.compile(r"[(+0-9](?=[+(]?\d|$)")
_DIGITS_OPEN = re.compile(r"[(+0-9](?:[+(]?\d)?[\d./()–-]*$")
_LETTER_START = re.compile(r"(?=[A-Z](?:\d{8}|[A-Z]{2}-\d{6}-[A-Z])\b)")
_TWO_DIGITS = re.compile(r"\d\d")
_TWO_LETTERS = re.compile(r"[A-Z][A-Z]")
_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_DOMAIN_TOKEN = re.compile(r"[\w-]+")
_LOOSE = re.compile(r"[+(]?\d[\d ()./–-]{4,}\d\b")
_PHONE_WORD = re.compile(r"\b(?:tel|tél|phone|fax|mobil|handy|natel|call|appel|joign|erreich|reach|anruf|rufnummer|dial|whatsapp|sms|the number|unter) ?", re.I)
_ID_WORD = re.compile(r"\b(?:identit|identity|identität|personal id|id\b|ssn|passport|passeport|pass(?:-?nr|nummer|\b)|reisepass|personalausweis|ausweis|insurance|assurance|versicherung|social|sécurité sociale|sozialversicherung|ahv|national (?:number|id)|personenkenn|steuer-?id|taxpayer)", re.I)
#: Tokens without which the patterns above and below cannot match: the first word of each phrase, the last word of a trap.
_PHONE_TOKEN = re.compile(_PHONE_WORD.pattern.replace("the number", "number"), re.I)
_ID_TOKEN = re.compile(_ID_WORD.pattern.replace("personal id", "personal").replace("sécurité sociale", "sécurité").replace("national (?:number|id)", "national"), re.I)
_TRAP_TOKEN = re.compile(r"(?:files?|no\.?|number|docket|consignment|invoice|rechnung|facture|account|konto\w*|compte|isbn|az\.|n°|nr\.|lot|sheet|exhibit|volume|page|p\.|aktenzeichen|dossier|,)$", re.I)
_NUMBER_TRAP = re.compile(r"\b(?:files?(?: no\.?| number)?|docket(?: no\.?)?|case no\.?|consignment|invoice|rechnung|facture|account(?: no\.?)?|konto\w*|compte|isbn|az\.|no\.|n°|nr\.|lot|sheet|exhibit|volume|page|p\.|aktenzeichen|dossier|v\.? [^.]{0,30},) $", re.I)
_DATE = re.compile(r"\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2}|\d{4}-\d{4}-\d{4}")
# --- address -----------------------------------------------------------------------------
_NO = r"\d+ ?[a-zA-Z]?(?:/\d+)?(?: bis| ter)?"
_EN_TYPES = ("Road", "Rd", "Street", "St", "Avenue", "Ave", "Lane", "Row", "Terrace", "Boulevard", "Blvd", "Close", "Square", "Drive", "Crescent", "Gardens", "Mews", "Place", "Way", "Hill")
_EN_TYPE = "(?:" + "|".join([*_EN_TYPES, *(t.upper() for t in _EN_TYPES)]) + ")"
_EN = re.compile(rf"{_NO},? (?:(?:St|ST)\.? )?[{_U}][\w'’-]* (?:[{_U}][\w'’-]* ){{0,2}}?(?:(?:St|ST|Ave|AVE|Rd|RD|Blvd|BLVD)\.|{_EN_TYPE}\b)")
_FR_NAME = rf"(?:(?:de la|de|du|des|la|le|les) |(?:de )?[lL]['’]|[dD]['’])?(?-i:[{_U}])[\w’'-]*(?:[ -](?:(?:de|du|des|la) )?(?-i:[{_U}])(?![\w’'-]* ?[:—–])[\w’'-]*)*"
_FR_TYPE = r"(?:rue|avenue|quai|boulevard|place|chemin|impasse|allée|cours|passage|calle|avenida|plaza|paseo|via|viale|piazza|corso)"
_FR = re.compile(rf"{_NO},? {_FR_TYPE} {_FR_NAME}", re.I)
_FR_AFTER = re.compile(rf"{_FR_TYPE} {_FR_NAME}(?:,)? {_NO}(?![\w/])", re.I)
#: A token that a type of street begins, and how far after the token with the number, at most, as ``_EN`` and ``_FR`` have it.
_TYPE_TOKEN = re.compile(rf"(?:St|ST|Ave|AVE|Rd|RD|Blvd|BLVD)\.|{_EN_TYPE}\b|(?i:{_FR_TYPE})$")
_TYPE_WITHIN = 7
_DE_END = re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|ring|damm|ufer|markt) (\d+ ?[a-z]?(?:/\d+)?)(?![\w/])", re.I)
_DE_LEFT = re.compile(rf"(?:(?:Am|An der|An den|Im|In der|Auf der|Zum|Zur|AM) (?:[{_U}][\w-]* )*)?[{_U}][\w-]*$|(?:(?:Am|An der|Im|In der|Zum|Zur|AM) )(?:[{_U}][\w-]* )+$")
_NUMBER = re.compile(r"[0-9]+")
_AFTER_HOUSE = frozenset(" ,/abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_STREET_FIRST = frozenset("raqbpcit")
_FR_ANCHOR = re.compile(r"[rRaAqQbBpPcCiIvV](?:ue|UE|venue|VENUE|uai|UAI|oulevard|OULEVARD|lace|LACE|hemin|HEMIN|mpasse|MPASSE|llée|LLÉE|ours|OURS|assage|ASSAGE|alle|ALLE|venida|VENIDA|laza|LAZA|aseo|ASEO|ia|IA|iale|IALE|iazza|IAZZA|orso|ORSO) ")
_DE_TAILS = ("ße ", "sse ", "tr. ", "weg ", "lee ", "atz ", "ring ", "amm ", "fer ", "rkt ")
_DE_LAST = frozenset(c for tail in _DE_TAILS for c in (tail[-2], tail[-2].upper()))
_ADDRESS_LEFT = re.compile(r"\b(?:resid\w*|lives?|living|demeur\w*|domicili\w*|wohn\w*|served|delivered|left|address\w*|anschrift|adresse|habit\w*|of|sis\w*)(?: (?:at|in|au|à|is|ist|est|on))?:?,? $", re.I)
_ADDRESS_PARTY = re.compile(r"(?:[^\W\d_]{1,}\.?|[\])█…_X]), $")
_ADDRESS_RIGHT = re.compile(rf",? (?:near [{_U}]|in [{_U}]|à [{_U}])|, (?:\d{{4,5}} )?[{_U}]|,? (?:Claimant|Respondent|Demandeu|Défend|Kläger|Beklagt)")
_COURT_LEFT = re.compile(rf"(?:Hall of Justice|Palace of Justice|Court ?[Hh]ouse|(?:Court|Tribunal|Gericht|Cour|Registry)(?: of| de| d'appel de)?(?: Appeal of)? [{_U}][\w-]+), $")
_COURT_RIGHT = re.compile(r" ?\|| ?[—–] [A-Z]-\d")
# --- names -------------------------------------------------------------------------------
_PARTICLE = r"(?:[Dd]e|DE|[Vv]an|VAN|[Vv]on|VON|[Dd]i|DI|[Dd]el|DEL|[Tt]er|[Zz]u)"
_PARTICLE_LEFT = re.compile(rf"(?<![\w'’-]){_PARTICLE} $")
_TITLE_WORD = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Me|Mme|Mlle|Frau|Herrn?|Justice|Lord|Lady|Sir|Maître|Madame|Monsieur)"
_TITLE = re.compile(rf"(?<![\w'’-]){_TITLE_WORD}\.? $")
_TITLED = re.compile(rf"(?<![\w'’-])(?:Mr|Mrs|Ms|Dr|Mme|Mlle|Frau|Herrn?)\.? (?:{_PARTICLE} )?([{_U}][\w'’]+(?:-[{_U}][\w'’]+)*)")
_PARTICLE_ENDS = frozenset(("de ", "an ", "on ", "di ", "el ", "er ", "zu "))
_GIVEN_RIGHT = re.compile(rf", ([^\W\d_][\w’]*(?:-[^\W\d_][\w’]+)?)(?: ([{_U}]\.))?(?![\w])")
_INITIAL_RIGHT = re.compile(rf", ([{_U}]\.)(?![\w])")
_ROLES = frozenset(
    "witness witnesses counsel claimant respondent applicant appellant plaintiff defendant petitioner registrar clerk judge justice presiding attorney solicitor barrister between "
    "demandeur demanderesse défendeur défenderesse appelant appelante intimé intimée requérant requérante témoin avocat avocate greffier greffière juge président présidente entre plaidé notamment procès-verbal signé signed "
    "kläger klägerin beklagte beklagter antragsteller antragstellerin zeuge zeugin zeugen richter richterin gegen sache vollmacht gez".split()
)
_ROLE_STEMS = ("vorsitz", "bevollmächtigt", "rechtsanw")
_ROLE_LINKS = frozenset("war a below für for of de".split())
_TITLES = frozenset("mr mrs ms dr mme mlle frau herr herrn".split())
_SAID_BEFORE = frozenset("erklärte sagte behauptete said says déclare soutient".split())
_SAYS = frozenset("did does state stated states said says told deny denies denied claims claimed is was has had soutient déclare conteste trägt hat habe gemäß".split())
_SAY_STEMS = ("submit", "conced", "resid", "testif", "argue", "maintain", "admit", "appear", "affirm", "erklärt", "behaupt", "bestreit", "wohn", "demeur")
_LIVE_STEMS = ("demeur", "wohn", "resid", "domicil")
_FOLLOWING = re.compile(r",? ([^\W_]+(?:-[^\W\d_]+)?)")
_SAYS_TWO = re.compile(r" (?:a (?:déclaré|reconnu|affirmé|dit)|par acte)\b")
_ACCOUNT = re.compile(r"['’]s (?:account|evidence|claim|statement)\b")
_ROLED = re.compile(rf"(?:[gG]ez\.|[^\W_]+(?:-[^\W\d_]+)?)(?: (?:war|a|below|für|for|of|de))?[ ,:]{{1,3}}(?:{_PARTICLE} |[{_U}]\. )?([{_U}][\w'’]+)")


def _is_role(word: str) -> bool:
    return word in _ROLES or word.startswith(_ROLE_STEMS)


def _role_left(last: str, before: str) -> bool:
    """Is the last word before a place a role, a word of saying, a dash or a slash, or a small word after a role?"""
    bare = last.rstrip(",:").lower().lstrip("([—„“«\"'")
    if not bare:
        return False
    if bare in ("—", "/") or _is_role(bare) or bare == "gez." or bare in _SAID_BEFORE:
        return True
    before = before.lower().lstrip("([—„“«\"'")
    return bare in _ROLE_LINKS and (_is_role(before) or before == "evidence" and bare == "of")


def _following(word: str) -> int:
    """What a word after a name may be: 1 a role, 2 where somebody lives, 4 "of", 8 a word of saying, 16 the first of two."""
    low = word.lower()
    return _is_role(low) | 2 * low.startswith(_LIVE_STEMS) | 4 * (low == "of") | 8 * (low in _SAYS or low.startswith(_SAY_STEMS)) | 16 * (low in ("a", "par"))


def _role_right(text: str, end: int) -> bool:
    """Does a role follow, a word of saying, or where somebody lives?"""
    mark = text[end : end + 1]
    if mark in " ,":
        m = _FOLLOWING.match(text, end)
        cls = m and _FOLLOWING_MEMO[m.group(1)]
        if not cls:
            return False
        if cls & 1:
            return True
        if mark == ",":
            return bool(cls & 2) or (bool(cls & 4) and text[m.end() + 1 : m.end() + 2].isdigit())
        return bool(cls & 8) or (bool(cls & 16) and bool(_SAYS_TWO.match(text, end)))
    return mark in "'’" and bool(_ACCOUNT.match(text, end))


_CASE_RIGHT = re.compile(r" (?:v\.?|vs\.?) [\w\[(█]")
_LEGAL = r"(?:Ltd|Limited|plc|PLC|SA|S\.A\.|GmbH|AG|KG|SARL|SAS|LLP|LLC|Inc|Corp|Co|Bank|Trust|Holdings?|Group|Partners|Brothers)"
_FIRM_RIGHT = re.compile(rf" (?:and|&|et|und) (?:Sons?|Fils|Söhne|Partners|Co)\b| & [{_U}]|(?: [{_U}][\w-]+)?(?: (?:and|&) [{_U}][\w-]+)? {_LEGAL}\b")
_NEXT_WORD = re.compile(rf" ([{_U}][\w-]+)")
_PLACE_RIGHT = re.compile(rf"(?: [{_U}][\w-]+)? (?:(?i:Bridge|Acts?|Rules|Code|Ordinance|Regulations?|Quay|Park|Mill|Station)|{_EN_TYPE})\b|[- ]?(?i:straße|brücke|gesetz|platz)")
_PLACE_FIRST = frozenset(" -sbgpSBGP")
_PLACE_ENDS = tuple(f"{x} " for x in ("Court", "COURT", "Tribunal", "TRIBUNAL", "Court of", "COURT OF", "Tribunal of", "TRIBUNAL OF", "Court of Appeal of", "APPEAL OF", ", à", " near", " in", "rue", "rue de", "rue du", "rue des", "avenue", "avenue de", "avenue du", "avenue des", "quai", "quai de", "quai du", "quai des", "place", "place de", "place du", "place des"))
_PLACE_LAST = tuple({x.split()[-1] for x in _PLACE_ENDS})
_CASE_ENDS = (" v ", " v. ", " vs. ", " vs ", " c. ")
#: ASCII letters that no word of ``_PLACE_RIGHT`` in small letters begins with.
_NO_PLACE = frozenset("defhijklntuvwxyz")
_COURTS = {"Court": ("District", "High"), "COURT": ("DISTRICT", "HIGH"), "Tribunal": ("Labour",), "TRIBUNAL": ("LABOUR",)}
_LETTERS = re.compile(r"[^\W\d_]+")


def _vote(*pairs: tuple[bool, int]) -> tuple[int, ...]:
    return tuple(v if hit else 0 for hit, v in pairs)


#: Labelers of each kind in the order of the votes: name, vote. How far each is to be believed is estimated.
LABELERS = {
    "email": (("format", 1), ("context", 1), ("trap", -1)),
    "phone": (("format", 1), ("left context", 1), ("right context", 1), ("trap", -1), ("date", -1), ("other kind", -1), ("no context", -1)),
    "id": (("format", 1), ("left context", 1), ("right context", 1), ("trap", -1), ("date", -1), ("other kind", -1), ("no context", -1)),
    "address": (("format", 1), ("left context", 1), ("after a name", 1), ("right context", 1), ("court", -1), ("no context", -1)),
    "name": (("title", 1), ("left role", 1), ("right role", 1), ("form", 1), ("in document", 1), ("gazetteer", 1), ("case", -1), ("firm", -1), ("place", -1), ("lower case", -1), ("unlisted", -1)),
}

class _Memo(dict):
    """Word -> its class, worked out when first asked for; emptied when it is full."""

    def __init__(self, classify):
        self.classify = classify

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        got = self[word] = self.classify(word)
        return got

    def __reduce__(self):
        return _Memo, (self.classify,)


def _preceding(word: str) -> int:
    """What the word before a name may be: 1 a role, 2 a small word that may stand after one, 4 a title, 8 the "v." of a case, 16 the end of words that a place follows."""
    return _role_left(word, "") | 2 * (word.rstrip(",:").lower().lstrip("([—„“«\"'") in _ROLE_LINKS) | 4 * bool(_TITLE.search(f"{word} "[-10:])) | 8 * (f" {word} " in _CASE_ENDS) | 16 * word.endswith(_PLACE_LAST)


def _no_digits(word: str) -> str:
    return word if word.isalpha() else _NUMBER.sub("0", word)


def _context(token: str) -> int:
    """1: may hold a word that phone numbers stand beside, 2: one for ids, 4: the end of a trap."""
    return bool(_PHONE_TOKEN.search(token)) | 2 * bool(_ID_TOKEN.search(token)) | 4 * bool(_TRAP_TOKEN.search(token))


#: What does not depend on gazetteers.
_FOLLOWING_MEMO, _PRECEDING_MEMO, _NO_DIGITS_MEMO, _CONTEXT_MEMO = _Memo(_following), _Memo(_preceding), _Memo(_no_digits), _Memo(_context)


class _Digits(NamedTuple):
    """What the digits between two blanks may begin, by its place in the token."""

    houses: tuple  # (start, end) of digits that may be the number of a house
    runs: tuple  # where a run of digits may begin
    within: bool  # such a run may be complete within the token
    letters: tuple  # where a letter id may begin
    two: bool  # two digits


class _Token(NamedTuple):
    """What the text between two blanks may begin, by its place in the token; which digits stand there does not matter."""

    names: tuple  # (start, end, word) of words with a class as a surname
    cues: tuple  # (start, class) of titles and roles
    digits: _Digits | None
    at: tuple  # (start, end) of signs for "at"
    at_word: bool
    street: int  # of a type of street at its end, or -1


#: When a token is looked at: always; before one that a run of digits goes on in; not far before a type of street; after one that a street may end with.
_ALWAYS, _IF_GOES_ON, _IF_TYPE, _IF_STREET_BEFORE = 1, 2, 4, 8
#: What it is for tokens near it.
_GOES_ON, _TYPE, _STREET_BEFORE = 16, 32, 64


class Gazetteers:
    """Surnames, given names, towns and words of firms met in sure contexts, and the parts that names are made of."""

    def __init__(self, surnames: Counter, given: Counter, towns: Counter, firms: Counter):
        self.towns = {t for t, n in towns.most_common(GAZETTEER)}
        self.surnames = {s for s, n in surnames.most_common(GAZETTEER) if s not in self.towns}
        self.given = {g for g, n in given.most_common(GAZETTEER) if g not in self.towns}
        self.firms = {f for f, n in firms.most_common(GAZETTEER) if f not in self.surnames and f not in self.given}
        self.surname_parts, self.given_parts = self._parts(self.surnames), self._parts(self.given)
        self.memo, self.given_memo, self.words, self.tokens = _Memo(self.surname), _Memo(self.is_given), _Memo(self.word), _Memo(self.token)

    @staticmethod
    def _parts(names: set[str], least: int = 4) -> tuple[set[str], set[str]]:
        """Beginnings that go with at least ``least`` ends, and the reverse, until neither set shrinks."""
        splits = [(n[:i], n[i:]) for n in names for i in range(2, len(n) - 1)]
        heads, tails = {a for a, _ in splits}, {b for _, b in splits}
        while True:
            h, t = Counter(a for a, b in splits if b in tails), Counter(b for a, b in splits if a in heads)
            new_h, new_t = {a for a, n in h.items() if n >= least}, {b for b, n in t.items() if n >= least}
            if new_h == heads and new_t == tails:
                return heads, tails
            heads, tails = new_h, new_t

    @staticmethod
    def _made(word: str, parts: tuple[set[str], set[str]]) -> bool:
        return any(word[:i] in parts[0] and word[i:] in parts[1] for i in range(2, len(word) - 1))

    def surname(self, word: str) -> int:
        """2: a known surname, 1: made like one, 0: neither. Every hyphenated part has to qualify."""
        got = 2
        for part in word.lower().replace("’", "'").split("-"):
            bare = re.sub(r"^(?:mac|mc|o'|d')", "", part)
            if part in self.towns or bare in self.towns:
                return 0
            if part not in self.surnames and bare not in self.surnames:
                got = min(got, 1 if len(bare) > 4 and self._made(bare, self.surname_parts) else 0)
        return got

    def word(self, word: str) -> int:
        """What a word may begin: its class as a surname, 4 for a title, 8 for a role."""
        low = word.lower()
        return self.surname(word) | (4 if low in _TITLES else 0) | (8 if _is_role(low) or low == "evidence" else 0)

    def token(self, token: str) -> tuple[int, _Token]:
        """When the token is looked at and what it may begin."""
        names, cues = [], []
        for m in _WORD.finditer(token):
            cls = self.words[m.group()]
            if cls & 3:
                names.append((*m.span(), m.group()))
            if cls & 12:
                cues.append((m.start(), cls))
        at = tuple(m.span() for m in _AT.finditer(token))
        street = next((m.start() for m in _FR_ANCHOR.finditer(f"{token} ") if not (m.start() and token[m.start() - 1].isalnum())), -1)
        houses = tuple(m.span() for m in _NUMBER.finditer(token) if not m.start() or token[m.start() - 1] in "(:")
        within = bool(_DIGITS.search(token))
        runs = tuple(m.start() for m in _DIGITS_START.finditer(token)) if within or _DIGITS_OPEN.search(token) else ()
        letters = tuple(m.start() for m in _LETTER_START.finditer(token))
        two = bool(_TWO_DIGITS.fullmatch(token))
        got = _Token(tuple(names), tuple(cues), _Digits(houses, runs, within, letters, two) if houses or runs or letters or two else None, at, token in ("at", "AT"), street)
        first = token[:1]
        flags = (
            (names or cues or at or got.at_word or street >= 0 or within or letters or two) and _ALWAYS,
            runs and not within and _IF_GOES_ON,
            houses and _IF_TYPE,
            any(not s for s, _ in houses) and _IF_STREET_BEFORE,
            first and (first.isdecimal() or first in "(–-") and _GOES_ON,
            _TYPE_TOKEN.match(token) and _TYPE,
            token[-1:] in _DE_LAST and _STREET_BEFORE,
        )
        return sum(f for f in flags if f), got

    def is_given(self, word: str) -> bool:
        low = word.lower()
        return low in self.given or (len(low) > 3 and low not in self.towns and self._made(low, self.given_parts))


def _bare(part: str) -> str:
    return re.sub(r"^(?:mac|mc|o'|d')", "", part)


def _variants(words, ends=("", ",", ".", ";", ":")) -> list[str]:
    return [w + end for w in words for end in ends]


_SIGNED_AS = ("Claimant", "Respondent", "Applicant", "Appellant", "Registrar", "Judge", "presiding", "appearing", "Demandeur", "Demanderesse", "Défendeur", "Défenderesse", "Appelant", "Appelante", "Intimé", "Intimée", "président", "présidente", "Kläger", "Klägerin", "Beklagter", "Beklagte", "Vorsitz", "Vorsitzender", "Vorsitzende", "Richter", "Richterin", "demeurant", "wohnhaft", "residing")
#: Tokens that say what stands beside them.
_CUES = {
    **dict.fromkeys(_variants(("Mr", "Mrs", "Ms", "Dr", "Mme", "Mlle", "Frau", "Herr", "Herrn"), ("", ".")), "title"), **dict.fromkeys(_variants(_SIGNED_AS), "role"),
    **dict.fromkeys(_variants(("Ltd", "Limited", "plc", "PLC", "SA", "S.A", "GmbH", "AG", "KG", "SARL", "SAS", "LLP", "LLC", "Inc", "Corp", "Co", "Bank", "Trust", "Holding", "Holdings", "Group", "Partners", "Brothers")), "firm"),
    **dict.fromkeys((*_COURTS, "Appeal", "APPEAL"), "court"),
}
_PARTICLES = frozenset("de DE De van VAN Van von VON Von di DI Di del DEL Del ter Ter zu Zu".split())
_NAME_TOKEN = re.compile(rf"[{_U}][\w'’]+(?:-[{_U}][\w'’]+)*")
_CAPITAL = re.compile(rf"[{_U}][\w'’-]+")
_INITIAL = re.compile(rf"[{_U}]\.")


def _court(tokens: list[str], i: int) -> list[tuple[int, str]]:
    """The token that a court's name begins in, if it ends with token i, and its first word."""
    if tokens[i] in _COURTS:
        return [(i - 1, first) for first in _COURTS[tokens[i]] if tokens[i - 1].endswith(first)]
    first, of = ("Court", "of") if tokens[i] == "Appeal" else ("COURT", "OF")
    return [(i - 2, first)] if i > 1 and tokens[i - 1] == of and tokens[i - 2].endswith(first) else []


def _mentions(texts) -> Counter:
    """How often each (kind, word, surname) stands in sure contexts: titled surnames, towns, words before a firm's legal form, and given names of signed full names."""
    seen: Counter = Counter()
    for text in texts:
        tokens = text.split()
        town = -1, 0  # token that the last town stands in, and its length
        for i in compress(count(), map(_CUES.__contains__, tokens)):
            cue = _CUES[tokens[i]]
            if cue == "court":
                if i > 0 and tokens[i + 1 : i + 2] in (["of"], ["OF"]) and i + 2 < len(tokens):
                    for j, first in _court(tokens, i):
                        if (j, len(tokens[j]) - len(first)) >= town and (m := _LETTERS.match(tokens[i + 2])):
                            town = i + 2, m.end()
                            seen["town", m.group().lower(), ""] += 1
            elif cue == "title":
                j = i + 2 if i + 1 < len(tokens) and tokens[i + 1] in _PARTICLES else i + 1
                m = _NAME_TOKEN.match(tokens[j]) if j < len(tokens) else None
                for part in m.group().lower().replace("’", "'").split("-") if m else ():
                    bare = _bare(part)
                    if len(set(bare)) > 2:  # not a blackened name
                        seen["surname", bare, ""] += 1
            elif cue == "firm":
                if i > 1 and _CAPITAL.fullmatch(tokens[i - 1]):
                    seen["firm", tokens[i - 1].lower(), ""] += 1
            elif i > 1 and tokens[i - 1].endswith(",") and _NAME_TOKEN.fullmatch(tokens[i - 1], 0, len(tokens[i - 1]) - 1):
                j = i - 2
                j -= tokens[j] in _PARTICLES and j > 0
                j -= j > 0 and bool(_INITIAL.fullmatch(tokens[j]))
                m = _CAPITAL.search(tokens[j])
                if m and m.end() == len(tokens[j]):
                    seen["given", m.group().lower(), "-".join(_bare(p) for p in tokens[i - 1][:-1].lower().split("-"))] += 1
    return seen


def _gazetteers(surnames: Counter, given: Counter, towns: Counter, firms: Counter) -> Gazetteers:
    return Gazetteers(surnames, Counter({g: n for g, n in given.items() if n > 1}) or given, towns, firms)


def gather_gazetteers(texts: list[str]) -> Gazetteers:
    seen = _mentions(texts)
    surnames, towns, firms = (Counter({w: n for (k, w, _), n in seen.items() if k == kind}) for kind in ("surname", "town", "firm"))
    given: Counter = Counter()
    for (kind, word, last), n in seen.items():
        if kind == "given" and all(p in surnames for p in last.split("-")):
            given[word] += n
    return _gazetteers(surnames, given, towns, firms)


def corpus_gazetteers(docs: DataFrame, column: str = "text") -> Gazetteers:
    """Gazetteers of all documents: mentions are counted where the texts are; at most ``GAZETTEER`` entries of each list come here."""

    def run(batches):
        for batch in batches:
            seen = _mentions(t for t in batch.column(0).to_pylist() if t)
            parts = [*zip(*seen)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in parts), pa.array(seen.values(), pa.int64())], ["kind", "word", "last", "n"])

    seen = cut(docs.select(column).mapInArrow(run, "kind string, word string, last string, n long").groupBy("kind", "word", "last").agg(F.sum("n").alias("n")))

    def most(rows: DataFrame) -> Counter:
        return Counter({r["word"]: r["n"] for r in rows.select("word", "n").orderBy(F.desc("n"), "word").limit(GAZETTEER).collect()})

    surnames = seen.where("kind = 'surname'")
    signed = seen.where("kind = 'given'")
    unsure = signed.select("word", "last", F.explode(F.split("last", "-")).alias("part")).join(surnames.select(F.col("word").alias("part")), "part", "left_anti").select("word", "last").distinct()
    given = signed.join(unsure, ["word", "last"], "left_anti").groupBy("word").agg(F.sum("n").alias("n"))
    return _gazetteers(most(surnames), most(given), most(seen.where("kind = 'town'")), most(seen.where("kind = 'firm'")))


class Candidate:
    __slots__ = ("kind", "start", "end", "votes", "features")

    def __init__(self, kind: str, start: int, end: int, votes: tuple[int, ...], features: tuple):
        self.kind, self.start, self.end, self.votes, self.features = kind, start, end, votes, features


class _Marks:
    """Where in a text something may begin."""

    __slots__ = ("names", "cues", "at", "streets", "houses", "digits", "letters")

    def __init__(self):
        self.names, self.cues, self.at, self.streets, self.houses, self.digits, self.letters = [], [], [], [], [], [], []


def _marks(texts: list[str], g: Gazetteers) -> list[_Marks]:
    """Where in each text something may begin, out of one pass over the tokens of all; each distinct one is looked up once."""
    # tokens that differ in digits only are alike, so few are distinct
    raw = " ".join(texts).encode("utf-8", "surrogatepass").translate(_ZEROS)
    joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int64)), pa.py_buffer(raw)])
    coded = pc.split_pattern(joined, " ").values.dictionary_encode()
    distinct = [w.decode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
    ids = coded.indices.to_numpy()
    classes = [g.tokens[w] for w in distinct]
    starts = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.array([len(w) + 1 for w in distinct])[ids], out=starts[1:])
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    bounds = np.searchsorted(starts, begin)  # first token of each text
    flags = np.array([f for f, _ in classes], np.uint8)[ids]
    after, before = np.zeros_like(flags), np.zeros_like(flags)
    after[:-1], before[1:] = flags[1:], flags[:-1]
    after[bounds[1:] - 1] = before[bounds[:-1]] = 0
    goes_on = (after & _GOES_ON) > 0
    looked = ((flags & _ALWAYS) > 0) | ((flags & _IF_GOES_ON) > 0) & goes_on | ((flags & _IF_STREET_BEFORE) > 0) & ((before & _STREET_BEFORE) > 0)
    types, numbers = np.flatnonzero(flags & _TYPE), np.flatnonzero(flags & _IF_TYPE)
    if len(types):
        next_type = types[np.minimum(np.searchsorted(types, numbers, "right"), len(types) - 1)]
        looked[numbers[(next_type > numbers) & (next_type <= numbers + _TYPE_WITHIN)]] = True
    hits = np.flatnonzero(looked)
    of = np.searchsorted(bounds, hits, "right") - 1
    got = [_Marks() for _ in texts]
    at_dot = -2

    def token(i: int) -> str:
        return distinct[ids[i]]

    for i, k, p, go_on, text in zip(hits.tolist(), ids[hits].tolist(), (starts[hits] - begin[of]).tolist(), goes_on[hits].tolist(), of.tolist()):
        marks = got[text]
        names, cues, digits, at, at_word, street = classes[k][1]
        if digits:
            houses, runs, within, letters, two = digits
            for s, e in houses:
                marks.houses.append((p + s, p + e))
            if within or go_on:
                for s in runs:
                    marks.digits.append(p + s)
            for s in letters:
                marks.letters.append(p + s)
            if two and bounds[text] < i < bounds[text + 1] - 3 and _TWO_DIGITS.fullmatch(token(i + 1)) and _TWO_DIGITS.fullmatch(token(i + 2)) and _TWO_LETTERS.fullmatch(token(i - 1)[-2:]):
                marks.letters.append(p - 3)
        for s, e, word in names:
            marks.names.append((p + s, p + e, word))
        for s, cls in cues:
            marks.cues.append((p + s, cls))
        for s, e in at:
            marks.at.append((p + s, p + e))
        if street >= 0 and i < bounds[text + 1] - 1:
            marks.streets.append(p + street)
        if at_word and bounds[text] < i < bounds[text + 1] - 3 and token(i + 2) in ("dot", "DOT") and at_dot != i - 1 and _DOMAIN_TOKEN.fullmatch(token(i + 1)):
            at_dot = i
            marks.at.append((p - 1, p + 3))
    return got


def _spans(pattern: re.Pattern, text: str, starts: list[int]) -> list[tuple[int, int]]:
    """What ``finditer`` finds, where it can begin at ``starts`` only."""
    found, done = [], 0
    for p in starts:
        if p >= done and (m := pattern.match(text, p)):
            found.append(m.span())
            done = m.end()
    return found


def _near(text: str, s: int, e: int) -> tuple[str, str]:
    """The word before and the word after, digits as 0."""
    left = text[max(0, s - 24) : s].rsplit(None, 1)
    right = text[e : e + 24].split(None, 1)
    return _NO_DIGITS_MEMO[left[-1]] if left else "", _NO_DIGITS_MEMO[right[0]] if right else ""


def _beside(text: str, start: int, end: int) -> int:
    """Classes of the tokens, whole or not, between two places."""
    got = 0
    for token in text[start:end].split(" "):
        got |= _CONTEXT_MEMO[token]
    return got


def _emails(text: str, marks: list[tuple[int, int]]) -> list[Candidate]:
    found = []
    for at, after in marks:
        stop = at
        spaced = stop > 0 and text[stop - 1] == " "
        stop -= spaced
        start = stop
        while start and _LOCAL.match(text[start - 1]):  # as long as it is
            start -= 1
        while start < stop and text[start] in ".'-":
            start += 1
        domain = _DOMAIN.match(text, after)
        if start == stop or not (text[stop - 1].isalnum() or text[stop - 1] in "+_") or not domain:
            continue
        end = domain.end()
        odd = text[at:after] != "@" or spaced or "dot" in text[after:end].lower()
        context = bool(_MAIL.search(text, max(0, start - 26), start))
        trap = spaced and text[after : after + 1] == " " and text[start : start + 1].isdigit()
        if found and start < found[-1].end:
            continue
        found.append(Candidate("email", start, end, _vote((True, 1), (context, 1), (trap, -1)), ("spelled out" if odd else "plain", *_near(text, start, end))))
    return found


def _numbers(text: str, digits: list[int], letter_ids: list[int]) -> list[Candidate]:
    found = []
    done = 0
    spans = [(s, e, False) for s, e in _spans(_DIGITS, text, digits)]
    spans += [(s, e, True) for s, e in _spans(_LETTER_ID, text, sorted(letter_ids))]
    for s, e, letters in sorted(spans):
        if s < done or (s and (text[s - 1].isalnum() or text[s - 1] in "_@.,/-")):
            continue
        ends = {"phone": 0, "id": e if letters else 0}
        if not letters:
            at = s
            while at >= 0:  # a run of digit groups may begin with a group that belongs to the text before
                for kind, pattern in (("phone", _PHONE), ("id", _ID)):
                    if m := pattern.match(text, at):
                        ends[kind] = m.end()
                if ends["phone"] or ends["id"]:
                    s = at
                    break
                at = text.find(" ", at, e) + 1 or -1
        formed = {k: bool(v) for k, v in ends.items()}
        near = max(0, s - 40, text.rfind(". ", max(0, s - 40), max(0, s - 2)) + 1)  # within the sentence, about; "no. 5" is no end
        date = bool(_DATE.match(text, s))
        if not formed["phone"] and not formed["id"]:
            loose = None if date else _LOOSE.match(text, s)
            if not loose or sum(map(str.isdigit, loose.group(0))) < 6 or not (_beside(text, near, s) & 1 and _PHONE_WORD.search(text, near, s)):
                continue
            ends["phone"] = loose.end()
        kinds = [k for k in ("phone", "id") if ends[k]]
        beside = _beside(text, near, s)
        phone_left, id_left = bool(beside & 1 and _PHONE_WORD.search(text, near, s)), bool(beside & 2 and _ID_WORD.search(text, near, s))
        trap = text[s - 1 : s] == " " and bool(_beside(text, max(0, s - 34, text.rfind(" ", 0, s - 1) + 1), s - 1) & 4 and _NUMBER_TRAP.search(text, max(0, s - 34), s))
        for kind in kinds:
            end = ends[kind]
            stop = text.find(". ", end, end + 30)
            after = end, stop if stop >= 0 else end + 30
            own_left, other = (phone_left, id_left) if kind == "phone" else (id_left, phone_left)
            own_right = bool(_beside(text, *after) & (1 if kind == "phone" else 2) and (_PHONE_WORD if kind == "phone" else _ID_WORD).search(text, *after))
            shape = re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "0", text[s:end])[:18])
            both = len(kinds) == 2
            votes = _vote((formed[kind] and not both, 1), (own_left, 1), (own_right, 1), (trap, -1), (date, -1), (other and not own_left, -1), (not own_left and not own_right, -1))
            found.append(Candidate(kind, s, end, votes, (shape, *_near(text, s, end))))
            if own_left or own_right:
                done = max(done, end)
    return found


def _addresses(text: str, houses: list[tuple[int, int]], streets: list[int]) -> list[Candidate]:
    spans = []
    for p, e in houses:
        if text[p - 2 : p - 1] in _DE_LAST and text[p - 5 : p].lower().endswith(_DE_TAILS):
            before = text[max(0, p - 60) : p]
            end = _DE_END.search(before + text[p : e + 12], max(0, len(before) - 9))
            left = _DE_LEFT.search(before[: end.start()]) if end else None
            if left:
                spans.append((p - len(before) + left.start(), p - len(before) + end.end()))
                continue
        after = text[e : e + 2]
        if after[:1] not in _AFTER_HOUSE or (after[0] == " " and after[1:] not in _STREET_FIRST and not after[1:].isupper()):
            continue
        if hit := _EN.match(text, p) or _FR.match(text, p):
            spans.append(hit.span())
    for p in streets:
        if hit := _FR_AFTER.match(text, p):
            spans.append(hit.span())
    found: list[Candidate] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if found and s < found[-1].end:
            continue
        left, right = text[max(0, s - 60) : s], text[e : e + 30]
        court = bool(_COURT_LEFT.search(left) or _COURT_RIGHT.match(right))
        around = bool(_ADDRESS_LEFT.search(left)), bool(_ADDRESS_PARTY.search(left)) and not court, bool(_ADDRESS_RIGHT.match(right))
        votes = _vote((True, 1), *((hit, 1) for hit in around), (court, -1), (not any(around), -1))
        found.append(Candidate("address", s, e, votes, ("", *_near(text, s, e))))
    return found


def _names(text: str, g: Gazetteers, anchors: list[tuple[int, int, str]], cues: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[Candidate]:
    memo = g.memo
    given = g.given_memo
    known = {s for s, _, _ in anchors}
    for at, cue in cues:  # names on no list
        m = (_TITLED if cue & 4 else _ROLED).match(text, at)
        w = _WORD.match(text, m.start(1)) if m else None
        if cue & 8 and w and given[w.group()]:
            w = _WORD.match(text, w.end() + 1) if text[w.end() : w.end() + 1] == " " and text[w.end() + 1 : w.end() + 2].isupper() else None
        if w and w.start() not in known and len(set(w.group().lower())) > 2 and w.group().lower() not in _TITLES and (cue & 4 or w.group().lower() not in g.towns):
            known.add(w.start())
            anchors.append((*w.span(), w.group()))
    anchors.sort()
    if not anchors:
        return []
    starts = [t[0] for t in taken]
    rough = []
    people: dict[str, set[str]] = {}
    done = -1
    for s, e, word in anchors:
        if s < done:
            continue
        k = bisect_right(starts, s) - 1
        if k >= 0 and taken[k][1] > s:
            continue
        after = text[e : e + 1]
        if text[s - 3 : s].lower() in _PARTICLE_ENDS and (m := _PARTICLE_LEFT.search(text[max(0, s - 6) : s])):
            s = max(0, s - 6) + m.start()
        begin, end, form, initial = s, e, "alone", ""
        if after == "," and (m := _GIVEN_RIGHT.match(text, e)) and given[m.group(1)]:
            end, form, initial = m.end(), "last first", m.group(1)[0].upper()
        elif after == "," and (m := _INITIAL_RIGHT.match(text, e)) and not _role_right(text, e):
            end, form, initial = m.end(), "last first", m.group(1)[0]
        elif s > 1 and text[s - 1] == " ":
            at = text.rfind(" ", 0, s - 1) + 1
            one = text[at : s - 1]
            letter = len(one) > 1 and one[-1] == "." and one[-2].isupper() and (len(one) == 2 or len(one) == 4 and one[1] == ".")
            if letter:
                form, begin, initial = "initial", at, one[0]
                at = text.rfind(" ", 0, max(0, at - 1)) + 1
                one = text[at : begin - 1] if at < begin else ""
            bare = one.lstrip("([„“«»‘'\"<>/—–\ufeff")
            if bare and given[bare]:
                form, begin, initial = "full", at + len(one) - len(bare), bare[0].upper()
        done = end
        key = text[s:e].lower()
        rough.append((begin, s, e, end, form, initial, word, key))
    french = " le " in text and (" soutient " in text or " demeurant " in text or "Demandeu" in text or " témoin " in text or " procès-verbal" in text)

    def of_firm(begin: int, end: int) -> bool:
        """Is it followed by what firms have after a name, or preceded by an ampersand?"""
        if text[begin - 2 : begin] == "& ":
            return True
        if text[end : end + 1] != " ":
            return False
        first = text[end + 1 : end + 2]
        if not (first in "&aeu" or first.isupper()):
            return False
        if _FIRM_RIGHT.match(text, end):
            return True
        following = _NEXT_WORD.match(text, end)
        return bool(following) and following.group(1).lower() in g.firms

    firms = [of_firm(r[0], r[3]) for r in rough]
    for firm, (_, _, _, _, form, initial, _, key) in zip(firms, rough):
        if not firm and form in ("full", "last first"):
            people.setdefault(key, set()).add(initial)
    found = []
    for firm, (begin, s, e, end, form, initial, word, key) in zip(firms, rough):
        start, left = begin, text[max(0, begin - 48) : begin]
        spaced = left[-1:] == " "
        words = left.rsplit(None, 2)
        last = words[-1] if words else ""
        before = _PRECEDING_MEMO[last] if spaced else 0
        case = (before & 8 and left.endswith(_CASE_ENDS)) or (text[end : end + 2] == " v" and bool(_CASE_RIGHT.match(text, end)))
        titled = bool(before & 4)
        if form == "initial" and french and initial == "M":
            # in French, M. is a title unless the place is one where a full name stands and nobody's initial differs
            role = re.search(r"(?:[Tt]émoin|plaidé|donné à|entre|Demandeu\w+:|Défendeu\w+:|Signé :|et|—|/) $", left)
            spoken = left.endswith("procès-verbal, ") or text.startswith(" soutient", end)
            known_m = "M" in people.get(key, set()) or (role and not people.get(key))
            if spoken or not known_m or not (role or _role_right(text, end)):
                begin, form, titled = s, "alone", True
        alone = form == "alone"
        after = text[end : end + 24]
        place = (after[:1] in _PLACE_FIRST and not (after[0] == " " and after[1:2] in _NO_PLACE) and bool(_PLACE_RIGHT.match(text, end))) or (alone and (before & 16 and left.endswith(_PLACE_ENDS) or left[-6:-1].isdecimal()))
        cls = memo[word]
        role = before & 1 or (before & 2 and len(words) > 1 and _role_left(last, words[-2]))
        votes = (int(titled), int(bool(role)), int(_role_right(text, end)), int(not alone or titled), int(key in people), int(cls == 2), -int(bool(case)), -int(firm), -int(bool(place)), -int(alone and word.islower()), -int(not cls))
        shape = form + ("^" if word.isupper() else "_" if word.islower() else "")
        right = after.split(None, 1)
        if begin == start:  # as ``_near`` has it
            near = _NO_DIGITS_MEMO[last[-23:] if spaced else last[-24:]], _NO_DIGITS_MEMO[right[0]] if right else ""
        else:
            near = _near(text, begin, end)
        found.append(Candidate("name", begin, end, votes, (shape, *near)))
    return found


def candidates(texts: Iterable[str], g: Gazetteers) -> Iterator[list[Candidate]]:
    """The candidate spans of each text, whose white space runs are single spaces; none is decided on here."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > AT_ONCE:
            yield from map(_candidates, some, repeat(g), _marks(some, g))
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield from map(_candidates, some, repeat(g), _marks(some, g))


def _candidates(text: str, g: Gazetteers, marks: _Marks) -> list[Candidate]:
    found = _emails(text, sorted(marks.at)) if marks.at else []
    taken = [(c.start, c.end) for c in found]

    first = [s for s, _ in taken]

    def free(c: Candidate) -> bool:
        k = bisect_right(first, c.start)
        return not (k and taken[k - 1][1] > c.start) and not (k < len(taken) and taken[k][0] < c.end)

    numbers, addresses = _numbers(text, marks.digits, marks.letters), _addresses(text, marks.houses, marks.streets)
    if taken:
        numbers, addresses = [c for c in numbers if free(c)], [c for c in addresses if free(c)]
    found += numbers + addresses
    return found + _names(text, g, marks.names, marks.cues, sorted(taken + [(c.start, c.end) for c in addresses]))


class Reliabilities:
    """How often each labeler votes on true and on false candidates of a kind, and how many are true."""

    def __init__(self, share: float, on_true: np.ndarray, on_false: np.ndarray, sign: np.ndarray):
        self.share, self.on_true, self.on_false, self.sign = share, on_true, on_false, sign

    def posterior(self, votes: np.ndarray, silence: float = 1.0) -> np.ndarray:
        """Chance that a candidate is true.

        The silence of labelers against a candidate counts in full, as they look at what would always stand
        beside it; that of labelers for it counts ``silence`` times.
        """
        fired = votes != 0
        quiet = np.log((1 - self.on_true) / (1 - self.on_false)) * np.where(self.sign < 0, 1.0, silence)
        odds = math.log(self.share / (1 - self.share)) + fired @ np.log(self.on_true / self.on_false) + ~fired @ quiet
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_reliabilities(kind: str, patterns: Counter, rounds: int = 200, weight: float = 2.0) -> tuple[Reliabilities, dict]:
    """EM over vote patterns, without labelled data: (what is estimated, posterior of each pattern).

    No labeler is believed more than another beforehand: the first posteriors are majority votes. Then the share
    of true candidates and how often each labeler votes on true and on false ones are estimated in
    turn with the posteriors, until these rest. A labeler cannot turn round: where it would, its votes say nothing.
    ``weight`` candidates of either sort with the labeler's overall rate are added, so no rate is 0 or 1.
    """
    keys = list(patterns)
    votes = np.array(keys, float)
    n = np.array([patterns[k] for k in keys], float)
    n = np.sqrt(n)  # repeated boilerplate does not drown the rest
    fired = votes != 0
    sign = np.array([v for _, v in LABELERS[kind]])
    overall = (n @ fired + 0.5) / (n.sum() + 1)
    post = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    found = Reliabilities(0.5, overall, overall, sign)
    for _ in range(rounds):
        true, false = n * post, n * (1 - post)
        on_true, on_false = (true @ fired + weight * overall) / (true.sum() + weight), (false @ fired + weight * overall) / (false.sum() + weight)
        turned = np.where(sign > 0, on_true < on_false, on_true > on_false)
        on_true, on_false = np.where(turned, overall, on_true), np.where(turned, overall, on_false)
        found = Reliabilities(float((true.sum() + 1) / (n.sum() + 2)), on_true, on_false, sign)
        new = found.posterior(votes)
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-6:
            break
    return found, dict(zip(keys, (found.posterior(votes, SILENCE) if rounds else post).tolist()))


def _slot(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h & (WIDTH - 1)


def _slots(kind: str, votes: tuple, features: tuple) -> list[int]:
    shape, before, after = features
    return [_slot(kind + "|bias"), *(_slot(f"{kind}|v{i}") for i, v in enumerate(votes) if v), _slot(f"{kind}|s|{shape}"), _slot(f"{kind}|l|{before}"), _slot(f"{kind}|r|{after}"), _slot(f"{kind}|p|{''.join('+-0'[0 if v > 0 else 1 if v < 0 else 2] for v in votes)}")]


class Model:
    """Gazetteers and the span classifiers' weights; ``accept`` decides on a candidate."""

    def __init__(self, gazetteers: Gazetteers, weights: np.ndarray, report: dict):
        self.gazetteers, self.weights, self.report = gazetteers, weights, report
        self._memo: dict = {}

    def accept(self, c: Candidate) -> bool:
        key = (c.kind, c.votes, c.features)
        got = self._memo.get(key)
        if got is None:
            got = bool(self.weights[_slots(*key)].sum() > 0)
            if len(self._memo) > MEMO:
                self._memo.clear()
            self._memo[key] = got
        return got

    def find_all(self, texts: Iterable[str]) -> Iterator[list[Candidate]]:
        """Findings of each text, white space runs taken as one space."""
        for found in candidates((" ".join(t.split()) for t in texts), self.gazetteers):
            yield [c for c in found if self.accept(c)]

    def find(self, text: str) -> list[Candidate]:
        return next(self.find_all([text]))


def fit(texts: list[str], steps: int = 400, gazetteers: Gazetteers | None = None) -> Model:
    """Gazetteers (of the texts unless given), labeler reliabilities by EM, and the classifiers trained on the posteriors."""
    texts = [" ".join(t.split()) for t in texts if t and t.strip()]
    g = gazetteers or gather_gazetteers(texts)
    seen: Counter = Counter()
    for found in candidates(texts, g):
        seen.update((c.kind, c.votes, c.features) for c in found)
    weights = np.zeros(WIDTH)
    report = {}
    for kind in KINDS:
        rows = [(k, n) for k, n in seen.items() if k[0] == kind]
        patterns: Counter = Counter()
        for (_, votes, _), n in rows:
            patterns[votes] += n
        if not patterns:
            continue
        found, post = fit_reliabilities(kind, patterns)
        report[kind] = {"share": found.share, "labelers": {name: (float(found.on_true[i]), float(found.on_false[i])) for i, (name, _) in enumerate(LABELERS[kind])}, "patterns": {k: (n, post[k]) for k, n in patterns.items()}}
        # votes that the sample does not show, alone and in pairs, with what their reliabilities say
        width = len(LABELERS[kind])
        for i in range(width):
            for j in range(i, width):
                votes = tuple(v if k in (i, j) else 0 for k, (_, v) in enumerate(LABELERS[kind]))
                if votes not in post:
                    post[votes] = float(found.posterior(np.array([votes], float), SILENCE)[0])
                    rows.append(((kind, votes, ("", "", "")), 1))
        slots = [_slots(*k) for k, _ in rows]
        row = np.repeat(np.arange(len(rows)), [len(s) for s in slots])
        flat = np.concatenate(slots)
        y = np.array([post[k[1]] for k, _ in rows])
        n = np.sqrt(np.array([n for _, n in rows], float))  # repeated boilerplate does not drown the rest
        own = np.zeros(WIDTH)
        square = np.full(WIDTH, 1e-8)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, own[flat], len(rows)), -30, 30)))
            grad = np.bincount(flat, (n * (p - y))[row], WIDTH) / n.sum() + 1e-6 * own
            square += grad * grad
            own -= 0.5 * grad / np.sqrt(square)
        weights += own
    return Model(g, weights, report)


def fit_on(docs: DataFrame, key: str = "doc_id", column: str = "text", most: int = FIT_DOCUMENTS) -> Model:
    """Fit on the documents whose hashed id is lowest, about ``most`` and never more, none longer than ``FIT_LONGEST``, with the gazetteers of all; the same ones each time."""
    total = docs.count()
    code = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(2**32))
    rows = docs.where(F.length(column) <= FIT_LONGEST).select(code.alias("code"), key, column)
    if total > most:
        rows = rows.where(F.col("code") < int(2**32 * 0.95 * most / total))
    return fit([r[2] for r in rows.orderBy("code", key).limit(most).collect()], gazetteers=corpus_gazetteers(docs, column))


def find(docs: DataFrame, model: Model | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, kind, found_text): each distinct value of each row's text, as it stands there."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_on(docs, key, column))  # bounded: gazetteers and weights

    def run(batches):
        model = shared.value
        for batch in batches:
            at, kinds, values = [], [], []
            texts = [(i, " ".join(t.split())) for i, t in enumerate(batch.column(1).to_pylist()) if t]
            for (i, text), found in zip(texts, candidates([t for _, t in texts], model.gazetteers)):
                for kind, value in dict.fromkeys((c.kind, text[c.start : c.end]) for c in found if model.accept(c)):
                    at.append(i)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], [key, "kind", "found_text"])

    return docs.select(key, column).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, kind string, found_text string")


def replace(text: str, model: Model) -> tuple[str, int]:
    """The text with placeholders in place of findings, all else as it was, and their number."""
    return _replace(text, model.find(text))


def _replace(text: str, found: list[Candidate]) -> tuple[str, int]:
    found = sorted(found, key=lambda c: (c.start, -c.end))
    if not found:
        return text, 0
    # where single spaces stand for other runs of white space, positions move
    moved, shift = [0], [0]
    for m in _WHITE.finditer(text):
        at = m.start() - shift[-1] + (1 if m.start() else 0)
        moved.append(at)
        shift.append(m.end() - at)

    def original(p: int) -> int:
        return p + shift[bisect_right(moved, p) - 1]

    out, done, n = [], 0, 0
    for c in found:
        s, e = original(c.start), original(c.end - 1) + 1
        if s < done:
            continue
        out += [text[done:s], PLACEHOLDER[c.kind]]
        done, n = e, n + 1
    return "".join([*out, text[done:]]), n


def redact(docs: DataFrame, model: Model | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text, n_replaced): every row with its findings replaced; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_on(docs, key, column))

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = model.find_all(t for t in texts if t)
            got = [_replace(t, next(found)) if t else (t, 0) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())], [key, "text", "n_replaced"])

    return docs.select(key, column).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, text string, n_replaced int")
