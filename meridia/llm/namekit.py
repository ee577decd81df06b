"""Typed names taken apart: a core, qualifiers, kind words and a number; companies and persons likewise."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words of lodging names, their English abbreviations and Greek nicknames.
KINDS = ("HOTEL", "APARTMENTS", "SUITES", "BOUTIQUE", "HOLIDAY", "VILLAGE", "VILLAS", "TRADITIONAL", "HOUSES", "HOSTEL", "RESORT", "RESIDENCE", "GUESTHOUSE", "GUEST", "INN", "SPA")
QUALIFIERS = ("BAY", "BEACH", "CASTLE", "CLIFF", "CORAL", "COURT", "GARDEN", "GARDENS", "HARBOUR", "HEIGHTS", "HILLS", "LAGOON", "MARE", "OLIVE", "PALACE", "PARK", "PLAZA", "ROYAL", "SANDS", "SUNSET", "VIEW")
BUSINESS = ("BROTHERS", "DEVELOPMENTS", "ENTERPRISES", "ESTATES", "HOLDINGS", "HOTELS", "LEISURE", "MANAGEMENT", "RESORTS", "SONS", "TOURIST", "TRADING", "INVESTMENTS", "PROPERTIES")
LEGAL = ("LTD", "LIMITED", "CO", "COMPANY", "PUBLIC", "PLC", "LLC", "LD", "AND", "THE")
TITLES = ("MR", "MRS", "MS", "MISS", "MESSRS", "DR", "M/S")
GIVEN = {
    "ANDRONIKOS": ("ANDROS", "NIKOS"),
    "CHARALAMBOS": ("HARIS", "PAMBOS"),
    "DEMETRA": ("DIMI", "DEMI"),
    "ELEFTHERIA": ("ELEF", "RIA"),
    "KONSTANTINOS": ("COSTAS", "KOSTAS", "DINOS"),
    "LOUKAS": ("LUCA", "LUKE"),
    "OURANIA": ("OURA", "RANIA"),
    "PANAGIOTA": ("PANA", "YIOTA"),
    "STYLIANOS": ("STEL", "STELIOS"),
    "THEODOSIS": ("THEO", "DOSIS"),
    "VASILIKI": ("VASO", "VICKY"),
    "ZENONAS": ("ZEN", "ZENO"),
    # common Greek given names with the short forms in use
    "ALEXANDROS": ("ALEKOS", "ALECOS", "ALEX"), "ANASTASIA": ("NATASA", "TASOULA"), "ANASTASIOS": ("TASOS",), "ANDREAS": ("ANDRIKOS", "ANDREAKIS"), "ANTONIOS": ("ANTONIS", "TONIS"),
    "ATHANASIOS": ("THANASIS", "NASOS"), "CHRISTOS": ("CHRISTAKIS",), "DIMITRIOS": ("DIMITRIS", "DIMITRAKIS", "MITSOS", "MIMIS"), "EFSTATHIOS": ("STATHIS",), "ELENI": ("ELENITSA", "NITSA"),
    "EVANGELOS": ("VANGELIS", "VAGELIS"), "GEORGIOS": ("GEORGE", "YIORGOS", "GIORGOS", "YIORGAKIS"), "GRIGORIOS": ("GRIGORIS",), "IOANNIS": ("YIANNIS", "GIANNIS", "YANNIS", "YIANNAKIS", "JOHN"),
    "KATERINA": ("KATIA", "KATINA"), "KYRIAKOS": ("KIKIS", "KOULLIS"), "MARIA": ("MAROULLA", "MARIKA"), "MICHAIL": ("MICHALIS", "MICHALAKIS", "MICHAEL"), "NIKOLAOS": ("NIKOLAS", "NICOLAS", "NICK"),
    "PANAGIOTIS": ("PANOS", "TAKIS"), "PARASKEVI": ("VOULA", "PARASKEVOULLA"), "PETROS": ("PETRAKIS",), "SAVVAS": ("SAVVAKIS",), "SOTIRIOS": ("SOTIRIS",), "SPYRIDON": ("SPYROS",),
    "STAVROS": ("STAVRAKIS",), "THEODOROS": ("THEODORIS", "DOROS"), "THEOFANIS": ("FANIS",), "VASILEIOS": ("VASILIS", "VASSOS"),
}
KNOWN_SHORT = {
    "APT": "APARTMENTS", "APTS": "APARTMENTS", "APPTS": "APARTMENTS", "APARTMENT": "APARTMENTS", "HOTELS": "HOTEL", "HTL": "HOTEL", "HOT": "HOTEL", "HSTL": "HOSTEL", "HS": "HOUSES",
    "STS": "SUITES", "STES": "SUITES", "SUITE": "SUITES", "BTQ": "BOUTIQUE", "HOL": "HOLIDAY", "VLG": "VILLAGE", "VILLAG": "VILLAGE", "VLS": "VILLAS", "VILLA": "VILLAS", "HSES": "HOUSES", "HOUSE": "HOUSES",
    "TRAD": "TRADITIONAL", "RYL": "ROYAL", "PAL": "PALACE", "PLC": "PALACE", "HTS": "HEIGHTS", "PK": "PARK", "BCH": "BEACH", "CRT": "COURT", "CSTL": "CASTLE", "HBR": "HARBOUR", "HARBOR": "HARBOUR",
    "GDNS": "GARDENS", "GDN": "GARDEN", "VW": "VIEW",
}
BUSINESS_SHORT = {
    "BROS": "BROTHERS", "BRO": "BROTHERS", "DEV": "DEVELOPMENTS", "DEVTS": "DEVELOPMENTS", "DEVELOPM": "DEVELOPMENTS", "DEVELOPMENT": "DEVELOPMENTS", "ENT": "ENTERPRISES", "ENTR": "ENTERPRISES",
    "ENTERPRISE": "ENTERPRISES", "EST": "ESTATES", "ESTS": "ESTATES", "ESTATE": "ESTATES", "HOLD": "HOLDINGS", "HLDGS": "HOLDINGS", "HOLDING": "HOLDINGS", "HOTEL": "HOTELS", "HTLS": "HOTELS", "HTL": "HOTELS",
    "LEIS": "LEISURE", "MGT": "MANAGEMENT", "MGMT": "MANAGEMENT", "RESORT": "RESORTS", "SON": "SONS", "TOUR": "TOURIST",
}
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10, "XI": 11, "XII": 12}
#: Latin spellings of one Greek sound, longer ones first. Values are the folded form.
ROMANISED = (("PH", "F"), ("OU", "U"), ("CH", "H"), ("NT", "D"), ("MP", "B"), ("TS", "Z"), ("GK", "G"), ("W", "V"), ("C", "K"), ("Y", "I"), ("J", "I"))
_CLASS = re.compile(r"\s+(?:[1-5]\s*\*|[ABC]\s*'|N\s*/\s*A)(?=\s|$)")
_JOINED = tuple(sorted((q for q in QUALIFIERS), key=len, reverse=True))
#: Qualifiers that a core may also end with by nature; they are cut off long words only.
_NATURAL, _LONG = {"MARE", "OLIVE"}, 11


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.upper())
    return "".join(c for c in text if not unicodedata.combining(c)).replace("’", "'").replace("`", "'")


@lru_cache(1 << 16)
def fold(word: str) -> str:
    for a, b in ROMANISED:
        word = word.replace(a, b)
    return word


def close(a: str, b: str) -> int:
    """0, 1 or 2: edits between two words, two and more as 2; swapped neighbours are one edit."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i, m = 0, min(len(a), len(b))
    while i < m and a[i] == b[i]:
        i += 1
    if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]:
        return 1
    return 1 if a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2


def _lexicon(word: str, words: tuple[str, ...], short: dict[str, str]) -> str | None:
    if word in words:
        return word
    if word in short:
        return short[word]
    if len(word) >= 4:
        found = [w for w in words if w.startswith(word)]
        if len(found) == 1:
            return found[0]
    if len(word) >= 5:
        found = [w for w in words if len(w) >= 5 and close(word, w) == 1]
        if len(found) == 1:
            return found[0]
    return None


@lru_cache(1 << 16)
def hotel_word(word: str) -> str | None:
    return _lexicon(word, KINDS + QUALIFIERS, KNOWN_SHORT)


#: Short forms that no core ends with by nature.
_JOINED_SHORT = {"HBR": "HARBOUR", "HTS": "HEIGHTS", "BCH": "BEACH", "CSTL": "CASTLE", "GDNS": "GARDENS", "CRT": "COURT", "RYL": "ROYAL", "PLC": "PALACE", "HTL": "HOTEL", "HSTL": "HOSTEL", "PK": "PARK"}


def _split_joined(word: str) -> list[str]:
    for q in _JOINED + KINDS:
        if word.endswith(q) and len(word) - len(q) >= 5 and (q not in _NATURAL or len(word) >= _LONG):
            return [*_split_joined(word[: -len(q)]), q]
    for q, full in _JOINED_SHORT.items():
        if word.endswith(q) and len(word) - len(q) >= 6:
            return [*_split_joined(word[: -len(q)]), full]
    return [word]


@lru_cache(1 << 16)
def hotel_name(text: str) -> tuple[str, str, str, str] | None:
    """(core, qualifiers, kinds, number) of a lodging's name, words within each sorted; None for blanks and dashes.

    The core is what no list knows, as spelled. A name of known words alone has the core "".
    """
    t = _CLASS.sub(" ", " " + re.sub(r"[\"“”«»]", " ", plain(text)) + " ")
    words = [w for w in re.split(r"[^A-Z0-9Ͱ-Ͽ']+", t) if w]
    words = [w.strip("'") for w in words]
    words = [w for w in words if w and w not in ("THE", "AND", "NO", "NR", "NUMBER", "N", "A", "B")]
    core, quals, kinds, number = [], [], [], ""
    for k, w in enumerate(words):
        if w.isdigit():
            number = str(int(w))
            continue
        if w in ROMAN and k:
            number = str(ROMAN[w])
            continue
        if w == "VIL":
            kinds.append("VILLAGE" if "HOLIDAY" in kinds or any(x.startswith("HOL") for x in words) else "VILLAS")
            continue
        known = hotel_word(w)
        if known is None:
            *head, last = _split_joined(w)
            if head:
                core += [head[0]]
                for x in [*head[1:], last]:
                    (quals if x in QUALIFIERS else kinds).append(x)
                continue
            core.append(w)
        elif known in QUALIFIERS:
            quals.append(known)
        else:
            kinds.append(known)
    if not (core or quals or kinds or number):
        return None
    return " ".join(sorted(core)), " ".join(sorted(set(quals))), " ".join(sorted(set(kinds))), number


#: A short form of several names stands for the first of them.
_NICK = {s: n for n, many in reversed(GIVEN.items()) for s in many} | {n: n for n in GIVEN}
_FOLDED_GIVEN = {fold(n): n for n in GIVEN}


@lru_cache(1 << 16)
def _given(word: str) -> str | None:
    if word in _NICK:
        return _NICK[word]
    f = fold(word)
    if f in _FOLDED_GIVEN:
        return _FOLDED_GIVEN[f]
    if len(word) >= 6:
        found = [n for g, n in _FOLDED_GIVEN.items() if close(f, g) == 1]
        if len(found) == 1:
            return found[0]
    return None


@lru_cache(1 << 16)
def business_word(word: str) -> str | None:
    return _lexicon(word, BUSINESS, BUSINESS_SHORT)


@lru_cache(1 << 16)
def operator_name(text: str) -> tuple[str, str, str] | None:
    """(core, "company" or "person", rest): rest are a company's business words, or a person's full given name, or its initial with a dot where no more is known. None for blanks and dashes.

    Titles and legal forms go. Relatives share a surname, so a person is surname
    and given name; a middle initial before the surname is dropped.
    """
    t = plain(text)
    t = re.sub(r"\bL\s*\.\s*T\s*\.\s*D\b\.?", " LTD ", t)
    t = re.sub(r"\bM\s*/\s*S\b", " ", t)
    t = re.sub(r"&", " AND ", t)
    t = re.sub(r"\bT\s*\.?\s+(?=ENT)", "TOURIST ", t)
    words = [w for w in re.split(r"[^A-Z0-9Ͱ-Ͽ]+", t) if w]
    legal = any(w in ("LTD", "LIMITED", "CO", "COMPANY", "PUBLIC", "LLC") for w in words)
    words = [w for w in words if w not in TITLES and w not in LEGAL]
    if not words:
        return None
    business = [business_word(w) for w in words]
    if legal or any(business):
        core = sorted(w for w, b in zip(words, business) if b is None)
        return " ".join(core), "company", " ".join(sorted({b for b in business if b}))
    given = [_given(w) if len(w) > 1 else None for w in words]
    names = sorted({g for g in given if g})
    initials = [w for w in words if len(w) == 1]
    surname = sorted(w for w, g in zip(words, given) if g is None and len(w) > 1)
    if names and surname:
        return " ".join(surname), "person", names[0]
    if initials and surname:
        return " ".join(surname), "person", initials[0] + "."
    return " ".join(sorted(words)), "person", ""
