"""Postal addresses taken apart: number, street, kind of street, postcode and town."""

from __future__ import annotations

import re
from functools import lru_cache

from meridia.llm.namekit import close, fold, plain

# Words of addresses and their short forms, Greek and English.
STREET_KINDS = {
    "AVENUE": "AVENUE", "AVE": "AVENUE", "AV": "AVENUE", "LEOFOROS": "AVENUE", "LEOF": "AVENUE",
    "STREET": "STREET", "STR": "STREET", "ST": "STREET", "ODOS": "STREET", "OD": "STREET",
    "ROAD": "ROAD", "RD": "ROAD", "LANE": "LANE", "LN": "LANE", "SQUARE": "SQUARE", "SQ": "SQUARE", "PLATEIA": "SQUARE", "PL": "SQUARE",
    "BOULEVARD": "BOULEVARD", "BLVD": "BOULEVARD", "DRIVE": "DRIVE", "DR": "DRIVE", "COURT": "COURT", "CRESCENT": "CRESCENT", "WAY": "WAY",
}
TOWN_PREFIX = {"KATO": "KATO", "K": "KATO", "PANO": "PANO", "PALEA": "PALEA", "NEA": "NEA", "N": "NEA", "AGIOS": "AGIOS", "AGIA": "AGIA"}
#: Short forms that stand for either of two words.
TOWN_EITHER = {"P": ("PANO", "PALEA"), "AG": ("AGIOS", "AGIA"), "AY": ("AGIOS", "AGIA")}
NUMBER_WORDS = ("NO", "NR", "NUM", "NUMBER", "ARITHMOS", "ARITH", "AR")
_BOX = re.compile(r"\b(?:P\s*\.?\s*O\s*\.?\s*BOX|POBOX|T\s*\.?\s*TH\b)")
_UNIT = re.compile(
    r"\b(?:(?:GROUND|FIRST|SECOND|THIRD|TOP|\d+(?:ST|ND|RD|TH))\s+FLOOR|FLOOR\s+\d+|(?:BLOCK|BLK)\s+[A-Z0-9]\b|(?:SHOP|FLAT|OFFICE|SUITE|UNIT|APT|APARTMENT)\s+(?:NO\.?\s*)?\d+[A-Z]?\b|C\s*/\s*O\s+[A-Z]+|RECEPTION)\s*[,;-]?"
)
_TAIL = re.compile(r"[\s,;]+(?:CY\s*-?\s*)?(\d{4})[\s,;]+([^\W\d_][^\d]*)$")
_NUMBER = re.compile(r"(?<![A-Z0-9])(\d{1,5})(?:\s*-?\s*([A-Z])(?![A-Z.'])|(?=[^A-Z0-9]|$))")


@lru_cache(1 << 16)
def street_kind(word: str) -> str | None:
    if word in STREET_KINDS:
        return STREET_KINDS[word]
    if len(word) >= 4:
        found = {v for k, v in STREET_KINDS.items() if len(k) >= 4 and close(word, k) == 1}
        if len(found) == 1:
            return found.pop()
    return None


@lru_cache(1 << 16)
def postcode(text: str | None) -> str:
    """Its four digits, "" where it isn't a postcode, all zeros or all nines."""
    d = re.sub(r"^\s*CY\s*-?", "", plain(text)) if text else ""
    d = re.sub(r"\s+", "", d)
    return d if re.fullmatch(r"\d{4}", d) and d not in ("0000", "9999") else ""


@lru_cache(1 << 16)
def towns(text: str | None) -> tuple[str, ...]:
    """The names a town's spelling may stand for, without blanks; () for blanks, dashes and words for unknown."""
    if not text:
        return ()
    words = [w for w in re.split(r"[^A-Z0-9Ͱ-Ͽ]+", plain(text)) if w]
    if not words or " ".join(words) in ("UNKNOWN", "TBA", "N A", "NA", "NONE"):
        return ()
    first, rest = words[0], "".join(words[1:])
    if rest and first in TOWN_EITHER:
        return tuple(p + rest for p in TOWN_EITHER[first])
    return (TOWN_PREFIX.get(first, first) + rest,) if rest else (first,)


def same_town(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return any(x == y or (len(x) > 4 and min(close(x, y), close(fold(x), fold(y))) <= 1) for x in a for y in b)


@lru_cache(1 << 16)
def address(text: str | None) -> tuple[str, str, str, str, str] | None:
    """(number with letter, street as spelled, kind, postcode in the tail, town in the tail); None for null, blanks, P.O. boxes and texts without a street."""
    if not text:
        return None
    t = plain(text)
    if _BOX.search(t):
        return None
    t = _UNIT.sub(" ", t)
    code = town = ""
    if (m := _TAIL.search(t)) and re.search(r"\d", t[: m.start()]):
        code, town, t = m[1], m[2].strip(" ,.;"), t[: m.start()]
    number = ""
    marked = re.search(rf"\b(?:{'|'.join(NUMBER_WORDS)})\b\s*\.?\s*(?=\d)", t)
    found = _NUMBER.search(t, marked.end()) if marked else _NUMBER.search(t)
    if found:
        number = str(int(found[1])) + (found[2] or "")
        t = t[: found.start()] + " " + t[found.end() :]
    kinds, street = [], []
    for w in re.split(r"[^A-Z0-9Ͱ-Ͽ]+", t):
        if not w or w in NUMBER_WORDS:
            continue
        k = street_kind(w)
        if k:
            kinds.append(k)
        elif len(w) > 1:
            street.append(w)
    if not street:
        return None
    return number, " ".join(sorted(street)), kinds[0] if kinds else "", code, town
