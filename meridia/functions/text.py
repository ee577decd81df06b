"""Normalisers of names, contacts and addresses as column expressions.

The variants differ on purpose: a key made with one of them must never be
compared with a key made with another. Unless a function says otherwise, null
gives the empty text where a key is made of it, and null elsewhere.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide results.
CLASS_MARKERS = r"(?:\s+(?:(?:5|4|3|2|1)\s*\*|[ABC]\s*'|N(?:\s*\/\s*|\s+)A|ΑΝΕΥ\s*Α?|ΆΝΕΥ\s*Α?|WITHOUT\s+STAR))+$"
GENERIC_SUFFIXES = ("HOTEL", "HOTELS", "APARTMENT", "APARTMENTS", "APTS", "APT", "SUITE", "SUITES", "RESIDENCE", "BOUTIQUE")
STOP_WORDS = ("AND", "APARTMENT", "APARTMENTS", "APT", "APTS", "BEACH", "BOUTIQUE", "BY", "GUEST", "GUESTHOUSE", "HOLIDAY", "HOSTEL", "HOTEL", "HOTELS", "HOUSE", "RESORT", "SPA", "SUITE", "SUITES", "THE", "VILLAGE")
STREET_WORDS = ("AVENUE", "STREET", "ROAD", "LANE", "DRIVE", "BOULEVARD", "SQUARE", "COURT", "PLACE", "CRESCENT", "WAY", "LEOFOROS", "ODOS")
SHARED_EXACT = ("atlanticahotels.com", "kanikahotels.com", "leonardo-hotels-cyprus.com", "leonardo-hotels.com", "leonardo-hotels.co", "louis-hotels.com", "louishotels.com", "tsokkos.com")
SHARED_SUFFIX = (
    "atlanticahotels.com", "booking.com", "expedia.com", "ihg.com", "kanikahotels.com", "leonardo-hotels-cyprus.com",
    "leonardo-hotels.com", "louis-hotels.com", "louishotels.com", "marriott.com", "radissonhotels.com", "tsokkos.com",
)
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "tiktok.com", "x.com")
AGGREGATOR_HOSTS = ("booking.com", "expedia.com", "hotels.com", "tripadvisor.com")


def _single() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and those forms, by rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0xFFFF) if not 0xD800 <= c <= 0xDFFF]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _single()


def compat(col: Column) -> Column:
    """NFKC of single characters (wide forms, special blanks, superscripts) without leaving the JVM; nfkc also composes and expands."""
    return F.translate(col, _FROM, _TO)


def nfkc(col: Column) -> Column:
    """Exact NFKC through an Arrow batch function."""
    return F.pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore"), "string")(col)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


_PUNCTUATION = r"[.,;:()\[\]{}/\\\-–—]"


def name_text(col: Column) -> Column:
    """Names for keys: quotes made straight, & as AND, punctuation as blanks, upper case. Null gives ''."""
    t = F.regexp_replace(F.regexp_replace(compat(F.coalesce(col, F.lit(""))), "[’‘`´]", "'"), "&", " AND ")
    return F.upper(squeeze(F.regexp_replace(t, _PUNCTUATION, " ")))


def plain_text(col: Column) -> Column:
    """As name_text without the rules for quotes and &. Null gives ''."""
    return F.upper(squeeze(F.regexp_replace(compat(F.coalesce(col, F.lit(""))), _PUNCTUATION, " ")))


def identity_text(col: Column) -> Column:
    """Upper case with single blanks, punctuation kept. Null gives ''."""
    return F.upper(squeeze(compat(F.coalesce(col, F.lit("")))))


def place_text(col: Column) -> Column:
    """For comparing localities: commas are blanks. Null gives ''."""
    return F.upper(squeeze(F.regexp_replace(compat(F.coalesce(col, F.lit(""))), r"(?U)[,\s]+", " ")))


def match_name(col: Column) -> Column:
    """For matching sources: & as AND, then A-Z and 0-9 alone; other letters vanish. Null gives ''."""
    t = F.regexp_replace(F.upper(compat(F.coalesce(col, F.lit("")))), "&", " AND ")
    return F.trim(F.regexp_replace(t, "[^A-Z0-9]+", " "))


def reduced_name(col: Column) -> Column:
    """match_name without the stop words; may be ''."""
    words = F.filter(F.split(match_name(col), " "), lambda w: ~w.isin(*STOP_WORDS) & (w != ""))
    return F.array_join(words, " ")


def strip_class(col: Column) -> Column:
    """Without class markers at the end (2*, B', N/A, the Greek and English words for no star); for texts of name_text."""
    return F.trim(F.regexp_replace(col, CLASS_MARKERS, ""))


def hotel_name(col: Column) -> Column:
    return strip_class(name_text(col))


def name_match_key(col: Column) -> Column:
    """hotel_name without a leading THE and generic words at the end; one word always stays."""
    t = F.regexp_replace(hotel_name(col), r"^THE (?=\S)", "")
    return F.regexp_replace(t, rf"(?<=\S)(?: (?:{'|'.join(GENERIC_SUFFIXES)}))+$", "")


def repair_name_class(name: Column, class_raw: Column) -> Column:
    """struct(name, class): a class mark [ABC]' at the name's end goes; a class of one to three digits is the name's own number."""
    cleaned = F.trim(F.regexp_replace(name, r"(?i)(?<=\S)\s+[ABC]'\s*$", ""))
    digits = F.trim(class_raw)
    moves = digits.rlike(r"^\d{1,3}$") & ~cleaned.endswith(F.concat(F.lit(" "), digits))
    moves = F.coalesce(moves, F.lit(False))
    return F.struct(F.when(moves, F.concat_ws(" ", cleaned, digits)).otherwise(cleaned).alias("name"), F.when(moves, F.lit(None)).otherwise(class_raw).alias("class"))


def repair_capacity(rooms: Column, beds: Column) -> Column:
    """struct(rooms, beds), swapped where both are positive and beds are fewer."""
    swap = F.coalesce((rooms > 0) & (beds > 0) & (beds < rooms), F.lit(False))
    return F.struct(F.when(swap, beds).otherwise(rooms).alias("rooms"), F.when(swap, rooms).otherwise(beds).alias("beds"))


def nullable_text(col: Column) -> Column:
    t = squeeze(compat(col))
    return F.when(t != "", t)


def _quoted(col: Column) -> Column:
    """A text as a pattern, in which each run of blanks stands for blanks and commas."""
    whole = F.replace(squeeze(col), F.lit(r"\E"), F.lit(""))
    return F.concat(F.lit(r"\Q"), F.replace(whole, F.lit(" "), F.lit(r"\E[\s,]+\Q")), F.lit(r"\E"))


def repair_location(address: Column, postcode: Column, locality: Column) -> Column:
    """struct(address, postcode, locality).

    An address that is only a postal line, four digits and a locality, becomes
    null and fills what is missing, if it contradicts nothing; without a known
    locality a line with a street word stays. Otherwise a postal line at the
    address's end that repeats postcode and locality is cut off.
    """
    a, p, t = nullable_text(address), nullable_text(postcode), nullable_text(locality)
    code, rest = F.regexp_extract(a, r"^(\d{4}),?\s+(\S.*)$", 1), F.regexp_extract(a, r"^(\d{4}),?\s+(\S.*)$", 2)
    street = F.upper(rest).rlike(rf"(?<![A-Z0-9_])(?:{'|'.join(STREET_WORDS)})(?![A-Z0-9_])")
    fits = (code != "") & (p.isNull() | (p == code)) & F.when(t.isNull(), ~street).otherwise(place_text(t) == place_text(rest))
    line = F.coalesce(fits, F.lit(False))
    tail = F.concat(F.lit(r"(?i)[\s,]+"), _quoted(p), F.lit(r"[\s,]+"), _quoted(t), F.lit(r"\s*$"))
    cut = F.when(p.isNotNull() & t.isNotNull(), nullable_text(F.regexp_replace(a, tail, ""))).otherwise(a)
    return F.struct(
        F.when(line, F.lit(None)).otherwise(cut).alias("address"),
        F.when(line, F.coalesce(p, code)).otherwise(p).alias("postcode"),
        F.when(line, F.coalesce(t, rest)).otherwise(t).alias("locality"),
    )


def postcode_key(col: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", ""))


def phone_key(col: Column) -> Column:
    """Digits and plus signs. Null gives ''."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\d+]", "")


def phone_list(col: Column) -> Column:
    """The keys of an array of cells that may hold several numbers between commas; distinct, sorted, without ''."""
    pieces = F.flatten(F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: F.split(x, ",")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(pieces, phone_key), lambda x: x != "")))


def phone_match(col: Column) -> Column:
    """Digits with the country's 357 before them; null where none are left."""
    d = F.regexp_replace(F.regexp_replace(col, r"\D", ""), "^00(?=357)", "")
    return F.when(d == "", F.lit(None)).when(F.length(d) == 8, F.concat(F.lit("357"), d)).otherwise(d)


_LOCAL = "[29][0-9]{7}"


def phones_in(cells: Column) -> Column:
    """The local numbers, [29] and seven digits, in an array of cells, with +357, each once in order; null gives [].

    A cell is cut at , ; / & and line ends first, so digits never run on from
    one number to the next. Within a piece a country code may be written +357,
    00357, 357, +367 by mistake, or a bare plus. What follows a plus counts only
    if a number starts right there; elsewhere numbers are found at any digit.
    """
    mended = lambda v: F.regexp_replace(F.regexp_replace(v, r"\+367", "+357"), r"(?U)00\s*357", "+357")
    pieces = F.flatten(F.transform(F.filter(cells, lambda v: v.isNotNull()), lambda v: F.split(mended(v), r"[,;/&\n\r]+")))

    def found(piece: Column) -> Column:
        runs = F.split(F.regexp_replace(piece, r"[^0-9+]", ""), r"\+", -1)
        open_ = F.filter(runs, lambda r, i: (i == 0) | r.rlike(f"^(?:357)?{_LOCAL}"))
        return F.flatten(F.transform(open_, lambda r: F.regexp_extract_all(r, F.lit(f"(?:00357|357)?({_LOCAL})"), F.lit(1))))

    numbers = F.transform(F.flatten(F.transform(pieces, found)), lambda n: F.concat(F.lit("+357"), n))
    return F.coalesce(F.array_distinct(numbers), F.array().cast("array<string>"))


def email_key(col: Column) -> Column:
    """Lower case without blanks, null unless it's like x@y.z."""
    t = F.lower(F.regexp_replace(col, r"(?U)\s+", ""))
    return F.when(t.rlike(r"^[^@]+@[^@]+\.[^@]+$"), t)


def email_domain(col: Column) -> Column:
    return F.when(F.instr(col, "@") > 0, F.lower(F.trim(F.regexp_extract(col, r"(?s)^[^@]*@(.*)$", 1))))


def host_of(col: Column) -> Column:
    """Host of a link in lower case without www.; a scheme may be missing; null without one."""
    t = F.lower(F.trim(col))
    h = F.regexp_extract(t, r"^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    h = F.regexp_replace(h, r"^www\.", "")
    return F.when(h != "", h)


def contact_domain(col: Column) -> Column:
    """A stored domain trimmed, in lower case, without www.; null stays null."""
    return F.regexp_replace(F.lower(F.trim(col)), r"^www\.", "")


def host_registry(col: Column) -> Column:
    """As registry entries compare websites: the host of a link with a scheme, else what stands before the first slash."""
    url = F.regexp_extract(F.trim(col), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return contact_domain(F.when(url != "", url).otherwise(F.regexp_extract(F.regexp_replace(col, r"^https?://", ""), r"^([^/]*)", 1)))


def host_strict(col: Column) -> Column:
    """The host of a full link alone; null for anything without a scheme."""
    url = F.regexp_extract(F.trim(col), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(url != "", F.lower(F.regexp_replace(url, r"(?i)^www\.", "")))


def website_key(col: Column) -> Column:
    """A link in one form: scheme http where missing, host in lower case, no trailing slash of a bare host; null for what is no web link."""
    t = F.regexp_replace(F.trim(col), r"(?U)\s+", "")
    full = F.when(t.rlike(r"(?i)^https?://"), t).when(t.rlike(r"^[a-z][a-z0-9+.\-]*:"), F.lit(None)).otherwise(F.concat(F.lit("http://"), t))
    scheme, host, rest = (F.regexp_extract(full, r"^(?i)(https?)://([^/?#]+)(.*)$", i) for i in (1, 2, 3))
    good = host.rlike(r"^[^@\s]+\.[^@\s]+$")
    return F.when(good, F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(rest == "", F.lit("/")).otherwise(rest)))


def website_list(col: Column) -> Column:
    """Distinct website keys of an array; more specific links, with a path, query or fragment, come first, otherwise in order."""
    keys = F.array_distinct(F.filter(F.transform(col, website_key), lambda x: x.isNotNull()))
    deep = lambda x: x.rlike(r"^https?://[^/]+/.")
    return F.concat(F.filter(keys, deep), F.filter(keys, lambda x: ~deep(x)))


def in_shared(host: Column, domains: tuple[str, ...] = SHARED_SUFFIX, suffixes: bool = True) -> Column:
    """Whether a host is one of the domains or, with suffixes, below one; null is none."""
    hit = host.isin(*domains)
    if suffixes:
        hit = hit | host.rlike(r"\.(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")
    return F.coalesce(hit, F.lit(False))


def website_kind(websites: Column, domains: Column) -> Column:
    """struct(declared, kind): missing, group, aggregator, social or own; the domains are the evidence if there are any, else the websites' hosts."""
    clean = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    sites, own = clean(websites), F.transform(clean(domains), host_of)
    seen = F.when(F.size(own) > 0, own).otherwise(F.transform(sites, host_of))
    every = lambda ds: F.forall(seen, lambda h: in_shared(h, ds))
    kind = F.when(F.size(seen) == 0, "missing").when(every(SHARED_EXACT), "group").when(every(AGGREGATOR_HOSTS), "aggregator").when(every(SOCIAL_HOSTS), "social").otherwise("own")
    return F.struct((F.size(sites) > 0).alias("declared"), kind.alias("kind"))


_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def address_form(col: Column, names: bool = True) -> Column:
    """An address for comparing: short forms of STREET and AVENUE in full, after name_text or, without names, plain_text."""
    t = name_text(col) if names else plain_text(col)
    return F.regexp_replace(F.regexp_replace(t, rf"{_BEFORE}(?:STR|ST){_AFTER}", "STREET"), rf"{_BEFORE}(?:AVE|AV){_AFTER}", "AVENUE")


def locality_form(col: Column, names: bool = True) -> Column:
    """A locality for comparing: K is KATO, P is PANO."""
    t = name_text(col) if names else plain_text(col)
    return F.regexp_replace(F.regexp_replace(t, rf"{_BEFORE}K{_AFTER}", "KATO"), rf"{_BEFORE}P{_AFTER}", "PANO")


def suffix_split(col: Column) -> Column:
    """struct(base, suffix) of a hotel_name: a number, perhaps with a letter, at its end; NO before it goes; suffix null without one."""
    pattern = r"^(.*?)(?:\s+(?:NO\s*)?(\d+[A-Z]?))$"
    suffix = F.regexp_extract(col, pattern, 2)
    return F.struct(F.when(suffix != "", F.trim(F.regexp_extract(col, pattern, 1))).otherwise(col).alias("base"), F.when(suffix != "", suffix).alias("suffix"))


def suffix_number(suffix: Column) -> Column:
    return F.regexp_extract(suffix, r"^(\d{1,9})[A-Z]?$", 1).try_cast("int")


def coordinates(col: Column) -> Column:
    """struct(lat, lng) of a text 'lat,lng' within bounds, else null."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
    lat, lng = (F.regexp_extract(col, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def run_time(run_id: Column) -> Column:
    """The time at the beginning of a run's id, YYYY-MM-DDTHH-mm-ss-, null where there's none."""
    return F.try_to_timestamp(F.regexp_extract(run_id, r"^(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})-", 1), F.lit("yyyy-MM-dd'T'HH-mm-ss"))


def file_region(filename: Column) -> Column:
    """The region word in a registry file's name, in upper case; null without one."""
    r = F.regexp_extract(F.upper(filename), r"HOTELS?[_\-\s]+([A-Z]+)|^([A-Z]+)[_\-\s]+HOTELS?", 1)
    s = F.regexp_extract(F.upper(filename), r"^([A-Z]+)[_\-\s]+HOTELS?", 1)
    return F.when(s != "", s).when(r != "", r)


def beach_type(surface: Column) -> Column:
    s = F.upper(F.coalesce(surface, F.lit("")))
    return F.when(s.contains("SAND"), "SAND").when(s.rlike("PEBBLE|GRAVEL"), "PEBBLE").when(s.contains("ROCK"), "ROCK").otherwise("UNKNOWN")
