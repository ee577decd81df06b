"""Resolution of a file's repeated rows in reading order, where later rows see what earlier ones left.

All that can meet shares the file and the normalised name, so a block is one
name of one file, and the fold within it equals a fold over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import keys as K
from meridia.functions import text as T
from meridia.operators.dedupe import fold_in_order

LISTS = ("phones", "faxes", "emails", "websites")
SCHEMA = "filename string, hotel string, seq long, merged int, name string, address string, locality string, postcode string, operatorname string, rooms int, beds int, phones array<string>, faxes array<string>, emails array<string>, websites array<string>, domain string, strict_key string"


def _blank(text: str | None) -> bool:
    return text is None or text == ""


def complementary(new: dict, old: dict) -> bool:
    """One of the two has an address, the other none, and they are otherwise the same house."""
    if _blank(old["address"]) != bool((new["address"] or "").strip()):
        return False
    same = ("establishmenttype", "locality", "operatorname", "postcode", "region")
    first = lambda r: r["phones"][0] if len(r["phones"]) else None
    return new["merge_key"] == old["merge_key"] or (all(new[c] == old[c] for c in same) and first(new) == first(old))


def strong_duplicate(new: dict, old: dict) -> bool:
    """Equal in all that identifies, with a compatible address, and sharing an e-mail address, an own domain or a website."""
    needed = ("rooms", "beds", "postcode", "operatorname")
    if any(new[c] is None for c in needed) or any(new[c] != old[c] for c in (*needed, "establishmenttype", "region")):
        return False
    if (new["address"] or "").strip() and not _blank(old["address"]) and new["address"] != old["address"]:
        return False
    own = new["domain"] is not None and not new["shared_domain"] and new["domain"] == old["domain"]
    return own or bool(set(new["emails"]) & set(old["emails"])) or bool(set(new["websites"]) & set(old["websites"]))


#: Where the fields of a merged row come from: of the preferred row first, or of the new one first. All else is the new row's.
PREFERRED, NEWEST = ("address", "domain"), ("classraw", "managername")


def told_by_region(row: dict, region: str | None) -> bool:
    """Whether the region's name holds the row's locality."""
    town = (row["locality"] or "").strip().upper()
    return town != "" and town in (region or "").strip().upper()


def merged(old: dict, new: dict) -> dict:
    """One row of two strong duplicates.

    The new row is preferred where it alone has a locality, or its locality
    differs from the old one's and is the only one that the region's name holds;
    else the old row is. The preferred row gives the locality, and comes first
    in what both may fill and in the lists.
    """
    region = new["region"] or old["region"]
    other_town = (old["locality"] or "").strip().upper() != (new["locality"] or "").strip().upper()
    fresh = new["locality"] is not None and (old["locality"] is None or (other_town and told_by_region(new, region) and not told_by_region(old, region)))
    first, second = (new, old) if fresh else (old, new)
    filled = lambda c, a, b: a[c] if a[c] is not None else b[c]
    chosen = {c: filled(c, first, second) for c in PREFERRED} | {c: filled(c, new, old) for c in NEWEST}
    lists = {c: list(dict.fromkeys([*first[c], *second[c]])) for c in LISTS}
    return new | chosen | lists | {"locality": first["locality"]}


def resolve(rows: list[dict]) -> list[dict]:
    """Rows in reading order to those that remain; the first found in that order wins, keeps its seq, and counts what it took in."""
    held: list[dict] = []

    def put(at: int, row: dict) -> None:
        held[at] = row | {"seq": held[at]["seq"], "merged": held[at]["merged"] + 1}

    for r in rows:
        r = r | {c: [] if r[c] is None else list(r[c]) for c in LISTS}
        at = next((i for i, e in enumerate(held) if complementary(r, e)), None)
        if at is not None:
            put(at, r if (r["address"] or "").strip() else r | {"address": held[at]["address"]})
            continue
        at = next((i for i, e in enumerate(held) if strong_duplicate(r, e)), None)
        if at is not None:
            put(at, merged(held[at], r))
            continue
        if r["reversed_key"] is not None and r["reversed_key"] != r["strict_key"]:
            held = [e for e in held if e["strict_key"] != r["reversed_key"]]
        at = next((i for i, e in enumerate(held) if e["strict_key"] == r["strict_key"]), None)
        if at is not None:
            put(at, r)
        else:
            held.append(r | {"merged": 1})
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]
    return [{n: (int(e[n]) if n in ("rooms", "beds", "seq") and e[n] is not None else e[n]) for n in names} for e in held]


def prepared(raw: DataFrame) -> DataFrame:
    """The columns a fold needs, keys included."""
    c = F.col
    key = lambda rooms, beds: K.strict_key(c("name"), c("postcode"), c("contacts.phones"), rooms, beds)
    proper = F.coalesce((c("rooms") > 0) & (c("beds") > 0) & (c("rooms") < c("beds")), F.lit(False))
    return raw.select(
        c("sourcefile.filename").alias("filename"), T.hotel_name(c("name")).alias("hotel"), "seq", "name", "address", "locality", "region", "postcode", "establishmenttype", "operatorname", "classraw", "managername", "rooms", "beds",
        *[c(f"contacts.{x}").alias(x) for x in LISTS], c("contacts.domain").alias("domain"), T.in_shared(T.host_of(c("contacts.domain")), T.SHARED_EXACT, False).alias("shared_domain"), key(c("rooms"), c("beds")).alias("strict_key"),
        F.when(proper, key(c("beds"), c("rooms"))).alias("reversed_key"), K.merge_key(c("name"), c("establishmenttype"), c("region"), c("locality"), c("postcode"), c("operatorname"), c("contacts.phones")).alias("merge_key"),
    )


def resolve_in_file(raw: DataFrame) -> DataFrame:
    """What remains of each file's rows, in SCHEMA's columns. Equal rows in direct succession change nothing but the count, so a block of copies stays cheap."""
    return fold_in_order(prepared(raw), ["filename", "hotel"], "seq", resolve, SCHEMA)
