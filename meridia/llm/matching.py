"""p1: matching entities across sources without keys.

Both sides' names, telephones, links, e-mail addresses and postal addresses
become blocking tokens; distinct names and streets meet by MinHash bands, short
names by the texts that leave letters of theirs out, and like ones share a token.
Records of one content meet once. Pairs that share a token get similarity features, and a
logistic classifier, fitted on weak labels and calibrated on objects held out,
gives each pair a probability. Pairs that share nothing but what a crowd shares
are made only if the fitted classifier could let one of them count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm.addresskit import address, postcode, same_town, towns
from meridia.llm.minhash import band_keys
from meridia.llm.namekit import close, fold, hotel_name, plain
from meridia.llm.places import within_two
from meridia.session import cut, table

#: A token of more hotels than this tells nothing alone. It blocks only together with a second shared token.
HEAVY = 50
#: Combinations of a heavy and a second token that more hotels have are joined by classes of like holders, in blocks of about so many rows a side.
TOGETHER, BLOCK = 50, 256
#: q, rows and bands of MinHash, for streets and for the cores of names of more than SHORT letters.
NAME_BANDS, STREET_BANDS = (3, 3, 72), (3, 3, 36)
#: Cores of up to so many letters, and two more, meet by what is left without one or two of them. No like ones are lost, and unlike ones, whose bands meet the more often the more names there are, hardly meet.
SHORT = 14
#: The classifier is fitted on at most this many patterns of weakly labelled pairs, chosen by hash, and calibrated on as many of other objects.
FIT_PAIRS = 10_000
#: A link needs this probability, and the second best hotel's score must stay below by the gap.
LEAST_P, GAP = 0.5, 0.5
FEATURES = (
    "bias", "name_same", "name_near", "name_two", "name_family", "name_other", "derived_same", "derived_core", "derived_family", "derived_other", "phone_own", "phone_shared", "phone_other", "link_own", "link_shared", "mail_own", "mail_shared",
    "place_same", "number_other", "street_other", "code_same", "code_other", "town_other", "rooms_same", "rooms_other", "kind_other", "shop",
)
#: Features that go together when evidence is hidden from the fit, so that it learns to decide without it.
GROUPS = (("name_same", "name_near", "name_two", "name_family", "name_other", "kind_other"), ("derived_same", "derived_core", "derived_family", "derived_other"), ("phone_own", "phone_shared", "phone_other"), ("link_own", "link_shared"), ("mail_own", "mail_shared"), ("place_same", "number_other", "street_other"), ("code_same", "code_other", "town_other"), ("rooms_same", "rooms_other"))
# Tag names of map objects, mailbox names, and path words that name no hotel.
NAME_TAGS = ("name", "name:en", "int_name", "alt_name", "official_name")
PHONE_TAGS = ("phone", "contact:phone", "contact:mobile", "mobile")
LINK_TAGS = ("website", "contact:website", "url")
MAIL_TAGS = ("email", "contact:email")
ROLES = ("info", "sales", "booking", "reservations", "frontdesk", "reception", "office", "contact")
PATH_WORDS = ("rooms", "show", "index", "home", "cy", "en", "hotels", "contact")
SHOP_WORDS = ("MINIMARKET", "PHARMACY", "TAVERNA", "RESTAURANT", "BAR", "CAFE", "SHOP", "MARKET", "KIOSK", "BAKERY")


def phone_key(text: str) -> str:
    """The last eight digits without an extension; "" for too few."""
    d = re.sub(r"\D", "", re.split(r"(?i)ext", text)[0])
    return d[-8:] if len(d) >= 8 and len(set(d[-8:])) > 1 else ""


def link_parts(text: str) -> tuple[str, str, str]:
    """(host, host and path, the word in it that may name a hotel)."""
    t = re.sub(r"^[a-z]+://", "", text.strip().lower()).split("#")[0]
    bare, query = (t.split("?") + [""])[:2]
    host, _, path = bare.partition("/")
    host = host.removeprefix("www.").strip(". ")
    if "." not in host:
        return "", "", ""
    path = path.strip("/")
    last = re.sub(r"\.(html?|php)$", "", path.rsplit("/", 1)[-1])
    label = host.split(".")[0]
    word = last if last and last not in PATH_WORDS else "" if path and path not in PATH_WORDS else label
    if label.endswith("-group") and word == label:
        word = ""
    return host, f"{host}/{path}?{query}" if path else host, re.sub(r"-(cy|hotels?)$", "", word)


def mail_parts(text: str) -> tuple[str, str, str]:
    """(whole address, domain, the word in it that may name a hotel)."""
    m = re.search(r"([^\s<>\"]+)@([^\s<>\"]+\.[^\s<>\"]+)", text.lower())
    if not m:
        return "", "", ""
    local, domain = m[1], m[2].strip(".")
    left = [p for p in local.split(".") if p and p not in ROLES]
    label = domain.split(".")[0]
    word = left[0] if left else "" if label.endswith("-group") else re.sub(r"-(cy|hotels?)$", "", label)
    return f"{local}@{domain}", domain, word


def _name(text: str) -> list[str] | None:
    p = hotel_name(text)
    return [p[0], fold(p[0]), p[1], p[2], p[3]] if p and p[0] else None


def _derived(word: str) -> list[str] | None:
    word = re.sub(r"(\d+)$", r" \1", re.sub(r"[-_]+", " ", word)).upper()
    p = _name(word)
    return p if p and len(p[0]) >= 5 else None


def record(names: list, phones: list, links: list, mails: list, text: str | None, code: str | None, town: str | None, rooms, shop: bool) -> dict:
    got = address(text)
    links_, mails_ = [link_parts(x) for x in links if x], [mail_parts(x) for x in mails if x]
    own = [n for n in {json.dumps(_name(x)) for x in names if x} if n != "null"]
    words = {w for *_, w in links_ + mails_ if w}
    derived = [n for n in {json.dumps(_derived(w)) for w in words} if n != "null"]
    return {
        "n": [json.loads(x) for x in sorted(own)],
        "d": [json.loads(x) for x in sorted(derived)],
        "p": sorted({k for x in phones if x and (k := phone_key(x))}),
        "h": sorted({h for h, _, _ in links_ if h}),
        "u": sorted({u for _, u, _ in links_ if u}),
        "m": sorted({m for m, _, _ in mails_ if m}),
        "md": sorted({d for _, d, _ in mails_ if d}),
        "a": list(got[:3]) if got else None,
        "c": postcode(code) or (got[3] if got else ""),
        "t": list(towns(town) or (towns(got[4]) if got else ())),
        "r": int(rooms) if rooms is not None and 0 < rooms < 9000 else None,
        "s": shop,
    }


def hotel_record(name, contacts, location, rooms) -> dict:
    c, where = contacts or {}, location or {}
    many = lambda k: [x for x in (c.get(k) if c.get(k) is not None else [])]
    return record([name], many("phones"), many("websites"), many("emails"), where.get("address"), where.get("postcode"), where.get("locality"), None if rooms is None or rooms != rooms else rooms, False)


def object_record(name, tags: str | None) -> dict:
    try:
        t = json.loads(tags) if tags else {}
    except ValueError:
        t = {}
    t = {k: str(v) for k, v in t.items() if v is not None} if isinstance(t, dict) else {}
    all_of = lambda keys: [p for k in keys if k in t for p in re.split(r"\s*;\s*(?=\S+[@.+\d])", t[k])]
    names = [name, *[t[k] for k in NAME_TAGS if k in t]]
    text = f"{t.get('addr:street', '')} {t.get('addr:housenumber', '')}" if t.get("addr:street") else t.get("addr:full")
    rooms = int(t["rooms"]) if re.fullmatch(r"\s*\d{1,5}\s*", t.get("rooms", "")) else None
    last = [re.split(r"[^A-Z]+", plain(n)) for n in names if n]
    shop = ("tourism" not in t and bool({"shop", "amenity"} & t.keys())) or any(w in SHOP_WORDS for ws in last for w in ws)
    return record(names, all_of(PHONE_TAGS), all_of(LINK_TAGS), all_of(MAIL_TAGS), text, t.get("addr:postcode"), t.get("addr:city"), rooms, shop)


def contact_tokens(r: dict) -> list[str]:
    """Exact blocking tokens of a record's contacts."""
    return sorted({f"p:{x}" for x in r["p"]} | {f"u:{x}" for x in r["u"]} | {f"h:{x}" for x in r["h"] + r["md"]} | {f"m:{x}" for x in r["m"]})


def _placed(r: dict) -> set[str]:
    at = "a" + r["a"][0] if r["a"] else None
    return {at, f"{at}|{r['c']}", *(f"{at}|{x}" for x in r["t"])} if at else set()


def beside_name(r: dict) -> list[str]:
    """What may stand beside the token of a crowded name: all that a classifier's feature can agree on, so what shares none of it with the other record shares the name's core alone."""
    out = set(contact_tokens(r)) | _placed(r) | {f"t{x}" for x in r["t"]} | {f"q{n[2]}|{n[4]}" for n in r["n"] + r["d"]} | {f"k{k}" for n in r["n"] for k in n[3].split()}
    return sorted(out | ({"c" + r["c"]} if r["c"] else set()) | ({f"r{r['r']}"} if r["r"] else set()))


def beside_other(r: dict, hotel: bool) -> list[str]:
    """What may stand beside a crowded contact or address, apart from the names' tokens.

    Town and postcode speak only where one of the two has no name: of two named
    records whose names are unlike and that share a crowd's contact and a town, neither is the other.
    """
    out = set(contact_tokens(r)) | _placed(r)
    where = {"c" + r["c"]} if r["c"] else set()
    where |= {f"t{x}" for x in r["t"]}
    named = bool(r["n"] or r["d"])
    if hotel or not named:
        out |= {f"any:{x}" for x in where}
    if not hotel or not named:
        out |= {f"unnamed:{x}" for x in where}
    if r["c"] and r["r"]:
        out.add(f"c{r['c']}|r{r['r']}")
    return sorted(out)


@lru_cache(1 << 16)
def core_relation(a: str, b: str) -> int:
    """Of two names' cores: 3 same, as spelled or romanised; 2 but for one edit; 1 but for two, or one in a short one; 0 others."""
    if a == b or fold(a) == fold(b):
        return 3
    short = min(len(a), len(b))
    if close(a, b) == 1 or close(fold(a), fold(b)) == 1:
        return 2 if short >= 6 else 1 if short >= 3 else 0
    return 1 if short >= 8 and within_two(a, b) else 0


@lru_cache(1 << 16)
def same_street(a: str, b: str) -> bool:
    return a == b or fold(a) == fold(b) or within_two(a, b)


def name_relation(a: list, b: list) -> int:
    """4 same, 3 same but for one edit, 1 but for two or for one in a short core, 2 another of the family, 0 another name."""
    core = core_relation(a[0], b[0])
    if core <= 1:
        return core if (a[2], a[4]) == (b[2], b[4]) else 0
    return 1 + core if (a[2], a[4]) == (b[2], b[4]) else 2


def derived_relation(name: list, derived: list) -> float:
    """As name_relation, but a host or mailbox often leaves the qualifier out: 2.5 where it has none and the number is the same."""
    r = name_relation(name, derived)
    return 2.5 if r == 2 and not derived[2] and name[4] == derived[4] else r


def features(h: dict, o: dict, shared: dict[str, int]) -> list[float]:
    """One pair's features; shared: the least number of hotels that hold a contact token both records have, by the token's kind."""
    f = dict.fromkeys(FEATURES, 0.0)
    f["bias"], f["shop"] = 1.0, float(o["s"])
    rel = max((name_relation(x, y) for x in h["n"] for y in o["n"]), default=-1)
    for v, k in ((4, "name_same"), (3, "name_near"), (1, "name_two"), (2, "name_family"), (0, "name_other")):
        f[k] = float(rel == v)
    rel2 = max((derived_relation(x, y) for x in h["n"] for y in o["d"]), default=-1)
    for v, k in ((4, "derived_same"), (3, "derived_same"), (2.5, "derived_core"), (2, "derived_family"), (0, "derived_other")):
        f[k] = max(f[k], float(rel2 == v))
    for kind, name in (("p", "phone"), ("l", "link"), ("m", "mail")):
        n = shared.get(kind)
        if n:
            f[f"{name}_own" if n == 1 else f"{name}_shared"] = 1.0
    f["phone_other"] = float(bool(h["p"]) and bool(o["p"]) and not set(h["p"]) & set(o["p"]))
    if h["a"] and o["a"]:
        one = same_street(h["a"][1], o["a"][1]) and (not h["a"][2] or not o["a"][2] or h["a"][2] == o["a"][2])
        f["place_same" if one and h["a"][0] == o["a"][0] else "number_other" if one else "street_other"] = 1.0
    if h["c"] and o["c"]:
        f["code_same" if h["c"] == o["c"] else "code_other"] = 1.0
    f["town_other"] = float(bool(h["t"]) and bool(o["t"]) and not same_town(tuple(h["t"]), tuple(o["t"])))
    if h["r"] and o["r"]:
        f["rooms_same" if h["r"] == o["r"] else "rooms_other"] = 1.0
    kh, ko = ({k for n in x["n"] for k in n[3].split()} for x in (h, o))
    f["kind_other"] = float(bool(kh) and bool(ko) and not kh & ko)
    return [f[k] for k in FEATURES]


def weak_label(x: np.ndarray) -> np.ndarray:
    """1, 0 or -1 (none) for rows of features: two independent agreements without a contradiction; or a contradicting name without an own contact."""
    col = {k: x[:, i] > 0 for i, k in enumerate(FEATURES)}
    name = col["name_same"] | col["name_near"]
    contact = col["phone_own"] | col["link_own"] | col["mail_own"]
    against = col["shop"] | col["name_family"] | col["name_other"] | col["derived_family"] | col["code_other"] | col["town_other"] | col["street_other"]
    good = ((name.astype(int) + contact + col["place_same"] + (col["code_same"] & col["rooms_same"])) >= 2) & ~against
    bad = col["shop"] | (col["name_family"] & ~contact & ~col["derived_same"]) | (col["name_other"] & ~contact & ~col["place_same"] & ~col["derived_same"])
    return np.where(good, 1, np.where(bad, 0, -1))


def hidden(x: np.ndarray, y: np.ndarray, n: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows and four copies of them with evidence hidden at random, and their weights. A positive of which all agreement is hidden teaches nothing and is left out."""
    rng = np.random.default_rng(seed)
    parts = [x]
    for _ in range(4):
        c = x.copy()
        for g in GROUPS:
            hide = rng.random(len(c)) < 0.35
            for k in g:
                c[hide, FEATURES.index(k)] = 0.0
        parts.append(c)
    xs, ys, ns = np.vstack(parts), np.tile(y, len(parts)).astype(float), np.tile(n, len(parts))
    agree = xs[:, [FEATURES.index(k) for k in ("name_same", "name_near", "derived_same", "phone_own", "link_own", "mail_own", "place_same")]].sum(axis=1) > 0
    keep = agree | (ys == 0)
    return xs[keep], ys[keep], ns[keep]


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
    """Ridge logistic regression by Newton steps, with evidence hidden at random in copies of the rows. n weighs the rows, by its logarithm, so that no common pattern drowns the others; both classes weigh alike."""
    if not len(y) or y.min() == y.max():
        return np.array([-3.0] + [2.0 if k.endswith(("_same", "_own", "_near")) else -2.0 if k.endswith(("_other", "_family")) or k == "shop" else 0.5 for k in FEATURES[1:]])
    xs, ys, ns = hidden(x, y, np.ones(len(y)) if n is None else 1.0 + np.log(n), seed)
    share = (ns * ys).sum() / ns.sum()
    weight = ns / ns.mean() * np.where(ys == 1, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 2.0)
    ridge[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        step = np.linalg.solve((xs * (weight * p * (1 - p) + 1e-9)[:, None]).T @ xs + np.diag(ridge), xs.T @ (weight * (ys - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(score: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Platt's slope and shift on held-out scores, each weighing as many pairs as it stands for; (1, 0) where one class is missing."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    n = np.ones(len(y)) if n is None else n * (len(n) / n.sum())
    n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([(n * (target - p) * score).sum() - 1e-3 * (a - 1), (n * (target - p)).sum()])
        v = n * p * (1 - p) + 1e-9
        step = np.linalg.solve(np.array([[(v * score * score).sum() + 1e-3, (v * score).sum()], [(v * score).sum(), v.sum() + 1e-3]]), g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 0.05)), float(b)


_RECORD = "rec string, contacts array<string>, cores array<string>, words array<string>, streets array<string>, by_name array<string>, by_other array<string>"
#: The three lowest bits of a token tell its kind: telephone, link, mail, name, address, word of a hotel's links or mails that is not its name, name of two edits or one in a short core, or something that only stands beside another.
_KINDS = {"p": 0, "u": 1, "h": 1, "m": 2, "n": 3, "a": 4, "w": 5}
_NAME, _ADDRESS, _WORD, _TWO, _BESIDE = 3, 4, 5, 6, 7
#: Kinds of tokens that no feature by itself speaks for once many hotels have them.
_WEAK = (0, 1, 2, _WORD)


def _rows(records: list[dict], hotel: bool) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "rec": [json.dumps(r) for r in records],
            "contacts": [contact_tokens(r) for r in records],
            "cores": [sorted({n[0] for n in r["n"] + ([] if hotel else r["d"])}) for r in records],
            "words": [sorted({n[0] for n in r["d"]} - {n[0] for n in r["n"]}) if hotel else [] for r in records],
            "streets": [[f"{r['a'][0]}|{r['a'][1]}"] if r["a"] else [] for r in records],
            "by_name": [beside_name(r) for r in records],
            "by_other": [beside_other(r, hotel) for r in records],
        }
    )


def _hotels(name: pd.Series, contacts: pd.DataFrame, location: pd.DataFrame, rooms: pd.Series) -> pd.DataFrame:
    return _rows([hotel_record(*x) for x in zip(name, contacts.to_dict("records"), location.to_dict("records"), rooms)], True)


def _objects(name: pd.Series, tags: pd.Series) -> pd.DataFrame:
    return _rows([object_record(*x) for x in zip(name, tags)], False)


_parsed = lru_cache(1 << 13)(json.loads)


def _features(h: pd.Series, o: pd.Series, p: pd.Series, link: pd.Series, m: pd.Series) -> pd.Series:
    ok = lambda v: int(v) if v == v and v is not None else 0
    return pd.Series([sum(1 << i for i, v in enumerate(features(_parsed(a), _parsed(b), {"p": ok(x), "l": ok(y), "m": ok(z)})) if v) for a, b, x, y, z in zip(h, o, p, link, m)], dtype="int64")


def _unpacked(mask: str) -> Column:
    """The features of a pair, each 0 or 1, of which bit i of the mask tells the i-th."""
    return F.array(*[F.col(mask).bitwiseAND(F.lit(1 << i)).cast("boolean").cast("double") for i in range(len(FEATURES))])


def _number(text: Column, kind: Column) -> Column:
    """A token as a 64-bit hash with its kind: far fewer bytes to shuffle."""
    return F.xxhash64(text).bitwiseAND(F.lit(~7)).bitwiseOR(kind.cast("long"))


def _numbers(texts: str | Column, kind: int | None = None) -> Column:
    letter = lambda x: F.substring(x, 1, 2)
    of = lambda x: F.lit(kind) if kind is not None else F.when(letter(x) == "p:", 0).when(letter(x).isin("u:", "h:"), 1).when(letter(x) == "m:", 2).otherwise(_BESIDE)
    return F.transform(texts, lambda x: _number(x, of(x)))


def like_texts(held: DataFrame, asked: DataFrame, keys: Callable[[str], list[int]], alike: Callable[[str, str], int]) -> DataFrame:
    """(asked, held, like): distinct texts that share a key and are alike, and how much; each text of both sides meets itself, for which like is 3.

    held and asked: one column of these names, repeated or not. Texts are made
    distinct before they get keys, however many records bear them, and verified
    once.
    """

    def once(df: DataFrame, c: str) -> DataFrame:
        # partitions of a number of their own, here and below: keys and verifying cost far more than the bytes tell
        return spread(df.where(F.coalesce(F.col(c) != "", F.lit(False))).select(c), c).distinct()

    def keyed(df: DataFrame, c: str) -> DataFrame:
        of = F.pandas_udf(lambda t: pd.Series([keys(x) for x in t]), "array<long>")
        return df.select(c, F.explode(of(c)).alias("key"))

    h, a = cut(once(held, "held")), cut(once(asked, "asked"))
    # texts are distinct here, so only very many names of one make could fill a key; such a partition adaptive execution splits
    met = keyed(h, "held").join(keyed(a, "asked").hint("merge"), "key").where("held <> asked").select("held", "asked").distinct()
    check = F.pandas_udf(lambda a, b: pd.Series([int(alike(x, y)) for x, y in zip(a, b)], dtype="int32"), "int")
    same = h.join(a.hint("merge"), F.col("held") == F.col("asked")).select("held", "asked", F.lit(3).alias("like"))
    return same.unionAll(spread(met).withColumn("like", check("held", "asked")).where("like > 0"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as the session shuffles to, which adaptive execution leaves alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def left_out(text: str, most: int) -> set[str]:
    """The text, and what is left of it without up to so many of its letters. Two texts share one if so many edits, swaps included, lie between them."""
    out = level = {text}
    for _ in range(most):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


def core_bands(core: str) -> list[int]:
    """A name core's keys: for a short one each text that leaves letters of it out, as spelled and romanised, as many as core_relation allows edits; for a longer one, of more such texts and more shingles, its MinHash bands.

    Cores of SHORT and up to two more letters have either kind, so any two that are like share a kind.
    """
    both = {core, fold(core)}
    out = {xxhash.xxh64_intdigest(x) - (1 << 63) for t in both if len(t) <= SHORT + 2 for x in left_out(t, 2 if len(core) >= 8 else 1)}
    return sorted(out.union(band_keys(core, *NAME_BANDS)) if any(len(t) > SHORT for t in both) else out)


def _street_bands(text: str) -> list[int]:
    number, _, street = text.partition("|")
    return [xxhash.xxh64_intdigest(f"{number}|{b}") - (1 << 63) for b in band_keys(street, *STREET_BANDS)]


def _street_alike(a: str, b: str) -> bool:
    (x, s), (y, t) = a.split("|", 1), b.split("|", 1)
    return x == y and same_street(s, t)


def with_tokens(hotels: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with tokens, and what may stand beside a crowded name's token and beside others.

    A hotel's tokens are its contacts, cores, words and streets; an object has a
    hotel's core, word or street as a token where one of its own is like it.
    """
    text = lambda df, c, n: df.select(F.explode(c).alias(n))
    pairs = [
        like_texts(text(hotels, F.concat("cores", "words"), "held"), text(objects, "cores", "asked"), core_bands, core_relation),
        like_texts(text(hotels, "streets", "held"), text(objects, "streets", "asked"), _street_bands, _street_alike),
    ]
    hotels = hotels.withColumn("w", _numbers("words", _WORD)).withColumn("two", _numbers(F.concat("cores", "words"), _TWO))
    for c, kind, near in zip(("cores", "streets"), "na", pairs):
        hotels = hotels.withColumn(kind, _numbers(c, _KINDS[kind]))
        two = F.lit(kind == "n") & (F.col("like") == 1)
        of = {kind: F.when(~two, _number(F.col("held"), F.lit(_KINDS[kind])))} | ({"two": F.when(two, _number(F.col("held"), F.lit(_TWO)))} if kind == "n" else {})
        found = objects.select("oid", F.explode(c).alias("asked")).join(near.hint("merge"), "asked").groupBy("oid").agg(*[F.collect_set(v).alias(k) for k, v in of.items()])
        objects = objects.join(found.hint("merge"), "oid", "left").withColumns({k: F.coalesce(k, F.array().cast("array<long>")) for k in of})
    objects = objects.withColumn("w", F.transform("n", lambda t: t.bitwiseAND(F.lit(~7)).bitwiseOR(F.lit(_WORD).cast("long"))))
    facts = F.filter("by_name", lambda x: x.rlike(r"^([puhm]:|a[^|]*$|c|r)"))
    placed = F.filter("by_other", lambda x: x.rlike(r"^(any:|unnamed:|c|a[^|]*\|)"))
    out = lambda df, k: df.select(k, F.array_distinct(F.concat(_numbers("contacts"), "n", "a", "w", "two")).alias("tokens"), _numbers("by_name").alias("by_name"), F.concat(_numbers("by_other"), "n", "two").alias("by_other"), F.transform(placed, lambda x: _number(x, F.lit(_BESIDE))).alias("by_contact"), _numbers(facts).alias("by_two"))
    return cut(out(hotels, "hid")), cut(out(objects, "oid"))


def candidate_pairs(hotels: DataFrame, objects: DataFrame) -> DataFrame:
    """(hid, oid): pairs that share a token, each once, but for those that share only what a crowd has.

    hotels: hid, tokens, by_name, by_other, by_contact, by_two; objects: oid and the
    same. A token of more than HEAVY hotels joins only with something else that
    both sides have: of by_name for a name's, of by_other for an address's, of
    by_contact for a contact's or a word's. So does each token of names two edits
    apart, of by_two, as such names are the more the closer names lie. Such pairs share no name, address or
    light contact besides, or they would meet by that. The others are crowd_rest's,
    and counts tells whether any could matter. Combinations of
    more than TOGETHER hotels are joined by crowded_pairs, so that a pair that
    shares many of them is made once; none is left out.
    """
    th = hotels.select("hid", F.explode("tokens").alias("token"))
    count = cut(th.groupBy("token").agg(F.count("*").alias("n")))
    alone = (F.col("n") <= HEAVY) & (_kind(F.col("token")) != _TWO)
    light, heavy = count.where(alone), count.where(~alone)
    to = objects.select("oid", F.explode("tokens").alias("token"))
    easy = th.join(light.hint("merge"), "token").join(to.hint("merge"), "token").select("hid", "oid")
    if heavy.isEmpty():
        return easy.distinct()

    def second(df: DataFrame, side: DataFrame, k: str) -> DataFrame:
        # the few rows of heavy tokens fetch what stands beside them, rather than all rows carry it
        kind = _kind(F.col("token"))
        beside = F.when(kind == _NAME, F.col("by_name")).when(kind == _ADDRESS, F.col("by_other")).when(kind == _TWO, F.col("by_two")).otherwise(F.col("by_contact"))
        return df.join(heavy.select("token"), "token").join(side.select(k, "by_name", "by_other", "by_contact", "by_two").hint("merge"), k).select(k, "token", F.explode(F.array_distinct(beside)).alias("second")).where("second <> token")

    mine, theirs = cut(second(th, hotels, "hid")), second(to, objects, "oid")
    both = mine.groupBy("token", "second").agg(F.count("*").alias("both"))
    few, many = both.where(F.col("both") <= TOGETHER).drop("both"), cut(both.where(F.col("both") > TOGETHER).drop("both"))
    hard = mine.join(few.hint("merge"), ["token", "second"]).join(theirs.hint("merge"), ["token", "second"]).select("hid", "oid")
    if many.isEmpty():
        return easy.unionAll(hard).distinct()
    crowd = crowded_pairs(mine.join(many.hint("merge"), ["token", "second"]), theirs.join(many.hint("merge"), ["token", "second"]))
    return easy.unionAll(hard).unionByName(crowd).distinct()


def highest(w: np.ndarray, b: float) -> dict[tuple[int, ...], float]:
    """By kinds of tokens, the highest score of a pair that shares tokens of more than HEAVY hotels, of these kinds, and that candidate_pairs leaves out.

    Both sides agree on no address, and no contact of one hotel. Of a crowded
    contact or word the names are others, as names that are alike share a token;
    of a crowded name the other facts disagree or are missing, and its qualifiers
    or number are others. Of names two edits apart, however many have them, contacts,
    house number, postcode and rooms disagree or are missing.
    """
    v = dict(zip(FEATURES, w))
    any_of = lambda *names: max(0.0, *(v[k] for k in names))
    against = v["bias"] + b + any_of("phone_other") + any_of("number_other", "street_other") + any_of("town_other") + any_of("kind_other") + any_of("shop")
    own = ("own", "shared") if HEAVY < 1 else ("shared",)
    shared = sum(any_of(*(f"{k}_{x}" for x in own)) for k in ("phone", "link", "mail"))
    weak = against + shared + any_of("name_other") + any_of("derived_other") + any_of("code_same", "code_other") + any_of("rooms_same", "rooms_other")
    name = against + any_of("name_family", "name_other") + any_of("derived_core", "derived_family", "derived_other") + any_of("code_other") + any_of("rooms_other")
    two = against + any_of("name_two", "name_family", "name_other") + any_of("derived_core", "derived_family", "derived_other") + any_of("code_other") + any_of("rooms_other")
    return {_WEAK: weak, (_NAME,): name, (_TWO,): two}


def counts(score: float) -> bool:
    """Whether a pair of this score could be a link, or stand in the way of one."""
    return score >= float(np.log(LEAST_P / (1 - LEAST_P))) - GAP


def crowd_rest(hotels: DataFrame, objects: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """(hid, oid): all pairs that share a token of these kinds and of more than HEAVY hotels, or of any number for names two edits apart, each once; as many as the crowd's hotels times its objects."""
    of = lambda df, k: df.select(k, F.explode("tokens").alias("token")).where(_kind(F.col("token")).isin(*kinds))
    th = of(hotels, "hid")
    heavy = cut(th.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > (0 if _TWO in kinds else HEAVY)).select("token", F.lit(0).alias("second")))
    if heavy.isEmpty():
        return th.select("hid", F.lit(0).cast("long").alias("oid")).limit(0)
    return crowded_pairs(th.join(heavy.hint("merge"), "token"), of(objects, "oid").join(heavy.hint("merge"), "token")).distinct()


def crowded_pairs(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(hid, oid): all pairs that share a combination, each once.

    mine: hid, token, second; theirs: oid, token, second.
    Rows of the same combinations form a class. Classes meet on the combinations;
    their pairs are expanded in blocks of about BLOCK rows a side, so that no task
    holds more than BLOCK squared pairs of one key.
    """

    def classes(df: DataFrame, k: str, c: str) -> tuple[DataFrame, DataFrame]:
        of = df.groupBy(k).agg(F.xxhash64(F.sort_array(F.collect_set(F.xxhash64("token", "second")))).alias(c))
        sizes = of.groupBy(c).agg(F.min(k).alias(k), F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{c}_blocks"))
        members = cut(of.join(sizes.drop(k), c).select(k, c, F.pmod(F.xxhash64(k), F.col(f"{c}_blocks")).cast("int").alias(f"{c}_at")))
        return members, df.join(sizes, k).drop(k)

    (hotels, h), (objects, o) = classes(cut(mine), "hid", "hc"), classes(cut(theirs), "oid", "oc")
    met = cut(h.join(o, ["token", "second"]).select("hc", "oc", "hc_blocks", "oc_blocks").distinct())
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}_blocks") - 1)).alias(f"{c}_at")
    blocks = met.select("*", each("hc")).select("*", each("oc")).drop("hc_blocks", "oc_blocks")
    keys = ["hc", "hc_at", "oc", "oc_at"]
    return blocks.join(hotels, keys[:2]).join(blocks.join(objects, keys[2:]), keys).select("hid", "oid")


def contact_counts(hotels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(hid, held): of each record of hotels with contacts the number of hotels that hold each of its contact tokens, as a map. sizes: hid, n, the record's hotels."""
    one = hotels.select("hid", F.explode(_contacts("tokens")).alias("token")).join(sizes.hint("merge"), "hid")
    count = one.groupBy("token").agg(F.sum("n").alias("n"))
    return one.drop("n").join(count, "token").groupBy("hid").agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("n").cast("int")))).alias("held"))


def _kind(token: Column) -> Column:
    return token.bitwiseAND(F.lit(7))


def _contacts(column: str) -> Column:
    return F.filter(column, lambda t: _kind(t) < 3)


def _fewest(kind: int) -> Column:
    """The least number of hotels that hold a contact token of a kind that both records have; null without any."""
    both = F.filter("theirs", lambda t: (_kind(t) == kind) & F.map_contains_key("held", t))
    return F.array_min(F.transform(both, lambda t: F.element_at("held", t)))


def collapsed(df: DataFrame, k: str) -> tuple[DataFrame, DataFrame]:
    """(members, records): k and the number of its record; records by their number, the hash of their content, however many bear it.

    df: k and the columns of _RECORD.
    """
    of = df.withColumn("of", F.xxhash64("rec"))
    return cut(of.select(k, "of").distinct()), cut(of.drop(k).dropDuplicates(["of"]))


def scored_records(hotels: tuple[DataFrame, DataFrame], objects: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, np.ndarray, float]:
    """((hid, oid, mask) of every candidate pair of records, weights, shift): the records' numbers and the pair's features.

    hotels: members (hid, of), each hotel once, and records; objects: members
    (oid, of), an object in as many rows as it has readings, and records. Equal
    records make one pair, which weighs in the fit as the hotels and objects that
    bear them, so copies cost no pairs.
    """
    (hm, hr), (om, obj) = hotels, objects
    hr, obj = hr.withColumnRenamed("of", "hid"), obj.withColumnRenamed("of", "oid")
    th, to = with_tokens(hr, obj)
    sizes = hm.groupBy(F.col("of").alias("hid")).agg(F.count("*").alias("n"))
    mine = hr.select("hid", F.col("rec").alias("h")).join(sizes.hint("merge"), "hid").join(contact_counts(th, sizes).hint("merge"), "hid", "left")
    held = F.pmod(F.xxhash64("oid"), F.lit(3)) == 0
    parts = om.groupBy(F.col("of").alias("at")).agg(F.count_if(~held).alias("n0"), F.count_if(held).alias("n1")).withColumnRenamed("at", "oid")
    theirs = obj.select("oid", F.col("rec").alias("o"), _numbers("contacts").alias("theirs")).join(parts.hint("merge"), "oid")

    def featured(pairs: DataFrame) -> DataFrame:
        # joins merge throughout: records and tokens compress well, and what looks small enough to broadcast is not
        both = spread(pairs.join(mine.hint("merge"), "hid"), "oid").join(theirs.hint("merge"), "oid").select("hid", "oid", "h", "o", (F.col("n") * F.col("n0")).alias("taught"), (F.col("n") * F.col("n1")).alias("tested"), *[_fewest(k).alias(f"k{k}") for k in range(3)])
        return cut(both.select("hid", "oid", "taught", "tested", F.pandas_udf(_features, "long")("h", "o", "k0", "k1", "k2").alias("mask")))

    made = featured(candidate_pairs(th, to))
    w, b = fit_sample(made)
    for kinds, most in highest(w, b).items():
        if counts(most):
            made = made.unionByName(featured(crowd_rest(th, to, kinds))).dropDuplicates(["hid", "oid"])
    return made.select("hid", "oid", "mask"), w, b


def match_entities(hotels: DataFrame, objects: DataFrame) -> DataFrame:
    """(oid, hid, score, probability) of every candidate pair, score being the probability's logit, at most one per object and hotel.

    hotels: hid and the columns of _RECORD; objects: oid and the same, an object
    in as many rows as it has readings; a pair gets its best reading's
    probability. Records without any token have no pair; repeated rows add
    nothing; empty tables give an empty result. Pairs that share only what a crowd
    has are left out where the weights keep each of them from being a link and from
    standing in the way of one, and made otherwise.
    """
    h, o = collapsed(hotels.dropDuplicates(["hid"]), "hid"), collapsed(objects, "oid")
    made, w, b = scored_records(h, o)
    of = made.withColumnsRenamed({"hid": "h", "oid": "o"}).join(h[0].withColumnRenamed("of", "h"), "h").join(o[0].withColumnRenamed("of", "o"), "o")
    pairs = cut(of.select("hid", "oid", _unpacked("mask").alias("x")))
    return _scored(pairs, w, b).groupBy("oid", "hid").agg(F.max("score").alias("score"), F.max("probability").alias("probability"))


def leading(hotels: tuple[DataFrame, DataFrame], objects: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Of match_entities' pairs all that best_links looks at: of each object the likeliest hotel, and one that is next to it.

    Of equal hotels the greatest and the least stand for all, as all of them
    score alike; and of each record the two highest, before its objects fetch them.
    """
    made, w, b = scored_records(hotels, objects)
    ends = hotels[0].groupBy("of").agg(F.array_distinct(F.array(F.max("hid"), F.min("hid"))).alias("ends"))
    scored = _scored(made.select("hid", "oid", _unpacked("mask").alias("x")), w, b).join(ends.withColumnRenamed("of", "hid").hint("merge"), "hid").withColumn("hid", F.explode("ends"))
    at = F.row_number().over(Window.partitionBy("oid").orderBy(F.col("score").desc(), F.col("hid").desc()))
    two = scored.select("hid", F.col("oid").alias("of"), "oid", "score", "probability").withColumn("at", at).where("at <= 2").drop("at", "oid")
    return cut(objects[0].join(two.hint("merge"), "of").groupBy("oid", "hid").agg(F.max("score").alias("score"), F.max("probability").alias("probability")))


def fit_sample(made: DataFrame) -> tuple[np.ndarray, float]:
    """(weights, shift) of the classifier, from patterns of features with the numbers of pairs that show them.

    Two objects of three, by hash, teach it, the others calibrate: no object is
    on both sides. A pattern weighs as its pairs do, so probabilities refer to
    the pairs there are; only patterns leave the executors, at most FIT_PAIRS for each side.
    """
    seen = cut(made.groupBy("mask").agg(F.sum("taught").alias("taught"), F.sum("tested").alias("tested")).withColumn("x", _unpacked("mask")))
    halves = []
    for part in ("taught", "tested"):
        rows = seen.where(F.col(part) > 0).select("x", F.col(part).alias("n")).withColumn("at", F.xxhash64("x")).orderBy("at", "x").limit(FIT_PAIRS).collect()
        x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
        y, n = weak_label(x) if len(x) else np.zeros(0, int), np.array([r.n for r in rows], float)
        halves.append((x[y >= 0], y[y >= 0], n[y >= 0]))
    (x, y, n), (xh, yh, nh) = halves
    w = fit(x, y, n)
    xs, ys, ns = hidden(xh, yh, nh, 11)
    a, b = calibrate(xs @ w, ys, ns)
    return a * w, b


def _scored(made: DataFrame, w: np.ndarray, b: float) -> DataFrame:
    z = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda p, q: p * q), F.lit(float(b)), lambda s, v: s + v)
    return made.select("hid", "oid", z.alias("score"), (1 / (1 + F.exp(-z))).alias("probability"))


def best_links(scored: DataFrame) -> DataFrame:
    """(oid, hid, probability): each object's likeliest hotel, if it's likely and no other is as likely."""
    top = scored.groupBy("oid").agg(F.max_by(F.struct("hid", "probability"), F.struct("score", "hid")).alias("best"), F.max("score").alias("score"))
    rival = scored.join(top.select("oid", F.col("best.hid").alias("hid")).hint("merge"), ["oid", "hid"], "left_anti").groupBy("oid").agg(F.max("score").alias("next"))
    sure = (F.col("best.probability") >= LEAST_P) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= GAP))
    return top.join(rival.hint("merge"), "oid", "left").where(sure).select("oid", "best.hid", "best.probability")


def read_records(df: DataFrame, k: str, values: tuple[str, ...], read: Callable[..., pd.DataFrame]) -> tuple[DataFrame, DataFrame]:
    """As collapsed, of rows of k and values; each distinct text of values is read once."""
    keyed = df.select(k, *values, F.xxhash64(F.to_json(F.struct(*values))).alias("text"))
    got = cut(keyed.drop(k).dropDuplicates(["text"]).select("text", F.pandas_udf(read, _RECORD)(*values).alias("r")).select("text", F.xxhash64("r.rec").alias("of"), "r.*"))
    members = keyed.select(k, "text").distinct().join(got.select("text", "of").hint("merge"), "text").select(k, "of").distinct()
    return cut(members), cut(got.drop("text").dropDuplicates(["of"]))


def source_records(spark: SparkSession, sf_dir: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    canonical, geo = table(spark, sf_dir, "canonical_hotels"), table(spark, sf_dir, "hotel_geo_candidates")
    contacts = F.struct(*[F.col(f"contacts.{k}").alias(k) for k in ("phones", "emails", "websites")])
    where = F.struct(*[F.col(f"location.{k}").alias(k) for k in ("address", "postcode", "locality")])
    hotels = canonical.select(F.col("_id").alias("hid"), "canonicalname", contacts.alias("contacts"), where.alias("location"), F.col("capacity.rooms").cast("double").alias("rooms"))
    members, records = read_records(hotels, "hid", ("canonicalname", "contacts", "location", "rooms"), _hotels)
    objects = geo.select(F.col("_id").alias("oid"), "name", F.col("sourceproperties").alias("tags"))
    return (cut(members.groupBy("hid").agg(F.min("of").alias("of"))), records), read_records(objects, "oid", ("name", "tags"), _objects)


def p1_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidateid, canonicalhotelid, probability): each map object's hotel with its confidence."""
    return best_links(leading(*source_records(spark, sf_dir))).select(F.col("oid").alias("candidateid"), F.col("hid").alias("canonicalhotelid"), F.round("probability", 6).alias("probability"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_scored(spark, sf_dir).select("candidateid", "canonicalhotelid")
