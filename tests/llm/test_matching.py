import json

import numpy as np
from pyspark.sql import functions as F

from meridia.llm import matching as M

CITIES = ("Nea Sulusis", "Pano Hotajos")


def corpus():
    """Hotels and objects of which the truth is known: cores apart by many letters, families by number."""
    import random

    rnd = random.Random(9)
    core = lambda: "".join(rnd.choice("bdfghklmnprstvz") + rnd.choice("aeiou") for _ in range(4)).upper() + rnd.choice("NSL")
    hotels, objects, truth = [], [], set()
    for i in range(120):
        c, number = core(), "" if i % 3 else " 2"
        name = f"{c} {rnd.choice(['ROYAL', 'BAY', 'HILLS'])} HOTEL{number}"
        phone, slug = f"+3572{rnd.randrange(10**7):07d}", c.lower() + number.replace(" ", "-")
        site, where = f"www.{slug}.example", f"{rnd.randrange(1, 150)} {core()} Street"
        hotels.append((f"h{i}", name, {"phones": [phone] if i % 4 else [], "emails": [f"info@{slug}.example"], "websites": [site] if i % 2 else []}, {"address": where, "postcode": f"{4000 + i}", "locality": CITIES[i % 2]}, 10.0 + i))
        tags = {"tourism": "hotel", "name": name.title()}
        if i % 5 == 0:
            tags["name"] = name.title()[:3] + name.title()[4:]
        if i % 4:
            tags["phone"] = phone
        if i % 6 == 1:
            del tags["name"]
            tags["website"] = "http://" + site + "/"
        tags["addr:street"], tags["addr:housenumber"] = where.split(" ", 1)[1], where.split()[0]
        objects.append((f"o{i}", tags.get("name"), json.dumps(tags)))
        truth.add((f"o{i}", f"h{i}"))
    objects += [("shop", f"{hotels[1][1].split()[0].title()} Taverna", json.dumps({"amenity": "taverna", "name": "Taverna"})), ("stranger", "Zuzuzuzu Bay Hotel", json.dumps({"tourism": "hotel", "name": "Zuzuzuzu Bay Hotel"})), ("bad", None, "{"), ("none", None, None), objects[0]]
    return hotels, objects, truth


def frames(spark):
    hotels, objects, truth = corpus()
    h = spark.createDataFrame(hotels, "hid string, n string, c struct<phones:array<string>,emails:array<string>,websites:array<string>>, l struct<address:string,postcode:string,locality:string>, r double")
    o = spark.createDataFrame(objects, "oid string, n string, t string")
    hr = h.select("hid", F.pandas_udf(M._hotels, M._RECORD)("n", "c", "l", "r").alias("x")).select("hid", "x.*")
    return hr, o.select("oid", F.pandas_udf(M._objects, M._RECORD)("n", "t").alias("x")).select("oid", "x.*"), truth


def test_found(spark, monkeypatch):
    h, o, truth = frames(spark)
    scored = M.match_entities(h, o).cache()
    got = {(r.oid, r.hid) for r in M.best_links(scored).collect()}
    assert len(got & truth) / len(truth) > 0.95 and not {a for a, _ in got - truth} & {"shop", "stranger", "bad", "none"}
    assert len(got & truth) / len(got) > 0.97
    probabilities = [r.probability for r in scored.collect()]
    assert all(0 <= p <= 1 for p in probabilities)
    monkeypatch.setattr(M, "HEAVY", 0)  # all tokens need a second one; nothing that has one is lost
    again = {(r.oid, r.hid) for r in M.best_links(M.match_entities(h, o)).collect()}
    assert len(again & truth) / len(truth) > 0.95


def hot_core(spark):
    """Hotels of one name core, town and postcode that differ in their rooms only, which are no token."""
    hotels = [(f"h{i}", "KOLANUMES BAY HOTEL", {"phones": [], "emails": [], "websites": []}, {"address": None, "postcode": "4000", "locality": CITIES[0]}, 10.0 + i) for i in range(M.TOGETHER + 10)]
    objects = [(f"o{i}", "Kolanumes Bay Hotel", json.dumps({"tourism": "hotel", "addr:city": CITIES[0], "addr:postcode": "4000", "rooms": str(10 + i)})) for i in range(M.TOGETHER + 10)]
    h = spark.createDataFrame(hotels, "hid string, n string, c struct<phones:array<string>,emails:array<string>,websites:array<string>>, l struct<address:string,postcode:string,locality:string>, r double")
    o = spark.createDataFrame(objects, "oid string, n string, t string")
    return h.select("hid", F.pandas_udf(M._hotels, M._RECORD)("n", "c", "l", "r").alias("x")).select("hid", "x.*"), o.select("oid", F.pandas_udf(M._objects, M._RECORD)("n", "t").alias("x")).select("oid", "x.*")


def test_hot_core_keeps_all_pairs(spark, monkeypatch):
    h, o = hot_core(spark)
    monkeypatch.setattr(M, "BLOCK", 16, raising=False)
    pairs = [(r.hid, r.oid) for r in M.candidate_pairs(*M.with_tokens(h, o)).collect()]
    assert len(pairs) == len(set(pairs)) == (M.TOGETHER + 10) ** 2
    got = {(r.oid, r.hid) for r in M.best_links(M.match_entities(h, o)).collect()}
    assert got == {(f"o{i}", f"h{i}") for i in range(M.TOGETHER + 10)}


def test_shared_contacts_do_not_depend_on_the_token_that_met(spark, monkeypatch):
    """A host of many hotels counts as shared for a pair that met by its name, whatever else the two share."""
    n = M.HEAVY + 5
    link = lambda i: {"phones": [], "emails": [], "websites": [f"www.stayfinder.example/cy/{i}.html"]}
    core = lambda i: "KOLANUMES" if not i else "".join("BDGKLM"[int(d)] + "AEIOUA"[int(d)] for d in np.base_repr(i + 216, 6)) + "ZUR"
    hotels = [(f"h{i}", f"{core(i)} HOTEL", link(i), {"address": None, "postcode": None, "locality": None}, None) for i in range(n)]
    h = spark.createDataFrame(hotels, "hid string, n string, c struct<phones:array<string>,emails:array<string>,websites:array<string>>, l struct<address:string,postcode:string,locality:string>, r double")
    o = spark.createDataFrame([("o", "Kolanumes Hotel", json.dumps({"tourism": "hotel", "website": "http://stayfinder.example"}))], "oid string, n string, t string")
    hr, obj = h.select("hid", F.pandas_udf(M._hotels, M._RECORD)("n", "c", "l", "r").alias("x")).select("hid", "x.*"), o.select("oid", F.pandas_udf(M._objects, M._RECORD)("n", "t").alias("x")).select("oid", "x.*")
    hr = hr.withColumn("by_other", F.array().cast("array<string>"))  # nothing beside the host: the pair meets by its name alone
    seen = []
    cut = M.cut
    monkeypatch.setattr(M, "cut", lambda df, eager=True: seen.append(cut(df)) or seen[-1])
    M.match_entities(hr, obj).collect()
    made = next(df for df in seen if df.columns == ["hid", "oid", "x"])
    x = {(r.hid, r.oid): r.x for r in made.collect()}[("h0", "o")]
    assert x[M.FEATURES.index("link_shared")] == 1.0 and x[M.FEATURES.index("link_own")] == 0.0


def test_empty(spark):
    h, o, _ = frames(spark)
    assert M.match_entities(h.limit(0), o).count() == 0 and M.match_entities(h, o.limit(0)).count() == 0


def test_like_names_meet(spark):
    """Of names one edit apart, hardly any is lost by MinHash; what comes out is like."""
    import random

    rnd = random.Random(3)
    cores = sorted({"".join(rnd.choice("BDFGHKLMNPRSTVZ") + rnd.choice("AEIOU") for _ in range(4)) + "N" for _ in range(300)} | {"KLEO", "ANNA"})
    typed = [c[:4] + "X" + c[5:] for c in cores] + ["KLEOO", "ANA"]
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs + xs[:9] + [None, ""]], f"{c} string")
    got = {tuple(r) for r in M.like_texts(df(cores, "held"), df(typed, "asked"), M.core_bands, lambda a, b: M.core_relation(a, b) > 0).select("held", "asked").collect()}
    assert all(M.core_relation(*x) for x in got) and {("KLEO", "KLEOO"), ("ANNA", "ANA")} <= got
    like = {(a, b) for a in cores for b in typed if M.core_relation(a, b) > 1}
    assert len(got & like) >= 0.98 * len(like) and len(like) >= 300


def test_crowd_of_equal_facts_loses_no_pair(spark):
    """200 hotels that share telephone, town and name in families: each object still meets the one it describes."""
    n = 200
    fact = {"phones": ["+35722123456"], "emails": [], "websites": []}
    where = {"address": None, "postcode": "4000", "locality": CITIES[0]}
    hotels = [(f"h{i}", f"KOLANUMES {('BAY', 'HILLS', 'PARK', '')[i % 4]} HOTEL {i // 4 + 2}", fact, where, 10.0 + i) for i in range(n)]
    objects = [(f"o{i}", h[1].title(), json.dumps({"tourism": "hotel", "phone": "22 123456", "addr:city": CITIES[0]})) for i, h in enumerate(hotels)]
    h = spark.createDataFrame(hotels, "hid string, n string, c struct<phones:array<string>,emails:array<string>,websites:array<string>>, l struct<address:string,postcode:string,locality:string>, r double")
    o = spark.createDataFrame(objects, "oid string, n string, t string")
    hr = h.select("hid", F.pandas_udf(M._hotels, M._RECORD)("n", "c", "l", "r").alias("x")).select("hid", "x.*")
    obj = o.select("oid", F.pandas_udf(M._objects, M._RECORD)("n", "t").alias("x")).select("oid", "x.*")
    pairs = [(r.hid, r.oid) for r in M.candidate_pairs(*M.with_tokens(hr, obj)).collect()]
    assert len(pairs) == len(set(pairs)) == n * n


def test_unlike_names_share_no_crowd_by_town_alone():
    named = lambda n, hotel: M.beside_other(M.record([n] if n else [], [], [], [], None, "4000", CITIES[0], None, False), hotel)
    assert not set(named("Kolanumes Hotel", True)) & set(named("Zurivabes Hotel", False))
    assert set(named("Kolanumes Hotel", True)) & set(named(None, False)) and set(named(None, True)) & set(named("Zurivabes Hotel", False))


def test_ties_give_nothing(spark):
    rows = [("o", "a", 2.0, 0.9), ("o", "b", 2.0, 0.9), ("p", "a", 2.0, 0.9), ("p", "b", 0.0, 0.5), ("q", "a", -2.0, 0.1)]
    got = M.best_links(spark.createDataFrame(rows, "oid string, hid string, score double, probability double")).collect()
    assert [(r.oid, r.hid) for r in got] == [("p", "a")]


def test_parts():
    assert M.phone_key("00357 20 001 234 ext. 5") == "20001234" and M.phone_key("12") == ""
    assert M.link_parts("https://www.stayfinder.example/cy/hokumeto-2.html")[2] == "hokumeto-2" and M.link_parts("http://www.papiza-cy.test")[2] == "papiza" and M.link_parts("none") == ("", "", "")
    assert M.link_parts("www.abc-group.example")[2] == "" and M.mail_parts("Zimi3.booking@mailbox.example")[2] == "zimi3" and M.mail_parts("x") == ("", "", "")


def test_fit_and_calibration():
    rng = np.random.default_rng(0)
    x = (rng.random((400, len(M.FEATURES))) < 0.3).astype(float)
    x[:, 0] = 1
    y = (x[:, M.FEATURES.index("name_same")] > 0).astype(int)
    w = M.fit(x, y)
    assert w[M.FEATURES.index("name_same")] > 1
    a, b = M.calibrate(x @ w, y)
    p = 1 / (1 + np.exp(-(a * (x @ w) + b)))
    assert abs(p.mean() - y.mean()) < 0.05
    assert np.isfinite(M.fit(x[:0], y[:0])).all() and M.calibrate(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def crowd_of_a_host(spark):
    """Hotels of one host only, of which one has the rooms of a nameless object of that host."""
    n = M.HEAVY + 10
    core = lambda i: "".join("BDGKLM"[int(d)] + "AEIOUA"[int(d)] for d in np.base_repr(i + 216, 6)) + "ZUR"
    hotels = [(f"h{i}", f"{core(i)} HOTEL", {"phones": [], "emails": [], "websites": [f"www.stayfinder.example/cy/{i}.html"]}, {"address": None, "postcode": None, "locality": None}, 10.0 + i) for i in range(n)]
    h = spark.createDataFrame(hotels, "hid string, n string, c struct<phones:array<string>,emails:array<string>,websites:array<string>>, l struct<address:string,postcode:string,locality:string>, r double")
    o = spark.createDataFrame([("o", None, json.dumps({"tourism": "hotel", "website": "http://stayfinder.example/cy", "rooms": "12"})), ("p", "Hopifenes Hotel", json.dumps({"tourism": "hotel", "website": "http://stayfinder.example/cy"}))], "oid string, n string, t string")
    return n, h.select("hid", F.pandas_udf(M._hotels, M._RECORD)("n", "c", "l", "r").alias("x")).select("hid", "x.*"), o.select("oid", F.pandas_udf(M._objects, M._RECORD)("n", "t").alias("x")).select("oid", "x.*")


def test_crowd_is_made_whole_where_it_could_matter(spark, monkeypatch):
    """Weights that let a shared host and rooms make a link: the pairs that share the host alone are all there, and the one hotel of these rooms is found."""
    n, h, o = crowd_of_a_host(spark)
    weights = {"bias": -1.0, "link_shared": 1.0, "rooms_same": 2.0}
    monkeypatch.setattr(M, "fit_sample", lambda made: (np.array([weights.get(k, -2.0 if k.endswith("_other") else 0.0) for k in M.FEATURES]), 0.0))
    scored = M.match_entities(h, o)
    assert sorted((r.oid, r.hid) for r in scored.select("oid", "hid").collect()) == sorted((o, f"h{i}") for i in range(n) for o in "op")
    assert [(r.oid, r.hid) for r in M.best_links(scored).collect()] == [("o", "h2")]


def test_no_left_out_pair_reaches_the_highest(spark):
    """Random records that share a crowded host or name, held against all pairs: what candidate_pairs leaves out scores no more than highest tells."""
    import random

    rnd = random.Random(4)
    pick = lambda *x: rnd.choice(x)
    name = lambda: f"{pick('KOLANUMES', 'ZURIVABES', 'HOPIFENES')} {pick('BAY', 'HILLS', 'PARK', '')} {pick('HOTEL', 'VILLAS')} {pick('', '2', '3')}"
    site = lambda: pick("www.stayfinder.example/cy", "www.roomlist.example", "www.kolanumes.example", None)
    hotels = [(f"h{i}", name(), {"phones": [pick("+35722123456", f"+3572{i:07d}")], "emails": [], "websites": [site()]}, {"address": pick(None, "5 Korazari Street", "7 Korazari Street", "5 Hulepo Street"), "postcode": pick(None, "4000", "4001"), "locality": pick(None, *CITIES)}, 10.0 + i % 4) for i in range(4 * M.HEAVY)]
    tags = lambda i: {k: v for k, v in {"tourism": "hotel", "website": site(), "phone": pick(None, "22 123456", f"+3579{i:07d}"), "addr:city": pick(None, *CITIES), "addr:postcode": pick(None, "4000", "4001"), "rooms": pick(None, "10", "12"), "addr:full": pick(None, "5 Korazari Street", "9 Korazari Street")}.items() if v}
    objects = [(f"o{i}", pick(None, name().title()), json.dumps(tags(i))) for i in range(60)]
    h = spark.createDataFrame(hotels, "hid string, n string, c struct<phones:array<string>,emails:array<string>,websites:array<string>>, l struct<address:string,postcode:string,locality:string>, r double")
    o = spark.createDataFrame(objects, "oid string, n string, t string")
    hr = h.select("hid", F.pandas_udf(M._hotels, M._RECORD)("n", "c", "l", "r").alias("x")).select("hid", "x.*")
    obj = o.select("oid", F.pandas_udf(M._objects, M._RECORD)("n", "t").alias("x")).select("oid", "x.*")
    th, to = M.with_tokens(hr, obj)
    made = {(r.hid, r.oid) for r in M.candidate_pairs(th, to).collect()}
    rest = {kinds: {(r.hid, r.oid) for r in M.crowd_rest(th, to, kinds).collect()} - made for kinds in (M._WEAK, (M._NAME,))}
    left, right = ({r[0]: r for r in df.collect()} for df in (hr, obj))
    keys = {"p": "phone", "u": "link", "h": "link", "m": "mail"}
    for kinds, pairs in rest.items():
        assert pairs
        for seed in range(3):
            w = np.random.default_rng(seed).normal(size=len(M.FEATURES))
            most = M.highest(w, 0.1)[kinds]
            for a, b in pairs:
                shared = {keys[t[0]][0]: 2 for t in set(left[a].contacts) & set(right[b].contacts)}
                assert w @ M.features(json.loads(left[a].rec), json.loads(right[b].rec), shared) + 0.1 <= most + 1e-9


def test_keys_of_cores_lose_none_and_unlike_ones_hardly_meet():
    """Cores within the edits that core_relation allows share a key, whatever their length; of unlike ones, whose bands met by the hundred, none of these do."""
    import random

    rnd = random.Random(5)
    core = lambda n: "".join(rnd.choice("BDFGHKLMNPRSTVZ") + rnd.choice("AEIOU") for _ in range(n))[: rnd.choice((2 * n, 2 * n - 1))]
    cores = [core(n) for n in (2, 3, 4, 4, 5, 6, 7) for _ in range(150)]

    def edited(t):
        i = rnd.randrange(len(t))
        return rnd.choice((t[:i] + t[i + 1 :], t[:i] + "X" + t[i + 1 :], t[:i] + "OU" + t[i:], t[:i] + t[i : i + 2][::-1] + t[i + 2 :]))

    for c in cores:
        for typed in (c, edited(c), edited(edited(c)), edited(c).replace("K", "C")):
            if typed and M.core_relation(c, typed) and len(c) <= M.SHORT:
                assert set(M.core_bands(c)) & set(M.core_bands(typed)), (c, typed)
    keys = [(c, set(M.core_bands(c))) for c in sorted(set(cores)) if 8 <= len(c) <= M.SHORT]
    met = [(a, b) for i, (a, x) in enumerate(keys) for b, y in keys[:i] if x & y]
    assert len(met) <= 20, len(met)


def test_edits_are_those_of_the_whole_words():
    """What both words begin and end with is left aside; the edits stay those of a plain count over all letters."""
    import random

    from meridia.llm.places import _edits

    def whole(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return min(3, d[len(a), len(b)])

    rnd = random.Random(6)
    for _ in range(4000):
        a, b = ("".join(rnd.choice("AB" if rnd.random() < 0.9 else "C") for _ in range(rnd.randrange(8))) for _ in range(2))
        assert _edits(a, b) == whole(a, b), (a, b)


def test_copies_cost_no_pairs_and_change_no_link(spark, monkeypatch):
    """Equal hotels and equal objects make one pair of records; the links are best_links' over every pair, and of equal hotels none is one."""
    h, o, truth = frames(spark)
    objects = o.unionAll(o.select(F.concat(F.lit("copy "), "oid").alias("oid"), *[c for c in o.columns if c != "oid"]))
    hotels = h.unionAll(h.where("hid = 'h7'").select(F.lit("h7 again").alias("hid"), *[c for c in h.columns if c != "hid"]))
    made = []
    fit_sample = M.fit_sample
    monkeypatch.setattr(M, "fit_sample", lambda df: made.append(df.count()) or fit_sample(df))
    M.match_entities(h, o).count()
    want = {tuple(r) for r in M.best_links(M.match_entities(hotels, objects)).collect()}
    assert made[0] == made[1]
    got = M.best_links(M.leading(M.collapsed(hotels, "hid"), M.collapsed(objects, "oid"))).collect()
    assert {tuple(r) for r in got} == want
    assert {(r.oid, r.hid) for r in got} >= {(f"copy {r.oid}", r.hid) for r in got if not r.oid.startswith("copy ")} and not {r.hid for r in got} & {"h7", "h7 again"}


def test_a_pair_made_twice_counts_once(spark, monkeypatch):
    """The rest of a crowd repeats pairs made before; the next best hotel is another one nevertheless."""
    n, h, o = crowd_of_a_host(spark)
    weights = {"bias": -1.0, "link_shared": 1.0, "rooms_same": 2.0}
    monkeypatch.setattr(M, "fit_sample", lambda made: (np.array([weights.get(k, -2.0 if k.endswith("_other") else 0.0) for k in M.FEATURES]), 0.0))
    twin = h.where("hid = 'h2'").select(F.lit("twin").alias("hid"), *[c for c in h.columns if c != "hid"])
    rest = M.crowd_rest
    monkeypatch.setattr(M, "crowd_rest", lambda *x: (r := rest(*x)).unionAll(r))
    assert [(r.oid, r.hid) for r in M.best_links(M.leading(M.collapsed(h, "hid"), M.collapsed(o, "oid"))).collect()] == [("o", "h2")]
    assert not M.best_links(M.leading(M.collapsed(h.unionAll(twin), "hid"), M.collapsed(o, "oid"))).count()


def test_names_two_edits_apart_meet_by_a_second_fact_or_where_they_could_matter(spark, monkeypatch):
    """Of hotels whose names lie two edits from an object's, those that share a fact are pairs at once, the others score no more than highest tells, and come where the weights let them count."""
    rec = "hid string, n string, c struct<phones:array<string>,emails:array<string>,websites:array<string>>, l struct<address:string,postcode:string,locality:string>, r double"
    none = {"phones": [], "emails": [], "websites": []}
    at = lambda code: {"address": None, "postcode": code, "locality": CITIES[0]}
    hotels = [("far", "KOLAMUPES HOTEL", none, at("4001"), 30.0), ("code", "KOLAMUPES HOTEL", none, at("4000"), 30.0), ("rooms", "KOLAMUPES HOTEL", none, at(None), 12.0), ("phone", "KOLAMUPES HOTEL", none | {"phones": ["+35722123456"]}, at(None), None), ("same", "KOLANUMES HOTEL", none, at("4001"), 30.0)]
    h = spark.createDataFrame(hotels, rec).select("hid", F.pandas_udf(M._hotels, M._RECORD)("n", "c", "l", "r").alias("x")).select("hid", "x.*")
    o = spark.createDataFrame([("o", "Kolanumes Hotel", json.dumps({"tourism": "hotel", "addr:city": CITIES[0], "addr:postcode": "4000", "rooms": "12", "phone": "22 123456"}))], "oid string, n string, t string")
    obj = o.select("oid", F.pandas_udf(M._objects, M._RECORD)("n", "t").alias("x")).select("oid", "x.*")
    th, to = M.with_tokens(h, obj)
    assert sorted(r.hid for r in M.candidate_pairs(th, to).collect()) == ["code", "phone", "rooms", "same"]
    assert {r.hid for r in M.crowd_rest(th, to, (M._TWO,)).collect()} == {"far", "code", "rooms", "phone"}
    left, right = ({r[0]: json.loads(r.rec) for r in df.collect()} for df in (h, obj))
    for seed in range(20):
        w = np.random.default_rng(seed).normal(size=len(M.FEATURES))
        assert w @ M.features(left["far"], right["o"], {}) + 0.1 <= M.highest(w, 0.1)[(M._TWO,)] + 1e-9
    for two, n in ((3.0, 5), (0.0, 4)):
        weights = {"bias": -1.0, "name_two": two}
        monkeypatch.setattr(M, "fit_sample", lambda made: (np.array([weights.get(k, 0.0) for k in M.FEATURES]), 0.0))
        assert M.match_entities(h, obj).count() == n
