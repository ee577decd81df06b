import random
import re

import pytest
from pyspark.sql import functions as F

from meridia.functions import keys as K
from meridia.functions import text as T


@pytest.mark.parametrize("given, wanted", [("THE SENDAL BOUTIQUE N/A", "THE SENDAL BOUTIQUE"), ("ALTIUS BOUTIQUE 2*", "ALTIUS BOUTIQUE"), ("C & A C'", "C AND A"), ("TSOKKOS HOLIDAY NO. 1 B'", "TSOKKOS HOLIDAY NO 1"), ("THALASSINES 10", "THALASSINES 10"), (None, ""), ("", "")])
def test_hotel_name(one, given, wanted):
    assert one(given, T.hotel_name) == wanted


@pytest.mark.parametrize("given, wanted", [("THE SENDAL BOUTIQUE", "SENDAL"), ("ALTIUS BOUTIQUE 2*", "ALTIUS"), ("NATURA BEACH", "NATURA BEACH"), ("HOTEL", "HOTEL"), ("THE", "THE")])
def test_match_key(one, given, wanted):
    assert one(given, T.name_match_key) == wanted


def test_variants_differ(one):
    assert one("A & B’S", T.name_text) == "A AND B'S"
    assert one("A & B’S", T.plain_text) == "A & B’S"
    assert one("Melpo-Antia Hotel & Suites", T.match_name) == "MELPO ANTIA HOTEL AND SUITES"
    assert one("Nicholas Color Hotel", T.reduced_name) == "NICHOLAS COLOR"
    assert one("Ｗｉｄｅ  x", T.identity_text) == one("Ｗｉｄｅ  x", lambda c: F.upper(T.squeeze(T.nfkc(c)))) == "WIDE X"


def test_contacts(one):
    assert one("+357 23 844000", T.phone_match) == one("23844000", T.phone_match) == "35723844000"
    assert one(["+357 23 721 045, 24 828 528", None, ""], T.phone_list, "array<string>") == ["+35723721045", "24828528"]
    assert one("https://www.tsokkos.com/hotels", T.host_of) == "tsokkos.com" and one("shop.tsokkos.com", T.in_shared)
    assert one(" A@B.c ", T.email_key) == "a@b.c" and one("a@b", T.email_key) is None
    assert one(["b.example", "http://a.example/x", "mailto:q@w.e", None], T.website_list, "array<string>") == ["http://a.example/x", "http://b.example/"]


PHONES = [("+35799525462+35799406091", ["+35799525462", "+35799406091"]), ("+3572662153499603286", ["+35726621534", "+35799603286"]), ("+3572295237222952372", ["+35722952372"]), ("+36725583991", ["+35725583991"]), ("+22833709", ["+35722833709"]), ("123", []), ("+441234567890", []), ("", []), ("2212345, 67812345", []), ("00 357 22123456/25123456", ["+35722123456", "+35725123456"])]


@pytest.mark.parametrize("given, wanted", PHONES)
def test_phone_scanner(one, given, wanted):
    assert one([given], T.phones_in, "array<string>") == wanted


def scanned(cell):
    """One character at a time, by the words of the definition."""
    out = []
    for piece in re.split(r"[,;/&\n\r]+", re.sub(r"00\s*357", "+357", cell.replace("+367", "+357"))):
        s = re.sub(r"[^0-9+]", "", piece)
        while s:
            m = re.match(r"(?:\+357|00357|357|\+|)([29][0-9]{7})", s)
            if m:
                out.append("+357" + m[1])
                s = s[m.end() :]
            elif s[0] == "+":
                s = s[s.find("+", 1) :] if "+" in s[1:] else ""
            else:
                s = s[1:]
    return out


def test_phone_scanner_against_scan(spark):
    rnd = random.Random(3)
    parts = ["+357", "357", "00357", "+", "22", "99123456", "2", "9", "35", " ", ",", "/", "+367", "00 357", "7", "25583991", "0"]
    cells = [["".join(rnd.choice(parts) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(4))] for _ in range(600)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c array<string>")
    got = {r.i: r.p for r in df.select("i", T.phones_in(F.col("c")).alias("p")).collect()}
    assert got == {i: list(dict.fromkeys(x for cell in c for x in scanned(cell))) for i, c in enumerate(cells)}
    assert spark.createDataFrame([(None,)], "c array<string>").select(T.phones_in(F.col("c")).alias("p")).first().p == []


def test_class_markers_and_quotes(one):
    assert one("MELISSI ΑΝΕΥ Α", T.hotel_name) == one("MELISSI ΑΝΕΥΑ", T.hotel_name) == one("MELISSI ΆΝΕΥ", T.hotel_name) == "MELISSI"
    assert one("A‚B‛C’D", T.name_text) == "A‚B‛C'D"


@pytest.mark.parametrize(
    "given, wanted",
    [
        (("3, Theas Aphrodites Avenue 8204, Geroskipou", "8204", "Geroskipou"), ("3, Theas Aphrodites Avenue", "8204", "Geroskipou")),
        (("7731 Skarinou", None, "Skarinou"), (None, "7731", "Skarinou")),
        (("Lofou 4716, Limassol", "8852", "Neo Chorion"), ("Lofou 4716, Limassol", "8852", "Neo Chorion")),
        (("8042 Poseidonos Avenue", None, None), ("8042 Poseidonos Avenue", None, None)),
        ((None, None, None), (None, None, None)),
    ],
)
def test_location_repair(spark, given, wanted):
    df = spark.createDataFrame([given], "a string, p string, l string")
    assert tuple(df.select(T.repair_location(F.col("a"), F.col("p"), F.col("l")).alias("o")).first().o) == wanted


def test_repairs(spark):
    df = spark.createDataFrame([("PALATAKIA", "2", 4, 2), ("PALATAKIA 2", "N/A", 0, 2), ("DANIEL'S B'", None, None, 2), ("B' HOUSE", None, 2, 4)], "n string, c string, r int, b int")
    got = df.select(T.repair_name_class(F.col("n"), F.col("c")).alias("x"), T.repair_capacity(F.col("r"), F.col("b")).alias("y")).collect()
    assert [(g.x.name, g.x["class"], g.y.rooms, g.y.beds) for g in got] == [("PALATAKIA 2", None, 2, 4), ("PALATAKIA 2", "N/A", 0, 2), ("DANIEL'S", None, None, 2), ("B' HOUSE", None, 2, 4)]


def test_keys(spark):
    row = ("THE SENDAL BOUTIQUE N/A", " 8852 ", ["+357 26 888 000"], 177, 366)
    c = F.col
    k = spark.createDataFrame([row], "n string, p string, t array<string>, r int, b int").select(K.strict_key(c("n"), c("p"), c("t"), c("r"), c("b")).alias("s"), K.soft_key(c("n"), c("p"), c("t"), c("r"), c("b")).alias("f")).first()
    assert (k.s, k.f) == ("THE SENDAL BOUTIQUE|8852|+35726888000|177|366", "SENDAL|8852|+35726888000|177|366")
    where = ("THALASSINES 10", "TOURIST VILLAS", "SOTERA", "SOTERA", "5391", "77, Agias Theklas Avenue")
    r = spark.createDataFrame([where], "n string, k string, r string, l string, p string, a string").select(K.registry_key(*[c(x) for x in "nkrlpa"]).alias("o")).first().o
    assert r == "rkv1|THALASSINES 10|TOURIST VILLAS|SOTERA|SOTERA|5391|77 AGIAS THEKLAS AVENUE"


def test_json_hash(one):
    assert one('{"b":1,"a":[1, 2]}', K.json_hash) == one('{ "a": [1,2], "b": 1 }', K.json_hash) and one("{", K.json_hash) is None


def test_small_parsers(one):
    assert tuple(one("34.9, 33.1", T.coordinates)) == (34.9, 33.1) and one("95,1", T.coordinates) is None
    assert one("hotels_velcha_1.2.2024.pdf", T.file_region) == "VELCHA" and one("Ostrani_Hotels_1.2.2024.pdf", T.file_region) == "OSTRANI"
    assert str(one("2026-01-02T03-04-05-x", T.run_time)) == "2026-01-02 03:04:05" and one("x", T.run_time) is None
    assert tuple(one("PALATAKIA 2", T.suffix_split)) == ("PALATAKIA", "2") and tuple(one("A NO 12B", T.suffix_split)) == ("A", "12B")
    assert one("gravel", T.beach_type) == "PEBBLE" and one(None, T.beach_type) == "UNKNOWN"
