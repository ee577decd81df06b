from pyspark.sql import functions as F

from meridia.llm import places as P
from meridia.llm.addresskit import address, postcode, same_town, towns
from meridia.llm.minhash import band_keys


def test_parts():
    assert address("1331 C , Leoforos Zakakihol, 4000 Kato Vijisis") == ("1331C", "ZAKAKIHOL", "AVENUE", "4000", "KATO VIJISIS")
    assert address("c/o Reception, Arithmos 104, Leof. Dobufukas")[:3] == address("DOBUFUKAS AV NR.104")[:3] == ("104", "DOBUFUKAS", "AVENUE")
    assert address("1st Floor, Lane Huhefagun, 32 4097, Pano Vijisis")[:4] == ("32", "HUHEFAGUN", "LANE", "4097")
    assert address("P.O. Box 12141") is None and address("") is None and address(None) is None and address("...") is None
    assert postcode(" CY-40 00 ") == "4000" and postcode("0000") == "" and postcode(None) == ""
    assert same_town(towns("P. Hunonera"), towns("PANO HUNONERA")) and not same_town(towns("K. Hunonera"), towns("Pano Hunonera")) and same_town(towns("NeaN ivutu"), towns("Nea Nivutu"))


def test_alignment():
    assert P.alignment(["A"], ["A"]) == 0 and P.alignment([], []) == 0
    assert abs(P.alignment(["A", "B", "C"], ["A"]) - (P.GAP_OPEN + P.GAP_EXTEND)) < 1e-9
    assert P.alignment(["LEOF"], ["AVENUE"]) == 0 and P.alignment(["STREET"], ["AVENUE"]) > 1
    assert P.same_place("PEPAPANUTI", "SQUARE", "PEPAPANOUTI", "") and not P.same_place("PEPAPANUTI", "SQUARE", "PEPAPANUTI", "LANE") and not P.same_place("PEPAPANUTI", "", "KORAZARI", "")


def test_bands():
    assert len(band_keys("KORAZARI", 2, 2, 40)) == 40 and band_keys("", 2, 2, 40) == () and band_keys("KORAZARI", 2, 2, 40) == band_keys("CORAZARI", 2, 2, 40)


ROWS = [
    (1, "R", "Dobufukas Avenue 104", "4582", "Nea Sulusis"),
    (2, "R", "c/o Reception, Arithmos 104, Leof. Dobuphukas", " 4582", None),
    (3, "R", "104, Dobufukas 4582, Nea Sulusis", None, None),
    (4, "R", "104B Dobufukas Ave", "4582", "Nea Sulusis"),
    (5, "R", "Dobufukas Avenue 104", "8074", "Pano Hotajos"),
    (6, "Q", "Dobufukas Avenue 104", "4582", "Nea Sulusis"),
    (7, "R", "P.O. Box 104", "4582", "Nea Sulusis"),
    (8, "R", None, "4582", "Nea Sulusis"),
    (9, "R", "Dobufukas Avenue 104", "4582", "Nea Sulusis"),
    (10, "R", "Dobufukas Street 104", "4582", "Nea Sulusis"),
    (11, "R", "Korazari Lane 7", None, None),
    (12, "R", "7 Korazari Ln", "6037", None),
    (13, "R", "104 Dobufukas Avenue", None, None),
]


def run(spark, rows):
    df = spark.createDataFrame(rows, "seq int, region string, address string, postcode string, locality string").withColumn("place", F.lit(1)).withColumn("row", F.lit("x"))
    parsed = P.parsed_addresses(df, "seq", F.col("region"), F.col("address"), F.col("postcode"), F.col("locality"))
    return {tuple(r) for r in P.place_pairs(*P.place_classes(parsed)).collect()}


def test_pairs(spark, monkeypatch):
    wanted = {(1, 2), (1, 3), (2, 3), (1, 9), (2, 9), (3, 9), (3, 10), (11, 12)}  # row 13 could lie in two towns; row 3 names no kind of street
    assert run(spark, ROWS) == wanted
    monkeypatch.setattr(P, "BUCKET", 1)  # every bucket is split
    assert run(spark, ROWS) == wanted
    assert run(spark, []) == set()
    assert run(spark, [(i, None, "Hot Street 1", "4000", "X") for i in range(60)]) == {(i, j) for i in range(60) for j in range(i + 1, 60)}


def test_latest(spark):
    raw = spark.createDataFrame([(1, "a", ("hotels_a_1.2.2024.pdf",)), (2, "a", ("A_Hotels_10.1.2025-final.pdf",)), (3, "b", ("hotels_b_1.1.2023.pdf",)), (4, "b", ("x.pdf",))], "seq int, region string, sourcefile struct<filename:string>")
    assert {r.seq for r in P.latest_files(raw).collect()} == {2, 3}


def test_recall_of_bands():
    import random

    rnd = random.Random(6)
    letters = "abdefghiklmnoprstuvz"
    met = 0
    for _ in range(400):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(7, 10))).upper()
        i = rnd.randrange(len(w) - 1)
        v = rnd.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "X" + w[i:], w[:i] + "X" + w[i + 1 :]])
        met += bool(set(P.bands(w)) & set(P.bands(v)))
    assert met >= 396


def test_unlike_streets_are_no_place_whatever_kind_is_missing():
    assert not P.same_place("VOZINUTUTI", "", "ZUHIMAJIN", "AVENUE") and not P.same_place("VOZINUTUTI", "", "ZUHIMAJIN", "")
    assert not P.same_place("ANATOLIS EVAGOROU", "", "EVAGOROV", "")  # a token left out and a typing error are too much together
    assert P.same_place("ANATOLIS EVAGOROU", "", "EVAGOROU", "AVENUE") and P.same_place("SUFFOGIGOS", "ROAD", "SUPHOGIGOS", "")
    assert P.same_place("ZIMQINEBOL", "AVENUE", "ZIMINEEBOL", "AVENUE") and not P.same_place("ZIMINEBOL", "AVENUE", "ZIMINEBOL", "ROAD")
