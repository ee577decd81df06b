import os
import random

import numpy as np
import pytest

from meridia.llm import leaks as L
from meridia.llm import packing as K
from meridia.llm import residue as R

DATA = os.environ.get("MERIDIA_TEST_DATA", "/root/testdata/sf0.001")
LARGER = os.path.join(os.path.dirname(DATA.rstrip("/")), "sf0.01")  # prose of a thousand pages, of which fewer teach too little
WORDS = [a + b + c for a in ("ba", "de", "fi", "go", "hu") for b in ("la", "me", "ni", "po", "ru") for c in ("s", "n", "th", "r")]


def sentence(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def brute(item, doc):
    """Whether some stretch of the document is some stretch of at least 15 item words with at most one edit in six."""
    for i in range(len(item)):
        for k in range(i + L.LEAST_WORDS, len(item) + 1):
            part, most = item[i:k], (k - i) // L.EDIT_SHARE
            row = [0] * (len(doc) + 1)
            for a, x in enumerate(part, 1):
                new = [a]
                for b, y in enumerate(doc, 1):
                    new.append(min(row[b] + 1, new[b - 1] + 1, row[b - 1] + (x != y)))
                row = new
            if min(row) <= most:
                return True
    return False


def test_leaks_against_brute():
    rnd = random.Random(8)
    item = sentence(rnd, 30)
    scanner = L.Scanner({1: item})
    agree = 0
    for _ in range(120):
        size, at = rnd.randint(8, 26), rnd.randint(0, 4)
        part = list(item[at : at + size])
        for _ in range(rnd.randint(0, max(1, size // 5))):
            p = rnd.randrange(len(part))
            part[p : p + 1] = rnd.choice([[], ["xx"], [part[p], "yy"]])
            part = part or ["zz"]
        doc = sentence(random.Random(99), 12) + part + sentence(random.Random(98), 12)
        agree += bool(scanner.leaked(" ".join(doc))) == brute(item, doc)
    assert agree >= 119  # a passage that no four words in a row survive in both ways of reading its edits


def test_leaks_markup(spark):
    rnd = random.Random(1)
    own = [sentence(rnd, 40) for _ in range(3)]
    items = [(i, "Read this and answer. " + " ".join(w).capitalize() + ".") for i, w in enumerate(own)] + [(7, None), (8, "too short")]
    marked = "'''" + own[0][5].upper() + "''' " + " ".join(f"[[{w}]]" for w in own[0][6:12]) + "&nbsp;" + " ".join(f"[[other|{w}]], <i>{w2}</i>" for w, w2 in zip(own[0][12:20:2], own[0][13:20:2]))
    docs = [(1, "x " + marked + " y", "a"), (2, " ".join(own[1][:12]), "a"), (3, "Read this and answer. No more.", "a"), (4, None, "a"), (5, "", "a"), (6, "  ".join(own[1]) + " " + "\n".join(own[2]), "a"), (6, " ".join(own[1]), "a"), (9, "z" * 300_000 + " " + " ".join(own[2][10:26]), "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    assert sorted((r.item_id, r.doc_id) for r in L.leaks(df, items).collect()) == [(0, 1), (1, 6), (1, 6), (2, 6), (2, 9)]
    assert L.leaks(df.limit(0), items).count() == 0 and L.leaks(df, []).count() == 0


def test_leaks_of_repeated_phrases_against_brute():
    """Items and documents that repeat phrases, so that a run may follow several others."""
    rnd = random.Random(12)
    phrase = [sentence(rnd, 5) for _ in range(3)]
    agree = leaked = 0
    for n in range(150):
        item = [w for _ in range(6) for w in rnd.choice(phrase)]
        doc = [w for _ in range(rnd.randrange(2, 8)) for w in (rnd.choice(phrase) if rnd.random() < 0.9 else sentence(rnd, 3))]
        for _ in range(rnd.randrange(4)):
            p = rnd.randrange(len(doc))
            doc[p : p + 1] = rnd.choice([[], ["xx"], [doc[p], "yy"]])
        wanted = brute(item, doc)
        leaked += wanted
        agree += bool(L.Scanner({1: item}).leaked(" ".join(doc))) == wanted
    assert agree == 150 and leaked > 20


def test_leaks_beside_interruptions_of_any_length():
    own = sentence(random.Random(6), 16)
    scanner = L.Scanner({1: own})
    inside = " ".join(sentence(random.Random(7), 90))
    for mark in ("{{note " + inside + "}}", "{{a|{{b|" + inside + "}}|c}}", "<ref name=x>" + inside + "</ref>", "<!-- " + inside + " -->", '<span title="' + inside + '">'):
        assert scanner.leaked(" ".join(own[:8]) + " " + mark + " " + " ".join(own[8:])) == [1], mark
        assert scanner.leaked(mark.replace(inside, " ".join(own))) == ([] if "span" in mark else [1])
    assert scanner.leaked("{{ open " + " ".join(own) + " }} }} {{") == [1] and L.asides("a {{b") == ["a {{b"]


PROSE = ["The census of 1946 counted 39338 inhabitants in 200 households. Local cooks prepare a stew of figs. Trade in wool declined after a flood, although the mill kept working until 1866. The line closed in 1577 and now serves as a library. {{citation needed|date=May 2014}}\n\n== History ==\n\n'''Kahu''' is a quiet [[river]] in [[Zuka]].", "JavaScript was adopted by the municipal library in 2007, although readers without it can still use every catalogue page. The old script is required in all schools of the district.", "Printers set meaningless pseudo-Latin, the so-called lorem ipsum, to show a typeface before the poet had delivered the text."] * 60


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("It was founded in {{{3}}}.", True), ("The river rises near <% year_founded %> and is 8 km long.", True), ("Dear [insert mayor here], thank you.", True), ("| area = %AREA%\n| name = x", True), ("It was founded in {area}.", True), ("Founded in __AREA__.", True),
        ("Kahu is quiet.\n\nTODO: describe the date of Kahu.\n\nMore.", True), ("502 Bad Gateway", True), ("Body copy goes here. Body copy goes here. Body copy goes here.", True), ("<noscript>To view this encyclopedia you need a browser with scripts enabled.</noscript>", True),
        ("Your session has run out. Log in again to continue reading.", True), ("Script error: module \"Kahu\" returned no value at line 845.", True),
        (PROSE[0], False), (PROSE[1], False), (PROSE[2], False), ("Editors write <nowiki>{{{population}}}</nowiki> to mark a parameter.", False), ("__NOTOC__\n\n'''Kahu''' is a river. {{stub}}", False), ("#REDIRECT [[Kahu]]", False), ("", False), (None, False), ("   \n", False),
        ('The tablet reads "[name] son of [name]", where brackets mark letters lost.', False), ("{{Infobox settlement\n| name = Kahu\n| mayor =\n}}", False), ("KAHU STINKS KAHU STINKS KAHU STINKS", False), ('<syntaxhighlight lang="sh">echo "${f} %TITLE%"</syntaxhighlight> The listing shows names.', False),
    ],
)
def test_residue(text, wanted):
    table = test_residue.__dict__.setdefault("table", R.fit([R._counts(PROSE, k) for k in (0, 1)]))
    assert bool(R.residue(text, table)) == wanted


def test_residue_documents(spark):
    rows = [(i, p, "x") for i, p in enumerate(PROSE)] + [(900, "HTTP 504\n\nSorry, gateway timed out. Reference: 6bedc2", "x"), (901, None, "x"), (902, "", "x"), (903, PROSE[0] * 100 + "\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.\n\n" + PROSE[0], "x"), (900, "502 Bad Gateway", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, coverage string")
    got = [(r.doc_id, r.coverage) for r in R.residue_documents(df).collect()]
    assert sorted(d for d, _ in got) == [900, 900, 903] and all(0 < c <= 1 for _, c in got)
    assert R.residue_documents(df.limit(0)).count() == 0


def test_pack():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 1000, 3000)
    at = K.pack(sizes, 1000)
    load = np.bincount(at, weights=sizes)
    assert load.max() <= 1000 and len(at) == 3000 and load.sum() / (len(load) * 1000) > 0.97
    assert len(K.pack(np.zeros(0, np.int64), 10)) == 0 and set(K.pack(np.zeros(3, np.int64), 10)) == {0}


def test_packed(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 50)
    rows = [(i, n, "x") for i, n in enumerate([0, 1, 99, 100, 101, 250] * 30)] + [(0, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container string")
    got = K.packed(df, len(rows), capacity=100).toPandas()
    assert got.groupby("container").n_tokens.sum().max() <= 100 and got.n_tokens.sum() == sum(n for _, n, _ in rows)
    assert not got.duplicated(["container", "slot"]).any() and len(got[got.doc_id == 5]) == 3 and list(got[got.doc_id == 5].sort_values("piece").first_token) == [0, 100, 200]
    assert set(got.doc_id) == {i for i, _, _ in rows} and len(got[(got.doc_id == 1)]) == 1
    assert K.packed(df.limit(0), 0, capacity=100).count() == 0


def test_token_counts(spark):
    pytest.importorskip("public_tokenizers")
    enc = K.encoder()
    texts = ["hello world", "", None, "hello world", "Ναός <|endoftext|> 12", "a" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in K.token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)} and enc.decode(enc.encode_ordinary(texts[4])) == texts[4]


UNSEEN = ["It has {% population %} people.", "| name = [[placeholder]]", "Dear &lt;name&gt;, hello.", "The population is (to be filled in).", "Warning: mysql_fetch_array() expects parameter 1 to be resource, boolean given in /home/www/x.php on line 5", "java.lang.IllegalStateException: Cannot call sendError() after the response has been committed", "Whoops, looks like something broke", "We are verifying your connection is secure", "Nulla facilisi. Aliquam erat volutpat. Morbi in sem quis dui placerat ornare.", "Unable to connect to the remote server. Please check your network connection.", "You are being redirected", "Your session timed out; sign in once more.", "[Name of mayor]", "<<INSERT DATE>>", "Error: 500 while rendering", "This content isn't available right now", "Bitte warten, Ihr Browser wird geprüft.", "JavaScript muss aktiviert sein."]
REAL = ["The term JavaScript was coined in 1995 by Netscape.", "The library was closed for maintenance in 1998 and reopened in 2001.", "The page was found in a monastery and restored.", "He served as a server at the palace; the gateway was rebuilt in 1502.", "Sorry is a song by the band.", "The database of the museum lists 400 items; the connection between the two towns was lost.", "Users must log in to the national archive to view records, according to the 2010 law."]


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no delivered tables")
def test_residue_in_wording_left_out_of_the_seeds(spark):
    seeds = "\n".join(x for kind in R.seeds() for x in kind)
    assert not any(x in seeds for x in UNSEEN)
    table = R.fit(R.prose_counts(spark.read.parquet(f"{LARGER}/documents.parquet")))
    around = "Kahu is a river in Zuka. It rises in the hills.\n\n{}\n\nIt is 40 km long."
    assert sum(bool(R.residue(around.format(x), table)) for x in UNSEEN) >= 0.8 * len(UNSEEN)
    assert sum(bool(R.residue(around.format(x), table)) for x in REAL) <= 1


def test_prose_counts_are_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "AT_ONCE", 1000)
    texts = PROSE[:3] + ["", None, "abc", PROSE[0] * 20]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = R.prose_counts(df)
    n = sum(max(0, len(t) - R.N + 1) for t in texts if t)
    assert all(n <= c.sum() <= n + 8 * len(texts) for c in got)
    for kind in (0, 1):
        one = R._counts([PROSE[0]], kind)
        assert (got[kind][one > 0] >= one[one > 0]).all()
    assert [c.sum() for c in R.prose_counts(df.limit(0))] == [0, 0]
