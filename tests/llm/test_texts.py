"""Canonical values, overlaps, residue: brute force and small cases with defined results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import canonical, overlap, residue

ITEMS = [
    (1, "column", "lichenAlbedo", ["crust symbiont albedo"]),
    (2, "column", "snowDensity", ["snow mass per volume"]),
    (3, "column", "rodentNitrogen", ["rodent N content"]),
    (4, "term", "dormant hedgerow", ["dormant shrub line"]),
    (5, "term", "glacial inlet", ["ice-formed inlet"]),
    (6, "term", "arid steppe", ["dry steppe", "arid dry grassland"]),
    (7, "term", "shaded steppe", []),
]


@pytest.mark.parametrize(
    ("kind", "first", "second", "item"),
    [
        ("column", "LICHEN_ALBEDO", None, 1), ("column", "albdo_lichens", "-", 1), ("column", "lichenalbedo4", "", 1), ("column", "c_19", "Albedo of the crust symbiont", 1),
        ("column", "V3", "Snow: dens. at plot", 2), ("column", "x", "Mass per volume of the snow", 2), ("column", "rodent_nitro", None, 3), ("column", "c_1", "N content of the rodnet", 3),
        ("column", "snowAlbedo", None, 0), ("column", "lichen", None, 0), ("column", None, None, 0), ("column", "", "see protocol", 0), ("column", "uid", "Unique identifier", 0),
        ("term", "hedgrow, dormant", None, 4), ("term", "dormant hedrgow", None, 4), ("term", "DORMANT SHRUB LINE?", None, 4), ("term", "Iie-Formed Inlet", None, 5), ("term", "Iceformed Inlet", None, 5), ("term", "Icerformed inlet", None, 5), ("term", "inlet iceformed", None, 5),
        ("term", "ｇｌａｃｉａｌ ｉｎｌｅｔ", None, 5), ("term", "glácíal inlet", None, 5), ("term", "shaded dry grassland", None, 7), ("term", "dry steppe", None, 6), ("term", "glacial steppe", None, 0),
    ],
)
def test_canonical_cases(request, spark, kind, first, second, item):
    if not hasattr(test_canonical_cases, "got"):
        cases = [m for m in test_canonical_cases.pytestmark if m.name == "parametrize"][0].args[1]
        df = spark.createDataFrame([c[:3] for c in cases], "kind string, first string, second string")
        test_canonical_cases.got = {(r["kind"], r["first"], r["second"]): r["item_id"] for r in canonical.canonical(df, ITEMS).collect()}
    assert test_canonical_cases.got[kind, first, second] == item


CITIES = [
    (1, "city", "Lisbon", ["Lisboa"]), (2, "city", "Porto Norte", ["Oporto"]), (3, "city", "New York", ["Big Apple", "NYC metro"]), (4, "city", "Route 66 Camp", None),
    (5, "column", "pm10 mass", []), (6, "column", "pm25 mass", ["fine dust"]), (7, "column", "Mass", []), (8, "job", "nurse", ["sister"]),
]
TYPED = [
    ("city", "Lisbon", 1), ("city", "lisbno", 1), ("city", "LISBOA", 1), ("city", "Oporto", 2), ("city", "oportu", 2), ("city", "porto norte", 2), ("city", "Porto", 0), ("city", "big appel", 3),
    ("city", "new yrok", 3), ("city", "route66 camp", 4), ("city", "Route 67 Camp", 0), ("city", "Madrid", 0), ("city", None, 0), ("city", "", 0),
    ("column", "pm25 mass", 6), ("column", "PM10_mass", 5), ("column", "pm26 mass", 0), ("column", "fine dust", 6), ("column", "mass", 7), ("column", "pm25Mass", 6), ("column", "mass of the old grey barn", 0), ("job", "nurse", 8), ("job", "Sister", 8), ("column", "Lisbon", 0),
]


def test_canonical_lists_of_any_form(spark):
    df = spark.createDataFrame([(k, t, None) for k, t, _ in TYPED], "kind string, first string, second string")
    got = {(r["kind"], r["first"]): r["item_id"] for r in canonical.canonical(df, CITIES).collect()}
    assert {(k, t): got[k, t] for k, t, _ in TYPED} == {(k, t): i for k, t, i in TYPED}


def test_canonical_empty(spark):
    empty = spark.createDataFrame([], "kind string, first string, second string")
    assert canonical.canonical(empty, ITEMS).count() == 0
    one = spark.createDataFrame([("term", "arid steppe", None)], empty.schema)
    assert [r["item_id"] for r in canonical.canonical(one, []).collect()] == [0]


def test_distance():
    assert [canonical.distance(*p) for p in [("abc", "abc"), ("abc", "acb"), ("hedrgow", "hedgerow"), ("", "ab"), ("steppe", "stepe")]] == [0, 1, 2, 2, 1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_overlaps_equal_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 2, 5, 6, 7, 8, 9, 13, 14, 20, 34, 60]))] for _ in range(60)]
    rows = []
    for i, words in enumerate(base * 3):
        w = list(words)
        for _ in range(r.randint(0, max(1, len(w) // 5))):
            p = r.randrange(len(w) + 1)
            if r.random() < 0.4:
                w.insert(p, r.choice(vocab))
            elif w and p < len(w):
                w.pop(p) if r.random() < 0.5 else w.__setitem__(p, r.choice(vocab))
        text = r.choice([" ", ", ", " - "]).join(x.upper() if r.random() < 0.3 else x for x in w)
        rows.append((f"id{i:03d}", i % 2 == 0, r.choice(["h1", "h2", None, "", f"u{i}"]), text))
    rows += [("n1", None, "h1", "w1 w2"), (None, True, "h1", "w1"), ("e1", True, None, None), ("e2", False, None, "..."), rows[0]]
    df = spark.createDataFrame(rows, "id string, ev boolean, sha string, text string").withColumn("words", F.lit(1))
    got = [tuple(x) for x in overlap.overlaps(df, "id", "ev", ["sha"], F.col("text")).collect()]
    want = set()
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    for a in rows:
        for b in rows:
            if a[0] and b[0] and a[1] and b[1] is False:
                x, y = split(a[3]), split(b[3])
                if (a[2] and a[2] == b[2]) or (x and y and 100 * lcs(x, y) >= 85 * max(len(x), len(y))):
                    want.add((a[0], b[0]))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_overlaps_long_runs_in_blocks(spark, monkeypatch):
    # Seeds shared by many texts are dealt to several cells and lose no pair.
    monkeypatch.setattr(overlap, "BLOCK", 3)
    rows = [(f"i{i:02d}", i % 2 == 0, f"one two three four five six seven eight nine ten x{i}") for i in range(16)]
    df = spark.createDataFrame(rows, "id string, ev boolean, text string")
    assert overlap.overlaps(df, "id", "ev", [], F.col("text")).count() == 64


def test_overlaps_empty(spark):
    df = spark.createDataFrame([], "id string, ev boolean, sha string, text string")
    assert overlap.overlaps(df, "id", "ev", ["sha"], F.col("text")).count() == 0


RESIDUE = [
    "Dear {{ user_name }}, the report of ${month} is ready.", "Title: <CARD_TITLE>\nUnit: [UNIT]", "Covered months: <%= months %>.", "Rows: undefined", "Habitat: [object Object].",
    "[your station here] was visited by [team].", "This column holds ________ measured in ________ (fill in).", "TODO: write this section", "{% block a %}{% for r in rows %} {{r}} {% endfor %}{% endblock %}",
    "Lorem ipsum dolor sit amet elit sed tempor", "asdf asdf asdf asdf", "blah blah blah blah blah", "Real text.\n\nClick to edit this text.", "Bitte Text hier einfügen.", "Votre texte ici.", "Texto de ejemplo, por favor sustituir.",
    "404 Not Found", "<h1>Too\nmany requests.</h1>", "Access&nbsp;Denied. You don&#39;t have permission to access this resource.", "Sorry, something went wrong on our end.", "Seite nicht gefunden.", "Accès refusé.",
    "Traceback (most recent call last):\n  File \"a.py\", line 1", "Good text here about plots.\n\nYour session has expired.", "Please enable JavaScript to view this page.", "This viewer works only with scripts enabled.",
    "Station portal\nYour\nbrowser does not support scripting, or it has been switched off.", "We\xa0could\nnot&nbsp;reach the station service. Incident 9e6", "Code&nbsp;401 unauthorized", "Esta aplicación necesita scripts y cookies habilitados.", "Cette\napplication\nrequiert l'activation des scripts et des cookies.",
]
CLEAN = [
    None, "", " ", "The crew walked 404 metres and read 500 values.", "The client treats 502 Bad Gateway as temporary.", "The page that said \"Access denied.\" was removed.", "Our checker looks for strings like `{{ name }}` in cards.",
    "The context template names {{unit}} and {{curie}}; the renderer fills both.", "In the formula $p_{fit} = a s_{c}$ the slope was 2.", "If the viewer says that JavaScript must be enabled, the bundle was blocked; see the runbook.",
    "Environment variables such as %HOME_DIR% or $PLOT are read once.", "Reviewers found lorem ipsum in three drafts last year; all were rewritten.", "The list of open TODO items was cleared.", "The word undefined means that a class has no definition.",
    "An expired session ends the review; people sign in again.", "Sample text from the crews is coded twice, once per reader, and both codes are kept.", "{\"column\": {\"name\": \"unit\"}} is stored with sorted keys.",
]


def test_residue_cases(spark):
    texts = [*enumerate(RESIDUE), *enumerate(CLEAN, 1000)]
    df = spark.createDataFrame([*texts, texts[0], (None, RESIDUE[0])], "doc_id long, text string").withColumn("s", F.lit("x"))
    got = residue.residue(df, "doc_id", "text").collect()
    found = {r["doc_id"] for r in got}
    assert len(got) == len(found)
    assert [RESIDUE[i] for i in range(len(RESIDUE)) if i not in found] == []
    assert [CLEAN[i - 1000] for i in found if i >= 1000] == []


def test_residue_learns_page_templates(spark):
    page = "The archive gate is closed, error {}."
    rows = [(i, page.format(i)) for i in range(4)] + [(9, "A long and good text about beetles. It has many parts. It goes on.\nAnd on. And on.\n\n" + page.format(77)), (10, "Nothing to see."), (11, "x" * 100_000)]
    found = {r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert found == {0, 1, 2, 3, 9}


def test_residue_explanations_share_one_syntax(spark):
    rows = [(i, f"Write {{{{field{i}}}}} where the value goes, as before.") for i in range(10)] + [(20, "Write {{a}} where the value goes, as before."), (30, "Hello {name}, bye."), (31, "Hello ${name}, bye.")]
    found = {r["doc_id"] for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert found == {30, 31}


def test_residue_empty(spark):
    assert residue.residue(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
