"""Stems of the published examples, stemmed search, and consistency fixes."""

import pytest
from pyspark.sql import functions as F

from inkfold.functions.stemming import stem
from inkfold.operators import fixers
from inkfold.plans import search

STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop",
    "falling": "fall", "fizzed": "fizz", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "vietnamization": "vietnam", "hopefulness": "hope", "triplicate": "triplic",
    "goodness": "good", "adoption": "adopt", "replacement": "replac", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "is": "is", "été": "été", "": "",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stem(word):
    assert stem(word) == STEMS[word]


def test_stemmed_search(spark):
    docs = spark.createDataFrame([("1", "Relational things", None), ("2", "x", "it relates"), ("3", None, "nothing"), ("4", "", "")], "id string, title string, body string")
    assert {r.id for r in search.search(docs, "relating", {}, stemming=True).collect()} == {"1", "2"}
    assert {r.id for r in search.search(docs, "relating", {}).collect()} == set()
    assert {r.id for r in search.search(docs, '"relational thing"', {}, stemming=True).collect()} == {"1"}


def test_fixes(spark):
    schema = "id string, path string, title string, type string, tags array<string>, meta map<string,string>, inline_keys array<string>, h1 string"
    rows = [
        ("1", "docs/20240101000000-my_note.md", "Good", "note", ["a", "b"], {"due": "x"}, ["other"], "Good"), ("2", "docs/20240101000000-my_note.md", None, None, None, None, None, None),
        ("3", "x.md", "Kept", "note", ["#z", "Z", "a"], {}, ["title"], "Else"), ("4", "x.md", "t ", "_typedef", [], {"origin": "manual"}, [], None), ("5", "x.md", "", "note", [], {}, [], "Head"),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = {}
    for r in fixers.fixes(docs).collect():
        got.setdefault(r.id, []).append((r.fix, r.detail))
    assert got == {
        "2": [("default", "type=note"), ("title_derived", "My note")],
        "3": [("cross_zone", "title"), ("tags_hash", "#z"), ("tags_dedup", "Z"), ("tags_sort", ""), ("h1_aligned", "Else")],
        "4": [("manual_typedef", "t ")],
        "5": [("title_derived", "Head")],
    }
    right = docs.select("id", fixers.fixed_tags(F.col("tags")).alias("tags"), fixers.fixed_title(F.col("title"), F.col("h1"), F.col("path")).alias("title"))
    assert {r.id: (r.tags, r.title) for r in right.collect()} == {"1": (["a", "b"], "Good"), "2": (None, "My note"), "3": (["a", "z"], "Kept"), "4": ([], "T"), "5": ([], "Head")}
    assert fixers.fixes(docs.limit(0)).count() == 0


def test_applied(spark):
    rows = [("1", "docs/20240101000000-my_note.md", " good", None, ["#b", "a", "B"], {"dueDate": "x", "name": "N"}, ["name", "other"], None), ("2", "docs/20240101000000-my_note.md", None, "book", None, {"name": "N"}, None, None)]
    docs = spark.createDataFrame(rows, "id string, path string, title string, type string, tags array<string>, meta map<string,string>, inline_keys array<string>, h1 string")
    assert {r.id: r.detail for r in fixers.template_fixes(docs, {"book": "{name} {none}"}).collect()} == {"2": "N"}
    got = {r.id: r for r in fixers.applied(docs, {"kind": "k", "other": "o"}, {"book": "{name} {none}"}).collect()}
    assert (got["1"].title, got["1"].type, got["1"].tags, got["1"].meta, got["1"].inline_keys) == ("Good", "note", ["a", "b"], {"due-date": "x", "name": "N", "kind": "k"}, ["other"])
    assert (got["2"].title, got["2"].type, got["2"].tags, got["2"].meta) == ("N", "book", [], {"name": "N", "kind": "k", "other": "o"})
    assert fixers.fixes(fixers.applied(docs)).filter("fix NOT IN ('h1_aligned')").count() == 0, "what was put right needs no fix"
