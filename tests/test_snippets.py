"""Snippets of search results."""

from pyspark.sql import functions as F

from inkfold.functions.snippets import cut_snippet, snippet


def test_cut():
    text = "one two, Three four five six."
    assert cut_snippet(text, frozenset({"three"})) == "one two, <b>Three</b> four five six."
    assert cut_snippet(text, frozenset({"three", "five"}), 3) == "...<b>Three</b> four <b>five</b>..."
    assert cut_snippet(text, frozenset({"six"}), 2) == "...five <b>six</b>."
    assert cut_snippet(text, frozenset({"none"}), 2) == "one two..."
    assert cut_snippet("a a a b", frozenset({"a", "b"}), 2) == "...<b>a</b> <b>b</b>"
    assert cut_snippet("", frozenset({"a"})) == cut_snippet(None, frozenset({"a"})) == ""
    assert cut_snippet(" .. ", frozenset({"a"})) == " .. "


def test_column(spark):
    rows = spark.createDataFrame([("x Y z",), (None,), ("",)], "t string").select(snippet(F.col("t"), ["y"]).alias("s")).collect()
    assert [r.s for r in rows] == ["x <b>Y</b> z", "", ""]
