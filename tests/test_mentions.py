"""Mentions of titles that many documents share."""

import pytest

from inkfold.operators import graph
from inkfold.plans import index as inverted


@pytest.fixture(scope="module")
def shared(spark):
    """200 documents titled "Of the", every other one of which holds it in its text too; one of another title, one without words."""
    rows = [(str(k), "Of the", "one of the words") for k in range(200)] + [("x", "Lone fox", "of, the"), ("y", "--", "of a the lone wolf"), ("z", "Fox", "a lone fox")]
    docs = spark.createDataFrame(rows, "id string, title string, body string").selectExpr("*", "concat('docs/', id, '.md') AS path")
    tags, fields = spark.createDataFrame([], "document_id string, tag string"), spark.createDataFrame([], "document_id string, key string, value string")
    return inverted.Index(inverted.postings(inverted.index_texts(docs, tags, fields)), None, 203, 1.0, docs, tags, fields)


@pytest.fixture(scope="module")
def tables(spark):
    links = spark.createDataFrame([("x", "7"), ("x", "docs/7.md"), ("3", "alias"), ("4", "4"), ("y", "9")], "source_id string, target string")
    return links, spark.createDataFrame([("5", "alias")], "document_id string, alias string")


def test_counts_make_no_pairs(shared, tables, monkeypatch):
    expected = {str(k): 200 for k in range(200)} | {"7": 199, "5": 199, "x": 1, "z": 1}
    pairs = graph.mentions(shared, *tables).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in pairs} == expected

    def made(*_):
        raise AssertionError("pairs of titles and documents are made, which grow with the square of titles alike")

    monkeypatch.setattr(graph, "mentions", made)
    assert {r.id: r.mentions for r in graph.mention_counts(shared, *tables).collect()} == expected


def test_titles_alike_are_one_phrase(shared):
    _, hits = graph.phrases(shared)
    assert {r.phrase: r["count"] for r in hits.groupBy("phrase").count().collect()} == {"of the": 201, "lone fox": 2, "fox": 2}
