"""Zones, frontmatter and sections."""

import json

import pytest
from pyspark.sql import functions as F

from inkfold.sources import zones

CASES = [
    ("---\nid: 1\n---\ntext\n---\n- source:: x\n", ("id: 1", "text", "- source:: x")),
    ("---\n---\na\n---\n- k:: v\n---\n\n---\n", ("", "a", "- k:: v")),
    ("---\n---\na\n---\nno reference", ("", "a\n---\nno reference", "")),
    ("---\n---\n```\n---\n- k:: v\n```\nb\r\n", ("", "```\n---\n- k:: v\n```\nb", "")),
    ("---\n---\n---\n- k:: v", ("", "", "- k:: v")),
    ("no frontmatter", (None, None, None)), ("", (None, None, None)), (None, (None, None, None)),
]


@pytest.mark.parametrize(("text", "parts"), CASES)
def test_zones(text, parts):
    assert zones.split_zones(text) == parts


def test_frontmatter():
    pytest.importorskip("yaml")
    ident, meta, error = zones.read_frontmatter("title: T\ndate: 2026-01-01\nok: true\nno: no\nn: 1.5\ntags: [a, b]", "x/20260101000000.md")
    assert (ident, error) == ("20260101000000", None)
    assert json.loads(meta) == {"title": "T", "date": "2026-01-01", "ok": True, "no": "no", "n": 1.5, "tags": ["a", "b"]}
    assert zones.read_frontmatter("id: 7", "x.md")[0] == "7"
    assert zones.read_frontmatter("", "x.md") == (None, "{}", None)
    for raw in (": invalid yaml [", "a: &x [1]\nb: *x", "k: " + "v" * zones.MOST_BYTES, "- 1", None):
        assert zones.read_frontmatter(raw, "x.md")[2]


def test_sections():
    assert zones.split_sections("pre\n# A #\ntext\n```\n# no\n```\n## B\n") == [("", 0, "pre"), ("A", 1, "text\n```\n# no\n```"), ("B", 2, "")]
    assert zones.split_sections("# A") == [("A", 1, "")]
    assert zones.split_sections("") == [] and zones.split_sections(None) is None


def test_columns(spark):
    pytest.importorskip("yaml")
    rows = spark.createDataFrame([(t, "d/20260101000000.md") for t, _ in CASES], "content string, path string").select(zones.zones(F.col("content")).alias("z"), "path")
    got = rows.select("z.*", zones.frontmatter(F.col("z.raw_frontmatter"), F.col("path")).alias("m"), zones.sections(F.col("z.body")).alias("s")).collect()
    assert [tuple(r)[:3] for r in got] == [p for _, p in CASES]
    assert got[0].m.id == "1" and got[0].s[0].level == 0 and got[-1].m.error and got[-1].s is None
