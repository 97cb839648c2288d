"""Search language, filter errors, parsing, merging and streaming."""

import pytest
from pyspark.sql import functions as F

from inkfold.operators import merge
from inkfold.plans import search
from inkfold.plans.catalog import Column_, plural
from inkfold.plans.where import FilterError, typed_list
from inkfold.sources import documents as parse
from inkfold.streaming.changes import subscribe
from inkfold.workload import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("text", "same"), [("b AND a", "a and b"), ("(a OR b) AND c", "(a or b) and c"), ("a  b", "a and b"), ("NOT tag=x A", "a and not tag=x"), ('"two words"', '"two words"'), ("a or", "a or"), ('"and" b', '"and" and b'), ("a OR b c", "a or b and c")])
def test_normalized(text, same):
    assert search.normalized(text) == same
    assert search.normalized(search.normalized(text)) == search.normalized(text)


def test_filter_errors(spark):
    c = catalog(spark, SF)
    for where in ({"c_acctbal": {"contains": "1"}}, {"c_custkey": {"gt": 1}}, {"c_name": {"gt": 1}}):
        with pytest.raises(FilterError):
            typed_list(c, "customer", where)
    deep: dict = {"r_name": {"eq": "ASIA"}}
    for k in range(8):
        deep = {("nations" if k % 2 else "region"): {"some": deep}}
    with pytest.raises(FilterError, match="too deep"):
        typed_list(c, "region", deep)
    with pytest.raises(FilterError):
        typed_list(c, "customer", limit=10_001)


def test_parsing(spark):
    body = "#a and #b/c `#no`\n```\n#code\n```\n[[#d]] x#e"
    row = spark.createDataFrame([(body,)], "b string").select(parse.body_tags(F.col("b")).alias("t")).first()
    assert row.t == ["a", "b/c"]


def test_merging(spark):
    row = spark.sql("SELECT array('a','b','c') a, array('a','c','z') o, array('b','c','y') t, array('- [ ] 2024-02-01 - x', '- [x] 2024-01-01 - y') l1, array('- [x] 2024-02-01 - x', '- [ ] 2024-01-15 - z') l2")
    got = row.select(merge.merged_list(F.col("a"), F.col("o"), F.col("t")).alias("m"), merge.merged_log(F.col("l1"), F.col("l2")).alias("l")).first()
    assert got.m == ["c", "y", "z"]
    assert got.l == ["- [x] 2024-01-01 - y", "- [ ] 2024-01-15 - z", "- [ ] 2024-02-01 - x"]


def test_catalog():
    assert [plural(x) for x in ("category", "box", "note", "orders", "day")] == ["categories", "boxes", "notes", "orderses", "daies"]
    assert [Column_("x", d).effective_zone for d in ("INT", "VARCHAR(100)", "VARCHAR(300)", "TEXT")] == ["Frontmatter", "Frontmatter", "Body", "Body"]


def test_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("updated")
    columns = {"kind": kind, "document_id": F.col("event_id"), "document_type": F.col("event_type"), "timestamp": F.col("ts")}
    q = subscribe(spark, str(tmp_path / "in"), columns, kind="deleted").writeStream.format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("gone").count() == spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'error'").count()
