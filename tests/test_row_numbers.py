"""Rows that are numbered keep all rows, however tables are dealt out, and queries that number rows say what their SQL says."""

import duckdb
import pytest

from inkfold.operators import merge
from inkfold.workload_engine import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def small_partitions(spark, monkeypatch):
    """Adaptive execution joins partitions of one table in other ways where fewer columns are read; and there are several ranges."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(merge, "ROWS_PER_RANGE", 500, raising=False)
    yield
    for k in conf:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_all_rows_are_numbered(spark):
    rows = spark.range(20000).selectExpr("id % 7 AS a", "nullif(cast(id AS string), '70') AS b", "repeat(cast(id AS string), 20) AS wide")
    got = [(r.n, r.a, r.b) for r in merge.row_numbers(rows, ["a", "b"], "n").orderBy("n").collect()]
    keys = sorted(((k % 7, "" if k == 70 else str(k)) for k in range(20000)))
    assert got == [(n, a, b or None) for n, (a, b) in enumerate(keys, 1)]


def test_few_rows_are_numbered(spark):
    rows = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert sorted((r.n, r.k) for r in merge.row_numbers(rows, ["k"], "n").collect()) == [(1, None), (2, "a"), (3, "b")]
    assert merge.row_numbers(rows.limit(0), ["k"], "n").collect() == []


@pytest.mark.parametrize("name", [
    "DML_03_next_per_partition",
    "DML_10_delete_cascade",
    "DML_14_junction",
    "DML_17_batch_update",
    "DDL_02_05_alter",
    "DDL_08_drop",
    "DML_01_insert",
    "DML_02_on_conflict",
    "DML_09_update",
    "DML_16_transactions",
])
def test_same_rows_in_small_partitions(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(map(str, r)) for r in df.collect())
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})")
    assert got == sorted(tuple(map(str, r)) for r in found.fetchall())
