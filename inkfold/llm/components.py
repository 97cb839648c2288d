"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import materialize

LEAST_HUB = 1000
HUBS = 1 << 17
BLOCK = 2_000_000


def hub_size(n_rows: int) -> int:
    """Rows from which on a key counts as hot; there can be no more than HUBS such keys, however many rows there are."""
    return max(LEAST_HUB, n_rows // HUBS)


def look_up(rows: DataFrame, table: DataFrame, on: list[str], n_rows: int, most: int) -> DataFrame:
    """Inner join of rows with a table of one row for each key, whose n says how many of n_rows rows have it; most: the greatest n.
    Hot keys are looked up in a broadcast table (of HUBS rows at most), so their rows stay where they are."""
    hub = hub_size(n_rows)
    if most < hub:
        return rows.join(table.drop("n"), on)
    values = [c for c in table.columns if c not in (*on, "n")]
    hot = F.broadcast(table.filter(F.col("n") >= hub).select(*on, F.struct(*values).alias("_hot")))
    marked = rows.join(hot, on, "left")
    near = marked.filter("_hot IS NOT NULL").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in values))
    far = marked.filter("_hot IS NULL").select(*rows.columns).join(table.filter(F.col("n") < hub).drop("n"), on)
    return near.unionByName(far)


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges but the least ones of their components, and these least ones."""
    nodes, number = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = number[: len(u)], number[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        one, two = root[a], root[b]
        np.minimum.at(low, one, two)
        np.minimum.at(low, two, one)
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            break
        root = low
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u > v) that connect what the given ones connect, with the components of each block of a partition's edges made stars. Nothing is shuffled."""

    def run(batches):
        held, n = [], 0

        def stars():
            u, v = local_roots(*(np.concatenate([h[k] for h in held]) for k in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("u", "v")])
            n += len(batch)
            if n >= BLOCK:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges: a, b (long). Returns node, root of every node with an edge; root is the component's least node.

    Edges are contracted where they lie, before they are shuffled. Rounds of stars go on until every node but the roots has one neighbour, a lesser one; their number
    grows with the logarithm of the nodes. Each is written to the shared folder, which cuts the lineage. An empty table has no components."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    while True:
        edges = materialize(contracted(edges).distinct(), name)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        mark = least.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count_if(F.expr("m < u AND n > 1")).alias("open")).first()
        if not mark.open:
            return least.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        large = look_up(both, least, ["u"], mark.n, mark.most).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = look_up(large, low, ["u"], mark.n, mark.most)
        edges = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
