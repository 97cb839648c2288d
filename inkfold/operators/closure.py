"""Closures over edge tables: everything that goes with given roots, and cycles on the way. Frontiers are joined level by
level until none is left; each level is checkpointed by the caller's `cut`, so plans stay short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CascadeCycle(ValueError):
    """A cascade that comes back to where it was."""

    code = "CASCADE_CYCLE"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session names a folder for them, else a persisted table."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) and df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist()


def closure(edges: DataFrame, roots: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """id of the roots and all that hangs on them, each once. edges: child, parent; roots: id. Null ids go with nothing."""
    edges = edges.filter("child IS NOT NULL AND parent IS NOT NULL").distinct()
    found = frontier = cut(roots.select("id").filter("id IS NOT NULL").distinct())
    while not frontier.isEmpty():
        level = frontier.join(edges, frontier.id == edges.parent).select(F.col("child").alias("id")).distinct()
        frontier = cut(level.join(found, "id", "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


def on_cycles(edges: DataFrame, nodes: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Nodes of a closure that lie on a cycle or lead to one: those without children are peeled off until none is left to peel."""
    edges = edges.join(nodes.select(F.col("id").alias("child")), "child", "left_semi").join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()
    left = cut(nodes.select("id").distinct())
    while True:
        inner = edges.join(left.select(F.col("id").alias("child")), "child", "left_semi")
        stay = cut(left.join(inner.select(F.col("parent").alias("id")), "id", "left_semi"))
        if stay.count() == left.count():
            return stay
        left = stay


def walk_down(parents: DataFrame, most: int | None = None, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """id, depth, path (array of ids, root first) of every node under a root of id -> parent (null at roots), up to `most` levels.
    Nodes that no root leads to, as in cycles, have no row."""
    text = F.col("id").cast("string")
    level = cut(parents.filter("parent IS NULL").select("id", F.lit(0).alias("depth"), F.array(text).alias("path")).distinct())
    found, depth = level, 0
    while not level.isEmpty() and (most is None or depth + 1 < most):
        depth += 1
        up = level.select(F.col("id").alias("parent"), "path")
        level = cut(parents.filter("parent IS NOT NULL").join(up, "parent").select("id", F.lit(depth).alias("depth"), F.concat("path", F.array(text)).alias("path")))
        found = found.unionByName(level)
    return found
