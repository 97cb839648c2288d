"""Deterministic three-way merging and constraint checks as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_list(base: Column, ours: Column, theirs: Column) -> Column:
    """What neither side removed, in the base's order, then what either side added, sorted."""
    kept = F.filter(base, lambda v: F.array_contains(ours, v) & F.array_contains(theirs, v))
    return F.concat(kept, F.array_sort(F.array_except(F.array_union(ours, theirs), base)))


def merged_references(base: Column, ours: Column, theirs: Column) -> Column:
    return F.array_sort(F.array_distinct(merged_list(base, ours, theirs)))


def merged_scalar(base: Column, ours: Column, theirs: Column, our_actor: Column | None = None, their_actor: Column | None = None) -> Column:
    """The side that changed; if both did, the side whose actor (a hash of its content) is greater, or the greater value where none is given."""
    both = F.greatest(ours, theirs) if our_actor is None else F.when(our_actor >= their_actor, ours).otherwise(theirs)
    return F.when(ours.eqNullSafe(base), theirs).when(theirs.eqNullSafe(base) | ours.eqNullSafe(theirs), ours).otherwise(both)


def merged_log(ours: Column, theirs: Column) -> Column:
    """Entries of both logs; entries alike but for their state count once, ours first; stable order by date."""
    def text(entry: Column) -> Column:
        return F.regexp_replace(entry, r"^\s*- \[[ xi]\]\s*", "")
    seen = F.transform(ours, text)
    both = F.concat(ours, F.filter(theirs, lambda e: ~F.array_contains(seen, text(e))))
    ordered = F.array_sort(F.transform(both, lambda e, i: F.struct(F.regexp_extract(e, r"(\d{4}-\d{2}-\d{2})", 1).alias("d"), i.alias("i"), e.alias("e"))))
    return F.transform(ordered, lambda x: x["e"])


def conflict_class(base: Column, ours: Column, theirs: Column, binary: Column) -> Column:
    return F.when(binary, "binary").when(base.isNotNull() & (ours.isNull() | theirs.isNull()), "delete_edit").when(base.isNull(), "add_add").otherwise("normal")


def singleton_sweep(rows: DataFrame, kind: str, clock: list[str], key: str) -> DataFrame:
    """Every row with its fate: of each type the row with the highest clock stays, the rest is set aside."""
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(*(F.desc(c) for c in [*clock, key])))
    return rows.withColumn("fate", F.when(nth == 1, "keep").otherwise("quarantine"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of rows that break a unique constraint; rows with a null never do."""
    return rows.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


# Rows of a range and ranges that rows are numbered in, about and at most, and keys that each range's bounds are taken from.
ROWS_PER_RANGE, MOST_RANGES, KEYS_PER_RANGE = 10_000, 256, 16


def range_of(rows: DataFrame, order: list[str]) -> Column:
    """Number of the range that a row's key lies in, by bounds that are values in the plan: whatever runs the plan again, in whatever partitions, finds
    the row in the same range. Bounds come from the keys whose hashes are least; how small these are tells how many rows there are, about."""
    most = MOST_RANGES * KEYS_PER_RANGE
    least = rows.select(*order, F.xxhash64(*order).alias("_hash")).orderBy("_hash").limit(most)
    keys = least.orderBy(*order).collect()  # 4096 at most
    greatest = max((k["_hash"] for k in keys), default=0)
    about = len(keys) if len(keys) < most else most * 2**64 / (greatest + 2**63 + 1)
    ranges = max(1, min(MOST_RANGES, round(about / ROWS_PER_RANGE)))
    kinds = {c: rows.schema[c].dataType for c in order}
    bounds = [F.struct(*(F.lit(keys[k * len(keys) // ranges][c]).cast(kinds[c]).alias(c) for c in order)) for k in range(1, ranges)]
    key = F.struct(*order)

    def found(low: int, high: int) -> Column:
        middle = (low + high + 1) // 2
        return F.lit(low) if low == high else F.when(key < bounds[middle - 1], found(low, middle - 1)).otherwise(found(middle, high))

    return found(0, ranges - 1)


def row_numbers(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """rows with numbers from 1 in an order that tells all of them apart: sorted ranges are numbered side by side, and each range
    goes on where those before it have ended. One row for each range meets in one task, nothing else."""
    parts = rows.withColumn("_part", range_of(rows, order))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_size")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_nth", nth).join(F.broadcast(before), "_part").withColumn(column, (F.col("_before") + F.col("_nth"))).drop("_part", "_nth", "_before")


def numbered(rows: DataFrame, existing: DataFrame, column: str, order: str, partition: str | None = None) -> DataFrame:
    """rows with the next numbers after the greatest existing one (of their partition)."""
    by = [partition] if partition else []
    highest = existing.groupBy(*by).agg(F.max(column).alias("_max"))
    if partition:
        joined = rows.join(highest, partition, "left").withColumn("_n", F.row_number().over(Window.partitionBy(partition).orderBy(order)))
    else:
        joined = row_numbers(rows, [order], "_n").join(F.broadcast(highest))  # one row
    return joined.withColumn(column, F.coalesce("_max", F.lit(0)) + F.col("_n")).drop("_max", "_n")


def insert_or_nothing(rows: DataFrame, existing: DataFrame, unique: list[str], order: str) -> DataFrame:
    """rows that collide with no stored row and no earlier row of the batch."""
    nth = F.row_number().over(Window.partitionBy(*unique).orderBy(order))
    fresh = rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return fresh.join(existing.select(*unique), unique, "left_anti")


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, error for each failed check of each row."""
    errors = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items())))
    return rows.select(key, F.explode(errors).alias("error"))
