"""Typed filters, relation quantifiers, ordering, paging and aggregates, compiled to DataFrame plans.

Relation conditions at the top level become semi and anti joins; inside _or they become a left join
with the distinct ids that match, so every condition stays an equi-join.
"""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.plans.catalog import BOOLEAN, INTEGER, REAL, Catalog, Relation, Table, reverse_fields

MAX_DEPTH = 5
MANY = {"in", "notIn", "nin"}
# Operators of each kind of column.
OPERATORS = {
    "text": {"eq", "neq", "contains", "startsWith", "in", "notIn", "nin", "isNull"},
    "number": {"eq", "neq", "gt", "gte", "lt", "lte", "in", "notIn", "nin", "isNull"},
    "boolean": {"eq", "notIn", "nin", "isNull"},
    "id": {"eq", "in", "notIn", "nin", "isNull"},
}
TAGS = "_tags"  # frame with document_id, tag
QUANTIFIERS = ("some", "none", "every")


class FilterError(ValueError):
    """A filter that the engine rejects."""


def like(column: Column, before: str, value: str, after: str) -> Column:
    """LIKE without regard to the case of ASCII letters; % and _ of the value stay wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(column, upper, lower).like(before + value.translate(str.maketrans(upper, lower)) + after)


def condition(column: Column, op: str, value) -> Column:
    if op in MANY and not isinstance(value, (list, tuple)):
        return F.lit(True)
    return {
        "eq": lambda: column == value,
        "neq": lambda: column != value,
        "gt": lambda: column > value,
        "gte": lambda: column >= value,
        "lt": lambda: column < value,
        "lte": lambda: column <= value,
        "contains": lambda: like(column, "%", value, "%"),
        "startsWith": lambda: like(column, "", value, "%"),
        "in": lambda: column.isin(list(value)) if value else F.lit(False),
        "notIn": lambda: ~column.isin(list(value)) if value else F.lit(True),
        "nin": lambda: ~column.isin(list(value)) if value else F.lit(True),
        "isNull": lambda: column.isNull() if value else column.isNotNull(),
    }[op]()


class Compiler:
    def __init__(self, catalog: Catalog, strict: bool = False):
        self.catalog, self.strict, self.flags = catalog, strict, itertools.count()
        self.reverse = reverse_fields(catalog.tables)

    def relation(self, table: Table, name: str) -> Relation | None:
        return table.relations.get(name) or self.reverse[table.name].get(name)

    def filtered(self, table: Table, where: dict, depth: int = 0) -> DataFrame:
        df = self.catalog.frame(table.name)
        columns = df.columns
        df, keep = self.compile(df, table, where, depth)
        return (df.filter(keep) if keep is not None else df).select(columns)

    def compile(self, df: DataFrame, table: Table, where: dict, depth: int, joined: bool = True) -> tuple[DataFrame, Column | None]:
        """df with what the condition needs, and the condition. joined: relation conditions may drop rows at once."""
        if depth > MAX_DEPTH:
            raise FilterError(f"relation filter nested too deep (max {MAX_DEPTH})")
        parts: list[Column] = []
        for name, spec in where.items():
            if name in ("_and", "_or"):
                items = []
                for item in spec:
                    df, c = self.compile(df, table, item, depth, joined and name == "_and")
                    items += [c] if c is not None else []
                if items:
                    parts.append(functools.reduce(operator.and_ if name == "_and" else operator.or_, items))
            elif name in table.columns and not (isinstance(spec, dict) and set(spec) & set(QUANTIFIERS)):
                parts += self.column(table, name, spec)
            elif name == "tags" and TAGS in self.catalog.frames and name not in table.relations:
                for ids in self.tagged(spec):
                    df, c = self.matched(df, table, ids, True, joined)
                    parts += [c] if c is not None else []
            elif r := self.relation(table, name):
                quantified = {q: spec[q] for q in QUANTIFIERS if q in spec}
                inlined = {k: v for k, v in spec.items() if k not in QUANTIFIERS}
                for q, sub in [*quantified.items(), *(("some", {k: v}) for k, v in inlined.items())]:
                    df, c = self.quantified(df, table, r, q, sub, depth, joined)
                    parts += [c] if c is not None else []
            elif self.strict:
                raise FilterError(f"unknown field: {table.name}.{name}")
        return df, functools.reduce(operator.and_, parts) if parts else None

    def tagged(self, spec: dict) -> list[DataFrame]:
        """Ids (_match) for each operator of a tag filter; one frame for each tag that all of is asked for."""
        if not set(spec) & {"contains", "containsAll", "containsAny"}:
            raise FilterError("a tag filter needs contains, containsAll or containsAny")
        tags = self.catalog.frames[TAGS]
        with_any = lambda values: tags.filter(F.col("tag").isin(values)).select(F.col("document_id").alias("_match"))
        out = []
        for op in ("containsAll", "containsAny"):
            if op in spec and not spec[op]:
                raise FilterError(f"tags.{op} must not be empty")
        if "contains" in spec:
            out.append(with_any([spec["contains"]]))
        if "containsAll" in spec:
            wanted = sorted({*spec["containsAll"]})
            out.append(tags.filter(F.col("tag").isin(wanted)).groupBy(F.col("document_id").alias("_match")).agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(wanted)).select("_match"))
        if "containsAny" in spec:
            out.append(with_any(list(spec["containsAny"])))
        return out

    def column(self, table: Table, name: str, spec: dict) -> list[Column]:
        c = table.columns[name]
        kind = "id" if name == table.key else "number" if c.kind in (INTEGER, REAL) else "boolean" if c.kind == BOOLEAN else "text"
        for op in spec:
            if op not in OPERATORS[kind]:
                raise FilterError(f"operator {op} does not apply to {kind} column {table.name}.{name}")
        return [condition(F.col(name), op, v) for op, v in spec.items()]

    def quantified(self, df: DataFrame, table: Table, r: Relation, quantifier: str, sub: dict, depth: int, joined: bool) -> tuple[DataFrame, Column | None]:
        links, target = self.catalog.junction(table.name, r), self.catalog.tables[r.target]
        if not sub and quantifier == "every":
            return df, None
        if sub:
            if quantifier == "every":  # rows that violate it; a condition that is null violates nothing
                inner, c = self.compile(self.catalog.frame(r.target), target, sub, depth + 1, joined=False)
                matched = inner.filter(F.coalesce(~c, F.lit(False))) if c is not None else inner.filter(F.lit(False))
            else:
                matched = self.filtered(target, sub, depth + 1)
            links = links.join(matched.select(F.col(target.key).alias("other_id")), "other_id", "left_semi")
        return self.matched(df, table, links.select(F.col("own_id").alias("_match")), quantifier == "some", joined)

    def matched(self, df: DataFrame, table: Table, ids: DataFrame, has: bool, joined: bool) -> tuple[DataFrame, Column | None]:
        """Rows whose key is (not) among the ids: at once by a semi or anti join, else by a flag from a left join with the distinct ids."""
        if joined:
            return df.join(ids, F.col(table.key) == F.col("_match"), "left_semi" if has else "left_anti"), None
        ids = ids.distinct()
        flag = f"_flag{next(self.flags)}"
        df = df.join(ids.select(F.col("_match").alias(f"{flag}_id"), F.lit(True).alias(flag)), F.col(table.key) == F.col(f"{flag}_id"), "left")
        found = F.coalesce(F.col(flag), F.lit(False))
        return df, found if has else ~found


def ordering(table: Table, order: list[tuple[str, str]], strict: bool = True) -> list[Column]:
    """Keys in the order given; the table's key last, in the direction of the last key."""
    keys = []
    for name, way in order:
        if name in table.columns:
            keys.append((name, way.upper()))
        elif strict:
            raise FilterError(f"unknown order key: {table.name}.{name}")
    if not keys:
        keys = [(table.key, "DESC")]
    elif table.key not in [k for k, _ in keys]:
        keys.append((table.key, keys[-1][1]))
    return [F.col(k).desc_nulls_last() if way == "DESC" else F.col(k).asc_nulls_first() for k, way in keys]


def page(df: DataFrame, limit: int | None, offset: int | None, most: int = 10_000) -> DataFrame:
    if limit is not None and not 0 <= limit <= most:
        raise FilterError(f"limit must be between 0 and {most}")
    if offset is not None and offset < 0:
        raise FilterError("offset must be 0 or more")
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def typed_list(catalog: Catalog, table: str, where: dict | None = None, order: list[tuple[str, str]] = (), limit: int | None = None, offset: int | None = None, distinct: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of a typed table; fields and order keys that it doesn't have are ignored, or are errors if strict."""
    t = catalog.tables[table]
    df = Compiler(catalog, strict).filtered(t, where or {})
    keys = ordering(t, list(order), strict)
    if distinct:
        df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(distinct).orderBy(*keys))).filter("_nth = 1").drop("_nth")
    return page(df.orderBy(*keys), limit, offset)


def typed_aggregate(catalog: Catalog, table: str, where: dict | None = None, group: str | None = None, distinct: str | None = None, strict: bool = False) -> DataFrame:
    """count, and min, max, sum, avg of every number column; with group: one row for each key, null too."""
    t = catalog.tables[table]
    df = Compiler(catalog, strict).filtered(t, where or {})
    numbers = [c.name for c in t.columns.values() if c.kind in (INTEGER, REAL) and c.name != t.key]
    total = F.count_distinct(distinct) if distinct else F.count("*")
    aggregates = [total.alias("count"), *(f(c).alias(f"{n}_{c}") for c in numbers for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("avg", F.avg)))]
    return df.groupBy(F.col(group).alias("key")).agg(*aggregates) if group else df.agg(*aggregates)
