"""Typed tables: columns, declared types, zones, relations, inference and widening."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGER, REAL, BOOLEAN, TEXT = "INTEGER", "REAL", "BOOLEAN", "TEXT"

# Declared type names by stored type.
DECLARED = {
    INTEGER: {"INT", "INTEGER", "BIGINT", "SMALLINT"},
    REAL: {"REAL", "FLOAT", "DOUBLE"},
    BOOLEAN: {"BOOLEAN", "BOOL"},
}
SPARK_TYPE = {INTEGER: "bigint", REAL: "double", BOOLEAN: "boolean", TEXT: "string"}


def stored_type(declared: str) -> str:
    name = re.sub(r"\(.*", "", declared.strip()).upper()
    return next((kind for kind, names in DECLARED.items() if name in names), TEXT)


@dataclass(frozen=True)
class Column_:
    name: str
    declared: str = TEXT
    references: str | None = None
    required: bool = False
    zone: str | None = None
    boost: float = 1.0
    allowed: tuple[str, ...] = ()
    default: object = None
    on_delete: str = "NONE"

    @property
    def kind(self) -> str:
        return stored_type(self.declared)

    @property
    def effective_zone(self) -> str:
        if self.zone:
            return self.zone
        if self.references:
            return "Reference"
        name = self.declared.upper()
        size = re.search(r"\((\d+)\)", name)
        short = name.startswith(("CHAR", "TINYTEXT")) or name.startswith("VARCHAR") and (not size or int(size[1]) <= 255)
        return "Frontmatter" if self.kind != TEXT or short or self.allowed else "Body"


@dataclass(frozen=True)
class Relation:
    """From rows of one table to rows of another: links(own key, other key) as a junction frame's columns."""

    target: str
    junction: str
    own: str
    other: str


@dataclass
class Table:
    name: str
    key: str
    columns: dict[str, Column_]
    relations: dict[str, Relation] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    singleton: bool = False
    stale_after_days: int | None = None
    title_template: str | None = None
    search_key: str | None = None


@dataclass
class Catalog:
    tables: dict[str, Table]
    frames: dict[str, DataFrame]

    def frame(self, name: str) -> DataFrame:
        return self.frames[name]

    def junction(self, table: str, relation: Relation) -> DataFrame:
        """own_id, other_id of a relation; pairs may repeat, which semi and anti joins don't mind."""
        return self.frames[relation.junction].select(F.col(relation.own).alias("own_id"), F.col(relation.other).alias("other_id")).filter("own_id IS NOT NULL AND other_id IS NOT NULL")


def plural(name: str) -> str:
    """Plural of a type's name, by its ending alone; case is kept."""
    low = name.lower()
    if low.endswith(("s", "sh", "ch", "x", "z")):
        return name + "es"
    return name[:-1] + "ies" if low.endswith("y") and len(name) > 1 else name + "s"


def type_name(name: str) -> str:
    """Parts between hyphens, each with a capital letter, in one word."""
    return "".join(x[:1].upper() + x[1:] for x in name.split("-"))


def singular_field(column: str) -> str:
    """Name of the field that expands a reference column."""
    return column[:-3] if column.endswith("_id") and len(column) > 3 else column


def reverse_fields(tables: dict[str, Table]) -> dict[str, dict[str, Relation]]:
    """Fields from a referenced table back: plural of the referencing type, on collision {table}_{column}; none for self-references."""
    out: dict[str, dict[str, Relation]] = {t: {} for t in tables}
    for source in tables.values():
        for column, r in source.relations.items():
            if r.target == source.name:
                continue
            taken = {*tables[r.target].columns, *tables[r.target].relations, *out[r.target]}
            name = next((n for n in (plural(source.name), f"{source.name}_{column}") if n not in taken), None)
            if name:
                out[r.target][name] = Relation(source.name, r.junction, r.other, r.own)
    return out


def inferred_type(value: Column) -> Column:
    """Type that a text value seems to have."""
    return (
        F.when(value.rlike(r"^(true|false)$"), BOOLEAN)
        .when(value.rlike(r"^[+-]?[0-9]+$") & value.try_cast("bigint").isNotNull(), INTEGER)
        .when(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), REAL)
        .otherwise(TEXT)
    )


def inferred_schema(fields: DataFrame) -> DataFrame:
    """type, key, inferred of each key of each type; fields: type, key, value. One aggregation, whatever the number of documents."""
    kinds = fields.groupBy("type", "key").agg(F.collect_set(inferred_type(F.col("value"))).alias("kinds"))
    widened = F.when(F.size("kinds") == 1, F.col("kinds")[0]).when(F.size(F.array_except("kinds", F.array(F.lit(INTEGER), F.lit(REAL)))) == 0, REAL).otherwise(TEXT)
    return kinds.select("type", "key", widened.alias("inferred"))
