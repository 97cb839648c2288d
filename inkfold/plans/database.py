"""Typed tables that are written by SQL text: each statement is a function from one state to the next.

A state is a catalog and one DataFrame for each table (id, title, its columns, date, updated_at). Statements check
first and change then, so an error leaves the state as it was. Checks are queries over the whole batch and the stored rows;
only the first violation comes to the driver. Transactions keep the state from before; with a store, a commit
writes the parts that are new and swaps one manifest.

References are stored as ids joined by commas; the junction table {table}_{column} is read from them and can be written to.
"""

from __future__ import annotations

import copy
import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.functions.scalars import template_title
from inkfold.operators.closure import CascadeCycle, closure, cut_lineage, on_cycles
from inkfold.operators.merge import numbered, row_numbers
from inkfold.plans.catalog import BOOLEAN, INTEGER, REAL, SPARK_TYPE, TEXT, Catalog, Column_, Relation, Table
from inkfold.plans.statements import AlterTable, CreateTable, Delete, DropTable, Ignored, Insert, Query, StatementError, Transaction, Update, reload_needed, statements

# Columns that every table has, and those that writes may name without declaring them.
CORE = ("id", "title", "date", "updated_at")
RESERVED = ("id", "title", "type", "date", "created_at", "updated_at", "tags")


class ConstraintError(ValueError):
    """A write that breaks a constraint; code and context say which."""

    def __init__(self, code: str, message: str, **context):
        super().__init__(message)
        self.code, self.context = code, context


@dataclass
class Result:
    rows: DataFrame | None = None
    ids: list[str] = field(default_factory=list)
    count: int = 0
    message: str = ""

    @property
    def text(self) -> str:
        return self.message or ",".join(self.ids)


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def copy(self) -> State:
        return State(copy.deepcopy(self.tables), dict(self.frames))


def limit_of(c: Column_) -> int | None:
    found = re.fullmatch(r"(?:VAR)?CHAR\((\d+)\)", c.declared.upper())
    return int(found[1]) if found else None


def ids_in(value: Column) -> Column:
    """Ids of a reference value."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


class Database:
    def __init__(self, spark: SparkSession, store=None, clock: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.timezone.utc)):
        self.spark, self.store, self.clock = spark, store, clock
        self.state = store.load(spark) if store else State()
        self.saved: State | None = None
        self.last_id = 0

    # --- reading --------------------------------------------------------------------------------

    def table(self, name: str) -> Table:
        if name not in self.state.tables:
            raise StatementError(f"table not found: {name}")
        return self.state.tables[name]

    def junction_of(self, name: str) -> tuple[Table, Column_] | None:
        """The table and reference column of a junction's name."""
        for t in self.state.tables.values():
            for c in t.columns.values():
                if c.references and name == f"{t.name}_{c.name}":
                    return t, c
        return None

    def frame(self, name: str) -> DataFrame:
        if name in self.state.frames:
            return self.state.frames[name]
        found = self.junction_of(name)
        if not found:
            raise StatementError(f"table not found: {name}")
        t, c = found
        return self.state.frames[t.name].select(F.col("id").alias(f"{t.name}_id"), F.explode(ids_in(F.col(c.name))).alias(f"{c.name}_id")).distinct()

    def names(self) -> list[str]:
        return [*self.state.frames, *(f"{t.name}_{c.name}" for t in self.state.tables.values() for c in t.columns.values() if c.references)]

    def select(self, text: str) -> DataFrame:
        """Spark SQL over the tables: each table that the text names is put in front as a common table expression."""
        words = {w.lower() for w in re.findall(r"\w+", text)}
        used = [n for n in self.names() if n in words]
        head = [f"`{n}` AS (SELECT * FROM {{_{k}}})" for k, n in enumerate(used)]
        with_own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text, re.I)
        if with_own:
            text = f"WITH {with_own[1] or ''}{', '.join([*head, ''])}{text[with_own.end():]}"
        elif head:
            text = f"WITH {', '.join(head)} {text}"
        return self.spark.sql(text, **{f"_{k}": self.frame(n) for k, n in enumerate(used)})

    def catalog(self) -> Catalog:
        """Tables, relations and frames for typed filters and aggregates."""
        tables, frames = {}, dict(self.state.frames)
        for t in self.state.tables.values():
            relations = {}
            for c in t.columns.values():
                if c.references in self.state.tables:
                    junction = f"{t.name}_{c.name}"
                    frames[junction] = self.frame(junction)
                    relations[c.name.removesuffix("_id") if c.name.endswith("_id") else f"{c.name}_"] = Relation(c.references, junction, f"{t.name}_id", f"{c.name}_id")
            core = {n: Column_(n) for n in CORE}
            tables[t.name] = replace(t, columns={**core, **t.columns}, relations=relations)
        return Catalog(tables, frames)

    # --- statements -----------------------------------------------------------------------------

    def execute(self, text: str) -> Result:
        return self.execute_batch(text)[-1]

    def execute_batch(self, text: str) -> list[Result]:
        """All statements of a text; several are one transaction unless the text itself says where it begins and ends."""
        found = statements(text)
        if not found:
            raise StatementError("no statement")
        implicit = len(found) > 1 and self.saved is None and not any(isinstance(s, Transaction) for s in found)
        before = self.state.copy()
        if implicit:
            self.saved = before
        try:
            out = [self.run(s) for s in found]
        except Exception:
            if implicit:
                self.state, self.saved = before, None
            raise
        if implicit:
            self.saved = None
            self.commit()
        return out

    def run(self, s) -> Result:
        match s:
            case Query(text):
                return Result(self.select(text))
            case Transaction(what):
                return self.transaction(what)
            case Ignored(message):
                return Result(message=message)
        before = self.state
        self.state = before.copy()
        try:
            match s:
                case CreateTable():
                    out = self.create(s)
                case AlterTable():
                    out = self.alter(s)
                case DropTable():
                    out = self.drop(s)
                case Insert():
                    out = self.insert(s)
                case Update():
                    out = self.update(s)
                case Delete():
                    out = self.delete(s)
                case _:
                    raise StatementError("unknown statement")
        except Exception:
            self.state = before
            raise
        if self.saved is None:
            self.commit()
        if reload_needed(s):
            out.message = out.message or "reloaded"
        return out

    def transaction(self, what: str) -> Result:
        if what == "begin":
            if self.saved is not None:
                raise StatementError("a transaction is open already")
            self.saved = self.state.copy()
        elif self.saved is None:
            raise StatementError("no transaction is open")
        else:
            if what == "rollback":
                self.state = self.saved
            self.saved = None
            if what == "commit":
                self.commit()
        return Result(message=what)

    def commit(self) -> None:
        if self.store:
            self.state = self.store.save(self.spark, self.state)

    # --- tables ---------------------------------------------------------------------------------

    def empty(self, t: Table) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{n}` {SPARK_TYPE[kind]}" for n, kind in self.columns(t).items()))

    @staticmethod
    def columns(t: Table) -> dict[str, str]:
        """Stored columns of a table and their kinds."""
        return {"id": TEXT, "title": TEXT, **{c.name: c.kind for c in t.columns.values() if c.name not in CORE}, "date": TEXT, "updated_at": TEXT}

    def create(self, s: CreateTable) -> Result:
        if s.name in self.state.tables:
            if s.if_missing:
                return Result(message=f"table {s.name} already exists")
            raise StatementError(f"table already exists: {s.name}")
        if self.junction_of(s.name):
            raise StatementError(f"{s.name} is the name of a junction table")
        known = {c.name for c in s.columns} | set(RESERVED)
        for group in s.unique:
            for n in group:
                if n not in known:
                    raise StatementError(f"column not found: {n}")
        t = Table(s.name, "id", {c.name: c for c in s.columns}, unique=tuple(dict.fromkeys(s.unique)), singleton=s.singleton)
        self.state.tables[s.name], self.state.frames[s.name] = t, self.empty(t)
        if s.seed:
            self.write(t, self.spark.range(1).select(F.lit(0).alias("_pos")), [])
        return Result(message=f"table {s.name} created")

    def alter(self, s: AlterTable) -> Result:
        t, a = self.table(s.name), s.arguments
        frame = self.state.frames[s.name]

        def own(name: str) -> Column_:
            if name not in t.columns:
                raise StatementError(f"column not found: {name}")
            return t.columns[name]

        match s.what:
            case "add":
                c, uniques = a
                if c.name in t.columns:
                    raise StatementError(f"column already exists: {c.name}")
                t.columns[c.name], t.unique = c, (*t.unique, *uniques)
                if c.name not in CORE:
                    frame = frame.withColumn(c.name, F.lit(None).cast(SPARK_TYPE[c.kind]))
            case "drop":
                if a[0] not in t.columns and a[1]:
                    return Result(message=f"table {s.name} altered")
                own(a[0])
                del t.columns[a[0]]
                t.unique = tuple(g for g in t.unique if a[0] not in g)
                frame = frame if a[0] in CORE else frame.drop(a[0])
            case "rename column":
                old, new = a
                c = own(old)
                if new in t.columns or old in CORE or new in CORE:
                    raise StatementError(f"column already exists: {new}" if new in t.columns else f"cannot rename {old} to {new}: core column")
                t.columns = {new if n == old else n: replace(c, name=new) if n == old else x for n, x in t.columns.items()}
                t.unique = tuple(tuple(new if n == old else n for n in g) for g in t.unique)
                t.search_key = new if t.search_key == old else t.search_key
                if t.title_template:
                    t.title_template = re.sub(r"\{" + re.escape(old) + r"([.}])", lambda m: "{" + new + m[1], t.title_template)
                frame = frame.withColumnRenamed(old, new)
            case "rename to":
                new = a[0]
                if new in self.state.tables:
                    raise StatementError(f"table already exists: {new}")
                t.name = new
                self.state.tables = {new if n == s.name else n: x for n, x in self.state.tables.items()}
                self.state.frames = {new if n == s.name else n: x for n, x in self.state.frames.items()}
                for x in self.state.tables.values():
                    x.columns = {n: replace(c, references=new) if c.references == s.name else c for n, c in x.columns.items()}
                return Result(message=f"table {s.name} renamed to {new}")
            case "type":
                frame = self.alter_type(t, own(a[0]) if a[0] not in CORE else None, a[0], a[1], frame)
            case "zone":
                c = own(a[0])
                if c.references and a[1] != "Reference":
                    raise StatementError(f"cannot move {a[0]}: a REFERENCES column stays in the reference zone")
                t.columns[a[0]] = replace(c, zone=a[1])
            case "template":
                if a[0] is not None:
                    for name in re.findall(r"\{([^}]*)\}", a[0]):
                        parts = name.split(".")
                        if len(parts) > 2:
                            raise StatementError(f"title template: more than one hop: {name}")
                        if parts[0] not in t.columns and parts[0] not in RESERVED:
                            raise StatementError(f"column not found: {parts[0]}")
                        if len(parts) == 2 and not own(parts[0]).references:
                            raise StatementError(f"title template: {parts[0]} is no reference")
                t.title_template = a[0]
            case "search key":
                if a[0] is not None and a[0] not in CORE:
                    own(a[0])
                t.search_key = a[0]
            case "singleton":
                if a[0] and not t.singleton and frame.limit(2).count() > 1:
                    raise StatementError(f"cannot set SINGLETON on {s.name}: it holds more than one row")
                t.singleton = a[0]
                return Result(message=f"singleton {'set' if a[0] else 'dropped'} on {s.name}")
            case "add unique":
                for n in a[0]:
                    if n not in CORE:
                        own(n)
                if a[0] not in t.unique:
                    twice = frame.dropna(subset=list(a[0])).groupBy(*a[0]).count().filter("count > 1").orderBy(*a[0]).first()
                    if twice:
                        raise ConstraintError("UNIQUE_VIOLATION", f"cannot add UNIQUE({', '.join(a[0])}): rows repeat", table=s.name, columns=list(a[0]), values=[twice[n] for n in a[0]])
                    t.unique = (*t.unique, a[0])
            case "drop unique":
                t.unique = tuple(g for g in t.unique if g != a[0])
        self.state.frames[s.name] = frame
        return Result(message=f"table {s.name} altered")

    def alter_type(self, t: Table, c: Column_ | None, name: str, new: str, frame: DataFrame) -> DataFrame:
        """Wider text types change the catalog only; narrower ones and numbers are checked against all rows first."""
        if c is None:
            raise StatementError(f"cannot alter {t.name}.{name}: a core column")
        old = c.declared.upper()
        after = replace(c, declared=new)
        if old == new:
            return frame
        family = lambda x: re.sub(r"\(.*", "", x)
        short, was = limit_of(after), limit_of(c)
        text = {"CHAR", "VARCHAR", "TEXT"}
        wider = family(old) in text and (family(new) == "TEXT" or family(old) == family(new) and (short or 0) >= (was or 0))
        if c.references and not wider:
            raise StatementError(f"cannot alter {t.name}.{name}: a REFERENCES column can only become wider")
        if not wider:
            if {family(old), family(new)} == {"CHAR", "VARCHAR"} or BOOLEAN in (c.kind, after.kind):
                raise StatementError(f"cannot alter {t.name}.{name}: conversion from {old} to {new} is not supported")
            if family(old) in text and short:
                bad = frame.filter(F.length(name) > short).count()
                what = f"{bad} row(s) exceed {new}"
            elif {c.kind, after.kind} == {INTEGER, REAL}:
                bad = frame.filter(F.col(name) != F.floor(name)).count() if after.kind == INTEGER else 0
                what = f"{bad} row(s) are no {new}"
            else:
                raise StatementError(f"cannot alter {t.name}.{name}: conversion from {old} to {new} is not supported")
            if bad:
                raise StatementError(f"cannot alter {t.name}.{name}: {what}")
        t.columns[name] = after
        return frame.withColumn(name, F.col(name).cast(SPARK_TYPE[after.kind]))

    def drop(self, s: DropTable) -> Result:
        for name in s.names:
            if name not in self.state.tables:
                if s.if_there:
                    continue
                raise StatementError(f"table not found: {name}")
            frame = self.state.frames.pop(name)
            del self.state.tables[name]
            if not s.cascade:  # rows stay as documents without a type
                rest = frame.select("id", "title", "date", "updated_at")
                self.state.frames["untyped"] = self.state.frames["untyped"].unionByName(rest) if "untyped" in self.state.frames else rest
        return Result(message=f"dropped {len(s.names)} table(s)")

    # --- rows -----------------------------------------------------------------------------------

    def new_ids(self, n: int) -> list[str]:
        """Ids of 14 digits, a second apart, none given out before."""
        first = datetime.datetime.strptime(self.clock().strftime("%Y%m%d%H%M%S"), "%Y%m%d%H%M%S")
        if self.last_id:
            first = max(first, datetime.datetime.strptime(str(self.last_id), "%Y%m%d%H%M%S") + datetime.timedelta(seconds=1))
        out = [(first + datetime.timedelta(seconds=k)).strftime("%Y%m%d%H%M%S") for k in range(n)]
        self.last_id = int(out[-1]) if out else self.last_id
        return out

    def insert(self, s: Insert) -> Result:
        if s.table not in self.state.tables and (found := self.junction_of(s.table)):
            return self.junction_insert(s, *found)
        t = self.table(s.table)
        columns = s.columns or [c.name for c in t.columns.values()]
        for row in s.rows:
            if len(row) != len(columns):
                raise StatementError("column count doesn't match value count")
        self.check_names(t, columns)
        rows = self.values(columns, s.rows)
        return self.write(t, rows, columns, s.or_nothing)

    def values(self, columns: list[str], rows: list[list[str]]) -> DataFrame:
        """_pos and the columns as text, from expressions."""
        selects = [f"SELECT {k} AS _pos, " + ", ".join(f"CAST(({e}) AS STRING) AS `{c}`" for c, e in zip(columns, row, strict=True)) for k, row in enumerate(rows)]
        return self.select(" UNION ALL ".join(selects))

    def check_names(self, t: Table, columns: list[str]) -> None:
        for n in columns:
            if n not in t.columns and n not in RESERVED:
                raise ConstraintError("UNKNOWN_FIELD", f"unknown column: {t.name}.{n}", table=t.name, unknown_field=n)

    def insert_rows(self, table: str, rows: DataFrame, order: list[str], or_nothing: bool = False) -> Result:
        """A whole DataFrame at once, numbered in the given order; what INSERT does, without going through text. An id column is kept."""
        before, self.state = self.state, self.state.copy()
        t = self.table(table)
        self.check_names(t, rows.columns)
        columns = rows.columns
        try:
            out = self.write(t, row_numbers(rows, order, "_pos").select((F.col("_pos") - 1).alias("_pos"), *(F.col(c).cast("string").alias(c) for c in columns)), columns, or_nothing, bulk="id" in columns)
        except Exception:
            self.state = before
            raise
        if self.saved is None:
            self.commit()
        return out

    def write(self, t: Table, rows: DataFrame, columns: list[str], or_nothing: bool = False, bulk: bool = False) -> Result:
        """rows: _pos and columns as text. Skips stored rows, fills defaults, checks everything, then adds."""
        stored, existing = self.state.frames[t.name], {}
        if or_nothing:
            for group in t.unique:
                if set(group) <= set(columns):
                    keys = stored.select(F.col("id").alias("_old"), *(F.col(c).cast("string").alias(c) for c in group))
                    rows = rows.join(keys.groupBy(*group).agg(F.min("_old").alias("_old")), list(group), "left")
                    existing |= {r["_pos"]: r["_old"] for r in rows.filter("_old IS NOT NULL").select("_pos", "_old").collect()} if not bulk else {}
                    rows = rows.filter("_old IS NULL").drop("_old")
        rows = self.defaults(t, rows, columns)
        full = list(dict.fromkeys([*columns, *(c for c in rows.columns if c != "_pos")]))
        rows = cut_lineage(rows.select("_pos", *full))
        if t.singleton:
            n, old = rows.limit(2).count(), stored.agg(F.min("id")).first()[0]
            if n and old is not None and not or_nothing:
                raise ConstraintError("SINGLETON_VIOLATION", f"SINGLETON constraint violated: {t.name} already holds row {old}", table=t.name, existing_id=old)
            if n > 1 and old is None:
                raise ConstraintError("SINGLETON_VIOLATION", f"SINGLETON constraint violated: {t.name} already holds row <intra-batch>", table=t.name, existing_id="<intra-batch>")
        self.check(t, rows, set(full), True)
        if bulk:
            made, count = [], 0
        else:
            at = [r[0] for r in rows.select("_pos").orderBy("_pos").collect()]  # one for each row of the statement
            made = dict(zip(at, self.new_ids(len(at)), strict=True))
            rows = rows.join(F.broadcast(self.spark.createDataFrame(list(made.items()), "_pos int, _new string")), "_pos") if made else rows.withColumn("_new", F.lit(None).cast("string"))
            rows = rows.withColumn("id", F.col("_new")).drop("_new")
            count = len(at)
        made_of = self.typed_rows(t, rows)
        self.check_unique(t, made_of, stored)
        self.state.frames[t.name] = stored.unionByName(made_of)
        if bulk:
            return Result(message=f"rows added to {t.name}")
        slots = {**existing, **made}
        return Result(ids=[slots[k] for k in sorted(slots)], count=count)

    def defaults(self, t: Table, rows: DataFrame, columns: list[str]) -> DataFrame:
        stored = self.state.frames[t.name]
        for c in t.columns.values():
            if c.name in columns or c.default is None:
                continue
            partition = re.fullmatch(r"NEXT\((.*)\)", str(c.default))
            if c.default == "NEXT" or partition:
                by = partition[1] if partition else None
                have = stored.select(*([F.coalesce(F.col(by).cast("string"), F.lit("")).alias("_by")] if by else []), F.col(c.name))
                if by:
                    rows = rows.withColumn("_by", F.coalesce(F.col(by), F.lit("")) if by in rows.columns else F.lit(""))
                rows = numbered(rows, have, c.name, "_pos", "_by" if by else None).withColumn(c.name, F.col(c.name).cast("string")).drop("_by")
            else:
                rows = rows.withColumn(c.name, F.lit(str(c.default)))
        return rows

    def check(self, t: Table, rows: DataFrame, given: set[str], inserting: bool) -> None:
        """Raises the first violation, by row and then by kind: allowed values, references, nulls, types and lengths."""
        tests: list[tuple[Column, Column, str]] = []
        say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
        for c in t.columns.values():
            if c.name in given and c.allowed:
                v = F.col(c.name)
                tests.append((v.isNotNull() & (v != "") & ~v.isin(list(c.allowed)), say(f"column '{c.name}': value '", v, f"' not in allowed values {list(c.allowed)}"), "VALIDATION"))
        if inserting:
            for c in t.columns.values():
                if c.name in given and c.references in self.state.tables:
                    known = self.state.frames[c.references].select(F.col("id").alias(f"_ref_{c.name}"))
                    rows = rows.join(known, F.col(c.name) == F.col(f"_ref_{c.name}"), "left")
                    v = F.col(c.name)
                    tests.append((v.isNotNull() & (v != "") & F.col(f"_ref_{c.name}").isNull(), say(f"column '{c.name}': referenced id '", v, f"' not found in {c.references}"), "REFERENCES_VIOLATION"))
        for c in t.columns.values():
            missing = c.name not in given
            if c.required and (not missing or inserting) and not (missing and c.name == "title" and t.title_template):
                tests.append((F.lit(True) if missing else F.col(c.name).isNull(), F.lit(f"NOT NULL constraint violated: {t.name}.{c.name}"), "NOT_NULL_VIOLATION"))
        for c in t.columns.values():
            if c.name not in given:
                continue
            v, most = F.col(c.name), limit_of(c)
            bad = {
                INTEGER: ~v.rlike(r"^[+-]?[0-9]+$") | v.try_cast("bigint").isNull(), REAL: v.try_cast("double").isNull() | v.rlike(r"^\s|\s$|[dDfF]$"), BOOLEAN: ~v.isin("0", "1", "true", "false", "TRUE", "FALSE"),
            }.get(c.kind)
            if bad is not None:
                tests.append((v.isNotNull() & F.coalesce(bad, F.lit(False)), say(f"type mismatch for {t.name}.{c.name}: expected {c.kind}, got '", v, "'"), "VALIDATION"))
            elif most is not None:
                tests.append((F.length(v) > most, say(f"value too long for {t.name}.{c.name}: ", F.length(v).cast("string"), f" chars exceeds limit {most}"), "VALIDATION"))
        if not tests:
            return
        found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(k).alias("k"), message.alias("message"), F.lit(code).alias("code"))) for k, (bad, message, code) in enumerate(tests))))
        first = rows.select("_pos", F.element_at(F.when(F.size(found) > 0, found), 1).alias("v")).filter("v IS NOT NULL").orderBy("_pos").first()
        if first:
            raise ConstraintError(first.v.code, first.v.message, table=t.name)

    def typed_rows(self, t: Table, rows: DataFrame) -> DataFrame:
        """Stored form of checked rows: columns by kind, titles by template, dates from ids."""
        stored = self.columns(t)
        title = self.titles(t, rows)
        rows = title
        out = []
        for n, kind in stored.items():
            if n == "date":
                plain = F.concat_ws("-", F.substring("id", 1, 4), F.substring("id", 5, 2), F.substring("id", 7, 2))
                out.append((F.coalesce("date", plain) if "date" in rows.columns else plain).alias("date"))
            elif n == "updated_at":
                out.append((F.col("updated_at") if "updated_at" in rows.columns else F.lit(self.clock().strftime("%Y-%m-%dT%H:%M:%SZ"))).alias("updated_at"))
            elif n not in rows.columns:
                out.append(F.lit(None).cast(SPARK_TYPE[kind]).alias(n))
            elif kind == BOOLEAN:
                out.append(F.lower(F.col(n).cast("string")).isin("1", "true").alias(n))
            else:
                value = F.col(n).try_cast(SPARK_TYPE[kind])
                c = t.columns.get(n)
                out.append((F.nullif(value, F.lit("")) if c is not None and c.references else value).alias(n))
        return rows.select(*out)

    def titles(self, t: Table, rows: DataFrame) -> DataFrame:
        """rows with a title: the given one, else the template's, else table and id. {ref.field} looks one reference up."""
        if "title" in rows.columns:
            return rows
        fallback = F.concat_ws(" ", F.lit(t.name), "id")
        if not t.title_template:
            return rows.withColumn("title", fallback)
        values = {n: F.col(n) for n in rows.columns if n != "_pos"}
        extra = []
        for name in re.findall(r"\{([^}]*\.[^}]*)\}", t.title_template):
            column, other = name.split(".")
            c = t.columns[column]
            if column in rows.columns and c.references in self.state.frames and other in self.state.frames[c.references].columns:
                alias = f"_{column}_{other}"
                target = self.state.frames[c.references].select(F.col("id").alias(f"{alias}_id"), F.col(other).cast("string").alias(alias))
                rows = rows.join(target, F.element_at(F.concat(ids_in(F.col(column)), F.array(F.lit(""))), 1) == F.col(f"{alias}_id"), "left")
                values[name] = F.col(alias)
                extra += [alias, f"{alias}_id"]
        return rows.withColumn("title", template_title(t.title_template, values, F.lit(t.name), F.col("id"))).drop(*extra)

    def check_unique(self, t: Table, fresh: DataFrame, stored: DataFrame) -> None:
        for group in t.unique:
            keys = fresh.select(*group, F.lit(1).alias("_new")).dropna(subset=list(group))
            old = stored.select(*group, F.lit(0).alias("_new")).join(keys.select(*group).distinct(), list(group), "left_semi")
            twice = keys.unionByName(old).groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1").orderBy(*group).first()
            if twice:
                values = [twice[c] for c in group]
                raise ConstraintError("UNIQUE_VIOLATION", f"UNIQUE constraint violated: {t.name}({', '.join(group)}) = ({', '.join(map(str, values))})", table=t.name, columns=list(group), values=values)

    def matching(self, t: Table, where: str | None, more: str = "") -> DataFrame:
        """id of rows that the condition holds for, with further select expressions."""
        return self.select(f"SELECT id{more} FROM {t.name}" + (f" WHERE {where}" if where else ""))

    def update(self, s: Update) -> Result:
        t = self.table(s.table)
        self.check_names(t, list(s.values))
        if "id" in s.values:
            raise StatementError("id can't be changed")
        new = "".join(f", CAST(({e}) AS STRING) AS `_new_{c}`" for c, e in s.values.items())
        changed = cut_lineage(self.matching(t, s.where, new))
        as_given = changed.select(F.hash("id").alias("_pos"), "id", *(F.col(f"_new_{c}").alias(c) for c in s.values))
        self.check(t, as_given, set(s.values), False)
        stored = self.state.frames[s.table]
        old = stored.join(changed, "id")
        body = next((c.name for c in t.columns.values() if c.effective_zone == "Body" and c.name not in CORE), None)
        values = {c: F.col(f"_new_{c}") for c in s.values if c in self.columns(t)}
        rows = old.select("id", *(values.get(n, F.col(n).cast("string")).alias(n) for n in self.columns(t) if n not in ("id", "updated_at") and not (n == "title" and t.title_template and "title" not in values)))
        if body in s.values and not t.title_template and "title" not in s.values:
            rows = rows.withColumn("title", F.coalesce(F.col(body), F.lit("")))
        rows = self.typed_rows(t, rows)
        rest = stored.join(changed, "id", "left_anti")
        self.check_unique(t, rows, rest)
        self.state.frames[s.table] = rest.unionByName(rows)
        return Result(count=changed.count())

    # --- deletes --------------------------------------------------------------------------------

    def reference_edges(self, wanted: Callable[[Column_], bool]) -> DataFrame | None:
        """child, parent, table, column of every reference of the columns that are wanted; nodes are ids."""
        parts = [
            self.state.frames[t.name].select(F.col("id").alias("child"), F.explode(ids_in(F.col(c.name))).alias("parent"), F.lit(t.name).alias("table"), F.lit(c.name).alias("column"))
            for t in self.state.tables.values() for c in t.columns.values() if c.references and wanted(c)
        ]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def delete(self, s: Delete) -> Result:
        if s.table not in self.state.tables and (found := self.junction_of(s.table)):
            return self.junction_delete(s, *found)
        t = self.table(s.table)
        roots = cut_lineage(self.matching(t, s.where))
        count = roots.count()
        self.remove(roots)
        return Result(count=count)

    def remove(self, roots: DataFrame) -> None:
        """The rows and what cascades from them go, unless a cycle or a RESTRICT is on the way; other references to them are cut."""
        cascading = self.reference_edges(lambda c: c.on_delete == "CASCADE")
        gone = roots
        if cascading is not None:
            cascading = cascading.filter("child IS NOT NULL")
            gone = closure(cascading.select("child", "parent"), roots)
            looped = on_cycles(cascading.select("child", "parent"), gone)
            some = cascading.join(looped.select(F.col("id").alias("child")), "child", "left_semi").join(looped.select(F.col("id").alias("parent")), "parent", "left_semi")
            tables = [r.table for r in some.select("table").distinct().orderBy("table").collect()]  # at most one for each table
            if tables:
                raise CascadeCycle(f"cascade delete would form a cycle through {', '.join([*tables, tables[0]])}")
        blocking = self.reference_edges(lambda c: c.required and c.on_delete == "RESTRICT")
        if blocking is not None:
            first = blocking.join(gone.select(F.col("id").alias("parent")), "parent", "left_semi").orderBy("table", "column", "child").first()
            if first:
                raise ConstraintError("REFERENCES_VIOLATION", f"cannot delete {first.parent}: {first.table}.{first.column} of {first.child} refers to it", table=first.table, column=first.column, referencing_id=first.child)
        ids = gone.select("id")
        for t in self.state.tables.values():
            frame = self.state.frames[t.name].join(ids, "id", "left_anti")
            for c in t.columns.values():
                if c.references:
                    frame = self.without(frame, c.name, ids)
            self.state.frames[t.name] = frame

    @staticmethod
    def without(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        """frame without the ids in the references of a column."""
        cut = frame.select("id", F.posexplode(ids_in(F.col(column))).alias("_at", "_ref")).join(ids.select(F.col("id").alias("_ref")), "_ref", "left_semi")
        hit = cut.groupBy("id").agg(F.collect_set("_ref").alias("_gone"))
        kept = F.array_join(F.filter(ids_in(F.col(column)), lambda x: ~F.array_contains(F.col("_gone"), x)), ",")
        return frame.join(hit, "id", "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)).otherwise(F.nullif(kept, F.lit("")))).drop("_gone")

    # --- junctions ------------------------------------------------------------------------------

    def junction_insert(self, s: Insert, t: Table, c: Column_) -> Result:
        wanted = [f"{t.name}_id", f"{c.name}_id"]
        if sorted(s.columns or wanted) != sorted(wanted):
            raise StatementError(f"{s.table} has the columns {', '.join(wanted)}")
        rows = cut_lineage(self.values(s.columns or wanted, s.rows))
        for own, target in ((wanted[0], t.name), (wanted[1], c.references)):
            lost = rows.join(self.state.frames[target].select(F.col("id").alias(own)), own, "left_anti").select(own).first() if target in self.state.frames else None
            if lost:
                raise ConstraintError("REFERENCES_VIOLATION", f"{s.table}: id '{lost[0]}' not found in {target}", table=s.table)
        more = rows.groupBy(F.col(wanted[0]).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col(wanted[1]).alias("v")))), lambda x: x["v"]).alias("_more"))
        frame = self.state.frames[t.name].join(more, "id", "left")
        joined = F.array_distinct(F.concat(F.coalesce(ids_in(F.col(c.name)), F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>"))))
        self.state.frames[t.name] = frame.withColumn(c.name, F.when(F.col("_more").isNull(), F.col(c.name)).otherwise(F.array_join(joined, ","))).drop("_more").select(*self.columns(t))
        return Result(count=rows.count())

    def junction_delete(self, s: Delete, t: Table, c: Column_) -> Result:
        found = {}
        for part in re.split(r"\s+AND\s+", s.where or "", flags=re.I):
            m = re.fullmatch(r"\s*[\"`]?(\w+)[\"`]?\s*=\s*'([^']*)'\s*", part)
            if m:
                found[m[1].lower()] = m[2]
        if set(found) != {f"{t.name}_id", f"{c.name}_id"}:
            raise StatementError(f"DELETE FROM {s.table} needs {t.name}_id = '...' AND {c.name}_id = '...'")
        own, target = found[f"{t.name}_id"], found[f"{c.name}_id"]
        hit = (F.col("id") == own) & F.array_contains(ids_in(F.col(c.name)), target)
        frame = self.state.frames[t.name]
        count = frame.filter(hit).count()
        kept = F.array_join(F.filter(ids_in(F.col(c.name)), lambda x: x != target), ",")
        self.state.frames[t.name] = frame.withColumn(c.name, F.when(hit, F.nullif(kept, F.lit(""))).otherwise(F.col(c.name)))
        return Result(count=count)

    # --- services -------------------------------------------------------------------------------

    def upsert_singleton(self, table: str, values: dict[str, object]) -> tuple[str, str]:
        """(id, "created" or "updated") of the one row of a singleton table."""
        t = self.table(table)
        if not t.singleton:
            raise StatementError(f"{table} is no SINGLETON")
        old = self.state.frames[table].agg(F.min("id")).first()[0]
        quoted = {k: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for k, v in values.items()}
        if old is None:
            return self.run(Insert(table, list(quoted), [list(quoted.values())])).ids[0], "created"
        self.run(Update(table, quoted, f"id = '{old}'"))
        return old, "updated"

    def update_rows(self, table: str, rows: DataFrame) -> Result:
        """Many rows at once: id and new values (null: unset). Ids that repeat or aren't there are errors; checks cover the whole batch."""
        before, self.state = self.state, self.state.copy()
        try:
            t, stored = self.table(table), self.state.frames[table]
            self.check_names(t, rows.columns)
            twice = rows.groupBy("id").count().filter("count > 1").orderBy("id").first()
            if twice:
                raise ConstraintError("VALIDATION", f"id repeats in the batch: {twice.id}", table=table)
            lost = rows.join(stored.select("id"), "id", "left_anti").orderBy("id").first()
            if lost:
                raise ConstraintError("NOT_FOUND", f"no such row: {lost.id}", table=table)
            given = [c for c in rows.columns if c != "id"]
            text = rows.select("id", *(F.col(c).cast("string").alias(c) for c in given))
            nth = F.row_number().over(Window.partitionBy("id").orderBy("id"))
            self.check(t, text.withColumn("_pos", nth), set(given), False)
            both = stored.drop(*given).join(text, "id")
            fresh = self.typed_rows(t, both.drop("updated_at"))
            rest = stored.join(text, "id", "left_anti")
            self.check_unique(t, fresh, rest)
            self.state.frames[table] = rest.unionByName(fresh)
            count = text.count()
        except Exception:
            self.state = before
            raise
        if self.saved is None:
            self.commit()
        return Result(count=count)
