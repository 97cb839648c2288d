"""A folder of document files, its index tables, and the typed tables made of them.

Files are read as whole texts; parsing that depends on the lines before (zones, YAML, sections) is done in Arrow batches, all else in Column
expressions. A file that can't be read is a warning and has no row in any table.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.plans.catalog import BOOLEAN, INTEGER, REAL, SPARK_TYPE, TEXT, Column_, Table, inferred_schema
from inkfold.sources import documents as parse
from inkfold.sources import zones
from inkfold.sources.store import Folder

# The order in which frontmatter is written; the keys that are columns of their own; folders without documents.
FIRST_KEYS = ("id", "title", "date", "tags", "type", "publish", "processed")
CORE_KEYS = ("id", "title", "date", "tags", "type")
PLAIN = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_ ./-]*")
NOT_TYPES = ("_typedef", "_conflicts")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (under the folder), content of every .md file below it; Spark passes over folders whose names begin with _ unless they are named."""
    paths = [folder, *(f"{folder.rstrip('/')}/{n}" for n in Folder(spark, folder).names() if n.startswith("_") and not n.endswith(".md"))]
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(paths, wholetext=True)
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    name = F.regexp_replace(F.expr("_metadata.file_path"), "^[a-z0-9]+:/*", "/")
    return rows.select(F.regexp_replace(name, "^" + re.escape(root) + "/*", "").alias("path"), F.col("value").alias("content"))


@dataclass
class Tables:
    """Index tables of a corpus."""

    docs: DataFrame
    tags: DataFrame
    fields: DataFrame
    links: DataFrame
    aliases: DataFrame
    attachments: DataFrame
    checkboxes: DataFrame
    sections: DataFrame
    warnings: DataFrame


def flat(value, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of all leaves: a.b[0].c, with \\, . and [ escaped in names. Null is an empty text."""
    if isinstance(value, dict):
        return [x for k, v in sorted(value.items()) for x in flat(v, (path + "." if path else "") + re.sub(r"([\\.\[])", r"\\\1", str(k)))]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in flat(v, f"{path}[{k}]")]
    if isinstance(value, bool):
        return [(path, "true" if value else "false")]
    if isinstance(value, float) and value.is_integer():
        return [(path, str(int(value)))]
    return [(path, "" if value is None else str(value))]


def _flat(meta: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [{"key": k, "value": v} for k, v in flat({k: v for k, v in json.loads(x).items() if k not in CORE_KEYS})] for x in meta], dtype=object)


def flat_fields(meta: Column) -> Column:
    """key, value of all leaves of a JSON map but the core keys."""
    return F.pandas_udf(_flat, "array<struct<key:string,value:string>>")(meta)


def parsed(files: DataFrame) -> DataFrame:
    """path, content, raw_frontmatter, body, reference_section, id, meta (JSON), error of each file."""
    split = files.withColumn("z", zones.zones(F.col("content")))
    read = split.select("path", "content", "z.*").withColumn("m", zones.frontmatter(F.col("raw_frontmatter"), F.col("path")))
    return read.select("path", "content", "raw_frontmatter", "body", "reference_section", "m.id", "m.meta", "m.error")


def index_tables(files: DataFrame, keep=lambda df: df.persist()) -> Tables:
    """All index tables of files with path and content; parsing is done once, and `keep` holds its result (a table that is written, or cached)."""
    rows = keep(parsed(files))
    bad = rows.filter("error IS NOT NULL").select("path", F.lit("unreadable").alias("kind"), F.col("error").alias("detail"))
    good = rows.filter("error IS NULL AND id IS NOT NULL")
    lost = rows.filter("error IS NULL AND id IS NULL").select("path", F.lit("no id").alias("kind"), F.lit("neither frontmatter nor file name has an id").alias("detail"))
    get = lambda key: F.get_json_object("meta", f"$.{key}")
    docs = good.select("id", get("title").alias("title"), get("date").alias("date"), get("type").alias("type"), "path", "body", F.from_json(get("tags"), "array<string>").alias("tags"), "meta", "raw_frontmatter", "reference_section")
    front = good.select(F.col("id").alias("document_id"), F.explode(flat_fields(F.col("meta"))).alias("f")).select("document_id", "f.key", "f.value", F.lit("Frontmatter").alias("zone"))
    fields = front.unionByName(parse.field_table(docs))
    crossed = parse.cross_zone_keys(fields).join(docs.select(F.col("id").alias("document_id"), "path"), "document_id").select("path", F.lit("cross-zone").alias("kind"), F.concat_ws(": ", "key", F.array_join("zones", ", ")).alias("detail"))
    sections = docs.select(F.col("id").alias("document_id"), F.explode(zones.sections(F.col("body"))).alias("s")).select("document_id", "s.*")
    return Tables(docs, parse.tag_table(docs.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))), fields, parse.link_table(docs), parse.alias_table(docs), parse.attachment_table(docs), parse.checkbox_table(docs), sections, bad.unionByName(lost).unionByName(crossed))


# --- typed tables -----------------------------------------------------------------------------


def read_typedefs(docs: DataFrame) -> dict[str, Table]:
    """Tables that documents of type _typedef declare: their title is the name; columns, unique, singleton, ... stand in the frontmatter."""
    out = {}
    for r in docs.filter("type = '_typedef'").select("title", "meta").orderBy("id").collect():  # the catalog
        spec = json.loads(r.meta)
        columns = {}
        for c in spec.get("columns") or []:
            c = dict(c)
            kind = str(c.get("data_type") or c.get("type") or TEXT)
            zone = str(c["zone"]).capitalize() if c.get("zone") else None
            columns[c["name"].lower()] = Column_(c["name"].lower(), kind, references=c.get("references"), required=bool(c.get("required")), zone=zone, boost=float(c.get("search_boost") or 1), allowed=tuple(c.get("allowed_values") or ()), default=c.get("default_value"), on_delete=str(c.get("on_delete") or "NONE").upper())
        name = str(spec.get("table_name") or r.title).lower()
        out[name] = Table(name, "id", columns, unique=tuple(tuple(g) for g in spec.get("unique_together") or ()), singleton=bool(spec.get("singleton")), stale_after_days=spec.get("stale_after_days"), title_template=spec.get("title_template"), search_key=spec.get("search_key"))
    return out


def column_values(tables: Tables) -> DataFrame:
    """id, type, key, value, zone: everything that can be the value of a typed column, by its lower-case name."""
    typed = tables.docs.filter(F.col("type").isNotNull() & ~F.col("type").isin(*NOT_TYPES)).select("id", F.lower("type").alias("type"))
    front = tables.fields.filter("zone <> 'Body'").select(F.col("document_id").alias("id"), F.lower("key").alias("key"), "value", "zone")
    body = tables.sections.filter("level > 0").groupBy(F.col("document_id").alias("id"), F.lower("heading").alias("key")).agg(F.first("content").alias("value")).withColumn("zone", F.lit("Body"))
    both = front.unionByName(body.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")))
    return both.join(typed, "id").filter("value IS NOT NULL AND value <> ''")


def table_schemas(tables: Tables) -> dict[str, Table]:
    """Declared tables, each with the columns that its documents have beside; types without a declaration have inferred columns only.
    Inference is one aggregation; only names and types of columns come to the driver."""
    known = read_typedefs(tables.docs)
    values = column_values(tables).filter(~F.col("key").isin("aliases", "attachments", *CORE_KEYS) & ~F.col("key").rlike(r"[.\[]"))
    found = inferred_schema(values.select("type", "key", "value", "zone"))
    zone = values.groupBy("type", "key").agg(F.min(F.struct(F.expr("CASE zone WHEN 'Frontmatter' THEN 0 WHEN 'Reference' THEN 1 ELSE 2 END").alias("o"), "zone"))["zone"].alias("zone"))
    out = dict(known)
    for r in found.join(zone, ["type", "key"]).orderBy("type", "key").collect():
        t = out.get(r.type) or Table(r.type, "id", {})
        if r.key not in t.columns:
            out[r.type] = replace(t, columns={**t.columns, r.key: Column_(r.key, r.inferred, zone=r.zone)})
    return {n: t for n, t in out.items() if t.columns}


def zone_of(c: Column_) -> str:
    return c.zone or ("Reference" if c.references else "Frontmatter" if c.kind in (INTEGER, REAL, BOOLEAN) else "Body")


def typed_table(tables: Tables, t: Table) -> DataFrame:
    """id, title, columns, date of all documents of a type, by one pivot over the column values; an empty value is null."""
    rows = tables.docs.filter(F.lower("type") == t.name).select("id", "title", "date")
    wanted = {c.name: zone_of(c) for c in t.columns.values() if c.name not in CORE_KEYS}
    value = F.when(F.lit(False), None)
    for name, zone in wanted.items():
        value = value.when((F.col("key") == name) & (F.col("zone") == zone), F.col("value"))
    cells = column_values(tables).filter(F.col("type") == t.name).withColumn("_v", value).filter("_v IS NOT NULL")
    wide = cells.groupBy("id").pivot("key", list(wanted)).agg(F.first("_v")) if wanted else rows.select("id")
    text = {n: F.col(f"`{n}`") for n in wanted}
    typed = [(F.lower(text[n]).isin("true", "1", "yes") if t.columns[n].kind == BOOLEAN else text[n].try_cast(SPARK_TYPE[t.columns[n].kind])).alias(n) for n in wanted]
    return rows.join(wide, "id", "left").select("id", "title", *typed, "date")


def materialized(tables: Tables) -> tuple[dict[str, Table], dict[str, DataFrame]]:
    """The catalog and a frame for each typed table."""
    schemas = table_schemas(tables)
    return schemas, {n: typed_table(tables, t) for n, t in schemas.items()}


def missing_required(schemas: dict[str, Table], frames: dict[str, DataFrame]) -> DataFrame | None:
    """table, id, column of required values that are not there."""
    out = None
    for n, t in schemas.items():
        names = [c.name for c in t.columns.values() if c.required and c.name in frames[n].columns]
        if names:
            gone = frames[n].select(F.lit(n).alias("table"), "id", F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in names)))).alias("column"))
            out = gone if out is None else out.unionByName(gone)
    return out


def rebuild(spark: SparkSession, folder: str, path: str, strict: bool = False) -> dict[str, int]:
    """Reads all files and writes every index table and typed table under path; strict: a file that can't be read stops it before anything is replaced.
    Returns rows by table; the fingerprint of the files is kept to tell later whether the tables are fresh."""
    files = read_files(spark, folder)
    tables = index_tables(files)
    if strict:
        first = tables.warnings.filter("kind = 'unreadable'").orderBy("path").first()
        if first:
            raise ValueError(f"{first.path}: {first.detail}")
    schemas, frames = materialized(tables)
    named = {k: v for k, v in vars(tables).items() if isinstance(v, DataFrame)} | {f"table_{n}": f for n, f in frames.items()} | {"fingerprint": fingerprint(files)}
    for name, df in named.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}").count() for name in named}


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: number of files and a sum of hashes of their paths and contents, whatever their order."""
    return files.agg(F.count("*").alias("files"), F.sum(F.xxhash64("path", "content").cast("decimal(38,0)")).alias("hashes"))


def is_fresh(spark: SparkSession, folder: str, path: str) -> bool:
    try:
        old = spark.read.parquet(f"{path}/fingerprint")
    except Exception as e:  # not built yet
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return old.exceptAll(fingerprint(read_files(spark, folder))).isEmpty()


# --- writing ----------------------------------------------------------------------------------


def scalar_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    text = "" if value is None else str(value)
    special = not PLAIN.fullmatch(text) or text.strip() != text or text.lower() in ("true", "false", "null", "yes", "no", "on", "off") or re.fullmatch(r"[\d.+-][\d._eE+-]*", text)
    return json.dumps(text, ensure_ascii=False) if special else text


def yaml_lines(value, indent: int) -> list[str]:
    pad = "  " * indent
    if isinstance(value, dict):
        return [y for k, v in sorted(value.items()) for y in entry(str(k), v, indent)]
    return [y for v in value for y in ([f"{pad}- {scalar_text(v)}"] if not isinstance(v, (dict, list)) else [f"{pad}-", *yaml_lines(v, indent + 1)])]


def entry(key: str, value, indent: int = 0) -> list[str]:
    pad = "  " * indent
    if isinstance(value, (dict, list)):
        return [f"{pad}{key}:", *yaml_lines(value, indent + 1)] if value else [f"{pad}{key}: {'{}' if isinstance(value, dict) else '[]'}"]
    return [f"{pad}{key}: {scalar_text(value)}"]


def file_text(meta: str | None, body: str | None, references: str | None) -> str:
    """The file of a document: known keys first, in their order, then the others by name; body as it is; references after a border."""
    found = json.loads(meta or "{}")
    keys = [k for k in FIRST_KEYS if k in found and found[k] not in (None, [])] + sorted(k for k in found if k not in FIRST_KEYS)
    front = [y for k in keys for y in ([f"{k}: {found[k]}"] if k in ("id", "date") else entry(k, found[k], 0))]
    out = "\n".join(["---", *front, "---", ""]) + (body or "")
    return out + ("\n---\n" + references if references else "")


@cache
def file_column():
    def made(meta: pd.Series, body: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([file_text(*x) for x in zip(meta, body, references, strict=True)], dtype=object)

    return F.pandas_udf(made, "string")


def serialized(meta: Column, body: Column, references: Column) -> Column:
    return file_column()(meta, body, references)
