"""Consistency fixes of documents: what is wrong with each, and the tags and title put right. Column expressions only.

docs: id, path, title, type, tags (array), meta (map of the other frontmatter keys), inline_keys (array: keys of inline fields), h1 (the
first heading of level 1, null if none). Null title, type, tags or map: as if missing. Every document stands by itself, so nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.scalars import kebab_case, template_title, title_from_path

FIX = "array<struct<fix:string,severity:string,detail:string>>"


def unmarked(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.regexp_replace(t, "^#", ""))


def fixed_tags(tags: Column) -> Column:
    """Without the mark, each once whatever its case (the first spelling stays), sorted regardless of case."""
    plain = unmarked(tags)
    low = F.transform(plain, F.lower)
    first = F.filter(plain, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    pairs = F.array_sort(F.transform(first, lambda t: F.struct(F.lower(t).alias("k"), t.alias("t"))))
    return F.transform(pairs, lambda p: p["t"])


def fixed_title(title: Column, h1: Column, path: Column) -> Column:
    """Trimmed and with a capital; without a title the first heading, else the name of the file."""
    text = F.trim(title)
    capital = F.concat(F.upper(text.substr(1, 1)), text.substr(F.lit(2), F.length(text)))
    return F.when(F.coalesce(title, F.lit("")) == "", F.coalesce(h1, title_from_path(path))).otherwise(capital)


def found(when: Column, fix: str, severity: str, detail: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(F.lit(fix).alias("fix"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")))).otherwise(F.array().cast(FIX))


def each(items: Column, fix: str, severity: str) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(fix).alias("fix"), F.lit(severity).alias("severity"), x.cast("string").alias("detail")))


def fixes(docs: DataFrame, required: dict[str, str] | None = None) -> DataFrame:
    """id, fix, severity, detail of every fix that a document needs. required: default value by key that must be there."""
    title, h1, kind = F.coalesce("title", F.lit("")), F.col("h1"), F.coalesce("type", F.lit(""))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    low = F.transform(unmarked(tags), F.lower)
    once = F.array_distinct(low)
    own = F.coalesce(F.map_keys("meta"), F.array().cast("array<string>"))
    inline = F.coalesce("inline_keys", F.array().cast("array<string>"))
    core = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("title", "type", "id")), F.when(F.size(tags) > 0, F.lit("tags"))))
    keys = F.array_union(own, core)
    again = F.filter(tags, lambda t, i: F.array_position(low, F.lower(F.regexp_replace(t, "^#", ""))) <= i)
    titled, typedef, text = title != "", kind == "_typedef", F.trim(title)
    derived = F.coalesce(h1, title_from_path(F.col("path")))
    parts = [
        each(F.filter(inline, lambda k: F.array_contains(keys, k)), "cross_zone", "error"),
        found(kind == "", "default", "warning", F.lit("type=note")),
        *(found(~F.array_contains(F.array_union(keys, inline), k), "default", "warning", F.lit(f"{k}={v}")) for k, v in (required or {}).items()),
        found(~typedef & ~titled & (derived != ""), "title_derived", "warning", derived),
        found(F.exists(tags, lambda t: t.startswith("#")), "tags_hash", "info", F.array_join(F.filter(tags, lambda t: t.startswith("#")), ",")),
        found(F.size(again) > 0, "tags_dedup", "info", F.array_join(again, ",")),
        found(~once.eqNullSafe(F.array_sort(once)), "tags_sort", "info", F.lit("")),
        found(~typedef & titled & (title != text), "title_trimmed", "info", text),
        found(~typedef & titled & text.rlike(r"^\p{Ll}"), "title_capital", "info", text),
        found(~typedef & titled & (h1 != text), "h1_aligned", "info", h1),
        each(F.filter(own, lambda k: kebab_case(k) != k), "key_kebab", "info"),
        found(typedef & (F.try_element_at("meta", F.lit("origin")) == "manual"), "manual_typedef", "info", F.coalesce("title", F.lit("unknown"))),
    ]
    return docs.select("id", F.inline(F.concat(*parts)))


def rendered_title(templates: dict[str, str]) -> Column:
    """The title that a document's type asks for, from its frontmatter; null for types without a template."""
    out = F.lit(None).cast("string")
    for kind, template in templates.items():
        values = {n: F.try_element_at("meta", F.lit(n)) for n in re.findall(r"\{([^}]*)\}", template)}
        out = F.when(F.col("type") == kind, template_title(template, values, F.lit(kind), F.col("id"))).otherwise(out)
    return out


def template_fixes(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """id, fix, severity, detail of documents whose title is not what the template of their type makes of them."""
    want = rendered_title(templates)
    wrong = docs.select("id", "title", want.alias("want")).filter("want IS NOT NULL AND NOT title <=> want")
    return wrong.select("id", F.lit("title_template").alias("fix"), F.lit("warning").alias("severity"), F.col("want").alias("detail"))


def applied(docs: DataFrame, required: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """docs with all fixes made: type, tags, title, keys in kebab case (of two that become one the first stays), required defaults, and inline keys
    only where the frontmatter doesn't hold them."""
    typedef = F.coalesce(F.col("type") == "_typedef", F.lit(False))
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    entries = F.transform(F.map_entries(meta), lambda e: F.struct(kebab_case(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    once = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    inline = F.coalesce("inline_keys", F.array().cast("array<string>"))
    missing = [F.when(~F.array_contains(names, k) & ~F.array_contains(inline, k), F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for k, v in (required or {}).items()]
    full = F.map_from_entries(F.concat(once, F.array_compact(F.array(*missing)))) if missing else F.map_from_entries(once)
    out = docs.withColumn("type", F.coalesce(F.nullif("type", F.lit("")), F.lit("note"))).withColumn("tags", fixed_tags(F.coalesce("tags", F.array().cast("array<string>"))))
    out = out.withColumn("title", F.when(typedef, F.col("title")).otherwise(fixed_title(F.col("title"), F.col("h1"), F.col("path")))).withColumn("meta", full)
    if templates:
        out = out.withColumn("title", F.coalesce(rendered_title(templates), F.col("title")))
    core = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("title", "type", "id")), F.when(F.size("tags") > 0, F.lit("tags"))))
    held = F.array_union(F.map_keys("meta"), core)
    return out.withColumn("inline_keys", F.filter(inline, lambda k: ~F.array_contains(held, k)))
