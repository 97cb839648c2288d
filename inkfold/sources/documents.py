"""Document parsing as Column expressions: tags, checkboxes, fields, links, and the index tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.scalars import media_type

# Patterns of the document format.
FENCE = r"(?m)^(?:```|~~~)[^\n]*$"
INLINE_CODE = r"`[^`\n]+`"
EMBED = r"!\[\[([^\]#|]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"
WIKILINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
MARKDOWN = r"(?<!!)\[([^\]]*)\]\(([^)]+)\)"
HASHTAG = r"(?:^|\s)#(\w[\w/-]*)"
CHECKBOX = r"^(\s*)- \[([ xi])\]\s+(.+)$"
FIELD = r"^([\w][\w\s-]*)::\s?(.*)$"
BARE_URL = r"(?m)(?:^|\s)(https?://[^\s<>\[\]()]+)"
ZONES = {"raw_frontmatter": "Frontmatter", "body": "Body", "reference_section": "Reference"}


def lines(body: Column) -> Column:
    return F.split(body, "\n")


def without_fences(body: Column) -> Column:
    """Lines outside of fences. Any fence line opens or closes, whatever its mark; an open fence goes on to the end."""
    return F.array_join(F.filter(F.split(body, FENCE), lambda x, i: i % 2 == 0), "\n")


def without_code(body: Column) -> Column:
    return F.regexp_replace(without_fences(body), INLINE_CODE, "")


def body_tags(body: Column) -> Column:
    """Hashtags outside code and wikilinks, each once, in order."""
    plain = F.regexp_replace(without_code(body), r"\[\[[^\]]*\]\]", "")
    return F.array_distinct(F.flatten(F.transform(lines(plain), lambda x: F.regexp_extract_all(x, F.lit(HASHTAG), F.lit(1)))))


def found_links(text: Column, pattern: str, kind: str, target: int, section: int | None, display: int | None) -> Column:
    """target, section, display, kind of each match; text is free of code."""
    groups = {"target": target, "section": section, "display": display}
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items() if g]

    def told(x: Column) -> Column:
        return F.struct(*((F.nullif(x[n], F.lit("")) if n != "target" else x[n]).alias(n) if g else F.lit(None).cast("string").alias(n) for n, g in groups.items()), F.lit(kind).alias("kind"))

    return F.transform(F.arrays_zip(*parts), told)


def links_of(text: Column) -> Column:
    """Embeds, wikilinks (a #section stays in the target) to nothing that is embedded, Markdown links, bare URLs that none of these names; in this order."""
    plain = without_code(F.coalesce(text, F.lit("")))
    embeds, markdown = found_links(plain, EMBED, "embed", 1, 2, 3), found_links(plain, MARKDOWN, "markdown", 2, None, 1)
    embedded, named = (F.transform(x, lambda e: e["target"]) for x in (embeds, markdown))
    wiki = F.filter(found_links(plain, WIKILINK, "wikilink", 1, None, 2), lambda x: ~F.array_contains(embedded, F.substring_index(x["target"], "#", 1)))
    urls = F.transform(F.regexp_extract_all(plain, F.lit(BARE_URL), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    urls = F.filter(urls, lambda u: (u != "") & ~F.array_contains(named, u))
    bare = F.transform(urls, lambda u: F.struct(u.alias("target"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("display"), F.lit("url").alias("kind")))
    return F.concat(embeds, wiki, markdown, bare)


def link_table(docs: DataFrame) -> DataFrame:
    """source_id, target, section, display, kind, zone of all links, in order, of the zones that docs has."""
    def in_zone(column: str, zone: str) -> Column:
        return F.transform(links_of(F.col(column)), lambda x: x.withField("zone", F.lit(zone)))

    zones = [in_zone(c, z) for c, z in ZONES.items() if c in docs.columns]
    return docs.select(F.col("id").alias("source_id"), F.explode(F.concat(*zones)).alias("link")).select("source_id", "link.*")


def checkbox_table(docs: DataFrame) -> DataFrame:
    """document_id, state, content, date, due_date, line_number (from 1), indent_level of every checkbox line."""
    rows = docs.select(F.col("id").alias("document_id"), F.posexplode(lines(F.col("body"))).alias("at", "line")).filter(F.col("line").rlike(CHECKBOX))
    mark, text = F.regexp_extract("line", CHECKBOX, 2), F.regexp_extract("line", CHECKBOX, 3)
    state = F.when(mark == "x", "done").when(mark == "i", "info").otherwise("open")
    dated = r"^(\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2})?) - (.*)$"
    date = F.when(text.rlike(dated), F.regexp_extract(text, dated, 1))
    due = F.when(text.rlike(r"⏳ \d{4}-\d{2}-\d{2}"), F.regexp_extract(text, r"⏳ (\d{4}-\d{2}-\d{2})", 1))
    content = F.trim(F.when(text.rlike(dated), F.regexp_extract(text, dated, 2)).otherwise(text))
    return rows.select("document_id", state.alias("state"), content.alias("content"), date.alias("date"), due.alias("due_date"), (F.col("at") + 1).alias("line_number"), F.length(F.regexp_extract("line", CHECKBOX, 1)).alias("indent_level"))


def zone_fields(docs: DataFrame, column: str, before: str) -> DataFrame:
    rows = docs.select(F.col("id").alias("document_id"), F.posexplode(lines(F.coalesce(F.col(column), F.lit("")))).alias("at", "line"))
    pattern = "^" + before + FIELD.removeprefix("^")
    value = F.trim(F.regexp_replace(F.regexp_extract("line", pattern, 2), r"\[\[([^\]|]*)(?:\|[^\]]*)?\]\]", "$1"))
    return rows.filter(F.col("line").rlike(pattern)).select("document_id", F.trim(F.regexp_extract("line", pattern, 1)).alias("key"), value.alias("value"), "at", F.lit(ZONES[column]).alias("zone"))


def field_table(docs: DataFrame) -> DataFrame:
    """document_id, key, value, zone of inline fields. In the body the first of a key counts; references (`- key:: value`) keep all
    values in order, joined by commas; [[x|y]] is read as x."""
    body = zone_fields(docs, "body", "").groupBy("document_id", "key", "zone").agg(F.min_by("value", "at").alias("value"))
    if "reference_section" in docs.columns:
        values = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
        body = body.unionByName(zone_fields(docs, "reference_section", "- ").groupBy("document_id", "key", "zone").agg(F.array_join(values, ",").alias("value")))
    return body.select("document_id", "key", "value", "zone")


def cross_zone_keys(fields: DataFrame) -> DataFrame:
    """document_id, key, zones of keys that stand in more than one zone of a document, which is an error."""
    return fields.groupBy("document_id", "key").agg(F.array_sort(F.collect_set("zone")).alias("zones")).filter(F.size("zones") > 1)


def alias_table(meta: DataFrame) -> DataFrame:
    """document_id, alias: texts under `aliases` in the frontmatter (id, meta as JSON)."""
    parsed = F.from_json(F.get_json_object("meta", "$.aliases"), "array<string>")
    return meta.select(F.col("id").alias("document_id"), F.explode(parsed).alias("alias")).filter("alias IS NOT NULL")


def attachment_table(meta: DataFrame) -> DataFrame:
    """document_id, name, mime, size, path: entries under `attachments` in the frontmatter, each a name or a map."""
    items = F.from_json(F.get_json_object("meta", "$.attachments"), "array<string>")
    item = meta.select(F.col("id").alias("document_id"), F.explode(items).alias("item"))
    name = F.coalesce(F.get_json_object("item", "$.name"), F.col("item"))
    kind, path = F.coalesce(F.get_json_object("item", "$.mime"), media_type(name)), F.coalesce(F.get_json_object("item", "$.path"), F.concat(F.lit("attachments/"), "document_id", F.lit("/"), name))
    return item.select("document_id", name.alias("name"), kind.alias("mime"), F.get_json_object("item", "$.size").try_cast("bigint").alias("size"), path.alias("path"))


def tag_table(docs: DataFrame) -> DataFrame:
    """document_id, tag, source: frontmatter tags and hashtags of the body."""
    front = docs.select(F.col("id").alias("document_id"), F.explode("tags").alias("tag"), F.lit("frontmatter").alias("source"))
    return front.unionByName(docs.select(F.col("id").alias("document_id"), F.explode(body_tags(F.col("body"))).alias("tag"), F.lit("body").alias("source")))


def rename_links(body: Column, old: str, new: str) -> Column:
    """Links and embeds of exactly one target pointed to another."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in old)
    to = new.replace("\\", "\\\\").replace("$", "\\$")
    out = F.regexp_replace(body, rf"(!?\[\[){quoted}((?:#[^\]|]*)?(?:\|[^\]]*)?\]\])", f"$1{to}$2")
    return F.regexp_replace(out, rf"(\]\(){quoted}(\))", f"$1{to}$2")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, kind (Added, Modified, Deleted) between two snapshots with path and content."""
    a = old.select("path", F.xxhash64("content").alias("a"))
    b = new.select("path", F.xxhash64("content").alias("b"))
    kind = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Deleted").otherwise("Modified")
    return a.join(b, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", kind.alias("kind"))


def merge_snapshot(state: DataFrame, changed: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Incremental upkeep: changed rows replace those with their key, deleted keys go."""
    gone = changed.select(key).unionByName(deleted.select(key)).distinct()
    return state.join(gone, key, "left_anti").unionByName(changed)
