"""More queries of the document engine, each through the library's own functions: parsing of texts with code, filters over all
documents, references, discovery, search over postings, writes and table definitions.
"""

from __future__ import annotations

import datetime
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import scalars
from inkfold.operators import graph, merge, sync
from inkfold.plans import expand, generic, schema_apply
from inkfold.plans import index as inverted
from inkfold.plans.catalog import Catalog, Column_, Table
from inkfold.plans.database import Database
from inkfold.plans.where import TAGS, typed_list
from inkfold.sources import corpus as files
from inkfold.sources import documents as parse
from inkfold.streaming import changes
from inkfold.workload import ALIASES, DOCS, LINKS, NAMES, ORACLES, QUERIES, alias_table, catalog, corpus, edges, query, read, sql

# --- parsing of texts with fences and code -----------------------------------------------------

# Pieces that stand before and after each text, by doc_id % 6: fences that mix marks, fences that stay open, code on a line, links of all kinds.
BEFORE = (
    "#top [[a#s|A]] ![[pic.png#x|P]] [[pic.png]]\n```\n#hidden [[b]]\n~~~\n#seen [[c]]\n```\n#gone [m](n.md)\n~~~~\nkey:: one\n",
    "`#code [[d]]` #real/tag [x](y z.md) ![im](i.png)\nkey:: two\nkey:: three\n",
    "https://e.org/a, (https://e.org/b) [u](https://e.org/c) https://e.org/c!\n~~~\nkey:: four\n",
    "key:: [[e|E]]\n#a #b #a [[f]] [[f]]\n",
    "text ``` #c\n ```\n#d [[g#h]]\n",
    "",
)
AFTER = ("\n#end [[z]]\n", "\n```\n#open [[o]]\n", "\n#end https://e.org/z.\n", "\n- [x] 2024-01-02 - done\n", "\n```\n", "\n#only [[last|L]]\n")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BODY = f"CASE doc_id % 6 {' '.join(f'WHEN {k} THEN concat({{e}}{quoted(a)}, coalesce(text, {quoted('')}), {{e}}{quoted(b)})' for k, (a, b) in enumerate(zip(BEFORE, AFTER, strict=True)))} END"
MADE = f"(SELECT doc_id, cast(doc_id AS VARCHAR) AS id, {BODY.format(e='')} AS body FROM documents)"
PLAIN_LINES = f"""split AS (SELECT id, line, n FROM (SELECT id, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS n FROM {MADE})),
fenced AS (SELECT *, regexp_matches(line, '^(```|~~~)') AS fence, count(*) FILTER (regexp_matches(line, '^(```|~~~)')) OVER (PARTITION BY id ORDER BY n) AS opened FROM split),
plain AS (SELECT id, n, regexp_replace(line, '`[^`]+`', '', 'g') AS line FROM fenced WHERE NOT fence AND opened % 2 = 0)"""


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lit(None).cast("string")
    for k, (a, b) in enumerate(zip(BEFORE, AFTER, strict=True)):
        body = F.when(F.col("doc_id") % 6 == k, F.concat(F.lit(a), F.coalesce("text", F.lit("")), F.lit(b))).otherwise(body)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), body.alias("body"))


@query("PRS_04_tags_outside_code", f"WITH {PLAIN_LINES} SELECT DISTINCT id, tag FROM (SELECT id, unnest(regexp_extract_all(regexp_replace(line, '\\[\\[[^\\]]*\\]\\]', '', 'g'), '(?:^|\\s)#([0-9A-Za-z_][0-9A-Za-z_/-]*)', 1)) AS tag FROM plain)")
def tags_outside_code(spark, sf_dir):
    return made(spark, sf_dir).select("id", F.explode(parse.body_tags(F.col("body"))).alias("tag"))


@query("PRS_07_10_links_outside_code", f"""WITH {PLAIN_LINES},
e AS (SELECT id, unnest(regexp_extract_all(line, '!\\[\\[([^\\]#|]+)(?:#([^\\]|]+))?(?:\\|([^\\]]+))?\\]\\]', 1)) AS target FROM plain),
w AS (SELECT id, unnest(regexp_extract_all(line, '\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]', 1)) AS target FROM plain),
m AS (SELECT id, unnest(regexp_extract_all(line, '(?:^|[^!])\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS target FROM plain),
u AS (SELECT id, rtrim(unnest(regexp_extract_all(line, '(?:^|\\s)(https?://[^\\s<>\\[\\]()]+)', 1)), '.,;:!?') AS target FROM plain)
SELECT id AS source_id, target, 'embed' AS kind, count(*) AS n FROM e GROUP BY ALL
UNION ALL SELECT id, target, 'wikilink', count(*) FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = w.id AND e.target = split_part(w.target, '#', 1)) GROUP BY ALL
UNION ALL SELECT id, target, 'markdown', count(*) FROM m GROUP BY ALL
UNION ALL SELECT id, target, 'url', count(*) FROM u WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.id = u.id AND m.target = u.target) GROUP BY ALL""")
def links_outside_code(spark, sf_dir):
    return parse.link_table(made(spark, sf_dir)).groupBy("source_id", "target", "kind").agg(F.count("*").alias("n"))


@query("PRS_06_reference_fields", "SELECT cast(doc_id AS VARCHAR) AS document_id, 'from' AS key, concat(source, ',', lang) AS value, 'Reference' AS zone FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def reference_fields(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    return parse.field_table(docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("plain").alias("body"), F.concat(F.lit("- from:: [["), "source", F.lit("|S]]\n- from:: "), "lang").alias("reference_section")))


@query("PRS_14_flat_fields", "SELECT cast(c_custkey AS VARCHAR) AS id, key, value FROM (SELECT c_custkey, unnest(['a.b[0]', 'a.b[1].c', 'd\\.e', 'n']) AS key, unnest([c_name, c_mktsegment, 'true', cast(c_nationkey AS VARCHAR)]) AS value FROM customer)")
def flat_fields(spark, sf_dir):
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    meta = F.concat(F.lit('{"a": {"b": ['), text("c_name"), F.lit(', {"c": '), text("c_mktsegment"), F.lit('}]}, "d.e": true, "title": "no", "n": '), F.col("c_nationkey").cast("string"), F.lit("}"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.explode(files.flat_fields(meta)).alias("f"))
    return rows.select("id", "f.key", "f.value")


@query("PRS_12_serialize", "SELECT doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'title: Note ' || lang || chr(10) || 'tags:' || chr(10) || '  - ' || source || chr(10) || 'type: note' || chr(10) || 'alpha: 1' || chr(10) || '---' || chr(10) || coalesce(text, '') AS content FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def serialize(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    meta = F.to_json(F.struct(F.lit(1).alias("alpha"), F.lit("note").alias("type"), F.array("source").alias("tags"), F.concat(F.lit("Note "), "lang").alias("title"), F.col("doc_id").cast("string").alias("id")))
    return docs.select("doc_id", files.serialized(meta, F.col("text"), F.lit("")).alias("content"))


# --- filters over all documents ---------------------------------------------------------------


def tag_rows(spark, sf_dir):
    return parse.tag_table(corpus(spark, sf_dir).withColumn("body", F.lit(""))).select("document_id", "tag", "source")


def field_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.explode(F.create_map(F.lit("size"), F.col("n_chars").cast("string"), F.lit("origin"), F.col("source"))).alias("key", "value")).filter("value IS NOT NULL")


def tagged_catalog(spark, sf_dir) -> Catalog:
    c = corpus(spark, sf_dir).select("id", "title", "type", "date", "doc_id")
    return Catalog({"note": Table("note", "id", {n: Column_(n) for n in ("id", "title", "type", "date")})}, {"note": c, TAGS: tag_rows(spark, sf_dir).select("document_id", "tag")})


ALL_TAGS = "(SELECT doc_id, lang AS tag FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, source FROM documents WHERE source IS NOT NULL)"
for name, where, oracle in (
    ("FLT_11_tags_contains", {"tags": {"contains": "src2"}}, "source = 'src2'"),
    ("FLT_12_tags_contains_all", {"tags": {"containsAll": ["en", "src2"]}}, "lang = 'en' AND source = 'src2'"),
    ("FLT_13_tags_contains_any", {"tags": {"containsAny": ["fr", "src2"]}}, "lang = 'fr' OR source = 'src2'"),
    ("FLT_11_tags_or_type", {"_or": [{"tags": {"contains": "src2"}}, {"type": {"eq": "de"}}]}, "lang = 'de' OR source = 'src2'"),
):

    def tagged(spark, sf_dir, where=where):
        return typed_list(tagged_catalog(spark, sf_dir), "note", where).select("doc_id")

    query(name, f"SELECT doc_id FROM documents WHERE {oracle}")(tagged)


@query("FLT_14_generic_list", "SELECT cast(doc_id AS VARCHAR) AS id FROM documents d WHERE lang = 'en' AND source = 'src2' ORDER BY doc_id % 400 DESC, id DESC LIMIT 20")
def generic_list(spark, sf_dir):
    found = generic.filtered(corpus(spark, sf_dir), tag_rows(spark, sf_dir), edges(spark, sf_dir), field_rows(spark, sf_dir), type_="en", tag="src2", field={"origin": "src2"})
    return generic.listed(found, limit=20).select("id")


@query("FLT_14_backlinks_of", "SELECT cast(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 2 = 0 AND doc_id * 7 % 1200 = 14")
def generic_backlinks(spark, sf_dir):
    return generic.filtered(corpus(spark, sf_dir), links=edges(spark, sf_dir), backlinks_of="14").select("id")


@query("FLT_15_tag_entries", f"SELECT cast(doc_id AS VARCHAR) AS document_id, tag FROM {ALL_TAGS} WHERE tag ILIKE '%RC1%' AND doc_id IN (3, 5, 11, 17, 21, 36, 41)")
def tag_entries(spark, sf_dir):
    return generic.tag_entries(tag_rows(spark, sf_dir), {"in": ["3", "5", "11", "17", "21", "36", "41"]}, {"contains": "RC1"})


@query("FLT_16_checkboxes", "SELECT cast(doc_id AS VARCHAR) AS document_id, substr(text, 1, 40) AS title, 'call' AS content, 2 AS line_number FROM documents WHERE doc_id % 3 = 0")
def open_actions(spark, sf_dir):
    body = F.when(F.col("doc_id") % 3 == 0, F.lit("- [x] done\n  - [ ] call\n- [i] know")).otherwise(F.lit("- [y] no\n- [x] all done"))
    c = corpus(spark, sf_dir)
    return generic.open_actions(parse.checkbox_table(c.withColumn("body", body)), c).select("document_id", "title", "content", "line_number")


@query("FLT_17_tag_prefix", f"SELECT DISTINCT cast(doc_id AS VARCHAR) AS document_id FROM {ALL_TAGS} WHERE tag ILIKE 'SRC1%'")
def tag_prefix(spark, sf_dir):
    return generic.tag_prefix(tag_rows(spark, sf_dir), "SRC1")


@query("FLT_18_search_where", "SELECT cast(doc_id AS VARCHAR) AS id FROM documents WHERE source IN ('src1', 'src2') AND contains(lang, 'e') AND cast(n_chars AS VARCHAR) LIKE '%1%'")
def search_where(spark, sf_dir):
    found = inverted.Index(None, None, 0, 1.0, corpus(spark, sf_dir), tag_rows(spark, sf_dir), field_rows(spark, sf_dir))
    return inverted.search(found, "", where={"origin": {"in": ["src1", "src2"]}, "type": {"contains": "e"}, "size": {"contains": "1"}}, limit=None).select("id")


@query("FLT_21_output_tags", "SELECT doc_id, concat_ws(',', lang, source, 'x') AS tags FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def output_tags(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    return d.select("doc_id", F.array_join(generic.output_tags(F.array("lang", "source"), F.array(F.col("source"), F.lit("x"), F.col("lang"))), ",").alias("tags"))


@query("FLT_22_typed_values", "SELECT event_id, lower(event_type) IN ('true', '1', 'yes') AS seen, try_cast(cast(user_id AS VARCHAR) AS BIGINT) AS number FROM events")
def typed_values(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", scalars.typed_value(F.col("event_type"), "BOOLEAN").alias("seen"), scalars.typed_value(F.col("user_id").cast("string"), "INTEGER").alias("number"))


@query("AGG_04_tag_counts", f"SELECT tag, count(*) AS count FROM {ALL_TAGS} GROUP BY tag")
def tag_counts(spark, sf_dir):
    return generic.tag_counts(tag_rows(spark, sf_dir))


@query("AGG_05_total_beside_page", "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey DESC LIMIT 10")
def total_beside_page(spark, sf_dir):
    found = typed_list(catalog(spark, sf_dir), "customer", {"c_acctbal": {"gt": 0}})
    return generic.with_total(found, found.orderBy(F.desc("c_custkey")).limit(10)).select("c_custkey", "total")


@query("AGG_07_count_of_list", "SELECT count(*) AS count FROM documents WHERE lang = 'en'")
def count_of_list(spark, sf_dir):
    return generic.count_of(generic.filtered(corpus(spark, sf_dir), type_="en"))


@query("AGG_10_duplicate_groups", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return merge.duplicates(read(spark, sf_dir, "orders"), ["o_custkey"])


@query("SRT_04_generic_sort", "SELECT cast(doc_id AS VARCHAR) AS id, lang AS type FROM documents ORDER BY lang NULLS FIRST, id DESC LIMIT 30 OFFSET 5")
def generic_sort(spark, sf_dir):
    return generic.listed(corpus(spark, sf_dir), "type", limit=30, offset=5).select("id", "type")


@query("SRC_11_scan_type", "SELECT cast(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'fr'")
def scan_type(spark, sf_dir):
    return generic.filtered(corpus(spark, sf_dir), type_="fr").select("id").orderBy("id")


@query("SRC_12_scan_tag", f"SELECT DISTINCT doc_id FROM {ALL_TAGS} WHERE tag = 'src3'")
def scan_tag(spark, sf_dir):
    return generic.filtered(corpus(spark, sf_dir), tag_rows(spark, sf_dir), tag="src3").select("doc_id")


@query("SRC_08_attachments", "SELECT cast(doc_id AS VARCHAR) AS document_id, name, mime, size, path FROM (SELECT doc_id, unnest(['a.js', 'b.' || lang]) AS name, unnest(['text/javascript', 'x/y']) AS mime, unnest([NULL, doc_id]) AS size, unnest(['attachments/' || doc_id || '/a.js', 'up/b']) AS path FROM documents WHERE lang IS NOT NULL)")
def attachments(spark, sf_dir):
    item = F.struct(F.concat(F.lit("b."), "lang").alias("name"), F.lit("x/y").alias("mime"), F.col("doc_id").alias("size"), F.lit("up/b").alias("path"))
    meta = F.concat(F.lit('{"attachments": ["a.js", '), F.to_json(item), F.lit("]}"))
    return parse.attachment_table(read(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), meta.alias("meta")))


# --- references -------------------------------------------------------------------------------


@query("JN_10_route_union", "SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey IN (SELECT customer_id FROM (SELECT o_custkey AS customer_id, o_orderpriority AS orders FROM orders) t WHERE orders = '1-URGENT')")
def route_union(spark, sf_dir):
    t = Table("customer", "c_custkey", {"c_custkey": Column_("c_custkey", "INTEGER"), "c_name": Column_("c_name")})
    junction = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("urgency"))
    own = Catalog({"customer": t}, {"customer": read(spark, sf_dir, "customer"), "customer_urgency": junction})
    docs = corpus(spark, sf_dir)
    found = inverted.Router(inverted.Index(None, None, 0, 1.0, docs, tag_rows(spark, sf_dir), field_rows(spark, sf_dir), own), None).ids("urgency", "eq", "1-URGENT")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")).join(found, "id", "left_semi")


@query("JN_11_shared_tags", f"SELECT cast(b.doc_id AS VARCHAR) AS id, count(*) AS shared FROM {ALL_TAGS} a JOIN {ALL_TAGS} b ON a.tag = b.tag WHERE a.doc_id = 10 AND b.doc_id <> 10 GROUP BY b.doc_id")
def shared_tags(spark, sf_dir):
    return graph.shared_tags(tag_rows(spark, sf_dir), "10")


@query("JN_14_enrichment", "SELECT cast(doc_id AS VARCHAR) AS id, concat_ws(',', least(lang, source), greatest(lang, source)) AS tags, source AS origin, 'typed' AS size FROM documents WHERE doc_id % 5 = 0 AND lang IS NOT NULL AND source IS NOT NULL")
def enrichment(spark, sf_dir):
    hits = read(spark, sf_dir, "documents").filter("doc_id % 5 = 0 AND lang IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"))
    typed = hits.select("id", F.create_map(F.lit("size"), F.lit("typed")).alias("typed"))
    out = expand.enriched(hits, tag_rows(spark, sf_dir), field_rows(spark, sf_dir), typed)
    return out.select("id", F.array_join("tags", ",").alias("tags"), F.col("fields")["origin"].alias("origin"), F.col("fields")["size"].alias("size"))


@query("JN_15_resolve_all", f"SELECT DISTINCT l.target, coalesce(p.id, i.id, a.document_id) AS id FROM {LINKS} l LEFT JOIN {DOCS} p ON p.path = l.target LEFT JOIN {DOCS} i ON i.id = l.target LEFT JOIN {ALIASES} a ON lower(a.alias) = lower(l.target)")
def resolve_all(spark, sf_dir):
    return graph.resolved(edges(spark, sf_dir), corpus(spark, sf_dir), alias_table(spark, sf_dir)).select("target", "id")


@query("JN_16_expand_reference", "SELECT o_orderkey, cast(o_custkey AS VARCHAR) AS customer_id, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def expand_reference(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer_id"))
    out = expand.expand_one(rows, "customer_id", read(spark, sf_dir, "customer").select("c_custkey", "c_name"), key="c_custkey")
    return out.select("o_orderkey", "customer_id", F.col("customer.c_name").alias("c_name"))


@query("JN_17_expand_plural", "SELECT c_custkey, coalesce(string_agg(cast(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) FILTER (n <= 3), '') AS orders FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) ON c_custkey = o_custkey GROUP BY c_custkey")
def expand_plural(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    refs = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ", ").alias("order_ids"))
    rows = read(spark, sf_dir, "customer").select("c_custkey").join(refs, "c_custkey", "left")
    out = expand.expand_many(rows, "c_custkey", "order_ids", o, "orders", key="o_orderkey", order="o_totalprice", direction="DESC", limit=3)
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("JN_18_typed_accessor", "SELECT cast(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN n_chars END AS size FROM documents")
def typed_accessor(spark, sf_dir):
    table = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("size"))
    return expand.typed_accessor(corpus(spark, sf_dir), "en", table).select("id", F.col("en.size").alias("size"))


# --- discovery --------------------------------------------------------------------------------


@query("GR_02_backlinks_with_path", f"SELECT DISTINCT source_id, 'docs/' || source_id || '.md' AS source_path FROM {LINKS} WHERE target = '14'")
def backlinks_with_path(spark, sf_dir):
    return graph.backlinks_with_path(edges(spark, sf_dir), corpus(spark, sf_dir), "14")


@query("GR_03_backlinks_of", f"SELECT source_id, 'docs/' || source_id || '.md' AS source_path, CASE WHEN bool_or(target = '22') THEN '22' ELSE 'docs/22.md' END AS target FROM (SELECT * FROM {LINKS} UNION ALL SELECT '3', 'docs/22.md' UNION ALL SELECT '3', '22') WHERE target IN ('22', 'docs/22.md') GROUP BY source_id")
def backlinks_of(spark, sf_dir):
    more = spark.createDataFrame([("3", "docs/22.md"), ("3", "22")], "source_id string, target string")
    return graph.backlinks_of(edges(spark, sf_dir).unionByName(more), corpus(spark, sf_dir), "22", "docs/22.md")


@query("GR_05_resurrected", "SELECT cast(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src4'")
def resurrected(spark, sf_dir):
    marks = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("resurrected").alias("key"), F.when(F.col("source") == "src4", "true").otherwise("false").alias("value"), F.lit("Frontmatter").alias("zone"))
    return graph.resurrected(corpus(spark, sf_dir), marks).select("id")


@query("GR_07_suggestions", f"WITH t AS (SELECT cast(doc_id AS VARCHAR) AS id, tag FROM {ALL_TAGS}) SELECT id, score FROM (SELECT b.id, round(0.6 * count(*) / (4.0 - count(*)), 6) AS score FROM t a JOIN t b ON a.tag = b.tag WHERE a.id = '11' AND b.id <> '11' GROUP BY b.id) s WHERE id NOT IN (SELECT n.id FROM {LINKS} l JOIN {NAMES} n ON n.name = l.target WHERE l.source_id = '11') ORDER BY score DESC, id LIMIT 15")
def suggestions(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumn("title", F.when(F.col("id") != "11", F.col("title")).otherwise(F.lit("zzqx none of this")))
    return graph.suggestions(replace(postings_of(spark, sf_dir), docs=docs), edges(spark, sf_dir), alias_table(spark, sf_dir), "11", 15).select("id", F.round("score", 6).alias("score"))


NAMED = "(SELECT cast(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 50 = 1 THEN ['of', 'the'] WHEN doc_id % 50 = 2 THEN ['idiot'] ELSE ['zzqx' || doc_id] END AS w FROM documents)"


def named(spark, sf_dir):
    title = F.when(F.col("doc_id") % 50 == 1, "Of the").when(F.col("doc_id") % 50 == 2, "idiot").otherwise(F.concat(F.lit("zzqx"), F.col("doc_id").cast("string")))
    return replace(postings_of(spark, sf_dir), docs=corpus(spark, sf_dir).withColumn("title", title))


WORDS_OF = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
IN_TEXT = "(SELECT cast(doc_id AS VARCHAR) AS id, ' ' || array_to_string(" + WORDS_OF.format("coalesce(substr(text, 1, 40), '')") + ", ' ') || ' ' AS a, ' ' || array_to_string(" + WORDS_OF.format("coalesce(text, '')") + ", ' ') || ' ' AS b FROM documents)"
LINKED = f"(SELECT l.source_id, n.id FROM {LINKS} l JOIN {NAMES} n ON n.name = l.target)"


@query("GR_06_unlinked_mentions", f"SELECT id AS source_id FROM {IN_TEXT} WHERE (contains(a, ' of the ') OR contains(b, ' of the ')) AND id <> '51' AND id NOT IN (SELECT source_id FROM {LINKED} WHERE id = '51')")
def unlinked_mentions(spark, sf_dir):
    return graph.unlinked_mentions(named(spark, sf_dir), edges(spark, sf_dir), alias_table(spark, sf_dir), "51")


@query("GR_06b_all_mentions", f"SELECT t.id, count(*) AS mentions FROM {NAMED} t JOIN {IN_TEXT} d ON (contains(d.a, ' ' || array_to_string(t.w, ' ') || ' ') OR contains(d.b, ' ' || array_to_string(t.w, ' ') || ' ')) AND d.id <> t.id AND NOT EXISTS (SELECT 1 FROM {LINKED} x WHERE x.source_id = d.id AND x.id = t.id) GROUP BY t.id")
def all_mentions(spark, sf_dir):
    return graph.mention_counts(named(spark, sf_dir), edges(spark, sf_dir), alias_table(spark, sf_dir))


SEQUENCE = "(SELECT DISTINCT (conv_id * 1000 + turn)::VARCHAR AS id, CASE WHEN turn > 0 THEN (conv_id * 1000 + turn - 1)::VARCHAR END AS parent FROM conversations)"


def sequence(spark, sf_dir):
    at = F.col("conv_id") * 1000 + F.col("turn")
    return read(spark, sf_dir, "conversations").select(at.cast("string").alias("id"), F.when(F.col("turn") > 0, (at - 1).cast("string")).alias("parent")).distinct()


@query("GR_13_children", f"SELECT id FROM {SEQUENCE} WHERE parent = '1000'")
def sequence_children(spark, sf_dir):
    return graph.children(sequence(spark, sf_dir), "1000")


@query("GR_15_breadcrumb", f"SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS step, id FROM {SEQUENCE} WHERE id IN ('1000', '1001')")
def sequence_breadcrumb(spark, sf_dir):
    return graph.sequence_info(sequence(spark, sf_dir), "1001")["breadcrumb"]


@query("GR_16_tree", f"SELECT id, (id::INT - 2000) AS depth FROM {SEQUENCE} WHERE id::INT BETWEEN 2000 AND 2002 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = 2 AND turn = 0)")
def sequence_tree(spark, sf_dir):
    return graph.sequence_tree(sequence(spark, sf_dir), "2000", 2).select("id", "depth")


@query("GR_17_broken_sequences", f"SELECT id, parent FROM {SEQUENCE} s WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM {SEQUENCE})")
def broken_sequences(spark, sf_dir):
    return graph.broken_sequences(sequence(spark, sf_dir))


@query("GR_18_alias", "SELECT '20' AS id WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id = 20)")
def alias_resolution(spark, sf_dir):
    return graph.by_alias(alias_table(spark, sf_dir), "ALIAS20")


# --- search over postings ---------------------------------------------------------------------

BUILT: dict[tuple[str, str], str] = {}  # folders of indexes that this process has built


def postings_of(spark: SparkSession, sf_dir: str, stemming: bool = False) -> inverted.Index:
    """The index over titles and texts of the documents; built once for each session and folder."""
    docs = corpus(spark, sf_dir)
    key = (spark.sparkContext.applicationId, f"{sf_dir} {stemming}")
    if key not in BUILT:
        shared = spark.conf.get("spark.checkpoint.dir", None) or ("file://" + tempfile.mkdtemp(prefix="inkfold-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir"))
        path = f"{shared.rstrip('/')}/inkfold-index-{uuid.uuid4().hex}"
        inverted.build(docs, tag_rows(spark, sf_dir).limit(0), field_rows(spark, sf_dir).limit(0), path, stemming=stemming, buckets=16)
        BUILT[key] = path
    return inverted.opened(spark, BUILT[key], docs, tag_rows(spark, sf_dir), field_rows(spark, sf_dir), stemming=stemming, buckets=16)


TOKENS = f"(SELECT cast(doc_id AS VARCHAR) AS id, substr(text, 1, 40) AS title, lang AS type, source, {WORDS_OF.format("concat_ws(' ', substr(text, 1, 40), text)")} AS w, ' ' || array_to_string({WORDS_OF.format("coalesce(substr(text, 1, 40), '')")}, ' ') || ' ' AS a, ' ' || array_to_string({WORDS_OF.format("coalesce(text, '')")}, ' ') || ' ' AS b FROM documents)"
for name, text, oracle, more in (
    ("SRCH_06_boolean", "the erent OR idiot AND NOT of", "(list_contains(w, 'the') AND list_contains(w, 'erent')) OR (list_contains(w, 'idiot') AND NOT list_contains(w, 'of'))", {}),
    ("SRCH_06_phrase", '"of the"', "contains(a, ' of the ') OR contains(b, ' of the ')", {}),
    ("SRCH_06_field_in_or", "idiot OR type=clown", "list_contains(w, 'idiot') OR list_contains(w, 'clown')", {}),
    ("SRCH_05_negative", "NOT the", "NOT list_contains(w, 'the')", {}),
    ("SRCH_04_filters_and_rest", "the tag=src3 NOT tag=fr type=e", "list_contains(w, 'the') AND source = 'src3' AND NOT coalesce(type = 'fr', false) AND contains(type, 'e')", {}),
    ("SRCH_09_fields", "origin=rc1 the", "list_contains(w, 'the') AND source ILIKE '%rc1%'", {}),
    ("SRCH_11_where", "the", "list_contains(w, 'the') AND source IN ('src1', 'src4') AND type = 'en'", {"where": {"origin": {"in": ["src1", "src4"]}, "type": {"eq": "en", "contains": "zz"}}}),
    ("SRCH_11_where_empty", "the", "false", {"where": {"origin": {"in": []}}}),
    ("SRCH_13_types_and_tag", "the", "list_contains(w, 'the') AND type IN ('en', 'fr') AND source = 'src2'", {"types": ["en", "fr"], "tag": "src2"}),
):

    def searched(spark, sf_dir, text=text, more=more):
        return inverted.search(postings_of(spark, sf_dir), text, limit=None, **more).select("id")

    query(name, f"SELECT id FROM {TOKENS} WHERE {oracle}")(searched)


@query("SRCH_12_filter_only", "SELECT cast(doc_id AS VARCHAR) AS id, substr(text, 1, 40) AS title, 0.0::DOUBLE AS rank FROM documents WHERE lang = 'fr' ORDER BY title NULLS FIRST, id LIMIT 25")
def filter_only(spark, sf_dir):
    return inverted.search(postings_of(spark, sf_dir), "", types=["fr"], limit=25).select("id", "title", "rank")


@query("SRCH_06_stemmed", f"SELECT id FROM {TOKENS} WHERE list_has_any(w, ['idiot', 'idiots', 'idioted', 'idioting'])")
def stemmed(spark, sf_dir):
    return inverted.search(postings_of(spark, sf_dir, True), "idiots", limit=None).select("id")


@query("SRCH_08_snippet")
def snippets(spark, sf_dir):
    return inverted.search(postings_of(spark, sf_dir), "idiot OR clown", limit=None, snippets=True).select("id", "snippet")


@query("SRCH_07_bm25", ORACLES["SRCH_07_bm25"])
def bm25(spark, sf_dir):
    return inverted.search(postings_of(spark, sf_dir), "idiot OR clown", limit=None).select("id", "title", "rank")


# --- writes -----------------------------------------------------------------------------------

CLOCK = datetime.datetime(2024, 1, 1)
CUSTOMERS = "CREATE TABLE client (name TEXT NOT NULL, balance REAL, segment VARCHAR(20), UNIQUE(name))"
SALES = "CREATE TABLE sale (total REAL, state TEXT, client_id TEXT REFERENCES client ON DELETE CASCADE, nth INTEGER DEFAULT NEXT(client_id), seller TEXT REFERENCES client)"


def shop(spark, sf_dir, sales: bool = False) -> Database:
    """Customers and orders as tables of a database."""
    db = Database(spark, clock=lambda: CLOCK)
    db.execute(CUSTOMERS)
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    db.insert_rows("client", c, ["id"])
    if sales:
        db.execute(SALES)
        o = read(spark, sf_dir, "orders").select(F.format_string("o%09d", "o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").cast("string").alias("client_id"), (F.col("o_custkey") % 20 + 1).cast("string").alias("seller"))
        db.insert_rows("sale", o, ["id"])
    return db


@query("DML_01_insert", "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'A', 5.5 UNION ALL SELECT 'B', NULL")
def insert(spark, sf_dir):
    db = shop(spark, sf_dir)
    db.execute("INSERT INTO client (name, balance) VALUES (UPPER('a'), 5 + 0.5), ('B', NULL)")
    return db.select("SELECT name, balance FROM client")


@query("DML_02_on_conflict", "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'new', 1.0")
def on_conflict(spark, sf_dir):
    db = shop(spark, sf_dir)
    db.execute("INSERT INTO client (name, balance) VALUES ('Customer#000000001', 0), ('new', 1) ON CONFLICT DO NOTHING")
    return db.select("SELECT name, balance FROM client")


@query("DML_03_next_per_partition", "SELECT printf('o%09d', o_orderkey) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders")
def next_numbers(spark, sf_dir):
    return shop(spark, sf_dir, True).select("SELECT id, nth FROM sale")


@query("DML_06_reference_check", "SELECT 'column ''client_id'': referenced id ''none'' not found in client' AS error")
def reference_check(spark, sf_dir):
    db = shop(spark, sf_dir)
    db.execute(SALES)
    try:
        db.execute("INSERT INTO sale (total, client_id) VALUES (1, '1'), (2, 'none')")
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "error string")
    return spark.createDataFrame([], "error string")


@query("DML_09_update", "SELECT c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN c_acctbal * 2 ELSE c_acctbal END AS balance FROM customer")
def update(spark, sf_dir):
    db = shop(spark, sf_dir)
    db.execute("UPDATE client SET balance = balance * 2 WHERE segment = 'BUILDING' AND balance > 0")
    return db.select("SELECT name, balance FROM client")


@query("DML_10_delete_cascade", "SELECT o_orderkey, CASE WHEN s.c_acctbal < 0 THEN NULL ELSE o_custkey % 20 + 1 END AS seller FROM orders o JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN customer s ON s.c_custkey = o_custkey % 20 + 1 WHERE NOT coalesce(c.c_acctbal < 0, false)")
def delete_cascade(spark, sf_dir):
    db = shop(spark, sf_dir, True)
    db.execute("DELETE FROM client WHERE balance < 0")
    return db.select("SELECT cast(substr(id, 2) AS BIGINT) AS o_orderkey, cast(seller AS BIGINT) AS seller FROM sale")


@query("DML_14_junction", "SELECT count(*) AS n FROM orders")
def junction(spark, sf_dir):
    db = shop(spark, sf_dir, True)
    return db.select("SELECT count(*) AS n FROM sale_client_id j JOIN client c ON c.id = j.client_id_id JOIN sale s ON s.id = j.sale_id")


@query("DML_16_transactions", "SELECT count(*) AS n FROM customer")
def transactions(spark, sf_dir):
    db = shop(spark, sf_dir)
    db.execute_batch("BEGIN; DELETE FROM client WHERE balance > 0; ROLLBACK")
    return db.select("SELECT count(*) AS n FROM client")


@query("DML_17_batch_update", "SELECT c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 7.0 ELSE c_acctbal END AS balance FROM customer")
def batch_update(spark, sf_dir):
    db = shop(spark, sf_dir)
    db.update_rows("client", read(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit(7.0).alias("balance")))
    return db.select("SELECT name, balance FROM client")


@query("DDL_02_05_alter", "SELECT c_name AS label, c_acctbal AS balance, NULL::VARCHAR AS note FROM customer")
def alter(spark, sf_dir):
    db = shop(spark, sf_dir)
    db.execute_batch("ALTER TABLE client ADD COLUMN note TEXT; ALTER TABLE client RENAME COLUMN name TO label; ALTER TABLE client DROP COLUMN segment; ALTER TABLE client RENAME TO person")
    return db.select("SELECT label, balance, note FROM person")


@query("DDL_08_drop", "SELECT c_custkey::VARCHAR AS id, 'client ' || c_custkey AS title FROM customer")
def drop(spark, sf_dir):
    db = shop(spark, sf_dir)
    db.execute("DROP TABLE client")
    return db.select("SELECT id, title FROM untyped")


@query("FN_26_content_ids", """WITH d AS (SELECT cast(doc_id AS VARCHAR) AS id, substr(sha256(cast(doc_id AS VARCHAR) || ':' || lang || ':0'), 1, 16) AS h FROM documents WHERE lang IS NOT NULL),
n AS (SELECT id, ('0x' || h)::UBIGINT::UHUGEINT AS n FROM d)
SELECT id, printf('%04d%02d%02d%02d%02d%02d', (2000 + n // 29030400 % 100)::INT, (1 + n // 2419200 % 12)::INT, (1 + n // 86400 % 28)::INT, (n // 3600 % 24)::INT, (n // 60 % 60)::INT, (n % 60)::INT) AS new_id FROM n""")
def content_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("id"), "lang")
    return scalars.content_ids(rows, "id", "lang", spark.createDataFrame([], "id string")).select("id", "new_id")




# --- the rest ---------------------------------------------------------------------------------


@query("SRC_10_get", "SELECT cast(doc_id AS VARCHAR) AS id, lang AS type FROM documents WHERE doc_id = 42")
def get(spark, sf_dir):
    return corpus(spark, sf_dir).filter("doc_id = 42").select("id", "type")


@query("PRS_15_index_texts", "SELECT cast(doc_id AS VARCHAR) AS id, concat_ws(', ', least(lang, source), greatest(lang, source)) AS tags, concat_ws(' ', source, cast(n_chars AS VARCHAR)) AS fields FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def index_texts(spark, sf_dir):
    rows = inverted.index_texts(corpus(spark, sf_dir).filter("type IS NOT NULL AND tags[1] IS NOT NULL"), tag_rows(spark, sf_dir), field_rows(spark, sf_dir))
    return rows.select("id", "tags", "fields")


@query("FN_28_paths", """SELECT c_custkey, '"' || c_mktsegment || '"' AS got, '{"a": {"b": ["", "new"]}, "n": ' || c_nationkey || '}' AS set, '{"n": ' || c_nationkey || '}' AS removed, NULL::VARCHAR AS missing FROM customer""")
def paths(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    document = F.to_json(F.struct(F.struct(F.array("c_mktsegment").alias("b")).alias("a"), F.col("c_nationkey").alias("n")))
    short = F.to_json(F.struct(F.col("c_nationkey").alias("n")))
    return c.select(
        "c_custkey", scalars.on_paths(scalars.value_at, document, F.lit("a.b[0]")).alias("got"), scalars.on_paths(scalars.with_value, short, F.lit("a.b[1]"), F.lit('"new"')).alias("set"),
        scalars.on_paths(scalars.without_value, document, F.lit("a")).alias("removed"), scalars.on_paths(scalars.value_at, document, F.lit("a.b[7]")).alias("missing"),
    )


@query("FN_24_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dates(spark, sf_dir):
    o, day = read(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.concat(day, F.lit("T10:00:00+00:00")))
    return o.select("o_orderkey", F.date_format(scalars.parsed_date(text), "yyyy-MM-dd").alias("day"))


@query("DML_19_merge_fields", "SELECT c_custkey, c_mktsegment AS a, 'new' AS b, NULL::VARCHAR AS c FROM customer")
def merge_fields(spark, sf_dir):
    have, change = F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.lit("old"), F.lit("c"), F.lit("x")), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit(None).cast("string"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", scalars.merged_fields(have, change).alias("m"))
    return rows.select("c_custkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"))


@query("DDL_10_declared_schema", "SELECT c_name AS name, 'note on ' || c_name AS title FROM customer WHERE c_custkey < 50")
def declared_schema(spark, sf_dir):
    db = Database(spark, clock=lambda: CLOCK)
    schema_apply.apply(db, {"tables": {"memo": {"columns": {"name": {"type": "VARCHAR(30)", "required": True}}, "unique": [["name"]], "title_template": "note on {name}"}}})
    db.insert_rows("memo", read(spark, sf_dir, "customer").filter("c_custkey < 50").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")), ["id"])
    return db.select("SELECT name, title FROM memo")


def customer_files(spark, sf_dir):
    """One document for each customer, with its numbers in the frontmatter and its nation as a reference."""
    c = read(spark, sf_dir, "customer")
    text = F.format_string("---\nid: c%s\ntitle: %s\ntype: client\nbalance: %s\nlimit: %s\n---\n## Segment\n\n%s\n---\n- nation:: [[n%s]]\n", "c_custkey", F.replace("c_name", F.lit("#"), F.lit(" ")), F.col("c_acctbal").cast("string"), "c_nationkey", "c_mktsegment", "c_nationkey")
    return c.select(F.concat(F.lit("client/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))


@query("MAT_02_typed_tables", "SELECT 'c' || c_custkey AS id, replace(c_name, '#', ' ') AS title, c_acctbal AS balance, c_nationkey::BIGINT AS \"limit\", c_mktsegment AS segment, 'n' || c_nationkey AS nation FROM customer")
def typed_tables(spark, sf_dir):
    return files.materialized(files.index_tables(customer_files(spark, sf_dir)))[1]["client"].select("id", "title", "balance", "limit", "segment", "nation")


@query("MAT_07_warnings", "SELECT 'bad/' || c_custkey || '.md' AS path, 'unreadable' AS kind FROM customer WHERE c_custkey % 10 = 0")
def warnings(spark, sf_dir):
    c = customer_files(spark, sf_dir)
    bad = read(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select(F.concat(F.lit("bad/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.lit("---\n: [\n---\n").alias("content"))
    return files.index_tables(c.unionByName(bad)).warnings.select("path", "kind")


@query("MRG_07_10_snapshots", "SELECT 'd/' || doc_id || '.md' AS path, CASE doc_id % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'ours' WHEN 2 THEN 'theirs' ELSE 'resurrected' END AS how, md5(CASE doc_id % 5 WHEN 1 THEN 'ours' WHEN 2 THEN 'theirs' WHEN 3 THEN '---' || chr(10) || 'resurrected: true' || chr(10) || 'new' ELSE coalesce(text, '') END) AS content FROM documents WHERE doc_id % 5 <> 4")
def snapshots(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.format_string("d/%s.md", "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    k = F.col("doc_id") % 5
    ours = d.filter(k != 4).withColumn("content", F.when(k == 1, "ours").when(k == 3, "---\nnew").otherwise(F.col("content")))
    theirs = d.filter(~k.isin(3)).withColumn("content", F.when(k == 2, "theirs").otherwise(F.col("content")))
    return sync.merged_snapshot(d, ours, theirs).select("path", "how", F.md5("content").alias("content"))


@query("STR_02_emitted", "SELECT cast(doc_id AS VARCHAR) AS document_id, CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'created' ELSE 'updated' END AS kind, lang AS document_type FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def emitted_events(spark, sf_dir):
    d = corpus(spark, sf_dir).select("id", "type", F.coalesce("body", F.lit("")).alias("content"), "doc_id")
    new = d.filter("doc_id % 10 <> 0").withColumn("content", F.when(F.expr("doc_id % 10 = 2"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return changes.emitted(d.filter("doc_id % 10 <> 1"), new, "2024-01-01").select("document_id", "kind", "document_type")


@query("MRG_12_stale_nodes", "SELECT user_id FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) WHERE date_diff('day', t::DATE, DATE '2025-06-01') > 90")
def stale_nodes(spark, sf_dir):
    nodes = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("string").alias("last_sync"))
    return sync.stale_nodes(nodes, "2025-06-01").select("user_id")


for name, text in {
    "DEL_07_cross_right_natural": "SELECT 'cross' AS kind, count(*) AS n FROM nation a CROSS JOIN region b UNION ALL SELECT 'right', count(*) FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000 UNION ALL SELECT 'natural', count(*) FROM nation NATURAL JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) t UNION ALL SELECT 'using', count(*) FROM nation JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) u USING (n_nationkey)",
    "DEL_16_more_windows": "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, nth_value(o_orderkey, 2) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, last_value(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)",
    "DEL_17_range_frames": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM orders",
    "FN_02_07_11_built_in": "SELECT c_custkey, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, trim(concat('  ', c_name, ' ')) AS b, c_name || '-' || c_mktsegment AS c FROM customer",
}.items():
    sql(name, text)
sql("DEL_13_string_agg", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, coalesce(sum(cast(n_nationkey AS DOUBLE)), 0.0) AS total FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, coalesce(sum(cast(n_nationkey AS DOUBLE)), 0.0) AS total FROM nation GROUP BY n_regionkey")
