"""Queries of the document engine over the supplied tables, and SQL that says the same.

Names start with the id of the operator in the blueprint. Supplied tables stand in for the engine's
own: documents for the corpus, customer, orders, nation and region for typed tables with
references, conversations and nation for sequences, events for changes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import scalars
from inkfold.functions.snippets import snippet
from inkfold.operators import fixers, graph, merge
from inkfold.operators.closure import closure
from inkfold.plans import search
from inkfold.plans.catalog import Catalog, Column_, Relation, Table, inferred_schema
from inkfold.plans.where import typed_aggregate, typed_list
from inkfold.sources import documents as parse
from inkfold.sources import zones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is SQL text: the same words for both engines unless the oracle needs other ones."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        return spark.sql(re.sub(rf"\b({'|'.join(used)})\b(?=[\s,)]|$)", r"{\1}", text), **{t: read(spark, sf_dir, t) for t in used})

    query(name, oracle or text)(run)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- typed tables -----------------------------------------------------------------------------


def typed(name: str, key: str, columns: str, **relations: Relation) -> Table:
    pairs = [c.split(":") for c in columns.split()]
    return Table(name, key, {n: Column_(n, {"i": "INTEGER", "r": "REAL", "t": "TEXT"}[k]) for n, k in pairs}, relations)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    tables = [
        typed("region", "r_regionkey", "r_regionkey:i r_name:t"),
        typed("nation", "n_nationkey", "n_nationkey:i n_name:t", region=Relation("region", "nation", "n_nationkey", "n_regionkey")),
        typed("customer", "c_custkey", "c_custkey:i c_name:t c_acctbal:r c_mktsegment:t c_nationkey:i", nation=Relation("nation", "customer", "c_custkey", "c_nationkey")),
        typed("orders", "o_orderkey", "o_orderkey:i o_orderstatus:t o_totalprice:r o_orderpriority:t o_custkey:i", customer=Relation("customer", "orders", "o_orderkey", "o_custkey")),
    ]
    return Catalog({t.name: t for t in tables}, {t.name: read(spark, sf_dir, t.name) for t in tables})


def listing(name: str, table: str, where: dict, oracle: str, columns: str, **how) -> None:
    def run(spark, sf_dir):
        return typed_list(catalog(spark, sf_dir), table, where, **{"strict": True, **how}).select(*columns.split())

    query(name, f"SELECT {', '.join(columns.split())} FROM {table} {oracle}")(run)


FLAGSHIP = {"nation": {"region": {"r_name": {"eq": "EUROPE"}}}, "orderses": {"some": {"o_totalprice": {"gt": 1000}}}}
EUROPE = "EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name = 'EUROPE')"
ORDERS = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {})"
listing("flagship_relation_list", "customer", FLAGSHIP, f"WHERE {EUROPE} AND {ORDERS.format('o_totalprice > 1000')} ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC LIMIT 20", "c_custkey c_name c_acctbal", order=[("c_acctbal", "DESC")], limit=20)

C = "c_custkey c_name c_acctbal c_mktsegment"
for name, where, oracle in (
    ("FLT_01_eq", {"c_mktsegment": {"eq": "BUILDING"}}, "c_mktsegment = 'BUILDING'"),
    ("FLT_01_neq", {"c_mktsegment": {"neq": "BUILDING"}}, "c_mktsegment <> 'BUILDING'"),
    ("FLT_02_range", {"c_acctbal": {"gte": 0, "lt": 5000}, "c_custkey": {"nin": [3, 4]}}, "c_acctbal >= 0 AND c_acctbal < 5000 AND c_custkey NOT IN (3, 4)"),
    ("FLT_03_contains", {"c_name": {"contains": "R#0000001"}}, "c_name ILIKE '%R#0000001%'"),
    ("FLT_04_starts_with", {"c_mktsegment": {"startsWith": "auto"}}, "c_mktsegment ILIKE 'auto%'"),
    ("FLT_05_in", {"c_custkey": {"in": [1, 2, 5, 900]}}, "c_custkey IN (1, 2, 5, 900)"),
    ("FLT_05_in_empty", {"c_custkey": {"in": []}}, "FALSE"),
    ("FLT_06_not_in", {"c_mktsegment": {"notIn": ["BUILDING", "MACHINERY"]}}, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("FLT_06_not_in_empty", {"c_mktsegment": {"notIn": []}}, "TRUE"),
    ("FLT_07_is_null", {"c_mktsegment": {"isNull": False}, "c_name": {"isNull": False}}, "c_mktsegment IS NOT NULL"),
    ("FLT_08_and_or", {"_or": [{"c_acctbal": {"lt": -500}}, {"_and": [{"c_mktsegment": {"eq": "BUILDING"}}, {"c_acctbal": {"gt": 9000}}]}, {}]}, "c_acctbal < -500 OR (c_mktsegment = 'BUILDING' AND c_acctbal > 9000)"),
    ("FLT_09_implicit_and", {"c_mktsegment": {"eq": "BUILDING"}, "c_acctbal": {"gt": 0}}, "c_mktsegment = 'BUILDING' AND c_acctbal > 0"),
    ("JN_01_some", {"orderses": {"some": {"o_totalprice": {"gt": 300000}}}}, ORDERS.format("o_totalprice > 300000")),
    ("JN_02_none", {"orderses": {"none": {"o_orderstatus": {"eq": "F"}}}}, "NOT " + ORDERS.format("o_orderstatus = 'F'")),
    ("JN_03_every", {"orderses": {"every": {"o_totalprice": {"gt": 50000}}}}, "NOT " + ORDERS.format("NOT o_totalprice > 50000")),
    ("JN_04_some_any", {"orderses": {"some": {}}}, ORDERS.format("TRUE")),
    ("JN_04_none_any", {"orderses": {"none": {}}}, "NOT " + ORDERS.format("TRUE")),
    ("JN_04_every_any", {"orderses": {"every": {}}}, "TRUE"),
    ("JN_05_inlined", {"nation": {"n_name": {"startsWith": "C"}}}, "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_name ILIKE 'C%')"),
    ("JN_06_key_column", {"c_nationkey": {"in": [1, 2]}}, "c_nationkey IN (1, 2)"),
    ("JN_07_reverse_or", {"_or": [{"orderses": {"some": {"o_orderpriority": {"eq": "1-URGENT"}}}}, {"c_acctbal": {"gt": 9500}}]}, ORDERS.format("o_orderpriority = '1-URGENT'") + " OR c_acctbal > 9500"),
    ("JN_09_nested", {"nation": {"some": {"region": {"none": {"r_name": {"in": ["ASIA", "AFRICA"]}}}}}}, "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name IN ('ASIA', 'AFRICA')))"),
):
    listing(name, "customer", where, f"WHERE {oracle}", C)

listing("FLT_09_unknown_field", "customer", {"nothing": {"eq": 1}, "c_mktsegment": {"eq": "BUILDING"}}, "WHERE c_mktsegment = 'BUILDING'", C, strict=False)
listing("JN_07_reverse_nested", "region", {"nations": {"some": {"customers": {"some": {"c_acctbal": {"gt": 9900}}}}}}, "WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 9900)", "r_regionkey r_name")
listing("SRT_01_multi_key", "orders", {"o_totalprice": {"gt": 200000}}, "WHERE o_totalprice > 200000 ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey DESC LIMIT 50", "o_orderkey o_orderstatus o_totalprice", order=[("o_orderstatus", "ASC"), ("o_totalprice", "DESC")], limit=50)
listing("SRT_03_default_order", "customer", {}, "ORDER BY c_custkey DESC LIMIT 10", "c_custkey", limit=10)
listing("SRT_06_limit_offset", "customer", {}, "ORDER BY c_name, c_custkey LIMIT 10 OFFSET 25", "c_custkey c_name", order=[("c_name", "ASC")], limit=10, offset=25)


@query("SRT_08_distinct", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS n FROM customer) WHERE n = 1")
def _(spark, sf_dir):
    return typed_list(catalog(spark, sf_dir), "customer", order=[("c_acctbal", "DESC")], distinct="c_mktsegment").select("c_mktsegment", "c_custkey")


STATS = "count(*) AS count, round(min(c_acctbal), 4) AS lo, round(max(c_acctbal), 4) AS hi, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean"


def stats(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "count", F.round("min_c_acctbal", 4).alias("lo"), F.round("max_c_acctbal", 4).alias("hi"), F.round("sum_c_acctbal", 2).alias("total"), F.round("avg_c_acctbal", 4).alias("mean"))


@query("AGG_01_typed", f"SELECT {STATS} FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    return stats(typed_aggregate(catalog(spark, sf_dir), "customer", {"c_mktsegment": {"eq": "BUILDING"}}))


@query("AGG_02_grouped", f"SELECT c_mktsegment AS key, {STATS} FROM customer WHERE {EUROPE} GROUP BY 1")
def _(spark, sf_dir):
    return stats(typed_aggregate(catalog(spark, sf_dir), "customer", {"nation": {"region": {"r_name": {"eq": "EUROPE"}}}}, group="c_mktsegment"), "key")


@query("AGG_03_empty", f"SELECT {STATS} FROM customer WHERE FALSE")
def _(spark, sf_dir):
    return stats(typed_aggregate(catalog(spark, sf_dir), "customer", {"c_custkey": {"in": []}}))


@query("AGG_06_distinct_count", "SELECT count(DISTINCT c_mktsegment) AS count FROM customer")
def _(spark, sf_dir):
    return typed_aggregate(catalog(spark, sf_dir), "customer", distinct="c_mktsegment").select("count")


sql("AGG_04_tag_counts", "SELECT tag, count(*) AS count FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source AS tag FROM documents) t GROUP BY tag ORDER BY count DESC, tag")
sql("AGG_05_total_beside_page", "SELECT c_custkey, count(*) OVER () AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey DESC LIMIT 10")
sql("AGG_10_duplicate_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
sql("AGG_11_violations", "SELECT count(*) AS n FROM customer WHERE length(c_name) > 17")

# --- documents --------------------------------------------------------------------------------

MARKUP = r"""concat('Text #t', cast({k} % 7 AS {s}), ' and #area/a', cast({k} % 3 AS {s}), ' `#no`', chr(10), 'status:: s', cast({k} % 4 AS {s}), chr(10), 'status:: later', chr(10),
 '- [x] 2024-01-0', cast({k} % 9 + 1 AS {s}), ' - done it', chr(10), '  - [ ] call ⏳ 2024-05-01', chr(10), 'see [[', cast({k} * 7 % 500 AS {s}), '|name]] ![[img', cast({k} % 5 AS {s}), '.png]] [a](x', cast({k} % 6 AS {s}), '.md) https://e.org/', cast({k} % 11 AS {s}), '.')"""
MARKED = "(SELECT cast(doc_id AS VARCHAR) AS id, " + MARKUP.format(k="doc_id", s="VARCHAR") + " AS body FROM documents)"
LINKS = "(SELECT cast(doc_id AS VARCHAR) AS source_id, CASE WHEN doc_id % 2 = 0 THEN cast(doc_id * 7 % 1200 AS VARCHAR) ELSE 'docs/' || cast(doc_id * 11 % 1200 AS VARCHAR) || '.md' END AS target FROM documents)"
ALIASES = "(SELECT cast(doc_id AS VARCHAR) AS document_id, 'alias' || cast(doc_id AS VARCHAR) AS alias FROM documents WHERE doc_id % 10 = 0)"
DOCS = "(SELECT cast(doc_id AS VARCHAR) AS id, 'docs/' || cast(doc_id AS VARCHAR) || '.md' AS path, lang AS type FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(400)).cast("int")), "yyyy-MM-dd")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 40).alias("title"), day.alias("date"), F.col("lang").alias("type"), F.col("text").alias("body"), F.array("lang", "source").alias("tags"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("2024-12-31").alias("updated_at"), "doc_id",
    )


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("body", F.expr(MARKUP.format(k="doc_id", s="STRING")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    target = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") * 7 % 1200).cast("string")).otherwise(F.concat(F.lit("docs/"), (F.col("doc_id") * 11 % 1200).cast("string"), F.lit(".md")))
    return d.select(F.col("doc_id").cast("string").alias("source_id"), target.alias("target"))


def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").filter("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("alias"), F.col("doc_id").cast("string")).alias("alias"))


@query("SRC_01_scan", "SELECT cast(doc_id AS VARCHAR) AS id, substr(text, 1, 40) AS title, lang AS type FROM documents")
def _(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", "title", "type")


@query("SRC_02_point_read", "SELECT cast(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents WHERE doc_id = 17")
def _(spark, sf_dir):
    return corpus(spark, sf_dir).filter("doc_id = 17").select("id", F.length("body").cast("long").alias("n"))


@query("SRC_03_batch_read", "SELECT cast(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IN (3, 5, 8)")
def _(spark, sf_dir):
    return corpus(spark, sf_dir).filter(F.col("doc_id").isin([3, 5, 8, -1])).select("id")


@query("SRC_06_change_feed", "SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'Deleted' WHEN doc_id % 10 = 1 THEN 'Added' ELSE 'Modified' END AS kind FROM (SELECT doc_id, 'docs/' || cast(doc_id AS VARCHAR) || '.md' AS path FROM documents) t WHERE doc_id % 10 IN (0, 1, 2)")
def _(spark, sf_dir):
    d = corpus(spark, sf_dir).withColumn("content", F.col("body"))
    return parse.changes(d.filter("doc_id % 10 <> 1"), d.filter("doc_id % 10 <> 0").withColumn("content", F.when(F.expr("doc_id % 10 = 2"), F.concat("body", F.lit("!"))).otherwise(F.col("body"))))


sql("SRC_11_scan_type", "SELECT cast(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'fr' ORDER BY id".replace("cast(doc_id AS VARCHAR)", "concat('', doc_id)"))
sql("SRC_12_scan_tag", "SELECT DISTINCT doc_id FROM (SELECT doc_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source AS tag FROM documents) t WHERE tag = 'src3'")


@query("SRC_13_backlinks", f"SELECT DISTINCT source_id FROM {LINKS} WHERE target = '14'")
def _(spark, sf_dir):
    return graph.backlinks(edges(spark, sf_dir), "14")


@query("PRS_04_hashtags", f"SELECT id, unnest(['t' || cast(cast(id AS INT) % 7 AS VARCHAR), 'area/a' || cast(cast(id AS INT) % 3 AS VARCHAR)]) AS tag FROM {MARKED}")
def _(spark, sf_dir):
    return marked(spark, sf_dir).select("id", F.explode(parse.body_tags(F.col("body"))).alias("tag"))


@query("PRS_05_checkboxes", f"SELECT id AS document_id, 'done' AS state, 'done it' AS content, '2024-01-0' || cast(cast(id AS INT) % 9 + 1 AS VARCHAR) AS date, NULL::VARCHAR AS due_date, 4 AS line_number, 0 AS indent_level FROM {MARKED} UNION ALL SELECT id, 'open', 'call ⏳ 2024-05-01', NULL, '2024-05-01', 5, 2 FROM {MARKED}")
def _(spark, sf_dir):
    return parse.checkbox_table(marked(spark, sf_dir))


@query("PRS_06_fields", f"SELECT id AS document_id, 'status' AS key, regexp_extract(body, 'status:: ([^\\n]*)', 1) AS value FROM {MARKED}")
def _(spark, sf_dir):
    return parse.field_table(marked(spark, sf_dir)).select("document_id", "key", "value")


LINK_SQL = f"""SELECT id AS source_id, regexp_extract(body, '!\\[\\[([^\\]|]+)', 1) AS target, 'embed' AS kind FROM {MARKED}
UNION ALL SELECT id, regexp_extract(body, '[^!]\\[\\[([^\\]|]+)', 1), 'wikilink' FROM {MARKED}
UNION ALL SELECT id, regexp_extract(body, '\\]\\(([^)]+)', 1), 'markdown' FROM {MARKED}
UNION ALL SELECT id, rtrim(regexp_extract(body, 'https://\\S+'), '.'), 'url' FROM {MARKED}"""


@query("PRS_07_11_links", LINK_SQL)
def _(spark, sf_dir):
    return parse.link_table(marked(spark, sf_dir)).select("source_id", "target", "kind")


@query("PRS_13_rename_links", f"SELECT id, replace(body, '![[img1.png]]', '![[new.png]]') AS body FROM {MARKED} WHERE cast(id AS INT) % 5 = 1")
def _(spark, sf_dir):
    return marked(spark, sf_dir).filter("doc_id % 5 = 1").select("id", parse.rename_links(F.col("body"), "img1.png", "new.png").alias("body"))


@query("PRS_16_tag_table", f"SELECT id AS document_id, tag, source FROM (SELECT cast(doc_id AS VARCHAR) AS id, unnest([lang, source]) AS tag, 'frontmatter' AS source FROM documents UNION ALL SELECT id, unnest(['t' || cast(cast(id AS INT) % 7 AS VARCHAR), 'area/a' || cast(cast(id AS INT) % 3 AS VARCHAR)]), 'body' FROM {MARKED})")
def _(spark, sf_dir):
    return parse.tag_table(marked(spark, sf_dir))


sql("FLT_11_tags_contains", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents t WHERE t.doc_id = d.doc_id AND t.source = 'src2')")
sql("FLT_12_tags_contains_all", "SELECT doc_id FROM (SELECT doc_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source AS tag FROM documents) t WHERE tag IN ('en', 'src2') GROUP BY doc_id HAVING count(DISTINCT tag) = 2")
sql("FLT_13_tags_contains_any", "SELECT DISTINCT doc_id FROM (SELECT doc_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source AS tag FROM documents) t WHERE tag IN ('fr', 'src2')")
sql("FLT_17_tag_prefix", "SELECT DISTINCT doc_id FROM documents WHERE source ILIKE 'SRC1%'")
sql("FLT_22_typed_values", "SELECT event_id, CASE WHEN lower(event_type) IN ('click', 'view') THEN true ELSE false END AS seen, try_cast(event_type AS BIGINT) AS number FROM events")

# --- joins on references ----------------------------------------------------------------------

sql("JN_10_route_union", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000 UNION SELECT c2.c_custkey FROM customer c2 WHERE c2.c_acctbal > 9800)")
sql("JN_11_shared_tags", "SELECT b.n_nationkey, count(*) AS shared FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 1 AND b.n_nationkey <> 1 GROUP BY b.n_nationkey")
sql("JN_12_left_anti", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL")
sql("JN_16_expand_reference", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")


@query("JN_15_resolve", f"SELECT id, path FROM {DOCS} WHERE id = '12'")
def _(spark, sf_dir):
    return graph.resolved(spark.createDataFrame([("12",)], "target string"), corpus(spark, sf_dir), alias_table(spark, sf_dir)).select("id", "path")


@query("JN_17_expand_plural", "SELECT c_custkey, string_agg(cast(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS orders FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) JOIN customer ON c_custkey = o_custkey WHERE n <= 3 GROUP BY c_custkey")
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))), 1, 3).alias("top"))
    return read(spark, sf_dir, "customer").join(o, "c_custkey").select("c_custkey", F.array_join(F.transform("top", lambda x: x["k"].cast("string")), ",").alias("orders"))


# --- graph ------------------------------------------------------------------------------------

NAMES = f"(SELECT id AS name, id FROM {DOCS} UNION SELECT path, id FROM {DOCS} UNION SELECT alias, document_id FROM {ALIASES})"


@query("GR_04_broken_links", f"SELECT DISTINCT source_id, target FROM {LINKS} l WHERE NOT EXISTS (SELECT 1 FROM documents WHERE cast(doc_id AS VARCHAR) = l.target)")
def _(spark, sf_dir):
    return graph.broken_links(edges(spark, sf_dir), corpus(spark, sf_dir))


@query("GR_09_orphans", f"SELECT d.id, (SELECT count(*) FROM {LINKS} l WHERE l.source_id = d.id) AS outgoing FROM {DOCS} d WHERE NOT EXISTS (SELECT 1 FROM {LINKS} l JOIN {NAMES} n ON n.name = l.target WHERE n.id = d.id)")
def _(spark, sf_dir):
    return graph.orphans(corpus(spark, sf_dir), edges(spark, sf_dir), alias_table(spark, sf_dir))


@query("GR_12_link_density", f"SELECT d.id, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM {DOCS} d LEFT JOIN (SELECT n.id, count(DISTINCT source_id) AS n FROM {LINKS} l JOIN {NAMES} n ON n.name = l.target GROUP BY n.id) i ON i.id = d.id LEFT JOIN (SELECT source_id, count(*) AS n FROM {LINKS} GROUP BY 1) o ON o.source_id = d.id")
def _(spark, sf_dir):
    return graph.link_density(corpus(spark, sf_dir), edges(spark, sf_dir), alias_table(spark, sf_dir))


@query("GR_07_tag_similarity", "WITH t AS (SELECT cast(doc_id AS VARCHAR) AS id, unnest([lang, source]) AS tag FROM documents) SELECT b.id, round(count(*) / (4.0 - count(*)), 6) AS score FROM t a JOIN t b ON a.tag = b.tag WHERE a.id = '10' AND b.id <> '10' GROUP BY b.id")
def _(spark, sf_dir):
    tags = corpus(spark, sf_dir).select(F.col("id").alias("document_id"), F.explode("tags").alias("tag"))
    return graph.tag_similarity(tags, "10").select("id", F.round("score", 6).alias("score"))


@query("GR_10_stale", "SELECT id, days - most AS days_stale FROM (SELECT cast(doc_id AS VARCHAR) AS id, CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 200 END AS most, date_diff('day', DATE '2024-01-01' + cast(doc_id % 400 AS INT), DATE '2024-12-31') AS days FROM documents) WHERE days > most")
def _(spark, sf_dir):
    return graph.stale(corpus(spark, sf_dir), {"en": 30, "fr": 200}, "2024-12-31").select("id", F.col("days_stale").cast("long").alias("days_stale"))


@query("GR_11_recent", "SELECT cast(doc_id AS VARCHAR) AS id, strftime(DATE '2024-01-01' + cast(doc_id % 400 AS INT), '%Y-%m-%d') AS effective FROM documents WHERE doc_id % 400 >= 300")
def _(spark, sf_dir):
    return graph.recent(corpus(spark, sf_dir), "2024-10-27")


@query("GR_14_16_sequence_paths", "WITH RECURSIVE p AS (SELECT DISTINCT conv_id * 1000 + turn AS id, CASE WHEN EXISTS (SELECT 1 FROM conversations q WHERE q.conv_id = c.conv_id AND q.turn = c.turn - 1) THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations c), walk AS (SELECT id, 0 AS depth, cast(id AS VARCHAR) AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.id, w.depth + 1, w.path || ',' || cast(p.id AS VARCHAR) FROM walk w JOIN p ON p.parent = w.id) SELECT * FROM walk")
def _(spark, sf_dir):
    node = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")).distinct()
    parents = node.join(node.select((F.col("id") + 1).alias("id"), F.col("id").alias("parent")), "id", "left")
    return graph.sequence_paths(parents)


sql("GR_13_children", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
sql("GR_17_broken_sequences", "SELECT conv_id, turn FROM conversations c WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations q WHERE q.conv_id = c.conv_id AND q.turn = c.turn - 1)")
sql("GR_18_alias", "SELECT c_custkey FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')")

# --- search -----------------------------------------------------------------------------------

TOKENS = "(SELECT cast(doc_id AS VARCHAR) AS id, substr(text, 1, 40) AS title, lang AS type, [lang, source] AS tags, regexp_extract_all(lower(concat_ws(' ', substr(text, 1, 40), text)), '[\\p{L}\\p{N}]+') AS w FROM documents)"


def hits(spark, sf_dir, text):
    c = corpus(spark, sf_dir)
    return search.search(c, text, {"tag": F.col("tags"), "type": F.col("type"), "title": F.col("title")})


@query("SRCH_06_boolean", f"SELECT id FROM {TOKENS} WHERE (list_contains(w, 'the') AND list_contains(w, 'erent')) OR (list_contains(w, 'idiot') AND NOT list_contains(w, 'of'))")
def _(spark, sf_dir):
    return hits(spark, sf_dir, "the erent OR idiot AND NOT of").select("id")


@query("SRCH_06_phrase", f"SELECT id FROM {TOKENS} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def _(spark, sf_dir):
    return hits(spark, sf_dir, '"of the"').select("id")


@query("SRCH_09_fields", f"SELECT id FROM {TOKENS} WHERE list_contains(w, 'the') AND list_contains(tags, 'src3') AND NOT list_contains(tags, 'fr') AND contains(type, 'e')")
def _(spark, sf_dir):
    return hits(spark, sf_dir, "the tag=src3 NOT tag=fr type=e").select("id")


@query("SRCH_07_bm25", f"WITH t AS MATERIALIZED (SELECT id, title, len(w) AS len, len(list_filter(w, lambda x: x = 'idiot')) AS a, len(list_filter(w, lambda x: x = 'clown')) AS b FROM {TOKENS}), s AS (SELECT count(*) AS n, avg(len) AS avg, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM t) SELECT id, title, round(-(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avg)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS rank FROM t, s WHERE a > 0 OR b > 0")
def _(spark, sf_dir):
    return hits(spark, sf_dir, "idiot OR clown")


# --- writes and merging -----------------------------------------------------------------------

@query("MRG_02_list_merge", "SELECT doc_id, 'c,' || lang || ',y,z' || cast(doc_id % 3 AS VARCHAR) AS merged FROM documents")
def _(spark, sf_dir):
    base, ours, theirs = F.array(F.lit("a"), F.lit("b"), F.lit("c"), "lang"), F.array(F.lit("a"), F.lit("c"), "lang", F.concat(F.lit("z"), (F.col("doc_id") % 3).cast("string"))), F.array(F.lit("b"), F.lit("c"), F.lit("y"), "lang")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(merge.merged_list(base, ours, theirs), ",").alias("merged"))


@query("MRG_01_last_write", "SELECT user_id, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS event_type FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return graph.last_write(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("MRG_03_scalar_merge", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN 'ours' WHEN c_custkey % 4 = 2 THEN 'theirs' ELSE 'theirs' END AS merged FROM customer")
def _(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    ours, theirs = F.when(k.isin(1, 3), "ours").otherwise(F.col("c_mktsegment")), F.when(k.isin(2, 3), "theirs").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", merge.merged_scalar(F.col("c_mktsegment"), ours, theirs).alias("merged"))


@query("MRG_08_singleton_sweep", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1 THEN 'keep' ELSE 'quarantine' END AS fate FROM events")
def _(spark, sf_dir):
    return merge.singleton_sweep(read(spark, sf_dir, "events"), "event_type", ["ts"], "event_id").select("event_id", "fate")


@query("DML_02_insert_or_nothing", "SELECT c_custkey + 1000000 AS c_custkey FROM customer WHERE c_custkey % 5 = 0")
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    batch = c.filter("c_custkey % 10 = 0").unionByName(c.filter("c_custkey % 5 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)).unionByName(c.filter("c_custkey % 7 = 0"))
    return merge.insert_or_nothing(batch, c, ["c_custkey"], "c_name").select("c_custkey")


@query("DML_03_next_per_partition", "SELECT o_orderkey, m + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM (SELECT o_orderkey, o_custkey, coalesce((SELECT max(c_nationkey) FROM customer WHERE c_custkey = o_custkey), 0) AS m FROM orders)")
def _(spark, sf_dir):
    have = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("pos"))
    return merge.numbered(read(spark, sf_dir, "orders"), have, "pos", "o_orderkey", "o_custkey").select("o_orderkey", F.col("pos").cast("long").alias("pos"))


@query("DML_04_05_validation", "SELECT c_custkey, 'balance' AS error FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
def _(spark, sf_dir):
    return merge.violations(read(spark, sf_dir, "customer"), "c_custkey", {"balance": F.col("c_acctbal") < 0, "segment": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE")})


sql("DML_06_reference_check", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")


@query("DML_07_unique", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf_dir):
    return merge.duplicates(read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


sql("DML_09_update", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal * 2, 4) ELSE c_acctbal END AS c_acctbal FROM customer")
sql("DML_10_delete", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")


@query("DML_11_cascade", "SELECT 'r' || r_regionkey::VARCHAR AS id FROM region WHERE r_name = 'ASIA' UNION SELECT 'n' || n_nationkey::VARCHAR FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' UNION SELECT 'c' || c_custkey::VARCHAR FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def _(spark, sf_dir):
    def pair(table, child, parent, a, b):
        return read(spark, sf_dir, table).select(F.concat(F.lit(a), F.col(child).cast("string")).alias("child"), F.concat(F.lit(b), F.col(parent).cast("string")).alias("parent"))

    tree = pair("nation", "n_nationkey", "n_regionkey", "n", "r").unionByName(pair("customer", "c_custkey", "c_nationkey", "c", "n"))
    roots = read(spark, sf_dir, "region").filter("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return closure(tree, roots)


@query("MAT_03_inference", "SELECT event_type AS type, 'value' AS key, 'REAL' AS inferred FROM events GROUP BY 1 UNION ALL SELECT event_type, 'user', 'INTEGER' FROM events GROUP BY 1 UNION ALL SELECT event_type, 'props', 'TEXT' FROM events GROUP BY 1")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    pairs = F.explode(F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("user"), F.col("user_id").cast("string"), F.lit("props"), F.col("props")))
    return inferred_schema(e.select(F.col("event_type").alias("type"), pairs))


@query("MAT_04_incremental", "SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 0")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return parse.merge_snapshot(d, d.filter("doc_id % 10 = 2").withColumn("lang", F.lit("new")), d.filter("doc_id % 10 = 0"), "doc_id")


# --- functions --------------------------------------------------------------------------------

@query("FN_01_11_scalars", "SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'F') IS NULL THEN NULL ELSE least(o_custkey, o_orderkey) END AS lo, coalesce(nullif(o_orderstatus, 'F'), 'none') AS state, length(o_orderpriority) AS len, upper(o_orderpriority) AS up, o_custkey // 7 AS part, o_custkey % 7 AS rest, 'integer' AS kind, 'real' AS kind2 FROM orders")
def _(spark, sf_dir):
    status = F.nullif("o_orderstatus", F.lit("F"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(status.isNotNull(), scalars.scalar_min(F.col("o_custkey"), F.col("o_orderkey"))).alias("lo"), F.coalesce(status, F.lit("none")).alias("state"), F.length("o_orderpriority").cast("long").alias("len"),
        scalars.ascii_upper(F.col("o_orderpriority")).alias("up"), F.expr("o_custkey div 7").alias("part"), (F.col("o_custkey") % 7).alias("rest"), scalars.type_name(F.col("o_custkey")).alias("kind"), scalars.type_name(F.col("o_totalprice")).alias("kind2"),
    )


@query("FN_20_29_helpers", "SELECT c_custkey, lower(replace(c_name, '#', '-x')) AS key, 'My note' || c_custkey::VARCHAR AS title, 1 AS yes, '2024-03-07' AS day, 'image/png' AS media, c_mktsegment || ' for ' || c_custkey::VARCHAR AS named FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", scalars.kebab_case(F.replace("c_name", F.lit("#"), F.lit(" x"))).alias("key"), scalars.title_from_path(F.concat(F.lit("docs/20240307120000-my_note"), k, F.lit(".md"))).alias("title"), scalars.boolean_value(F.lit("Yes")).alias("yes"),
        scalars.date_from_id(F.lit("20240307120000")).alias("day"), scalars.media_type(F.concat(F.lit("a."), F.lit("PNG"))).alias("media"), scalars.template_title("{seg} for {id} {gone}", {"seg": F.col("c_mktsegment"), "id": k}, F.lit("customer"), k).alias("named"),
    )


# --- relational operators through SQL ---------------------------------------------------------

for name, text in {
    "DEL_01_projection": "SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders",
    "DEL_02_where": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urgent%'",
    "DEL_03_inner_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "DEL_04_theta_join": "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey",
    "DEL_05_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "DEL_06_multi_join": "SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name",
    "DEL_07_full_join": "SELECT n_nationkey, s_suppkey FROM nation FULL OUTER JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0",
    "DEL_08_semi_anti": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "DEL_09_group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "DEL_10_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15",
    "DEL_11_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "DEL_12_count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "DEL_13_filter_clause": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, coalesce(sum(o_totalprice) FILTER (WHERE o_totalprice < 0), 0.0) AS total FROM orders GROUP BY o_orderstatus",
    "DEL_14_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "DEL_15_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders",
    "DEL_16_windows": "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)",
    "DEL_17_frames": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi FROM orders",
    "DEL_18_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "DEL_19_union": "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region",
    "DEL_20_set_operations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "DEL_21_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, round(total, 2) AS total FROM big WHERE total > 1000000",
    "DEL_23_subqueries": "SELECT o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') t WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "DEL_24_case_cast": "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 0 AND 100000 THEN 'small' WHEN o_totalprice IS NULL THEN 'none' ELSE 'large' END AS size, cast(o_orderkey AS DOUBLE) AS d FROM orders",
    "DEL_25_strings_math": "SELECT c_custkey, substr(c_name, 1, 8) AS a, replace(c_name, '#', '-') AS b, round(sqrt(abs(c_acctbal)), 6) AS c, ltrim(concat('  ', c_mktsegment)) AS d FROM customer",
}.items():
    sql(name, text)
sql("DEL_22_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, count(*) AS c FROM t JOIN nation ON n_nationkey < n GROUP BY n")
sql("DEL_26_dates", "SELECT date_format(o_orderdate, 'yyyy-MM') AS month, count(*) AS n FROM orders GROUP BY 1", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
sql("DEL_27_json", "SELECT event_id, cast(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


@query("STR_04_type_changes", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS kind FROM events WHERE event_type <> 'view'")
def _(spark, sf_dir):
    from inkfold.streaming.changes import change_events

    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    found = change_events(read(spark, sf_dir, "events"), kind, F.col("event_id"), F.col("event_type"), F.col("ts"))
    return found.filter("document_type <> 'view'").select(F.col("document_id").alias("event_id"), "kind")



# --- zones of files ---------------------------------------------------------------------------


@query("PRS_01_zones", """SELECT doc_id AS id, 'id: ' || doc_id AS raw_frontmatter, md5(rtrim(replace(text, chr(13) || chr(10), chr(10)), chr(13))) AS body_md5, '- source:: ' || source AS reference_section FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""")
def zones_of_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL AND source IS NOT NULL")
    content = F.concat(F.lit("---\nid: "), "doc_id", F.lit("\n---\n"), "text", F.lit("\n---\n- source:: "), "source", F.lit("\n"))
    parts = docs.select(F.col("doc_id").alias("id"), zones.zones(content).alias("z"))
    return parts.select("id", "z.raw_frontmatter", F.md5("z.body").alias("body_md5"), "z.reference_section")


@query("PRS_02_frontmatter", """SELECT doc_id AS id, lang, n_chars FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL""")
def frontmatter_of_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("lang IS NOT NULL AND n_chars IS NOT NULL")
    raw = F.concat(F.lit("id: "), "doc_id", F.lit("\nlang: '"), F.replace("lang", F.lit("'"), F.lit("''")), F.lit("'\nn_chars: "), "n_chars")
    meta = docs.select(zones.frontmatter(raw, F.lit("x.md")).alias("m"))
    return meta.select(F.col("m.id").cast("long").alias("id"), F.get_json_object("m.meta", "$.lang").alias("lang"), F.get_json_object("m.meta", "$.n_chars").cast("long").alias("n_chars"))


@query("PRS_03_sections", """SELECT doc_id AS id, 'Lang ' || lang AS heading, 2 AS level, md5(rtrim(replace(text, chr(13) || chr(10), chr(10)), chr(13))) AS content_md5 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def sections_of_bodies(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang IS NOT NULL")
    body = F.concat(F.lit("## Lang "), "lang", F.lit(" ##\n"), "text", F.lit("\n"))
    found = docs.select(F.col("doc_id").alias("id"), F.explode(zones.sections(body)).alias("s"))
    return found.select("id", "s.heading", F.col("s.level").cast("int").alias("level"), F.md5("s.content").alias("content_md5"))


@query("SRCH_08_snippet")
def snippets_of_hits(spark, sf_dir):
    tree = search.parse("idiot OR clown")
    found = corpus(spark, sf_dir).filter(search.matches(tree, search.words(F.concat_ws(" ", "title", "body")), {}))
    return found.select("id", snippet(F.col("body"), search.terms_of(tree)).alias("snippet"))


# --- stems and consistency fixes --------------------------------------------------------------


@query("SRCH_06_stemmed")
def stemmed_hits(spark, sf_dir):
    return search.search(corpus(spark, sf_dir), "idiots OR clowning", {}, stemming=True)


FIX_SQL = """WITH d AS (SELECT cast(doc_id AS VARCHAR) AS id, doc_id % 4 AS k FROM documents)
SELECT id, 'cross_zone' AS fix, 'error' AS severity, 'dueDate' AS detail FROM d WHERE k = 0
UNION ALL SELECT id, 'default', 'warning', 'type=note' FROM d WHERE k = 1 UNION ALL SELECT id, 'default', 'warning', 'status=open' FROM d
UNION ALL SELECT id, 'title_derived', 'warning', 'Note ' || id FROM d WHERE k = 2 UNION ALL SELECT id, 'tags_hash', 'info', '#b' FROM d
UNION ALL SELECT id, 'tags_dedup', 'info', 'B' FROM d UNION ALL SELECT id, 'tags_sort', 'info', '' FROM d
UNION ALL SELECT id, 'title_trimmed', 'info', 'draft ' || id FROM d WHERE k <> 2 UNION ALL SELECT id, 'title_capital', 'info', 'draft ' || id FROM d WHERE k <> 2
UNION ALL SELECT id, 'key_kebab', 'info', 'dueDate' FROM d WHERE k = 0"""


@query("FIX_01_08_consistency", FIX_SQL)
def consistency(spark, sf_dir):
    k, key = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    due = k == 0
    docs = read(spark, sf_dir, "documents").select(
        key.alias("id"), F.concat(F.lit("docs/20240101000000-note-"), key, F.lit(".md")).alias("path"), F.when(k != 2, F.concat(F.lit(" draft "), key)).alias("title"), F.when(k != 1, "note").alias("type"),
        F.array(F.lit("#b"), F.lit("B"), F.lit("a")).alias("tags"), F.when(due, F.create_map(F.lit("dueDate"), F.lit("x"))).alias("meta"), F.when(due, F.array(F.lit("dueDate"))).alias("inline_keys"), F.lit(None).cast("string").alias("h1"),
    )
    return fixers.fixes(docs, {"status": "open"})


@query("FIX_02_03_tags", "SELECT cast(doc_id AS VARCHAR) AS id, 'a,b,' || lower(source) AS tags FROM documents WHERE source IS NOT NULL AND source > 'b'")
def tags_put_right(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("source IS NOT NULL AND source > 'b'")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.array_join(fixers.fixed_tags(F.array(F.lower("source"), F.lit("#b"), F.lit("B"), F.lit("a"), F.lit("#A"))), ",").alias("tags"))
