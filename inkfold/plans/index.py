"""Search over an inverted index: postings are written once, sorted and dealt out by term; a query reads those of its own terms only.

A query is planned first: field conditions at the top become filters, each a semi or anti join with the ids that a
route finds (tags, core columns, typed columns, references, fields); the rest is matched against the postings.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.snippets import snippet
from inkfold.functions.stemming import stem, stems
from inkfold.plans.catalog import Catalog, Column_, Table
from inkfold.plans.search import Field, Group, Not, SearchError, Term, parse, query_words, words
from inkfold.plans.where import like

# The columns of the index, in order, and those of documents that field conditions can name.
COLUMNS = ("title", "body", "tags", "fields")
CORE = ("id", "title", "type", "date", "updated_at")
BUCKETS = 64


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def index_texts(docs: DataFrame, tags: DataFrame, fields: DataFrame) -> DataFrame:
    """id and the four texts of each document: title, body, its frontmatter tags, its plain fields but aliases and attachments."""
    front = tags.filter("source = 'frontmatter'") if "source" in tags.columns else tags
    of_tags = front.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))
    plain = fields.filter(~F.col("key").rlike(r"^(aliases|attachments)(\b|\[|\.)") & ~F.col("key").rlike(r"[.\[]"))
    of_fields = plain.groupBy(F.col("document_id").alias("id")).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: x["value"])).alias("fields"))
    return docs.select("id", "title", "body").join(of_tags, "id", "left").join(of_fields, "id", "left")


def postings(texts: DataFrame, stemming: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """term, id, tf (of each column), places (column * 2^32 + position, sorted), bucket."""
    def placed(k: int, column: str) -> Column:
        own = words(F.coalesce(F.col(column), F.lit("")))
        return F.transform(stems(own) if stemming else own, lambda w, i: F.struct(w.alias("term"), (F.lit(k << 32) + i).cast("long").alias("place")))

    parts = [placed(k, c) for k, c in enumerate(COLUMNS)]
    rows = texts.select("id", F.explode(F.concat(*parts)).alias("w")).select("id", "w.term", "w.place")
    tf = F.array(*(F.count_if(F.col("place").bitwiseAND(F.lit(7 << 32)) == F.lit(k << 32)).cast("int") for k in range(len(COLUMNS))))
    out = rows.groupBy("term", "id").agg(tf.alias("tf"), F.array_sort(F.collect_list("place")).alias("places"))
    return out.withColumn("bucket", bucket_of(F.col("term"), buckets))


@dataclass
class Index:
    """postings; lengths (id, len); n documents and their mean length; docs, tags and fields for filters; the catalog of typed tables."""

    postings: DataFrame
    lengths: DataFrame
    n: int
    mean: float
    docs: DataFrame
    tags: DataFrame
    fields: DataFrame
    catalog: Catalog | None = None
    stemming: bool = False
    buckets: int = BUCKETS
    boosts: dict[str, float] = field(default_factory=dict)  # greatest column boost of each type


def boosts_of(catalog: Catalog | None) -> dict[str, float]:
    return {t.name: max((c.boost for c in t.columns.values()), default=1.0) for t in catalog.tables.values()} if catalog else {}


def build(docs: DataFrame, tags: DataFrame, fields: DataFrame, path: str, catalog: Catalog | None = None, stemming: bool = False, buckets: int = BUCKETS) -> Index:
    """Writes postings (a folder for each bucket, sorted by term) and lengths under path."""
    made = postings(index_texts(docs, tags, fields), stemming, buckets)
    made.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    spark = docs.sparkSession
    stored = spark.read.parquet(f"{path}/postings")
    lens = stored.groupBy("id").agg(F.sum(F.size("places")).cast("long").alias("len"))
    docs.select("id").join(lens, "id", "left").select("id", F.coalesce("len", F.lit(0)).alias("len")).write.mode("overwrite").parquet(f"{path}/lengths")
    return opened(spark, path, docs, tags, fields, catalog, stemming, buckets)


def opened(spark: SparkSession, path: str, docs: DataFrame, tags: DataFrame, fields: DataFrame, catalog: Catalog | None = None, stemming: bool = False, buckets: int = BUCKETS) -> Index:
    stored, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    all_of = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    return Index(stored, lengths, all_of.n, float(all_of["mean"] or 1), docs, tags, fields, catalog, stemming, buckets, boosts_of(catalog))


# --- plans ------------------------------------------------------------------------------------


@dataclass
class Plan:
    filters: list[Field] = field(default_factory=list)
    negated: list[Field] = field(default_factory=list)
    rest: object | None = None


def plan(query: str) -> Plan:
    """Field conditions at the top, those that are negated, and what is left for the postings."""
    if query.strip() in ("*", "**", ".*"):
        raise SearchError("a bare wildcard finds nothing; leave the query empty and give filters")
    tree = parse(query)
    items = list(tree.items) if isinstance(tree, Group) and tree.kind == "and" else [tree]
    out, rest = Plan(), []
    for item in items:
        if isinstance(item, Field):
            out.filters.append(item)
        elif isinstance(item, Not) and isinstance(item.item, Field):
            if item.item.name != "tag":
                raise SearchError(f"NOT on a field is for tags only: {item.item.name}")
            out.negated.append(item.item)
        else:
            rest.append(item)
    if rest:
        out.rest = rest[0] if len(rest) == 1 else Group("and", tuple(rest))
    if not (out.filters or out.negated or rest):
        raise SearchError("nothing to search for")
    return out


def compare(value: Column, op: str, wanted) -> Column:
    text = value.cast("string")
    return text == wanted if op == "eq" else text.isin(list(wanted)) if op == "in" else like(text, "%", wanted, "%")


def union(frames: Iterable[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


class Router:
    """Ids (id) of documents for one condition on a field."""

    def __init__(self, index: Index, types: list[str] | None):
        self.index, self.types = index, types

    def tables(self) -> list[Table]:
        found = self.index.catalog.tables.values() if self.index.catalog else []
        return [t for t in found if not self.types or t.name in self.types]

    def ids(self, name: str, op: str, value) -> DataFrame:
        index = self.index
        if op == "in" and not value:
            return index.docs.select("id").limit(0)
        if name == "tag":
            return index.tags.filter(compare(F.col("tag"), op, value)).select(F.col("document_id").alias("id"))
        if name in CORE:
            return index.docs.filter(compare(F.col(name), op, value)).select("id")
        typed = [(t, t.columns[name]) for t in self.tables() if name in t.columns]
        if typed:
            return union(self.typed(t, c, op, value) for t, c in typed)
        routes = union(r for t in self.tables() for r in self.routes(t, name, op, value))
        if routes is not None:
            return routes
        return index.fields.filter((F.col("key") == name) & compare(F.col("value"), op, value)).select(F.col("document_id").alias("id"))

    def frame(self, t: Table) -> DataFrame:
        return self.index.catalog.frame(t.name)

    def titled(self, target: str, op: str, value) -> DataFrame:
        """_ref of documents of a type whose search key (else title) meets the condition."""
        t = self.index.catalog.tables[target]
        key = t.search_key or ("title" if "title" in self.frame(t).columns else t.key)
        return self.frame(t).filter(compare(F.col(key), op, value)).select(F.col(t.key).cast("string").alias("_ref"))

    def typed(self, t: Table, c: Column_, op: str, value) -> DataFrame:
        rows = self.frame(t)
        own = F.col(t.key).cast("string").alias("id")
        if c.references in (self.index.catalog.tables if self.index.catalog else ()) and op == "contains":
            refs = rows.select(own, F.explode(F.split(F.col(c.name).cast("string"), ",")).alias("_ref"))
            return refs.join(self.titled(c.references, op, value), "_ref", "left_semi").select("id")
        return rows.filter(compare(F.col(c.name), op, value)).select(own)

    def routes(self, t: Table, name: str, op: str, value) -> list[DataFrame]:
        """Through {name}_id on the type itself, and through any table that holds {type}_id and {name}_id or {name}."""
        out = []
        catalog = self.index.catalog
        own = f"{name}_id"
        if own in t.columns and t.columns[own].references in catalog.tables:
            out.append(self.typed(t, t.columns[own], op, value))
        for junction in catalog.frames.values():
            other = own if own in junction.columns else name if name in junction.columns else None
            if f"{t.name}_id" in junction.columns and other and other != f"{t.name}_id":
                rows = junction.select(F.col(f"{t.name}_id").cast("string").alias("id"), F.col(other).cast("string").alias("_ref"))
                if name in catalog.tables and op == "contains":
                    out.append(rows.join(self.titled(name, op, value), "_ref", "left_semi").select("id"))
                else:
                    out.append(rows.filter(compare(F.col("_ref"), op, value)).select("id"))
        return out


# --- matching ---------------------------------------------------------------------------------


def leaves(tree) -> list[list[str]]:
    """Word lists of all terms; a field condition inside counts by its value."""
    match tree:
        case Term(text, _) | Field(_, text):
            return [query_words(text)]
        case Not(item):
            return leaves(item)
        case Group(_, items):
            return [x for i in items for x in leaves(i)]
    return []


def wanted_words(tree) -> list[str]:
    """Words that count for the rank: those that are not negated."""
    match tree:
        case Not(_) | None:
            return []
        case Group(_, items):
            return list(dict.fromkeys(w for i in items for w in wanted_words(i)))
    return list(dict.fromkeys(w for x in leaves(tree) for w in x))


def terms_in(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the terms; the buckets and the terms are conditions on the scan."""
    spark = index.postings.sparkSession
    buckets = spark.range(1).select(*(bucket_of(F.lit(t), index.buckets).alias(f"b{k}") for k, t in enumerate(terms))).first() if terms else []
    return index.postings.filter(F.col("bucket").isin([int(b) for b in buckets]) & F.col("term").isin(terms))


def matching(index: Index, tree) -> DataFrame:
    """id of documents that match. One aggregation over the postings of all its terms; documents with none of them are looked at only
    if the query can be met without any."""
    folded = (lambda ws: [stem(w) for w in ws]) if index.stemming else (lambda ws: ws)
    every = list(dict.fromkeys(w for x in leaves(tree) for w in folded(x)))
    if not every:
        raise SearchError("nothing to search for")
    number = {w: k for k, w in enumerate(every)}
    found = terms_in(index, every).groupBy("id").agg(*(F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{k}") for w, k in number.items()))

    def holds(t, places) -> Column:
        match t:
            case Term(text, _) | Field(_, text):
                own = folded(query_words(text))
                if not own:
                    raise SearchError("nothing to search for")
                first = places(number[own[0]])
                if len(own) == 1:
                    return first.isNotNull()
                rest = [places(number[w]) for w in own[1:]]
                run = F.exists(first, lambda p: functools.reduce(operator.and_, [F.array_contains(r, p + k) for k, r in enumerate(rest, 1)]))
                return functools.reduce(operator.and_, [x.isNotNull() for x in (first, *rest)]) & F.coalesce(run, F.lit(False))
            case Not(item):
                return ~holds(item, places)
            case Group(kind, items):
                return functools.reduce(operator.and_ if kind == "and" else operator.or_, [holds(i, places) for i in items])
        raise SearchError("not a query")

    def without_any(t) -> bool:
        match t:
            case Not(item):
                return not without_any(item)
            case Group(kind, items):
                return (all if kind == "and" else any)(without_any(i) for i in items)
        return False

    if without_any(tree):
        found = index.docs.select("id").join(found, "id", "left")
    return found.filter(holds(tree, lambda k: F.col(f"p{k}"))).select("id")


def scores(index: Index, terms: list[str], weights: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, rank (BM25 with all columns alike) and weighted (with the weights of columns) of documents with any of the terms; less is better."""
    own = list(dict.fromkeys(stem(t) for t in terms)) if index.stemming else terms
    if not own:
        return index.docs.select("id", F.lit(0.0).alias("rank"), F.lit(0.0).alias("weighted"))
    rows = terms_in(index, own)
    often = {r.term: r.n for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one for each term of the query
    idf = functools.reduce(lambda c, t: c.when(F.col("term") == t, max(math.log((index.n - often[t] + 0.5) / (often[t] + 0.5)), 1e-6)), often, F.when(F.lit(False), 0.0)).otherwise(0.0)
    rows = rows.join(index.lengths, "id")
    norm = k1 * (1 - b + b * F.col("len") / index.mean)

    def part(weight: dict[str, float]) -> Column:
        tf = functools.reduce(operator.add, [F.col("tf")[k] * float(weight.get(c, 1.0)) for k, c in enumerate(COLUMNS)])
        return F.sum(idf * tf * (k1 + 1) / (tf + norm))

    return rows.groupBy("id").agg(F.round(-part({}), 6).alias("rank"), F.round(-part(weights or {}), 6).alias("weighted"))


def search(index: Index, query: str = "", types: list[str] | None = None, tag: str | None = None, where: dict[str, dict] | None = None, limit: int | None = 50, offset: int = 0, snippets: bool = False) -> DataFrame:
    """id, title, type, rank (and snippet) of documents, best first; without text to match: by title, rank 0, empty snippet.

    where: eq, contains or in for each field, the first of these that is there. A single type boosts its fields."""
    router = Router(index, types)
    made = plan(query) if query.strip() else Plan()
    if not query.strip() and not (types or tag or where):
        raise SearchError("an empty query needs a filter")
    hits = index.docs.select("id", "title", "type", *(["body"] if snippets else []))
    if types:
        hits = hits.filter(F.col("type").isin(types))
    conditions = [("tag", "eq", tag)] if tag is not None else []
    for name, spec in (where or {}).items():
        op = next((o for o in ("eq", "contains", "in") if o in spec), None)
        if op:
            conditions.append((name, op, spec[op]))
    conditions += [(f.name, "eq" if f.name == "tag" else "contains", f.value) for f in made.filters]
    for name, op, value in conditions:
        hits = hits.join(router.ids(name, op, value), "id", "left_semi")
    for f in made.negated:
        hits = hits.join(router.ids("tag", "eq", f.value), "id", "left_anti")
    if made.rest is None:
        hits = hits.withColumn("rank", F.lit(0.0)).withColumn("weighted", F.lit(0.0))
        order = [F.col("title").asc_nulls_first(), F.col("id")]
    else:
        hits = hits.join(matching(index, made.rest), "id", "left_semi")
        words_ = wanted_words(made.rest)
        boost = index.boosts.get(types[0], 1.0) if types and len(types) == 1 else 1.0
        hits = hits.join(scores(index, words_, {"fields": boost}), "id", "left").na.fill(0.0, ["rank", "weighted"]) if words_ else hits.withColumn("rank", F.lit(0.0)).withColumn("weighted", F.lit(0.0))
        order = [F.col("weighted"), F.col("id")]
    hits = hits.orderBy(*order).offset(offset)
    hits = hits.limit(limit) if limit is not None else hits
    shown = [snippet(F.col("body"), wanted_words(made.rest)) if made.rest is not None else F.lit("")] if snippets else []
    return hits.select("id", "title", "type", "rank", *(s.alias("snippet") for s in shown))
