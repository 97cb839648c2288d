"""Links, suggestions, sequences and staleness over document and edge tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions.scalars import ascii_lower
from inkfold.functions.stemming import stems
from inkfold.operators.closure import walk_down
from inkfold.plans.index import Index, matching, scores
from inkfold.plans.search import Term, query_words, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def backlinks(links: DataFrame, target: str) -> DataFrame:
    return links.filter(F.col("target") == target).select("source_id").distinct()


def broken_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    return links.join(docs.select(F.col("id").alias("target")), "target", "left_anti").select("source_id", "target").distinct()


def names_of(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, id: everything a link can call a document by; one equi-join instead of a disjunction."""
    ids = docs.select(F.col("id").alias("name"), "id")
    return ids.unionByName(docs.select(F.col("path").alias("name"), "id")).unionByName(aliases.select(F.col("alias").alias("name"), F.col("document_id").alias("id"))).distinct()


def inbound(links: DataFrame, docs: DataFrame, aliases: DataFrame) -> DataFrame:
    return links.join(names_of(docs, aliases), links.target == F.col("name")).select("source_id", "id").distinct()


def orphans(docs: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Documents that nothing links to, with the number of links they make."""
    out = links.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outgoing"))
    alone = docs.join(inbound(links, docs, aliases).select("id").distinct(), "id", "left_anti")
    return alone.join(out, "id", "left").select("id", F.coalesce("outgoing", F.lit(0)).alias("outgoing"))


def link_density(docs: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    out = links.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outbound"))
    into = inbound(links, docs, aliases).groupBy("id").agg(F.count("*").alias("inbound"))
    return docs.select("id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def tag_similarity(tags: DataFrame, source: str) -> DataFrame:
    """id, score: Jaccard of tag sets with one document; only documents that share a tag."""
    tags = tags.select(F.col("document_id").alias("id"), "tag").distinct()
    mine = tags.filter(F.col("id") == source).select("tag")
    n = mine.count()
    sizes = tags.groupBy("id").agg(F.count("*").alias("n"))
    shared = tags.filter(F.col("id") != source).join(F.broadcast(mine) if n <= 10_000 else mine, "tag").groupBy("id").agg(F.count("*").alias("shared"))
    return shared.join(sizes, "id").select("id", (F.col("shared") / (F.col("n") + n - F.col("shared"))).alias("score"))


def stale(docs: DataFrame, limits: dict[str, int], today: str) -> DataFrame:
    """id, days_stale of documents that are older than their type allows; dates to come don't count."""
    table = docs.sparkSession.createDataFrame(list(limits.items()), "type string, most int")
    days = F.datediff(F.to_date(F.lit(today)), F.to_date("date"))
    return docs.join(F.broadcast(table), "type").withColumn("days", days).filter("days > most").select("id", (F.col("days") - F.col("most")).alias("days_stale"))


def recent(docs: DataFrame, cutoff: str) -> DataFrame:
    when = F.coalesce(F.nullif("date", F.lit("")), "updated_at")
    return docs.select("id", when.alias("effective")).filter(F.col("effective") >= cutoff).orderBy(F.desc("effective"), "id")


def last_write(states: DataFrame, key: str, clock: list[str], value: str) -> DataFrame:
    """The value with the highest clock of each key; equal clocks: the greater value."""
    return states.groupBy(key).agg(F.max_by(value, F.struct(*clock, value)).alias(value))


# --- backlinks, aliases, shared tags --------------------------------------------------------------


def backlinks_with_path(links: DataFrame, docs: DataFrame, target: str) -> DataFrame:
    return backlinks(links, target).join(docs.select(F.col("id").alias("source_id"), F.col("path").alias("source_path")), "source_id").distinct()


def backlinks_of(links: DataFrame, docs: DataFrame, id_: str, path: str) -> DataFrame:
    """source_id, source_path, target of links by id or path; a source that uses both counts once, by id."""
    found = links.filter(F.col("target").isin(id_, path)).withColumn("_by", (F.col("target") != id_).cast("int"))
    once = found.groupBy("source_id").agg(F.min_by("target", "_by").alias("target"))
    return once.join(docs.select(F.col("id").alias("source_id"), F.col("path").alias("source_path")), "source_id").select("source_id", "source_path", "target")


def resurrected(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents that an edit brought back after a delete on another side."""
    marked = fields.filter("key = 'resurrected' AND value = 'true' AND zone = 'Frontmatter'").select(F.col("document_id").alias("id"))
    return docs.join(marked, "id", "left_semi")


def by_alias(aliases: DataFrame, name: str) -> DataFrame:
    """The first document (least id) with an alias, whatever the case of its ASCII letters."""
    return aliases.filter(ascii_lower(F.col("alias")) == name.translate(FOLD)).orderBy("document_id").limit(1).select(F.col("document_id").alias("id"))


def shared_tags(tags: DataFrame, source: str) -> DataFrame:
    """id, shared: other documents and how many tags they share with one."""
    rows = tags.select(F.col("document_id").alias("id"), "tag").distinct()
    mine = rows.filter(F.col("id") == source).select("tag")
    return rows.filter(F.col("id") != source).join(mine, "tag").groupBy("id").agg(F.count("*").alias("shared"))


def resolved(targets: DataFrame, docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """target, id, path of each wanted target (a column `target`): by path, then id, then alias, then the shortest path that ends in /target.md
    (ties by path). Four equi-joins, the last on the name that a path ends in; targets that nothing fits have nulls."""
    wanted = targets.select("target").distinct()
    named = docs.select("id", "path")
    low = aliases.select(ascii_lower(F.col("alias")).alias("_alias"), F.col("document_id").alias("id")).groupBy("_alias").agg(F.min("id").alias("id")).join(named, "id")
    tail = wanted.withColumn("_name", F.substring_index("target", "/", -1)).join(named.withColumn("_name", F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")), "_name").filter(F.expr("endswith(path, concat('/', target, '.md'))"))
    ranked = [
        wanted.join(named, wanted.target == named.path).select("target", F.lit(1).alias("rank"), "id", "path"),
        wanted.join(named, wanted.target == named.id).select("target", F.lit(2).alias("rank"), "id", "path"),
        wanted.join(low, ascii_lower(wanted.target) == low["_alias"]).select("target", F.lit(3).alias("rank"), "id", "path"),
        tail.select("target", F.lit(4).alias("rank"), "id", "path"),
    ]
    every = functools.reduce(DataFrame.unionByName, ranked)
    best = every.groupBy("target").agg(F.min_by(F.struct("id", "path"), F.struct("rank", F.length("path"), "path")).alias("best"))
    return wanted.join(best, "target", "left").select("target", "best.id", "best.path")


# --- sequences --------------------------------------------------------------------------------


def parents_of(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """id, parent of every document; the parent is the value of its field `sequence`, null without one."""
    up = fields.filter("key = 'sequence'").groupBy(F.col("document_id").alias("id")).agg(F.min("value").alias("parent"))
    return docs.select("id").join(up, "id", "left")


def sequence_paths(parents: DataFrame, most: int = 100) -> DataFrame:
    """id, depth, path (root first, comma-joined) of each node of id -> parent (null at roots), level by level;
    nodes that no root leads to, as in cycles, have no row."""
    return walk_down(parents, most).select("id", "depth", F.array_join("path", ",").alias("path"))


def sequence_tree(parents: DataFrame, root: str, max_depth: int) -> DataFrame:
    """id, depth, path (array) of the nodes under a root, in the order of a walk that goes down first; ids in order beside each other."""
    down = parents.select("id", F.when(F.col("id") != root, F.col("parent")).alias("parent"))
    alone = down.filter((F.col("id") == root) | F.col("parent").isNotNull())
    return walk_down(alone, max_depth + 1).orderBy("path")


def children(parents: DataFrame, id_: str) -> DataFrame:
    return parents.filter(F.col("parent") == id_).select("id").orderBy("id")


def breadcrumb(parents: DataFrame, id_: str, most: int = 100) -> DataFrame:
    """step, id from the root to a node; the walk up stops at a parent that is missing or was there before. A look-up for each step, of one row."""
    seen, at = [], id_
    while at is not None and at not in seen and len(seen) < most:
        row = parents.filter(F.col("id") == at).select("parent").first()
        if row is None:
            break
        seen.append(at)
        at = row.parent
    return parents.sparkSession.createDataFrame([(k, x) for k, x in enumerate(reversed(seen))], "step int, id string")


def broken_sequences(parents: DataFrame) -> DataFrame:
    """id, parent where no document has the parent's id."""
    return parents.filter("parent IS NOT NULL").join(parents.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent")


def sequence_info(parents: DataFrame, id_: str) -> dict[str, object]:
    """parent (id or None), children and breadcrumb (DataFrames) of one node."""
    own = parents.filter(F.col("id") == id_).select("parent").first()
    return {"parent": own.parent if own else None, "children": children(parents, id_), "breadcrumb": breadcrumb(parents, id_)}


# --- discovery ----------------------------------------------------------------------------------


def linked_pairs(links: DataFrame, docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """source_id, id: which documents link to which, by path, id or alias."""
    return inbound(links, docs, aliases)


def phrases(index: Index) -> tuple[DataFrame, DataFrame]:
    """(id, phrase of each title with words; phrase, source_id of the documents that hold its words in a row). Titles alike are one phrase. Of each phrase
    only the rarest word's postings are joined; the places of its other words are then looked up for the pairs that are left."""
    own = words(F.coalesce("title", F.lit("")))
    titles = index.docs.select("id", F.array_join(stems(own) if index.stemming else own, " ").alias("phrase")).filter("phrase <> ''")
    wanted = titles.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("w"))
    parts = wanted.select("phrase", F.posexplode("w").alias("at", "term"))
    often = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    rare = parts.join(often, "term").groupBy("phrase").agg(F.min_by("term", F.struct("n", "at")).alias("term"))
    places = index.postings.select("term", F.col("id").alias("source_id"), "places")
    pairs = rare.join(places.select("term", "source_id"), "term").select("phrase", "source_id")
    looked = pairs.join(parts, "phrase").join(places, ["term", "source_id"])
    starts = looked.select("source_id", "phrase", F.explode(F.transform("places", lambda p: p - F.col("at"))).alias("start"), "at").distinct()
    sizes = wanted.select("phrase", F.size("w").alias("n"))
    return titles, starts.groupBy("source_id", "phrase", "start").agg(F.count("*").alias("m")).join(sizes, "phrase").filter("m = n").select("phrase", "source_id").distinct()


def mentions(index: Index, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """source_id, id: documents that hold the words of another's title in a row and don't link to it."""
    titles, hits = phrases(index)
    pairs = titles.join(hits, "phrase").filter("source_id <> id").select("source_id", "id")
    return pairs.join(linked_pairs(links, index.docs, aliases), ["source_id", "id"], "left_anti")


def unlinked_mentions(index: Index, links: DataFrame, aliases: DataFrame, id_: str) -> DataFrame:
    """source_id of documents that name the title of one and don't link to it, in order."""
    one = index.docs.filter(F.col("id") == id_).select("title").first()
    own = query_words(one.title or "") if one else []
    if not own:
        return index.docs.select(F.col("id").alias("source_id")).limit(0)
    found = matching(index, Term(" ".join(own), True)).filter(F.col("id") != id_).select(F.col("id").alias("source_id"))
    linking = linked_pairs(links, index.docs, aliases).filter(F.col("id") == id_).select("source_id")
    return found.join(linking, "source_id", "left_anti").orderBy("source_id")


def mention_counts(index: Index, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, mentions of every document that is mentioned without a link. Pairs are not made: documents that hold a phrase are counted once for all
    titles alike, less the document itself and those that link to it."""
    titles, hits = phrases(index)
    holding = hits.groupBy("phrase").agg(F.count("*").alias("n"))
    own = titles.select(F.col("id").alias("source_id"), "id")
    apart = linked_pairs(links, index.docs, aliases).select("source_id", "id").unionByName(own).distinct()
    less = apart.join(titles, "id").join(hits, ["phrase", "source_id"], "left_semi").groupBy("id").agg(F.count("*").alias("less"))
    counts = titles.join(holding, "phrase").join(less, "id", "left").select("id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("mentions"))
    return counts.filter("mentions > 0").orderBy("id")


def content_scores(index: Index, id_: str, most: int = 50) -> DataFrame:
    """id, score: BM25 of the phrase of a document's title, the best as 1; no more than `most`."""
    one = index.docs.filter(F.col("id") == id_).select("title").first()
    own = query_words(one.title or "") if one else []
    if not own:
        return index.docs.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = matching(index, Term(" ".join(own), True)).filter(F.col("id") != id_)
    top = hits.join(scores(index, list(dict.fromkeys(own))), "id").select("id", (-F.col("rank")).alias("score")).orderBy(F.desc("score"), "id").limit(most)
    best = top.agg(F.max("score").alias("best"))
    return top.join(F.broadcast(best)).select("id", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0).alias("score"))


def suggestions(index: Index, links: DataFrame, aliases: DataFrame, id_: str, limit: int = 10) -> DataFrame:
    """id, score of documents to link to: 0.6 of the Jaccard similarity of tags and 0.4 of the content score; content alone if the document has no tags.
    Documents that it links to already are left out; ties by id."""
    linked = linked_pairs(links, index.docs, aliases).filter(F.col("source_id") == id_).select("id")
    if index.tags.filter(F.col("document_id") == id_).isEmpty():
        found = content_scores(index, id_, limit + 10).join(linked, "id", "left_anti").orderBy(F.desc("score"), "id").limit(limit)
        best = found.agg(F.max("score").alias("best"))
        return found.join(F.broadcast(best)).select("id", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0).alias("score")).orderBy(F.desc("score"), "id")
    by_tags = tag_similarity(index.tags, id_).select("id", F.col("score").alias("tag_score"))
    both = by_tags.join(content_scores(index, id_).withColumnRenamed("score", "content_score"), "id", "full_outer").na.fill(0.0)
    total = both.select("id", (0.6 * F.col("tag_score") + 0.4 * F.col("content_score")).alias("score")).filter(F.col("id") != id_)
    return total.join(linked, "id", "left_anti").orderBy(F.desc("score"), "id").limit(limit)
