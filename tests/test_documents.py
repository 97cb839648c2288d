"""Files, index tables, typed tables, search plans, discovery, references and merging of whole documents."""

import random

import pytest
from pyspark.sql import functions as F

from inkfold.functions import scalars
from inkfold.operators import graph, sync
from inkfold.plans import expand, generic, index
from inkfold.plans.catalog import Catalog, plural, singular_field, type_name
from inkfold.plans.search import SearchError
from inkfold.plans.where import FilterError
from inkfold.sources import corpus

@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Rows here are few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


FILES = {
    "_typedef/20240101000001.md": "---\nid: '20240101000001'\ntitle: book\ntype: _typedef\nsearch_key: name\ncolumns:\n  - {name: name, data_type: TEXT, zone: frontmatter, search_boost: 3}\n  - {name: pages, data_type: INTEGER, required: true}\n  - {name: author, data_type: TEXT, references: person}\n---\n",
    "_typedef/20240101000002.md": "---\nid: '20240101000002'\ntitle: person\ntype: _typedef\ncolumns:\n  - {name: nick, data_type: TEXT, zone: frontmatter}\n---\n",
    "20240101000010.md": "---\nid: '20240101000010'\ntitle: Red Fox\ntype: book\nname: The Red Fox\npages: 12\nmood: calm\ntags: [animal, x/y]\naliases: [Vixen]\nattachments: [a.js]\n---\nA fox. See [[20240101000011]] #body\n\n## Summary\n\nshort text\n---\n- author:: [[20240101000020]]\n",
    "20240101000011.md": "---\ntitle: Hen house\ntype: book\nname: Hens\npages: many\nmood: 3\nsequence: '20240101000010'\n---\nThe red fox came. ```#no```\n- [ ] lock it\n",
    "20240101000020.md": "---\nid: '20240101000020'\ntitle: Ann\ntype: person\nnick: annie\n---\nShe wrote about the red fox and the hen house.\nnick:: twice\n",
    "broken.md": "---\n: [\n---\n",
    "none.md": "plain",
}


@pytest.fixture(scope="module")
def tables(spark):
    return corpus.index_tables(spark.createDataFrame(list(FILES.items()), "path string, content string"))


@pytest.fixture(scope="module")
def found(spark, tables, tmp_path_factory):
    schemas, frames = corpus.materialized(tables)
    docs = tables.docs.select("id", "title", "date", "type", "path", "body").withColumn("updated_at", F.lit(None).cast("string"))
    relations = {n: t for n, t in schemas.items()}
    return index.build(docs, tables.tags, tables.fields, f"file://{tmp_path_factory.mktemp('index')}", Catalog(relations, frames), buckets=4)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_index_tables(tables):
    assert got(tables.tags, "document_id", "tag", "source") == [("20240101000010", "animal", "frontmatter"), ("20240101000010", "body", "body"), ("20240101000010", "x/y", "frontmatter")]
    assert got(tables.links.filter("source_id = '20240101000010'"), "target", "zone") == [("20240101000011", "Body"), ("20240101000020", "Reference")]
    assert got(tables.aliases, "alias") == [("Vixen",)] and got(tables.attachments, "name", "mime") == [("a.js", "text/javascript")]
    kinds = got(tables.warnings, "path", "kind")
    assert ("20240101000020.md", "cross-zone") in kinds and {p for p, k in kinds if k == "unreadable"} == {"broken.md", "none.md"}


def test_typed_tables(tables):
    schemas, frames = corpus.materialized(tables)
    assert set(schemas) == {"book", "person"} and {c.name: c.kind for c in schemas["book"].columns.values()}["mood"] == "TEXT", "3 and calm widen to text"
    book = {r.id: r for r in frames["book"].collect()}
    assert (book["20240101000010"].name, book["20240101000010"].pages, book["20240101000010"].author) == ("The Red Fox", 12, "20240101000020")
    assert book["20240101000010"].summary == "short text" and book["20240101000011"].pages is None
    assert got(corpus.missing_required(schemas, frames), "table", "id", "column") == [("book", "20240101000011", "pages")]


def test_rebuild(spark, tmp_path):
    for path, text in FILES.items():
        file = tmp_path / "in" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    assert not corpus.is_fresh(spark, folder, out)
    with pytest.raises(ValueError, match="broken.md|none.md"):
        corpus.rebuild(spark, folder, out, strict=True)
    counts = corpus.rebuild(spark, folder, out)
    assert counts["docs"] == 5 and counts["table_book"] == 2 and corpus.is_fresh(spark, folder, out)
    (tmp_path / "in" / "none.md").write_text("other")
    assert not corpus.is_fresh(spark, folder, out)


def test_files_are_written_as_they_are_read(spark, tables):
    docs = tables.docs.filter("id = '20240101000010'")
    text = docs.select(corpus.serialized(F.col("meta"), F.col("body"), F.col("reference_section")).alias("t")).first().t
    assert text.startswith("---\nid: 20240101000010\ntitle: Red Fox\ntags:\n  - animal\n  - x/y\ntype: book\naliases:\n  - Vixen\n") and text.endswith("\n---\n- author:: [[20240101000020]]")
    assert corpus.scalar_text("yes") == '"yes"' and corpus.scalar_text("a: b") == '"a: b"' and corpus.scalar_text(2.0) == "2" and corpus.scalar_text("12") == '"12"'


@pytest.mark.parametrize("text, more, want", [
    ("fox", {}, {"10", "11", "20"}), ('"red fox" NOT hen', {}, {"10"}), ("name=hens", {}, {"11"}), ("author=ann", {}, {"10"}), ("mood=calm fox", {}, {"10"}), ("NOT tag=animal fox", {}, {"11", "20"}), ("", {"tag": "animal"}, {"10"}),
    ("", {"types": ["person"]}, {"20"}), ("", {"where": {"pages": {"eq": "12"}}}, {"10"}), ("", {"where": {"pages": {"in": []}}}, set()), ("calm", {"types": ["book"]}, {"10"}), ("fox OR nick=house", {}, {"10", "11", "20"}),
])
def test_search(found, text, more, want):
    assert {r.id[-2:] for r in index.search(found, text, **more).collect()} == want


def test_search_plans(found):
    assert [f.name for f in index.plan("a=1 and b").filters] == ["a"] and index.plan("NOT tag=x").rest is None
    for bad in ("*", "NOT title=x y", "(a"):
        with pytest.raises(SearchError):
            index.plan(bad)
    with pytest.raises(SearchError):
        index.search(found, "")
    plain = index.search(found, "calm OR fox").collect()
    assert [r["rank"] for r in plain] == sorted(r["rank"] for r in plain) and found.boosts["book"] == 3
    assert "<b>fox</b>" in index.search(found, "fox", snippets=True, limit=1).first().snippet


def test_discovery(tables, found):
    assert got(graph.unlinked_mentions(found, tables.links, tables.aliases, "20240101000010"), "source_id") == [("20240101000011",), ("20240101000020",)]
    counts = dict(got(graph.mention_counts(found, tables.links, tables.aliases), "id", "mentions"))
    assert counts == {"20240101000010": 2, "20240101000011": 1}, "a title inside the titled document, or where it is linked, doesn't count"
    assert {r.id for r in graph.suggestions(found, tables.links, tables.aliases, "20240101000011").collect()} == {"20240101000020"}
    assert "20240101000011" not in {r.id for r in graph.suggestions(found, tables.links, tables.aliases, "20240101000010").collect()}
    parents = graph.parents_of(tables.docs, tables.fields)
    assert [r.id[-2:] for r in graph.breadcrumb(parents, "20240101000011").collect()] == ["10", "11"]
    assert got(graph.resolved(tables.docs.sparkSession.createDataFrame([("vixen",), ("20240101000011",), ("20240101000020.md",), ("nothing",)], "target string"), tables.docs, tables.aliases), "target", "id")[1:] == [("20240101000020.md", "20240101000020"), ("nothing", None), ("vixen", "20240101000010")]


def test_references(spark, tables):
    schemas, frames = corpus.materialized(tables)
    one = expand.expand_one(frames["book"], "author", frames["person"])
    assert {(r.id[-2:], r.author.nick if r.author else None) for r in one.collect()} == {("10", "annie"), ("11", None)}
    rows = spark.createDataFrame([("r", "b,c,a,zz"), ("s", None)], "k string, refs string")
    target = spark.createDataFrame([("a", 10), ("b", 9), ("c", None)], "id string, n int")
    names = lambda **how: {r.k: [x.id for x in r["many"]] for r in expand.expand_many(rows, "k", "refs", target, "many", **how).collect()}
    assert names() == {"r": ["b", "c", "a"], "s": []} and names(order="n")["r"] == ["b", "a", "c"] and names(order="n", direction="DESC", limit=2)["r"] == ["a", "b"]


def test_pages_and_names():
    assert generic.valid_page() == (50, 0) and generic.clamped_page(2, 500) == (200, 200)
    for bad in ((0, 0), (10_001, 0), (5, -1)):
        with pytest.raises(FilterError):
            generic.valid_page(*bad)
    with pytest.raises(FilterError):
        generic.order_keys("body")
    assert (plural("category"), plural("box"), type_name("literature-note"), singular_field("author_id")) == ("categories", "boxes", "LiteratureNote", "author")


def test_content_ids(spark):
    import hashlib

    def want(old, content, attempt):
        n = int.from_bytes(hashlib.sha256(f"{old}:{content}:{attempt}".encode()).digest()[:8], "big")
        return f"{2000 + n // (86400 * 28 * 12) % 100:04}{1 + n // (86400 * 28) % 12:02}{1 + n // 86400 % 28:02}{n // 3600 % 24:02}{n // 60 % 60:02}{n % 60:02}"

    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "old string, content string")
    taken = spark.createDataFrame([(want("a", "x", 0),), (want("a", "x", 1),)], "id string")
    assert dict(got(scalars.content_ids(rows, "old", "content", taken), "old", "new_id")) == {"a": want("a", "x", 2), "b": want("b", "y", 0)}


# --- merging ----------------------------------------------------------------------------------


def test_lines_merge():
    assert sync.merge_lines(list("abc"), list("aXbc"), list("abcY")) == list("aXbcY")
    assert sync.merge_lines(list("abc"), list("ac"), list("abZ")) == list("aZ")
    dice = random.Random(1)
    for _ in range(500):
        base = [dice.choice("abcde") for _ in range(dice.randrange(8))]
        side = [x for x in base if dice.random() < 0.7] + [dice.choice("xyz") for _ in range(dice.randrange(3))]
        assert sync.merge_lines(base, side, base) == side == sync.merge_lines(base, base, side) == sync.merge_lines(base, side, side)


def test_documents_merge(spark):
    doc = lambda title, tags, body, refs="": f"---\nid: 20240101000001\ntitle: {title}\ntags: [{tags}]\n---\n{body}" + (f"\n---\n{refs}" if refs else "")
    base = {"20240101000001.md": doc("A", "a, b", "one\ntwo\nthree", "- r:: [[x]]"), "20240101000002.md": "two", "20240101000003.md": "---\nid: 20240101000003\n---\nold", "20240101000004.md": "gone"}
    ours = {**base, "20240101000001.md": doc("A", "b, c", "ONE\ntwo\nthree", "- r:: [[x]]\n- r:: [[y]]"), "20240101000002.md": "mine", "20240101000005.md": "---\nid: 20240101000005\n---\nnew here"}
    theirs = {**base, "20240101000001.md": doc("B", "a, b, d", "one\ntwo\nTHREE", "- r:: [[x]]"), "20240101000003.md": "---\nid: 20240101000003\n---\nedited", "20240101000005.md": "---\nid: 20240101000005\n---\nnew there"}
    del ours["20240101000003.md"], theirs["20240101000004.md"]
    frames = [spark.createDataFrame(list(x.items()), "path string, content string") for x in (base, ours, theirs)]
    rows = {r.path: r for r in sync.merged_snapshot(*frames).collect()}
    assert rows["20240101000001.md"].content == "---\nid: 20240101000001\ntitle: B\ntags:\n  - b\n  - c\n  - d\n---\nONE\ntwo\nTHREE\n---\n- r:: [[x]]\n- r:: [[y]]"
    assert rows["20240101000002.md"].content == "mine" and "20240101000004.md" not in rows
    assert rows["20240101000003.md"].content == "---\nresurrected: true\nid: 20240101000003\n---\nedited"
    moved = [r for r in rows.values() if r.how == "moved"]
    assert len(moved) == 1 and {rows["20240101000005.md"].content.split()[-1], moved[0].content.split()[-1]} == {"here", "there"} and f"id: {moved[0].path[:14]}" in moved[0].content
    again = {r.path: r.content for r in sync.merged_snapshot(frames[0], frames[2], frames[1]).collect()}
    assert again == {p: r.content for p, r in rows.items()}, "both sides come to the same"


def test_logs_merge():
    base, ours, theirs = "## Log\n- [ ] 2024-01-02 a", "## Log\n- [x] 2024-01-02 a\n- [ ] 2024-01-05 c", "## Log\n- [ ] 2024-01-02 a\n- [ ] 2024-01-03 b"
    assert sync.merge_bodies(base, ours, theirs) == "## Log\n- [x] 2024-01-02 a\n- [ ] 2024-01-03 b\n- [ ] 2024-01-05 c"


def test_clocks(spark):
    a = sync.Hlc(10, 0, "a")
    assert a.tick(5) == sync.Hlc(10, 1, "a") and a.tick(11) == sync.Hlc(11, 0, "a") and a.receive(sync.Hlc(10, 4, "b"), 3) == sync.Hlc(10, 5, "a") and sync.Hlc.read(str(a)) == a
    rows = spark.createDataFrame([("9-5-b", "x"), ("10-0-a", "y")], "clock string, v string")
    assert rows.agg(F.max_by("v", sync.clock_struct(F.col("clock")))).first()[0] == "y"
    nodes = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-05-01")], "node string, last_sync string")
    assert got(sync.stale_nodes(nodes, "2024-05-02"), "node") == [("a",)]


def test_bundles(spark, tmp_path):
    new, old = (spark.createDataFrame(list(x.items()), "path string, content string") for x in ({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "old", "d": "4"}))
    path = f"file://{tmp_path}/bundle"
    sync.export_bundle(new, path, old)
    assert got(spark.read.parquet(f"{path}/files"), "path") == [("b",), ("c",)]
    assert got(sync.import_bundle(spark, path, old), "path", "content") == [("a", "1"), ("b", "2"), ("c", "3")]
    with pytest.raises(ValueError):
        sync.import_bundle(spark, path)
    spark.createDataFrame([("x", "y")], "path string, content string").write.mode("append").parquet(f"{path}/files")
    with pytest.raises(ValueError, match="checksum"):
        sync.import_bundle(spark, path, old)


