"""Two sides of one corpus brought together: clocks, three-way merging of whole documents, bundles, nodes that fell behind.

Snapshots are tables of path and content. Sorting out who changed what is one outer join; only files that both sides changed are
parsed and merged, in Arrow batches.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.scalars import content_ids
from inkfold.sources import zones
from inkfold.sources.corpus import file_text

LOG_ENTRY = re.compile(r"^\s*- \[([ xi])\]\s*(.*)$")
DATED_ENTRY = re.compile(r"^\s*- \[[ xi]\]\s*(\d{4}-\d{2}-\d{2})")


@dataclass(frozen=True, order=True)
class Hlc:
    """A hybrid logical clock: wall time in milliseconds, a counter, the node."""

    wall_ms: int
    counter: int
    node: str

    def tick(self, now_ms: int) -> Hlc:
        return Hlc(now_ms, 0, self.node) if now_ms > self.wall_ms else Hlc(self.wall_ms, self.counter + 1, self.node)

    def receive(self, other: Hlc, now_ms: int) -> Hlc:
        wall = max(self.wall_ms, other.wall_ms, now_ms)
        counters = [c.counter for c in (self, other) if c.wall_ms == wall]
        return Hlc(wall, max(counters) + 1 if counters else 0, self.node)

    def __str__(self) -> str:
        return f"{self.wall_ms}-{self.counter}-{self.node}"

    @staticmethod
    def read(text: str) -> Hlc:
        wall, counter, node = text.split("-", 2)
        return Hlc(int(wall), int(counter), node)


def clock_struct(text: Column) -> Column:
    """A clock's text as a struct that sorts as the clock does."""
    part = lambda k: F.regexp_extract(text, r"^(\d+)-(\d+)-(.*)$", k)
    return F.struct(part(1).try_cast("bigint").alias("wall_ms"), part(2).try_cast("int").alias("counter"), part(3).alias("node"))


def stale_nodes(nodes: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Nodes (node, last_sync) that have not been in touch for more than some days."""
    return nodes.filter(F.datediff(F.to_date(F.lit(today)), F.to_date("last_sync")) > days)


# --- documents --------------------------------------------------------------------------------


def actor(content: str) -> str:
    """What ties are decided by: the first half of a hash of the content."""
    return hashlib.sha256(content.encode()).hexdigest()[:32]


def edits(base: list[str], side: list[str]) -> list[tuple[int, int, list[str]]]:
    """(start, end, lines instead) of the stretches of base that a side replaces."""
    return [(a, b, side[c:d]) for tag, a, b, c, d in difflib.SequenceMatcher(None, base, side, autojunk=False).get_opcodes() if tag != "equal"]


def merge_lines(base: list[str], first: list[str], second: list[str]) -> list[str]:
    """All edits of both sides; where they touch the same stretch, the lines of the first side come before those of the second."""
    every = sorted((a, b, k, new) for k, side in enumerate((first, second)) for a, b, new in edits(base, side))
    out, at = [], 0
    while every:
        start, end, _, _ = every[0]
        own: tuple[list, list] = ([], [])
        while every and (every[0][0] < end or every[0][0] == start):
            a, b, k, new = every.pop(0)
            own[k].append((a, b, new))
            end = max(end, b)

        def applied(changes, start=start, end=end):
            lines, here = [], start
            for a, b, new in changes:
                lines += base[here:a] + new
                here = b
            return lines + base[here:end]

        one, two = (applied(x) if x else None for x in own)
        out += base[at:start]
        out += one if two is None or one == two else two if one is None else one + [x for x in two if x not in one]
        at = end
    return out + base[at:]


def is_log(lines: list[str]) -> bool:
    full = [x for x in lines if x.strip()]
    return bool(full) and all(DATED_ENTRY.match(x) for x in full)


def merge_log(ours: list[str], theirs: list[str]) -> list[str]:
    """Entries of both, those alike but for their state once (ours), by date."""
    seen, out = set(), []
    for x in [*ours, *theirs]:
        text = LOG_ENTRY.match(x)
        if text and text[2] not in seen:
            seen.add(text[2])
            out.append(x)
    return sorted(out, key=lambda x: DATED_ENTRY.match(x)[1])


def merge_bodies(base: str, ours: str, theirs: str) -> str:
    """Section by section: dated logs entry by entry, all else line by line."""
    parts = [{(h, n): c for h, n, c in zones.split_sections(x) or []} for x in (base, ours, theirs)]
    if not any(is_log(c.split("\n")) for p in parts for c in p.values()):
        return "\n".join(merge_lines(base.split("\n"), ours.split("\n"), theirs.split("\n")))
    out = []
    for key in dict.fromkeys([*parts[1], *parts[2]]):
        had, one, two = (p.get(key) for p in parts)
        if (one is None or two is None) and had is not None:
            kept = one if two is None else two
            if kept == had:
                continue  # one side took the section away, the other left it alone
            one = two = kept
        one, two = one if one is not None else two, two if two is not None else one
        a, b = one.split("\n"), two.split("\n")
        lines = merge_log(a, b) if is_log(a) and is_log(b) else merge_lines((had or "").split("\n"), a, b)
        out += ([f"{'#' * key[1]} {key[0]}"] if key[1] else []) + lines
    return "\n".join(out)


def merge_values(base: dict, ours: dict, theirs: dict, ours_wins: bool) -> dict:
    out = {}
    for k in sorted({*base, *ours, *theirs}):
        b, o, t = (x.get(k) for x in (base, ours, theirs))
        if isinstance(b, list) or isinstance(o, list) or isinstance(t, list):
            b, o, t = (x if isinstance(x, list) else [] if x is None else [x] for x in (b, o, t))
            if k in base and (k not in ours or k not in theirs):
                continue
            kept = [v for v in b if v in o and v in t]
            out[k] = kept + sorted({str(v): v for v in [*o, *t] if v not in b}.values(), key=str)
        else:
            out[k] = t if o == b else o if t == b or o == t else o if ours_wins else t
    return {k: v for k, v in out.items() if v is not None}


def merge_documents(base: str, ours: str, theirs: str) -> tuple[str, str]:
    """(content, how) of one file that both sides changed: merged zone by zone; the side that wins ties as a whole if one of them can't be read."""
    wins = actor(ours) >= actor(theirs)
    read = []
    for x in (base, ours, theirs):
        front, body, refs = zones.split_zones(x)
        _, meta, error = zones.read_frontmatter(front, "")
        if error:
            return (ours if wins else theirs), "last write"
        read.append((json.loads(meta), body or "", refs or ""))
    (m0, b0, r0), (m1, b1, r1), (m2, b2, r2) = read
    meta = merge_values(m0, m1, m2, wins)
    first, second = ((b1, b2) if wins else (b2, b1))
    body = merge_bodies(b0, first, second)
    lines = [[y for y in x.split("\n") if y.strip()] for x in (r0, r1, r2)]
    refs = sorted({*[x for x in lines[0] if x in lines[1] and x in lines[2]], *[x for s in lines[1:] for x in s if x not in lines[0]]})
    return file_text(json.dumps(meta), body, "\n".join(refs)), "merged"


@cache
def merged_column():
    def run(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([merge_documents(*x) for x in zip(base, ours, theirs, strict=True)], columns=["content", "how"], dtype=object)

    return F.pandas_udf(run, "content string, how string")


def merged_snapshot(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, content, how of the corpus after both sides' changes: ours, theirs, same, deleted by none;
    an edit wins over a delete (resurrected); of two new files with one path the one with the greater hash stays and the other moves to an id of its own content."""
    name = lambda df, c: df.select("path", F.col("content").alias(c))
    every = name(base, "b").join(name(ours, "o"), "path", "full_outer").join(name(theirs, "t"), "path", "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    how = (
        F.when(o.eqNullSafe(t), "same").when(o.eqNullSafe(b), "theirs").when(t.eqNullSafe(b), "ours").when(b.isNull(), "both added")
        .when(o.isNull() | t.isNull(), "resurrected").otherwise("both changed")
    )
    told = every.withColumn("how", how)
    plain = told.filter("how IN ('same', 'theirs', 'ours')").select("path", F.when(F.col("how") == "theirs", t).otherwise(o).alias("content"), "how")
    marked = F.regexp_replace(F.coalesce("o", "t"), r"\A---\n", "---\nresurrected: true\n")
    revived = told.filter("how = 'resurrected'").select("path", marked.alias("content"), "how")
    changed = told.filter("how = 'both changed'").select("path", merged_column()("b", "o", "t").alias("m")).select("path", "m.content", "m.how")
    added = told.filter("how = 'both added'").withColumn("first", F.sha2("o", 256) >= F.sha2("t", 256))
    winners = added.select("path", F.when(F.col("first"), o).otherwise(t).alias("content"), "how")
    losers = added.select(F.regexp_extract("path", r"(\d{14})\.md$", 1).alias("old"), F.when(F.col("first"), t).otherwise(o).alias("content"), F.regexp_replace("path", r"[^/]*$", "").alias("folder"))
    ids = every.select(F.regexp_extract("path", r"(\d{14})\.md$", 1).alias("id"))
    moved = content_ids(losers, "old", "content", ids)
    moved = moved.select(F.concat("folder", "new_id", F.lit(".md")).alias("path"), F.regexp_replace("content", r"(?m)\A(---\n(?:.*\n)*?)id: .*$", F.concat(F.lit("$1id: "), "new_id")).alias("content"), F.lit("moved").alias("how"))
    return plain.filter("content IS NOT NULL").unionByName(revived).unionByName(changed).unionByName(winners).unionByName(moved)


# --- bundles ----------------------------------------------------------------------------------


def checksum(files: DataFrame) -> str:
    """Of paths and contents, whatever their order."""
    row = files.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\0", "path", "content"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{row.n}:{row.s}".encode()).hexdigest()


def export_bundle(files: DataFrame, path: str, known: DataFrame | None = None) -> dict:
    """Writes files that the target (its snapshot: known) doesn't have, the paths that it has to drop, and a manifest; all files without a target."""
    spark = files.sparkSession
    if known is None:
        new, gone = files, files.select("path").limit(0)
    else:
        new = files.join(known.select("path", F.sha2("content", 256).alias("_h")), "path", "left").filter(~F.col("_h").eqNullSafe(F.sha2("content", 256))).drop("_h")
        gone = known.select("path").join(files.select("path"), "path", "left_anti")
    new.select("path", "content").write.mode("overwrite").parquet(f"{path}/files")
    gone.write.mode("overwrite").parquet(f"{path}/gone")
    manifest = {"delta": known is not None, "checksum": checksum(spark.read.parquet(f"{path}/files"))}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def import_bundle(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """The target's snapshot with a bundle applied; ValueError if its files are not those that were written."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    files = spark.read.parquet(f"{path}/files")
    if checksum(files) != manifest["checksum"]:
        raise ValueError("the bundle's checksum does not fit its files")
    if known is None:
        if manifest["delta"]:
            raise ValueError("a delta needs the snapshot that it was made for")
        return files
    gone = spark.read.parquet(f"{path}/gone").unionByName(files.select("path"))
    return known.join(gone, "path", "left_anti").unionByName(files)
