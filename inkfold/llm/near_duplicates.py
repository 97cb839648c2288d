"""N-gram Jaccard join by a MinHash LSH forest with exact verification (operator 4).

Documents are sets of shingles of five words. Documents with the same set are one class from the
start and take part once, with their number. Each set has a label of `max_depth` minima in each of `trees` trees.
The labels of a tree are sorted, which makes it a prefix trie: neighbours in that order with a common
prefix of d minima lie under one node of depth d, and neighbours tell all nodes apart.

Matches on the longest prefixes come first. Then prefixes are shortened: every verified link of similarity s stands for 1 / p(s) links,
p(s) = 1 - (1 - s^d)^trees being the part of them that prefixes of length d find, which gives the recall so far and the
longest prefix with which `recall` is to be expected; this is repeated with what has been found until the recall is reached. It can't become
shorter than the length that reaches it if all links had the threshold's similarity.

Neighbours under common nodes are connected to blocks, all pairs of which are verified on the sets of shingles
themselves (64-bit hashes of the words of a shingle); pairs that a round before has verified are left out, and so are blocks without
new ones. A block of more than `most_in_block` texts or SHINGLES shingles is cut into parts and each two parts meet in a task
of their own, so a task's memory is bounded; pairs are counted there, never emitted.

Texts under five words are one shingle; texts without words are alone in their class, without links.
Null text: as empty. Rows that repeat a doc_id and text are one document with copies. Null doc_id: one more
id, after all others. Very long texts are read in segments. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import NULL_ID, SPACE, Spans, chunks, id_and_text, if_small, materialize, mix, ragged_index, segments, text_arrays, text_bytes, word_bounds
from inkfold.llm.components import components, look_up
from inkfold.llm.substring_dedup import joined

CHUNK = 2_000_000
PACK = 6_000_000
SHINGLES = 1_000_000
BINS = 20
POOLED = -(2**63)


def found_share(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """Share of pairs with that similarity that agree in a prefix of `depth` minima in any tree."""
    return 1 - (1 - similarity**depth) ** trees


def next_depth(links: np.ndarray, threshold: float, depth: int, least: int, trees: int, recall: float) -> int:
    """The longest prefix, up to depth, that is expected to find `recall` of all links. links: those found by
    prefixes of length depth, in bins of similarity from the threshold to 1."""
    if not links.sum():
        return least
    at = threshold + (np.arange(len(links)) + 0.5) * (1 - threshold) / len(links)
    there = links / found_share(at, depth, trees)
    for d in range(depth, least, -1):
        if (there * found_share(at, d, trees)).sum() >= recall * there.sum():
            return d
    return least


def shortest_prefix(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    depth = max_depth
    while depth > 1 and found_share(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def long_shingles(data: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes of one long text, sorted."""
    found = np.zeros(0, np.uint64)
    for lo, hi, starts, ends, windows in segments(data, k, ~SPACE, CHUNK):
        buf, a, b = joined(data[lo:hi], starts, ends)
        at = np.arange(windows if windows or lo else min(len(a), 1))  # fewer than k words: the whole text is one shingle
        found = np.union1d(found, Spans(buf).hash(a[at], b[np.minimum(at + k, len(a)) - 1]))
    return found


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where those of each text start (one more than texts)."""
    if len(off) == 2 and len(data) > 2 * CHUNK:
        h = long_shingles(data, k)
        return h, np.array([0, len(h)])
    starts, ends, first = word_bounds(data, off, ~SPACE)
    buf, a, b = joined(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at, text = ragged_index(first[:-1], count), np.repeat(np.arange(len(n)), count)
    h = Spans(buf).hash(a[at], b[at + np.minimum(n, k)[text] - 1])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def sum_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each text's set."""
    return sum_of(mix(h), first).view(np.int64), sum_of(mix(h ^ np.uint64(0xA0761D6478BD642F)), first).view(np.int64)


def sketch(docs: DataFrame, k: int, trees: int, depth: int) -> DataFrame:
    """doc_id, key1, key2, size (shingles) and labels: for each tree 16 bits of each of `depth` minima, in order."""
    rng = np.random.default_rng(7)
    times = rng.integers(0, 1 << 63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, trees * depth, np.uint64)

    def run(batches):
        for batch in batches:
            ids, data, off = text_arrays(batch)
            keys, sizes, labels = [np.zeros(len(ids), np.int64) for _ in range(2)], np.zeros(len(ids), np.int64), np.zeros((len(ids), trees * depth), ">u2")
            for lo, hi in chunks(off, CHUNK):
                h, first = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                keys[0][lo:hi], keys[1][lo:hi] = set_keys(h, first)
                sizes[lo:hi] = np.diff(first)
                full = np.flatnonzero(np.diff(first)) + lo
                if len(full):
                    at = first[:-1][full - lo]
                    for j in range(trees * depth):
                        labels[full, j] = mix(np.minimum.reduceat(h * times[j] + plus[j], at)) >> np.uint64(48)
            columns = [pa.array(ids), pa.array(keys[0]), pa.array(keys[1]), pa.array(sizes), pa.array([x.tobytes() for x in labels], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key1", "key2", "size", "labels"])

    return docs.mapInArrow(run, "doc_id long, key1 long, key2 long, size long, labels binary")


def common_prefix(paths: np.ndarray) -> np.ndarray:
    """Minima that each path (a byte for the tree, two for each minimum) and the one before it begin with; 0 in different trees."""
    same = paths[1:] == paths[:-1]
    return np.where(same[:, 0], np.minimum.accumulate(same[:, 1::2] & same[:, 2::2], axis=1).sum(1), 0)


def neighbours(kinds: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """a, b, prefix: a representative, the length of the prefix that its label in a tree shares with the one before it in sorted order (`least` or more),
    and the first one under that node of the trie."""
    width = 2 * depth
    rows = kinds.filter("size > 0").select("rep", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    path = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(labels, tree * {width} + 1, {width})"))
    tries = rows.select(path.alias("path"), "rep").repartitionByRange("path", "rep").sortWithinPartitions("path", "rep")

    def run(batches):
        """Pairs of neighbours; the first and the last path of the partition, with which it joins the partitions beside it."""
        last = first = None
        heads = {}
        for batch in batches:
            if not len(batch):
                continue
            rep = batch.column("rep").to_numpy()
            raw = batch.column("path").cast(pa.large_binary())
            paths = np.frombuffer(raw.buffers()[2], np.uint8)[np.frombuffer(raw.buffers()[1], np.int64)[raw.offset] :][: len(rep) * (width + 1)].reshape(-1, width + 1)
            first = (paths[:1].copy(), rep[:1].copy()) if first is None else first
            before = np.zeros((1, width + 1), np.uint8) + np.uint8(255) if last is None else last[0]  # 255: no tree
            prefix = common_prefix(np.concatenate([before, paths]))
            head, place = np.zeros(len(rep), np.int64), np.arange(len(rep))
            for d in range(least, depth + 1):
                at = np.maximum.accumulate(np.where(prefix < d, place, -1))
                own = np.where(at >= 0, rep[at], heads.get(d, 0))
                head[prefix == d], heads[d] = own[prefix == d], int(own[-1])
            last = (paths[-1:].copy(), rep[-1:].copy())
            some = np.flatnonzero((prefix >= least) & (rep != head))
            yield out(rep[some], head[some], prefix[some], [None] * len(some))
        if first is not None:
            ends = [first, last]
            yield out(*(np.array([x[1][0] for x in ends]) for _ in range(2)), np.zeros(2, np.int64), [x[0].tobytes() for x in ends])

    def out(a, b, prefix, edge):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(prefix.astype(np.int32)), pa.array(edge, pa.binary())], ["a", "b", "prefix", "edge"])

    found = materialize(tries.mapInArrow(run, "a long, b long, prefix int, edge binary"), "neighbours")
    ends = found.filter("edge IS NOT NULL").orderBy("edge", "a").select("a", "edge").collect()  # two rows for each partition
    across = []
    if len(ends) > 1:
        prefix = common_prefix(np.stack([np.frombuffer(r.edge, np.uint8) for r in ends]))
        across = [(x.a, y.a, int(p)) for x, y, p in zip(ends, ends[1:], prefix.tolist(), strict=False) if p >= least and x.a != y.a]
    inner = found.filter("edge IS NULL").select("a", "b", "prefix")
    return inner.unionByName(kinds.sparkSession.createDataFrame(across, "a long, b long, prefix int")) if across else inner


def verify_block(sets: list[np.ndarray], parts: np.ndarray, wanted: tuple[int, int], old: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of one block, of one or two parts: the weight of each text's partners, the least text that it is connected with and the links
    by bins of similarity. old: blocks of the round before, within which all is known."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, feature, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = often[feature] > 1
    owner, feature = owner[shared], feature[shared]
    _, feature = np.unique(feature, return_inverse=True)
    order = np.argsort(feature, kind="stable")
    owner, feature = owner[order], feature[order]
    common = np.zeros((n, n), np.float32)
    width = max(64, 4_000_000 // max(n, 1))
    for lo in range(0, int(feature[-1]) + 1 if len(feature) else 0, width):
        a, b = np.searchsorted(feature, [lo, lo + width])
        dense = np.zeros((n, min(width, int(feature[-1]) + 1 - lo)), np.float32)
        dense[owner[a:b], feature[a:b] - lo] = 1
        common += dense @ dense.T
    union = size[:, None] + size[None, :] - common
    linked = common >= threshold * union - 1e-3
    linked &= old[:, None] != old[None, :]
    if wanted[0] != wanted[1]:
        linked &= parts[:, None] != parts[None, :]
    one, two = np.nonzero(np.triu(linked))
    bins = np.clip((common[one, two] / union[one, two] - threshold) / (1 - threshold) * BINS, 0, BINS - 1).astype(np.int64)
    partners = linked @ weight
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
        low = low[low]
        if (low == root).all():
            return partners, root, np.bincount(bins, minlength=BINS)
        root = low


def grown(tries: DataFrame, depth: int, blocks: DataFrame | None, last: int) -> DataFrame:
    """node, old, root: blocks of prefixes of length depth, and what each node was in before. blocks: those of length `last`, which take part as one node each."""
    if blocks is None:
        return components(tries.filter(F.col("prefix") >= depth), "blocks").select("node", F.col("node").alias("old"), "root")
    edges = tries.filter((F.col("prefix") >= depth) & (F.col("prefix") < last))
    for c in ("a", "b"):
        edges = edges.join(blocks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    found = components(edges.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "blocks")
    found = materialize(found, "blocks")
    old = blocks.select("node", F.col("root").alias("old")).join(found.select(F.col("node").alias("old"), "root"), "old", "left").select("node", "old", F.coalesce("root", "old").alias("root"))
    new = found.join(blocks.select(F.col("root").alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("old"), "root")
    return old.unionByName(new)


def verified(texts: DataFrame, kinds: DataFrame, blocks: DataFrame, k: int, threshold: float, most: int, packs: int) -> DataFrame:
    """a, b, n, bins: of each text with new links, a text that it is connected with (itself for the least one) and the number of partners;
    bins: links by similarity of a whole task, in one row of it."""
    member = blocks.join(kinds.select(F.col("rep").alias("node"), "key1", "key2", "copies", "size"), "node")
    # a large old block has parts of its own, which need not meet each other; all others of a block share theirs
    olds = member.groupBy("root", "old").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    fresh = olds.groupBy("root").agg(F.min("old").alias("x"), F.max("old").alias("y")).filter("x < y").select("root")
    olds = olds.join(fresh, "root", "left_semi").withColumn("own", F.when((F.col("n") > most // 2) | (F.col("s") > SHINGLES // 2), F.col("old")).otherwise(POOLED))
    parts = F.greatest(F.ceil(F.sum("n") / most), F.ceil(F.sum("s") / SHINGLES)).cast("int")
    owns = olds.groupBy("root", "own").agg(F.sum("n").alias("n"), parts.alias("parts"))
    order = Window.partitionBy("root").orderBy("own")
    owns = owns.select("root", "own", "n", "parts", (F.sum("parts").over(order) - F.col("parts")).cast("int").alias("first"), F.sum("parts").over(Window.partitionBy("root")).cast("int").alias("total"))
    sizes = owns.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    member = look_up(look_up(member, olds.drop("s"), ["root", "old"], sizes.members, sizes.most), owns, ["root", "own"], sizes.members, sizes.most)
    member = member.withColumn("part", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    member = member.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    member = member.filter((F.col("own") == POOLED) | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("parts")))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    pack = F.when(F.col("total") == 1, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.xxhash64("root", lo, hi))
    member = member.select(pack.alias("pack"), "root", lo.alias("lo"), hi.alias("hi"), "part", "old", "node", "key1", "key2", "copies", "text")

    def verify(table: pa.Table) -> pa.Table:
        batch = table.select(["node", "text"]).combine_chunks().to_batches()
        sets, keep = [], []
        seen: set[tuple] = set()
        columns = {c: table.column(c).to_numpy() for c in ("root", "lo", "hi", "part", "old", "node", "key1", "key2", "copies")}
        _, data, off = text_arrays(batch[0], "node") if batch else (None, None, np.zeros(1, np.int64))
        for first, last in chunks(off, CHUNK):
            h, at = shingles(data[off[first] : off[last]], off[first : last + 1] - off[first], k)
            one, two = set_keys(h, at)
            for i in range(first, last):
                place = tuple(int(columns[c][i]) for c in ("root", "lo", "hi", "node"))
                # rows that repeat a doc_id: the text that is meant, once
                if one[i - first] == columns["key1"][i] and two[i - first] == columns["key2"][i] and place not in seen:
                    seen.add(place)
                    keep.append(i)
                    sets.append(h[at[i - first] : at[i - first + 1]])
        keep = np.array(keep, np.int64)
        where = np.lexsort((columns["node"][keep], columns["hi"][keep], columns["lo"][keep], columns["root"][keep]))
        block = np.stack([columns[c][keep][where] for c in ("root", "lo", "hi")], 1)
        cuts = np.flatnonzero((block[1:] != block[:-1]).any(1)) + 1
        out, bins = [np.full((1, 3), -1)], np.zeros(BINS, np.int64)
        for rows in np.split(where, cuts) if len(where) else []:
            i = keep[rows]
            node, weight = columns["node"][i], columns["copies"][i].astype(np.float64)
            partners, root, some_bins = verify_block([sets[r] for r in rows], columns["part"][i], (columns["lo"][i[0]], columns["hi"][i[0]]), columns["old"][i], weight, threshold)
            some = partners > 0
            bins += some_bins
            out.append(np.stack([node[some], node[root[some]], partners[some].astype(np.int64)], 1))
        out = np.concatenate(out)
        return pa.table({**{n: pa.array(out[:, j]) for j, n in enumerate(("a", "b", "n"))}, "bins": pa.array([bins.tolist(), *[None] * (len(out) - 1)], pa.list_(pa.int64()))})

    return member.groupBy("pack").applyInArrow(verify, "a long, b long, n long, bins array<long>")


def join(docs: DataFrame, k: int = 5, threshold: float = 0.8, trees: int = 40, max_depth: int = 12, recall: float = 0.9999, most_in_block: int = 512) -> DataFrame:
    """doc_id, class_id (least doc_id of those connected by links), copy_id (least doc_id with the same shingles),
    n_links (other documents with a similarity of the threshold or more)."""
    docs = id_and_text(docs)
    sketches = materialize(sketch(docs, k, trees, max_depth), "sketch")
    alone = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(0)
    keys = sketches.select("doc_id", "key1", "key2", alone.alias("key3"))
    kinds = sketches.groupBy("key1", "key2", alone.alias("key3")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size"), F.first("labels").alias("labels"))
    kinds = materialize(kinds, "kinds")
    depth, least = max_depth, shortest_prefix(threshold, trees, max_depth, recall)
    tries = neighbours(kinds, trees, max_depth, least)
    candidates = tries.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.select(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("node"), "text").join(if_small(candidates), "node", "left_semi")
    texts = materialize(texts, "candidates")
    packs = max(1, -(-text_bytes(texts) // PACK))
    before, last, found, links = None, max_depth, [], np.zeros(BINS, np.int64)
    while True:
        blocks = materialize(grown(tries, depth, before, last), "block")
        checked = materialize(verified(texts, kinds, blocks, k, threshold, most_in_block, packs), "links")
        for r in checked.filter("bins IS NOT NULL").select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # BINS rows
            links[r.pos] += r.n
        found.append(checked.filter("bins IS NULL").select("a", "b", "n"))
        shorter = next_depth(links, threshold, depth, least, trees, recall)
        if shorter == depth:
            break
        before, last, depth = blocks, depth, shorter
    checked = found[0]
    for more in found[1:]:
        checked = checked.unionByName(more)
    classes = components(checked.select("a", "b"), "classes").select(F.col("node").alias("rep"), F.col("root").alias("class"))
    total = checked.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    kinds = kinds.select("key1", "key2", alone_of(kinds), "rep", "copies").join(total, "rep", "left").join(classes, "rep", "left")
    result = keys.join(kinds, ["key1", "key2", "key3"])
    known = F.when(F.col("doc_id") != int(NULL_ID), F.col("doc_id"))
    return result.select(known.alias("doc_id"), F.coalesce("class", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def alone_of(kinds: DataFrame):
    return F.when(F.col("size") == 0, F.col("rep")).otherwise(0).alias("key3")
