"""Benchmark decontamination by a prefix-filtered set join (operator 6).

A window is 10 consecutive words of a benchmark item, or a whole item of fewer words. A document
contains a window only if it has the window's rarest word, so that word alone is the prefix that has
to be joined (exact containment allows no word to be missing). Rarity is counted over all documents.
A document word that is the rarest word of some window, at its offset there, gives a place
where that window could start; places that would leave the document on either side are dropped (position and
length bounds), what is left is looked up by the hash of the whole window and then compared byte by byte.

Items are dealt into blocks of some `block_bytes` of text, long items in pieces. Each block's table is a broadcast of its own, of bounded
size; a task takes one after the other for some texts and holds one of them. So documents are
read twice, to count words and to find windows, however many items there are.

Null or empty text: no words. Items that repeat an id are one item with several texts. Null item_id: the
empty string. Repeated documents: one result each. Very long texts are read in segments. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import Spans, carried_schema, carrying, chunks, ids_out, materialize, ragged_index, segments, text_arrays, word_bounds
from inkfold.llm.substring_dedup import joined

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
CHUNK = 4_000_000


def words_of(data: np.ndarray, off: np.ndarray):
    """Lower-cased words of texts, joined by spaces: buffer, starts, ends, first word of each text, hash of each word, Spans."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, off, WORD)
    buf, a, b = joined(data, starts, ends)
    spans = Spans(buf)
    return buf, a, b, first, spans.hash(a, b), spans


def bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


class Windows:
    """The windows of one block of items."""

    def __init__(self, items: list[tuple[str, str]], k: int):
        self.ids = [i for i, _ in items]
        data, off = bytes_of([t for _, t in items])
        self.buf, a, b, first, self.words, spans = words_of(data, off)
        n = np.diff(first)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        self.first = ragged_index(first[:-1], count)
        self.item = np.repeat(np.arange(len(items)), count)
        self.size = np.minimum(n, k)[self.item]
        self.start, self.end = a[self.first], b[self.first + self.size - 1]
        self.hash = spans.hash(self.start, self.end)
        order = np.argsort(self.hash, kind="stable")
        self.first, self.item, self.size, self.start, self.end, self.hash = (x[order] for x in (self.first, self.item, self.size, self.start, self.end, self.hash))
        self.vocabulary, self.word_no = np.unique(self.words, return_inverse=True)

    def order(self, counts: np.ndarray) -> None:
        """Choose the prefix word of each window. counts: how often each word of the vocabulary is in the documents."""
        rare = counts[self.word_no]
        at = ragged_index(self.first, self.size)
        owner = np.repeat(np.arange(len(self.first)), self.size)
        by = np.lexsort((at, rare[at], owner))
        head = np.searchsorted(owner, np.arange(len(self.first)))
        prefix = at[by][head]
        key = np.stack([self.words[prefix].view(np.int64), prefix - self.first, self.size], 1)
        key = np.unique(key, axis=0)
        word = key[:, 0].copy().view(np.uint64)
        order = np.argsort(word, kind="stable")
        self.prefix, self.offset, self.length = word[order], key[order, 1], key[order, 2]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.prefix >> np.uint64(48)] = True
        del self.words, self.word_no

    def hits(self, buf, a, b, first, words, spans):
        """(document word, words, window) of each occurrence in the texts."""
        at = np.flatnonzero(self.maybe[words >> np.uint64(48)])
        lo, hi = np.searchsorted(self.prefix, words[at], "left"), np.searchsorted(self.prefix, words[at], "right")
        which = ragged_index(lo, hi - lo)
        at = np.repeat(at, hi - lo)
        start, size = at - self.offset[which], self.length[which]
        text = np.searchsorted(first, at, "right") - 1
        fits = (start >= first[text]) & (start + size <= first[text + 1])
        start, size = start[fits], size[fits]
        x, y = a[start], b[start + size - 1]
        h = spans.hash(x, y)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        window = ragged_index(lo, hi - lo)
        start, size, x, y = (np.repeat(v, hi - lo) for v in (start, size, x, y))
        same = ((self.end - self.start)[window] == y - x) & (self.size[window] == size)
        start, size, x, y, window = start[same], size[same], x[same], y[same], window[same]
        keep = equal_slices(buf, x, self.buf, self.start[window], y - x)
        return start[keep], size[keep], window[keep]


def equal_slices(a, at, b, other, lens):
    """For each k: a[at[k]:][:lens[k]] equals b[other[k]:][:lens[k]]."""
    out = np.ones(len(at), bool)
    for lo in range(0, len(at), 20_000):
        part = slice(lo, lo + 20_000)
        bad = a[ragged_index(at[part], lens[part])] != b[ragged_index(other[part], lens[part])]
        out[np.repeat(np.arange(len(at))[part], lens[part])[bad]] = False
    return out


def item_blocks(items: DataFrame, k: int, block_bytes: int):
    """(item_id, text) pairs in lists of some `block_bytes` of text; long items in pieces that share k - 1 words. The driver holds one list at a time."""

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column("item_id").to_pylist(), batch.column("text").to_pylist()
            for item, text in zip(ids, texts, strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                pieces = [data.tobytes()] if len(data) <= block_bytes // 4 else [data[lo:hi].tobytes() for lo, hi, _, _, windows in segments(LOWER[data], k, WORD, block_bytes // 4) if windows or not lo]
                for piece in pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([piece.decode()])], ["item_id", "text"])

    held, size = [], 0
    for r in items.distinct().mapInArrow(cut, "item_id string, text string").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text.encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def texts_of(batch: pa.RecordBatch, k: int):
    """(first text, last text, number of the first word, words_of) of several texts at once, very long ones in segments that share k - 1 words."""
    ids, data, off = text_arrays(batch)
    for lo, hi in chunks(off, CHUNK):
        part = data[off[lo] : off[hi]]
        if hi - lo > 1 or len(part) <= 2 * CHUNK:
            yield lo, hi, 0, words_of(part, off[lo : hi + 1] - off[lo])
            continue
        at = 0
        for a, b, starts, _, _ in segments(LOWER[part], k, WORD, CHUNK):
            yield lo, hi, at, words_of(part[a:b], np.array([0, b - a]))
            at += max(len(starts) - (k - 1), 0)


def contamination(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 4_000_000, carry: tuple = ()) -> DataFrame:
    """doc_id, n_words, items (sorted ids of items with occurring windows), hits (first word and end of each occurrence)
    and n_hit (words inside any occurrence) of each document; carried: the columns of docs that are asked for."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    items = materialize(items, "items")
    docs, sc = carrying(docs, carry), docs.sparkSession.sparkContext
    vocabularies = [sc.broadcast(Windows(block, k).vocabulary) for block in item_blocks(items, k, block_bytes)]

    def count(batches):
        def rows(n, counts):
            some = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(some), pa.array(counts[some])], ["block", "word", "n"])

        total = None
        for batch in batches:
            for *_, (_, _, _, _, words, _) in texts_of(batch, 1):
                for n, shared in enumerate(vocabularies):
                    vocabulary = shared.value
                    if len(vocabulary):
                        near = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                        counts = np.bincount(near[vocabulary[near] == words], minlength=len(vocabulary))
                        if len(vocabularies) > 1:  # a task holds one block's counts
                            yield rows(n, counts)
                            shared.__dict__.pop("_value", None)
                        else:
                            total = counts if total is None else total + counts
        if total is not None:
            yield rows(0, total)

    counts = materialize(docs.select("doc_id", "text").mapInArrow(count, "block int, word long, n long").groupBy("block", "word").agg(F.sum("n").alias("n")), "rarity")
    tables = []
    for n, block in enumerate(item_blocks(items, k, block_bytes)):
        table = Windows(block, k)
        often = np.zeros(len(table.vocabulary), np.int64)
        for r in counts.filter(F.col("block") == n).toLocalIterator():
            often[r.word] = r.n  # at most one row for each word of the block
        table.order(often)
        tables.append(sc.broadcast(table))

    def find(batches):
        for batch in batches:
            ids = text_arrays(batch)[0]
            n_words, items_out, hits_out = np.zeros(len(ids), np.int64), [set() for _ in ids], [set() for _ in ids]
            for lo, hi, before, (buf, a, b, first, words, spans) in texts_of(batch, k):
                n_words[lo:hi] = before + np.diff(first)
                for shared in tables:
                    table = shared.value
                    start, size, window = table.hits(buf, a, b, first, words, spans)
                    if len(start):
                        text = np.searchsorted(first, start, "right") - 1
                        for t, i in np.unique(np.stack([text, table.item[window]], 1), axis=0).tolist():
                            items_out[lo + t].add(table.ids[i])
                        for t, s, e in np.unique(np.stack([text, start - first[text] + before, start - first[text] + before + size], 1), axis=0).tolist():
                            hits_out[lo + t].add((s, e))
                    if len(tables) > 1:
                        shared.__dict__.pop("_value", None)
            spans_out = [[{"start": s, "end": e} for s, e in sorted(h)] for h in hits_out]
            yield pa.RecordBatch.from_arrays(
                [ids_out(ids), pa.array(n_words), pa.array([sorted(i) for i in items_out], pa.list_(pa.string())), pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *batch.columns[2:]],
                ["doc_id", "n_words", "items", "hits", *batch.schema.names[2:]],
            )

    out = docs.mapInArrow(find, carried_schema(docs, "doc_id long, n_words long, items array<string>, hits array<struct<start: long, end: long>>"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    walk = F.aggregate("hits", zero, lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n")))
    return out.withColumn("n_hit", walk["n"])
