"""Shared parts of the two operators that look for repeated windows (3 and 7).

A window is k consecutive units (bytes or words) of one document. Its minimiser is the least hash
among the grams of m units inside it. Consecutive windows with the same minimiser form a
super-k-mer, which travels as one packed string to the bucket of the minimiser, so that equal
windows of all documents meet there. Strings that are equal as a whole are folded first, in the
task that cuts them and again in the bucket: all but the earliest are repeats throughout. So a text
that a third of all documents share reaches its bucket once for each task, not once for each document.

Grams that are so common that their windows would overfill a bucket come last in the order of grams: a window takes
one of them for its minimiser only if it has no other. So the windows around a common expression are dealt out by what
else they hold, and those that lie wholly inside it are equal strings, which are folded. The weights of minimisers
are counted over all texts beforehand; at most `COMMON` grams can be that common, which bounds their broadcast.

Blocks of packed arrays are zstd-compressed and travel as single rows. Buckets and parts are as
many as the input's bytes ask for, so a task's memory doesn't grow with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import chunks, id_and_text, mix, ragged_equal, ragged_index, slice_hashes, sort_order, text_arrays, text_bytes

FLUSH = 12_000_000  # bytes of text whose super-k-mers are folded and sent together
BUCKET = 6_000_000  # bytes of packed strings that a bucket is to hold
COMMON = 1 << 20  # grams that may count as common: 8 bytes each
PART = 8_000_000  # bytes of text whose results are worked out together
BLOCK = "bucket int, kind int, payload binary"
STRINGS, REPEATS, TEXTS = 0, 1, 2
KINDS = [np.dtype(x) for x in (np.uint8, np.int32, np.int64)]


def dump(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (KINDS.index(a.dtype), len(a))]], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def load(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        dtype = KINDS[kind]
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


NONE = np.zeros(0, np.uint64)
LAST = np.uint64(1 << 63)


def rank_grams(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """63 bits for each gram's place in the order; common ones (sorted ranks) come after all others."""
    rank = mix(grams) >> np.uint64(1)
    if len(common):
        maybe = np.zeros(1 << 16, bool)
        maybe[common >> np.uint64(47)] = True
        at = np.flatnonzero(maybe[rank >> np.uint64(47)])
        near = np.minimum(np.searchsorted(common, rank[at]), len(common) - 1)
        rank[at[common[near] == rank[at]]] |= LAST
    return rank


def super_kmers(units: np.ndarray, first: np.ndarray, k: int, m: int, common: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer. units: a hash of each unit;
    first: the first unit of each text (one more than texts)."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, size = units, 1
    while size < m:  # hashes of grams of 1, 2, 4, ... and at last m units
        step = min(size, m - size)
        grams = grams[:-step] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * size) + grams[step:]
        size += step
    low, size, want = rank_grams(grams, common), 1, k - m + 1
    while size < want:  # least hash of 1, 2, 4, ... and at last all grams of a window
        step = min(size, want - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    valid = np.ones(n + 1, bool)
    lens = np.diff(first)
    late = ragged_index(np.maximum(first[1:] - k + 1, first[:-1]), np.minimum(lens, k - 1))
    valid[late[late < n]] = False
    valid[n] = False
    new = valid.copy()
    new[1:n] &= (low[1:] != low[:-1]) | ~valid[: n - 1]
    at = first[:-1][first[:-1] < n]
    new[at] = valid[at]
    edges = np.flatnonzero(new | ~valid)
    starts = np.flatnonzero(new)
    return starts, edges[np.searchsorted(edges, starts) + 1] - starts, low[starts]


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of all groups of two or more equal keys, a group after the other, and where groups start."""
    order, ordered = sort_order(keys)
    edge = np.ones(len(keys) + 1, bool)
    edge[1:-1] = ordered[1:] != ordered[:-1]
    alone = edge[1:] & edge[:-1]
    return order[~alone], np.flatnonzero(edge[:-1][~alone])


def fold(buf: np.ndarray, at: np.ndarray, lens: np.ndarray, keys: np.ndarray, rank: Callable) -> np.ndarray:
    """Which strings are repeats throughout: an equal string is earlier. keys: a hash of each string;
    rank(members): sortable places, of which a greater one is later."""
    out = np.zeros(len(at), bool)
    member, start = groups(keys ^ (lens.astype(np.uint64) << np.uint64(40)))
    if len(member):
        size = np.diff(np.append(start, len(member)))
        head = np.repeat(member[start], size)
        same = lens[member] == lens[head]
        same[same] = ragged_equal(buf, at[member[same]], at[head[same]], lens[member[same]])
        place = rank(member)
        place = np.where(same, place, np.iinfo(np.int64).max)  # a string that only shares the hash is left as it is
        least = np.repeat(np.minimum.reduceat(place, start), size)
        out[member] = same & (place > least)
    return out


def places(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Dense ranks of (doc, start) pairs."""
    order = np.lexsort((start, doc))
    edge = np.zeros(len(doc), np.int64)
    edge[1:] = (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(edge)
    return out


def spread(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) if ids.dtype == np.int64 else ids) % np.uint64(n)).astype(np.int64)


def by_number(number: np.ndarray):
    """(number, positions) for each number that occurs."""
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(number[part[0]]), part


def block(rows: list[tuple[int, int, bytes]], name: str = "bucket") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], [name, "kind", "payload"])


def tags(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """31 bits of each text, which tell rows with one doc_id and different texts apart."""
    return np.array([zlib.crc32(data[lo:hi]) >> 1 for lo, hi in pairwise(off.tolist())], np.int32)


def part_of(doc: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    return spread(doc.view(np.uint64) ^ (tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), n)


def repeats_out(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray, n_parts: int) -> list[tuple[int, int, bytes]]:
    return [(p, REPEATS, dump(doc[i], tag[i], start[i], end[i])) for p, i in by_number(part_of(doc, tag, n_parts))]


def minimiser_weights(docs: DataFrame, cut: Callable, share: float) -> DataFrame:
    """gram, weight: bytes of packed strings of each minimiser that makes up `share` of all or more. A task lets go of what is below an
    eighth of that share of its own, so a weight may be too low by that much, and a task holds 8 / share grams at most between two clearings."""

    def run(batches):
        low, weight, pending, total = NONE, np.zeros(0, np.int64), [], 0

        def cleared():
            own = np.concatenate([low, *(p[0] for p in pending)])
            order, own = sort_order(own)
            head = np.flatnonzero(np.concatenate([np.ones(min(len(own), 1), bool), own[1:] != own[:-1]]))
            sums = np.add.reduceat(np.concatenate([weight, *(p[1] for p in pending)])[order], head) if len(head) else weight
            keep = sums >= total * share / 8
            return own[head][keep], sums[keep]

        for batch in batches:
            _, data, off = text_arrays(batch)
            for lo, hi in chunks(off, 2_000_000):
                _, _, lens, _, _, _, own = cut(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], NONE)
                pending.append((own, lens))
                total += int(lens.sum())
            if sum(len(p[0]) for p in pending) > 1_000_000:
                low, weight = cleared()
                pending = []
        low, weight = cleared()
        yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(weight)], ["gram", "weight"])

    return docs.mapInArrow(run, "gram long, weight long").groupBy("gram").agg(F.sum("weight").alias("weight"))


def common_grams(docs: DataFrame, cut: Callable, packed: float) -> np.ndarray:
    """Sorted minimisers that would fill more than half a bucket; at most COMMON. packed: bytes of all packed strings."""
    limit = max(BUCKET / 2, packed / COMMON)
    found = minimiser_weights(docs, cut, limit / max(packed, 1)).filter(F.col("weight") >= limit * 0.75).select("gram").toLocalIterator()
    return np.sort(np.fromiter((r.gram for r in found), np.int64).view(np.uint64))


def find(docs: DataFrame, cut: Callable, search: Callable, finish: Callable, schema: str) -> DataFrame:
    """cut(data, off, common) -> buf, at, lens, text, start, end, minimiser of super-k-mers (start, end: units of the text);
    search(buf, at, lens, doc, start) -> string (its index), start, end of repeated stretches;
    finish(ids, data, off, stretches) -> rows of the result, stretches being (starts, ends) for each text. cut.later: rank of occurrences, as fold() takes it."""
    docs = id_and_text(docs)
    total = text_bytes(docs)
    n_buckets, n_parts = max(1, -(-total * 10 // (3 * BUCKET))), max(1, -(-total // PART))
    later = cut.later
    common = docs.sparkSession.sparkContext.broadcast(common_grams(docs, cut, total * 10 / 3))  # 8 * COMMON bytes at most

    def send(held: list[tuple]) -> list[tuple[int, int, bytes]]:
        base = np.cumsum([0, *[len(x[0]) for x in held]])
        buf = np.concatenate([x[0] for x in held])
        at = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
        lens, doc, tag, start, end, low, keys = (np.concatenate([x[k] for x in held]) for k in range(2, 9))
        again = fold(buf, at, lens, keys, lambda i: later(doc[i], start[i]))
        gone = np.flatnonzero(again)  # settled here; they only pass through some bucket on their way to the texts
        rows = [(int(spread(doc[gone[:1]] + start[gone[:1]], n_buckets)[0]), REPEATS, dump(doc[gone], tag[gone], start[gone], end[gone]))] if len(gone) else []
        keep = np.flatnonzero(~again)
        for bucket, i in by_number(spread(low[keep], n_buckets)):
            i = keep[i]
            rows.append((bucket, STRINGS, dump(doc[i], tag[i], start[i].astype(np.int32), lens[i].astype(np.int32), buf[ragged_index(at[i], lens[i])])))
        return rows

    def cut_all(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids, data, off = text_arrays(batch)
            tag = tags(data, off)
            for lo, hi in chunks(off, 2_000_000):
                buf, at, lens, text, start, end, low = cut(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], common.value)
                held.append((buf, at, lens, ids[lo:hi][text], tag[lo:hi][text], start, end, low, slice_hashes(buf, at, lens)))
                size += len(buf)
                if size >= FLUSH:
                    yield block(send(held))
                    held, size = [], 0
        if held:
            yield block(send(held))

    def search_all(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        out = [load(p) for k, p in zip(kinds, payloads, strict=True) if k == REPEATS]
        strings = [load(p) for k, p in zip(kinds, payloads, strict=True) if k == STRINGS]
        del payloads, table
        if strings:
            doc, tag, start, lens, buf = (np.concatenate([x[k] for x in strings]) for k in range(5))
            del strings
            start, lens = start.astype(np.int64), lens.astype(np.int64)
            at = np.cumsum(lens) - lens
            again = fold(buf, at, lens, slice_hashes(buf, at, lens), lambda i: later(doc[i], start[i]))
            units = cut.units(buf, at, lens)
            out.append([doc[again], tag[again], start[again], start[again] + units[again]])
            left = np.flatnonzero(~again)
            own, first, end = search(buf, at[left], lens[left], doc[left], start[left])
            out.append([doc[left[own]], tag[left[own]], first, end])
        if not out:
            return pa.Table.from_batches([block([], "part")])
        return pa.Table.from_batches([block(repeats_out(*(np.concatenate([x[k] for x in out]) for k in range(4)), n_parts), "part")])

    def parts_of(batches):
        held, size = [], 0

        def out():
            ids = np.concatenate([x[0] for x in held])
            data = np.concatenate([x[1] for x in held])
            lens = np.concatenate([np.diff(x[2]) for x in held])
            off = np.cumsum(lens) - lens
            return block([(p, TEXTS, dump(ids[i], lens[i], data[ragged_index(off[i], lens[i])])) for p, i in by_number(part_of(ids, tags(data, np.append(off, len(data))), n_parts))], "part")

        for batch in batches:
            held.append(text_arrays(batch))
            size += len(held[-1][1])
            if size >= FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def finish_all(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        texts = [load(p) for k, p in zip(kinds, payloads, strict=True) if k == TEXTS]
        found = [load(p) for k, p in zip(kinds, payloads, strict=True) if k == REPEATS]
        del payloads, table
        ids, lens, data = (np.concatenate([x[k] for x in texts]) for k in range(3)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        doc, tag, start, end = (np.concatenate([x[k] for x in found]) for k in range(4)) if found else [np.zeros(0, np.int64)] * 4
        off = np.concatenate([[0], np.cumsum(lens)])
        return finish(ids, data, off, stretches_of(ids, tags(data, off), doc, tag, start, end))

    part = "part int, kind int, payload binary"
    strings = docs.mapInArrow(cut_all, BLOCK)
    found = strings.groupBy("bucket").applyInArrow(search_all, part)
    return found.unionByName(docs.mapInArrow(parts_of, part)).groupBy("part").applyInArrow(finish_all, schema)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the stretches."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:n]) > 0


def stretches_of(ids: np.ndarray, own: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each text, known by its id and its own tag, its stretches."""
    _, number = np.unique(np.concatenate([ids, doc]), return_inverse=True)
    number = (number.astype(np.int64) << 31) | np.concatenate([own, tag]).astype(np.int64)
    text, key = number[: len(ids)], number[len(ids) :]
    order = np.argsort(key, kind="stable")
    key, start, end = key[order], start[order], end[order]
    for lo, hi in zip(np.searchsorted(key, text, "left").tolist(), np.searchsorted(key, text, "right").tolist(), strict=True):
        yield start[lo:hi], end[lo:hi]
