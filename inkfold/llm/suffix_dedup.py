"""Suffix-array dedup by bucket-pointer refinement (operator 3).

Removes each byte that is covered by a 50-byte string which also starts in a document with a
smaller doc_id. The suffixes of all documents are dealt out by minimiser (see superkmers). There every
suffix has a bucket pointer, at first that of its q-gram of 16 bytes. Rounds refine buckets by sorting on
(own pointer, pointer of the suffix some bytes later) and write the refined pointers back, so a round looks up what the
round before it has refined at later offsets: 16, 32 and at last 50 bytes. A suffix that is alone in its bucket,
or that runs into one that is, drops out. What remains is compared byte by byte.

Null text: as empty, nothing to remove. Texts under 50 bytes: nothing is removed. Rows that
share a doc_id, whatever their texts, or have none: neither removes from the other. A null doc_id orders last. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfold.llm.common import ids_out, mix, ragged_index
from inkfold.llm.superkmers import covered, find, groups, super_kmers

Q = 16
ALONE = np.int32(-1)
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SEGMENT = 2_000_000


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buffer=buf, strides=(1,))


def refine(buf: np.ndarray, at: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in buf of all groups of two or more equal k-byte strings inside the strings buf[at:][:lens], and where groups start.

    pointer[p] is the bucket of the suffix at p, as a place in the sorted order (ALONE: no other suffix is in it).
    In each round suffixes are sorted on (own bucket, bucket `step` further on); both agree in `depth` bytes, so refined buckets
    agree in depth + step. The refined pointers replace the old ones and are those that the next round looks up."""
    words = eights(buf)
    pointer = np.full(len(buf), ALONE, np.int32)
    depth, pos = Q, ragged_index(at, np.maximum(lens - Q + 1, 0))
    member, start = groups(mix(words[pos] * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[pos + 8])))
    member = pos[member]
    while True:
        size = np.diff(np.append(start, len(member)))
        pointer[member] = np.repeat(start, size)
        if depth >= k:
            break
        step = min(depth, k - depth)
        depth += step
        pos = ragged_index(at, np.maximum(lens - depth + 1, 0))  # suffixes that have as many bytes
        own, later = pointer[pos], pointer[pos + step]
        live = (own != ALONE) & (later != ALONE)
        pos = pos[live]
        at_once = mix((own[live].astype(np.uint64) << np.uint64(32)) | later[live].astype(np.uint64))  # one to one
        pointer[:] = ALONE
        member, start = groups(at_once)
        member = pos[member]
    if not len(member):
        return member, start
    head = np.repeat(member[start], size)
    offsets = [*range(0, k - 7, 8), k - 8]
    if all((words[member + o] == words[head + o]).all() for o in offsets):
        return member, start
    keys = [words[member + o] for o in offsets]  # two q-grams share a hash: sort on the bytes themselves
    order = np.lexsort(keys)
    differ = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
    among, start = groups(mix(np.cumsum(np.concatenate([[0], differ])).astype(np.uint64)))
    return member[order][among], start


def remove_repeats(docs: DataFrame, k: int = 50, m: int = 8) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) of each text; k at least 32."""

    def cut(data, off, common):
        lens = np.diff(off)
        pieces = np.maximum(1, -(-lens // SEGMENT))  # of very long texts, with windows dealt among them
        text = np.repeat(np.arange(len(lens)), pieces)
        nth = ragged_index(np.zeros(len(lens), np.int64), pieces)
        lo = off[:-1][text] + nth * SEGMENT
        hi = np.minimum(lo + SEGMENT + k - 1, off[1:][text])
        found = []
        for a, b in runs(lo, hi):
            size = hi[a:b] - lo[a:b]
            first = np.concatenate([[0], np.cumsum(size)])
            s, r, low = super_kmers(BYTES[data[ragged_index(lo[a:b], size)]], first, k, m, common)
            seg = np.searchsorted(first, s, "right") - 1
            found.append((lo[a:b][seg] + s - first[seg], r, low, text[a:b][seg]))
        at, r, low, text = (np.concatenate([x[i] for x in found]) for i in range(4)) if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        start = at - off[:-1][text] if len(text) else at
        return data, at, r + k - 1, text, start, start + r + k - 1, low

    def runs(lo, hi):
        """Ranges of segments of some 2 MB together."""
        total, a = np.cumsum(hi - lo), 0
        while a < len(lo):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SEGMENT, "right")))
            yield a, b
            a = b

    cut.later = lambda doc, start: doc
    cut.units = lambda buf, at, lens: lens

    def search(buf, at, lens, doc, start):
        member, first = refine(buf, at, lens, k)
        if not len(member):
            return [np.zeros(0, np.int64)] * 3
        owner_of = lambda p: np.searchsorted(at, p, "right") - 1
        ids = doc[owner_of(member)]
        hit = np.sort(member[ids > np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(member))))])
        if not len(hit):
            return [np.zeros(0, np.int64)] * 3
        edge = np.ones(len(hit), bool)
        edge[1:] = hit[1:] != hit[:-1] + 1  # strings lie k - 1 places apart at least, so no run goes on from one to the next
        a, b = hit[edge], hit[np.append(edge[1:], True)]
        own = owner_of(a)
        return own, start[own] + a - at[own], start[own] + b - at[own] + k

    def finish(ids, data, off, stretches):
        out = []
        for (s, e), lo, hi in zip(stretches, off[:-1].tolist(), off[1:].tolist(), strict=True):
            text = data[lo:hi]
            gone = covered(hi - lo, s, e)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            out.append((int(gone.sum()), len(edge) // 2, hashlib.sha256(text[~gone].tobytes() if len(s) else text.tobytes()).hexdigest(), edge.tolist()))
        return pa.table({
            "doc_id": ids_out(ids), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array([x[0] for x in out], pa.int64()), "n_spans": pa.array([x[1] for x in out], pa.int64()),
            "kept_sha256": pa.array([x[2] for x in out], pa.string()), "spans": pa.array([x[3] for x in out], pa.list_(pa.int64())),
        })

    return find(docs, cut, search, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
