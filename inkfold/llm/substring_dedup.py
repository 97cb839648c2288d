"""Substring dedup by super-k-mer partitioning (operator 7).

Removes each word that is covered by a window of 20 words whose word sequence also starts earlier
(in a smaller doc_id, or in the same document further left). Consecutive windows that share a minimiser travel as
one packed string to its bucket; there equal windows are brought together by a sort and compared
byte by byte, and all but the earliest are repeats. Windows are judged on the input.

Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage
return. Null text: no words. Texts under 20 words: nothing is removed. Rows that share a
doc_id, or have none: read as places of one document, so of a window the furthest left stays, and at the same place
in two rows it stays in both; rows with the same text have the same result. A null doc_id orders last. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfold.llm.common import SPACE, Spans, ids_out, ragged_equal, ragged_index, slice_hashes, word_bounds
from inkfold.llm.superkmers import covered, find, groups, places, super_kmers


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and their places there."""
    lens = ends - starts
    at = np.cumsum(lens + 1) - (lens + 1)
    out = np.full(int((lens + 1).sum()), 0x20, np.uint8)
    out[ragged_index(at, lens)] = data[ragged_index(starts, lens)]
    return out, at, at + lens


def remove_repeats(docs: DataFrame, k: int = 20, m: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text that is left) of each text."""

    def cut(data, off, common):
        starts, ends, first = word_bounds(data, off, ~SPACE)
        buf, a, b = joined(data, starts, ends)
        s, r, low = super_kmers(Spans(buf).hash(a, b), first, k, m, common)
        text = np.searchsorted(first, s, "right") - 1
        start = s - first[text] if len(s) else s
        last = s + r + k - 2
        return buf, a[s] if len(s) else s, b[last] - a[s] if len(s) else s, text, start, start + r + k - 1, low

    def bounds(buf, at, lens):
        data = buf[ragged_index(at, lens)]
        return data, *word_bounds(data, np.concatenate([[0], np.cumsum(lens)]), ~SPACE)

    cut.later = places
    cut.units = lambda buf, at, lens: np.diff(bounds(buf, at, lens)[3])

    def search(buf, at, lens, doc, start):
        if not len(at):
            return [np.zeros(0, np.int64)] * 3
        data, starts, ends, first = bounds(buf, at, lens)
        windows = np.diff(first) - k + 1
        word, owner = ragged_index(first[:-1], windows), np.repeat(np.arange(len(at)), windows)
        a, b = starts[word], ends[word + k - 1]
        member, head = groups(slice_hashes(data, a, b - a))
        if not len(member):
            return [np.zeros(0, np.int64)] * 3
        size = np.diff(np.append(head, len(member)))
        ref = np.repeat(member[head], size)
        same = (b - a)[member] == (b - a)[ref]
        same[same] = ragged_equal(data, a[member[same]], a[ref[same]], (b - a)[member[same]])
        own = owner[member]
        place = np.where(same, places(doc[own], start[own] + word[member] - first[own]), np.iinfo(np.int64).max)
        hit = np.sort(member[same & (place > np.repeat(np.minimum.reduceat(place, head), size))])
        if not len(hit):
            return [np.zeros(0, np.int64)] * 3
        edge = np.ones(len(hit), bool)
        edge[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
        lo, hi = hit[edge], hit[np.append(edge[1:], True)]
        own = owner[lo]
        return own, start[own] + word[lo] - first[own], start[own] + word[hi] - first[own] + k

    def finish(ids, data, off, stretches):
        starts, ends, first = word_bounds(data, off, ~SPACE)
        buf, a, b = joined(data, starts, ends)
        out = []
        for (s, e), lo, hi in zip(stretches, first[:-1].tolist(), first[1:].tolist(), strict=True):
            gone = covered(hi - lo, s, e)
            keep = np.flatnonzero(~gone) + lo
            if len(keep) == hi - lo:
                kept = buf[a[lo] : b[hi - 1]] if hi > lo else buf[:0]
            else:
                kept = buf[ragged_index(a[keep], (b - a)[keep] + 1)][:-1]
            kept = kept.tobytes()
            out.append((hi - lo, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
        return pa.table({
            "doc_id": ids_out(ids), "n_words": pa.array([x[0] for x in out], pa.int64()), "n_removed": pa.array([x[1] for x in out], pa.int64()),
            "kept_sha256": pa.array([x[2] for x in out], pa.string()), "kept": pa.array([x[3].decode() for x in out], pa.string()),
        })

    return find(docs, cut, search, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
