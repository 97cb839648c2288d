"""Token counts by rank-synchronous array merging (operator 2).

Texts of a batch are cut into pre-tokens with numpy; equal pre-tokens of a batch are worked on
once. All of them stand in one ragged array of symbols, and in each round every sequence merges
all places of its own lowest-rank pair at once, until no pair of it is in the vocabulary. A pair
that a merge makes always ranks behind that merge, so this gives the same symbols as merging one
place at a time. The symbols that survive are counted.

Null text: as empty. Empty text: 0 tokens. Repeated rows: one result each. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfold.llm import pretokens
from inkfold.llm.common import P, Spans, chunks, id_and_text, ids_out, ragged_equal, ragged_index, text_arrays

CHUNK = 4_000_000
NONE = np.int32(2**31 - 1)
SLOTS = 20


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others in order from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Merge ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.byte_ids = np.array([ids[c] for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])], np.int32)
        self.n_ids = max(ids.values()) + 1
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.table_keys = np.full(1 << SLOTS, -1, np.int64)  # open addressing, a few of a hundred slots in use
        self.table_ranks = np.full(1 << SLOTS, NONE, np.int32)
        keys = np.array([ids[a] * self.n_ids + ids[b] for a, b in pairs], np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self.slot(keys).tolist(), strict=True)):
            while self.table_keys[slot] >= 0:
                slot = (slot + 1) % (1 << SLOTS)
            self.table_keys[slot], self.table_ranks[slot] = key, rank
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * P) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n_ids + right
        slot = self.slot(key)
        found = self.table_keys[slot]
        out = np.where(found == key, self.table_ranks[slot], NONE)
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) % (1 << SLOTS)
            found = self.table_keys[slot[more]]
            hit = found == key[more]
            out[more[hit]] = self.table_ranks[slot[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out

    def merge(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each sequence of bytes (lens: at least 1 each), one after the other, and their counts."""
        counts = np.ones(len(lens), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # (sequence of each symbol, symbol)
        symbols, lens, which = self.byte_ids[data], lens.astype(np.int64), np.arange(len(lens))
        ends = np.cumsum(lens)
        ranks = np.full(len(symbols), NONE, np.int32)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[ends - 1] = NONE
        while len(lens):
            starts = np.cumsum(lens) - lens
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest != NONE
            if not live.all():
                over = np.flatnonzero(~live)
                counts[which[over]] = lens[over]
                done.append((np.repeat(which[over], lens[over]), symbols[ragged_index(starts[over], lens[over])]))
                keep = np.repeat(live, lens)
                symbols, ranks = symbols[keep], ranks[keep]
                lens, which, lowest = lens[live], which[live], lowest[live]
                if not len(lens):
                    break
            owner = np.repeat(np.arange(len(lens)), lens)
            hit = np.flatnonzero(ranks == lowest[owner])
            # aaa: of pairs that overlap, the first, third, ... of a run are merged
            new_run = np.ones(len(hit), bool)
            new_run[1:] = hit[1:] != hit[:-1] + 1
            if not new_run.all():
                run = np.cumsum(new_run) - 1
                place = np.arange(len(hit)) - np.flatnonzero(new_run)[run]
                hit = hit[place % 2 == 0]
            symbols[hit] = self.merged[ranks[hit]]
            gone = hit + 1
            lens = lens - np.bincount(owner[hit], minlength=len(lens))
            keep = np.ones(len(symbols), bool)
            keep[gone] = False
            moved = hit - np.arange(len(hit))
            symbols, ranks = symbols[keep], ranks[keep]
            last = np.zeros(len(symbols) + 1, bool)
            last[np.cumsum(lens) - 1] = True
            last[-1] = True  # stands before the first symbol too
            before = moved - 1
            ranks[moved[last[moved]]] = NONE
            inner = np.concatenate([before[~last[before]], moved[~last[moved]]])
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        seq = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int32)
        return sym[np.argsort(seq, kind="stable")], counts


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(data: np.ndarray, off: np.ndarray, specials: list[str]):
    """Pre-tokens of texts in UTF-8: byte starts, byte ends, first pre-token of each text (one more
    than texts), and for each pre-token which special string it is (-1: none)."""
    raw = data.tobytes()
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
    text_start = np.searchsorted(lead, off[:-1][np.diff(off) > 0])
    found = []
    for k, s in enumerate(specials):
        mark, at = s.encode(), raw.find(s.encode())
        while at >= 0:
            end = at + len(mark)
            if np.searchsorted(off, at, "right") == np.searchsorted(off, end - 1, "right"):
                found.append((at, end, k))
            at = raw.find(mark, end)
    found.sort()
    special = np.searchsorted(lead, np.array([x[0] for x in found], np.int64))
    after = np.searchsorted(lead, np.array([x[1] for x in found], np.int64))
    bounds = np.unique(np.concatenate([text_start, special, after]))
    at = pretokens.split(codes, bounds[bounds < len(codes)], special)
    starts = lead[at]
    ends = np.append(starts[1:], len(data))
    kind = np.full(len(starts), -1, np.int64)
    if found:
        kind[np.searchsorted(at, special)] = [x[2] for x in found]
    return starts, ends, np.searchsorted(starts, off), kind


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pre-token of each kind, and for each pre-token the number of its kind. Slices count as
    equal by hash and length, and then byte by byte."""
    hashes = Spans(data).hash(starts, ends) + (ends - starts).astype(np.uint64)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    same_len = (ends - starts) == (ends - starts)[first][inverse]
    if not (same_len.all() and ragged_equal(data, starts, starts[first][inverse], ends - starts).all()):
        return np.arange(len(starts)), np.arange(len(starts))  # two kinds share a hash: no sharing of work here
    return first, inverse


LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True


def parts(data: np.ndarray, off: np.ndarray, whole: bool, size: int = CHUNK):
    """(first text, last text, bytes, offsets) of some texts at once. A very long text comes in parts that begin at a blank between two ASCII letters, where a
    pre-token always begins; as a whole if it has no such place, or if whole is set."""
    for lo, hi in chunks(off, size):
        part = data[off[lo] : off[hi]]
        if whole or hi - lo > 1 or len(part) <= 2 * size:
            yield lo, hi, part, off[lo : hi + 1] - off[lo]
            continue
        at = 0
        while at < len(part):
            end = at + size
            while end < len(part) - 1:
                piece = part[end - 1 : end + size + 1]
                cut = np.flatnonzero((piece[1:-1] == 0x20) & LETTERS[piece[:-2]] & LETTERS[piece[2:]])
                if len(cut):
                    end += int(cut[0])
                    break
                end += size
            end = end if end < len(part) - 1 else len(part)
            yield lo, hi, part[at:end], np.array([0, end - at])
            at = end


def count_tokens(docs: DataFrame, vocab_path: str, limit: int, key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each text."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            ids, data, off = text_arrays(batch, key)
            tokens = np.zeros(len(ids), np.int64)
            for lo, hi, part, o in parts(data, off, any(" " in x for x in vocab.special)):
                if not len(part):
                    continue
                starts, ends, first, kind = pieces(part, o, list(vocab.special))
                one, inverse = distinct(part, starts, ends)
                _, counts = vocab.merge(part[ragged_index(starts[one], (ends - starts)[one])], (ends - starts)[one])
                each = np.where(kind >= 0, 1, counts[inverse])
                total = np.concatenate([[0], np.cumsum(each)])
                tokens[lo:hi] += total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([ids_out(ids), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, key).mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")
