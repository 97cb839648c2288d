"""Bounded-space online packing (operator 1).

Each partition keeps a fixed number of open windows. A document longer than a window fills whole
windows; what is left is placed in the open window where it fits best. If it fits in none, the
fullest window is emitted; if that window still has room for a piece of `least_cut` tokens, it is
first filled from the document. At the end of a partition its open windows are leftovers, whose
pieces are merged in a second pass of the same kind: leftovers of some 64 partitions meet in one task, so no
task gets more than 64 times the open windows, whatever the size of the input; in that pass
pieces are cut to fill windows up, so each group ends with one window that is not full.

The result is one row for each piece. A row's ids are those of its document from `start` on.
Null text: as empty, its only id is the end id. Repeated rows: packed once each, told apart by
the sequence. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from inkfold.llm import pretokens
from inkfold.llm.common import NULL_ID, id_and_text, ids_out, materialize
from inkfold.llm.token_counts import byte_letters

OPEN_WINDOWS = 64
MERGED_PARTITIONS = 64
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_OF = byte_letters()
NO_ID = int(NULL_ID)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them. The same vocabulary runs in the faster
    tiktoken; the few texts with characters that are new in Unicode, which the two may class
    differently, or with runs of blanks that tiktoken fails on, go to the library itself."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.specials = {x.content: k for k, x in self.library.get_added_tokens_decoder().items()}
        ranks = {bytes(BYTE_OF[c] for c in token): k for token, k in self.library.get_vocab().items() if token not in self.specials}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)
        self.allowed = set(self.specials)

    def ids(self, text: str) -> np.ndarray:
        if text.isascii() or pretokens.recent().isdisjoint(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
            except ValueError:  # its pattern runs out of stack on about a million blanks in a row
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows of one partition; pieces are (doc, start, length, crc or ids, tokens of the document)."""

    def __init__(self, size: int, open_windows: int, least_cut: int, first: int):
        self.size, self.most, self.least_cut, self.next = size, open_windows, least_cut, first
        self.room: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []  # (sequence, pieces)

    def emit(self, held: list[tuple]) -> None:
        self.out.append((self.next, held))
        self.next += 1

    def add(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        at = bisect_left(self.room, (len(ids), -1))
        if at == len(self.room) and len(self.room) >= self.most:
            free, window = self.room.pop(0)
            held = self.held.pop(window)
            if free >= self.least_cut:
                held.append((doc, start, ids[:free], total))
                start, ids = start + free, ids[free:]
            self.emit(held)
            at = bisect_left(self.room, (len(ids), -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            free, window = self.size, max(self.held, default=-1) + 1
        self.held.setdefault(window, []).append((doc, start, ids, total))
        if free == len(ids):
            self.emit(self.held.pop(window))
        else:
            insort(self.room, (free - len(ids), window))

    def leftovers(self) -> list[list[tuple]]:
        """Open windows, fullest first."""
        out = [self.held[w] for _, w in self.room]
        self.room, self.held = [], {}
        return out


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def rows(windows: list[tuple], leftover: bool) -> pa.RecordBatch:
    """leftover: the ids themselves go along, as they may be cut once more."""
    flat = [(doc, start, ids, total, seq, at) for seq, held in windows for (doc, start, ids, total), at in zip(held, np.cumsum([0, *[len(x[2]) for x in held]]).tolist(), strict=False)]
    columns = [
        ids_out(np.array([x[0] for x in flat], np.int64)),
        pa.array([x[1] for x in flat], pa.int64()),
        pa.array([len(x[2]) for x in flat], pa.int64()),
        pa.array([zlib.crc32(np.ascontiguousarray(x[2], "<u4")) for x in flat], pa.int64()),
        pa.array([x[3] for x in flat], pa.int64()),
        pa.array([x[4] for x in flat], pa.int64()),
        pa.array([x[5] for x in flat], pa.int64()),
        pa.array([np.ascontiguousarray(x[2], "<u4").tobytes() if leftover else None for x in flat], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [*NAMES, "ids"])


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, open_windows: int = OPEN_WINDOWS, least_cut: int = 16) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def fill(batches):
        coder, packer = encoder(tokenizer), None
        for batch in batches:
            packer = packer or Packer(size, open_windows, least_cut, TaskContext.get().partitionId() << 36)
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(coder.ids(text), np.uint32(end_id))
                packer.add((NO_ID if key is None else key, 0, ids, len(ids)))
            yield rows(packer.out, False)
            packer.out = []
        if packer:
            yield rows([(packer.next + k, held) for k, held in enumerate(packer.leftovers())], True)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        # sequence numbers of the group's first partition, beyond those that it has used
        packer = Packer(size, open_windows, 1, (table.column("grp")[0].as_py() * MERGED_PARTITIONS << 36) + (1 << 35))
        columns = [table.column(n) for n in ("doc_id", "start", "ids", "doc_tokens")]
        for doc, start, ids, total in zip(*(c.to_pylist() for c in columns), strict=True):
            packer.add((NO_ID if doc is None else doc, start, np.frombuffer(ids, "<u4"), total))
        made = packer.out
        packer.out, packer.most = [], 1  # what is open at the end: one window after the other
        for held in packer.leftovers():
            for piece in held:
                packer.add(piece)
        made += packer.out
        made += [(packer.next + k, held) for k, held in enumerate(packer.leftovers())]
        return pa.Table.from_batches([rows(made, False).select(NAMES)])

    first = materialize(id_and_text(docs).mapInArrow(fill, COLUMNS + ", ids binary"), "pack")
    left = first.filter(F.col("ids").isNotNull()).withColumn("grp", F.shiftright(F.shiftright("sequence_id", 36), MERGED_PARTITIONS.bit_length() - 1))
    merged = left.groupBy("grp").applyInArrow(merge, COLUMNS)
    return first.filter(F.col("ids").isNull()).drop("ids").unionByName(merged)

