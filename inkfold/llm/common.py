"""Shared plumbing: input columns, the shared folder, ragged arrays, byte-level words."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 16_000_000
NULL_ID = np.iinfo(np.int64).max  # a null doc_id orders after every other id


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, in rows and bytes, so that a batch of long texts fits a Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the two columns that the operators read; a null text counts as empty."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def carrying(docs: DataFrame, carry: tuple, key: str = "doc_id") -> DataFrame:
    """id_and_text, and the columns to carry along as one struct, so that no later join has to find a row again."""
    id_, text = F.col(key).cast("long").alias(key), F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(id_, text, F.struct(*carry).alias("carried")) if carry else docs.select(id_, text)


def carried_schema(docs: DataFrame, fields: str) -> StructType:
    """The fields, and those that `carrying` has put into docs."""
    found = StructType.fromDDL(fields)
    return found.add(docs.schema["carried"]) if "carried" in docs.columns else found


def if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, marked for a broadcast if it has at most that many rows (of a few numbers each); a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset: the warehouse, or a temporary folder if driver and executors are one local process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = "file://" + tempfile.mkdtemp(prefix="inkfold-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, in one pass over df."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkfold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes the number of buckets."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


# --- ragged arrays ---------------------------------------------------------------------------


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0]+lens[0]-1, starts[1] .., one after the other."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lens), lens)


def ragged_equal(a: np.ndarray, at: np.ndarray, other: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each k: a[at[k]:][:lens[k]] equals a[other[k]:][:lens[k]]; worked off in bounded blocks."""
    out = np.ones(len(at), bool)
    if not len(at):
        return out
    cut = np.searchsorted(np.cumsum(lens), np.arange(0, int(lens.sum()) + 1, 4_000_000)[1:])
    for lo, hi in zip([0, *cut], [*cut, len(at)], strict=True):
        if hi > lo:
            n = lens[lo:hi]
            same = a[ragged_index(at[lo:hi], n)] == a[ragged_index(other[lo:hi], n)]
            bad = np.repeat(np.arange(lo, hi), n)[~same]
            out[bad] = False
    return out


# --- hashing ---------------------------------------------------------------------------------

P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full((2, n + 1), P, np.uint64)
    out[1] = _P_INV
    out[:, 0] = 1
    np.multiply.accumulate(out, axis=1, out=out)
    return out[0], out[1]


class Spans:
    """64-bit hashes of many slices of one array of codes, by a polynomial modulo 2^64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers, self.inverse = _powers(1 << max(21, int(n).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def slice_hashes(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, block: int = 1_500_000) -> np.ndarray:
    """Hashes of slices in rising order of their starts, worked off in blocks of codes."""
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + block, "right")))
        base, part = starts[lo], slice(lo, hi)
        ends = starts[part] + lens[part]
        out[part] = Spans(codes[base : ends.max()]).hash(starts[part] - base, ends - base)
        lo = hi
    return out


def sort_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of 64-bit keys and the keys in it. One plain sort of the keys' first bits with their positions
    behind them; the few runs in which different keys share their first bits are sorted once more."""
    n = len(keys)
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    both = (keys & ~low) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    both >>= np.uint64(bits)
    ordered = keys[order]
    mixed = np.flatnonzero((both[1:] == both[:-1]) & (ordered[1:] != ordered[:-1]))
    last = 0
    for at in mixed.tolist():
        if at < last:
            continue
        first, last = int(np.searchsorted(both, both[at], "left")), int(np.searchsorted(both, both[at], "right"))
        again = np.argsort(ordered[first:last], kind="stable")
        order[first:last], ordered[first:last] = order[first:last][again], ordered[first:last][again]
    return order, ordered


# --- Arrow -----------------------------------------------------------------------------------


def text_arrays(batch: pa.RecordBatch, key: str = "doc_id") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes of all texts one after the other, offsets (one more than texts)."""
    column = batch.column("text")
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    ids = pc.fill_null(batch.column(key).cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)
    return ids, data, off - off[0] if len(off) else np.zeros(1, np.int64)


def chunks(off: np.ndarray, most: int):
    """(first, last) ranges of texts of at most `most` bytes together, a longer text alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def segments(data: np.ndarray, k: int, inside: np.ndarray, size: int):
    """(first byte, end, word starts, word ends, windows) of pieces of one long text, of some `size` bytes each, that neighbours share k - 1 words of:
    every k consecutive words lie wholly in exactly one piece. A piece grows until it holds k words, as far as there are any."""
    lo, n = 0, len(data)
    while lo < n:
        hi = lo + size
        while True:
            while hi < n and inside[data[hi]]:  # to the end of the word
                rest = np.flatnonzero(~inside[data[hi : hi + size]])
                hi = min(n, hi + (int(rest[0]) if len(rest) else size))
            hi = min(hi, n)
            starts, ends, _ = word_bounds(data[lo:hi], np.array([0, hi - lo]), inside)
            if hi == n or len(starts) >= k:
                break
            hi += size
        yield lo, hi, starts, ends, max(len(starts) - k + 1, 0)
        if hi == n:
            return
        lo += int(starts[-(k - 1)]) if k > 1 else hi - lo


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends of maximal runs of bytes with inside[byte], no run across texts; words before each text."""
    ok = np.zeros(len(data) + 2, bool)
    ok[1:-1] = inside[data]
    edge = ok[1:] != ok[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[ok[cut] & ok[cut + 1]]  # a run goes on across a boundary between texts
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    if len(both):
        both = np.unique(both)
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return starts, ends, np.searchsorted(starts, off)
