"""Secret scans with a recursive decoding worklist (operator 5).

Each text is scanned for secrets. Then its encoded stretches are unwrapped in place: percent escapes, \\u
and \\x escapes, character references, base64 (plain or URL-safe, also wrapped in lines) and what base64 or escapes hold
in compressed form (gzip, zlib, bzip2, xz). The unwrapped text is a new layer, which is scanned and
unwrapped in turn until nothing changes or a layer comes back that was there before. Spans found in a layer
are mapped to the original text, an unwrapped stretch as a whole; they count if they touch an unwrapped stretch.

A compressed stretch that holds more than `most_unpacked` bytes is unwrapped and scanned, layers and all, in overlapping blocks of
that size, which bounds what a text can do to a task's memory; no part is left out. One of broken data counts as far as it can be unwrapped.

Decoded bytes are text if they are UTF-8 and nine tenths of it readable, or if they hold a secret when
read as UTF-8, UTF-16 or Latin-1 with what can't be decoded replaced.

Null or empty text: no spans. Repeated rows: one result each. Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import carried_schema, carrying

# The kinds, in the order in which spans at the same start are listed, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
ONE_ALPHABET = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_-]{16,}={0,2}")
LINE = re.compile(r"[^\r\n]+")
BREAK = re.compile(r"[^A-Za-z0-9+/_=\-\r\n%\\&#;]")
MOST_UNPACKED = 4_000_000
EDGE = 4096
KNOWN: dict[tuple[bytes, int], frozenset[int]] = {}  # what inner_kinds has found


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of all secrets in a text."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def opener(head: bytes):
    """What makes a decompressor for bytes that start like this; None if they aren't compressed."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def inflate(blocks: Iterable[bytes], new, step: int) -> Iterator[bytes]:
    """The content of compressed blocks, member by member, in blocks of up to `step` bytes; ends where the data is broken."""
    machine = new()
    for data in blocks:
        while True:
            try:
                out = machine.decompress(data, step)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            if out:
                yield out
            if machine.eof:
                data = machine.unused_data
                machine = new()
                if not data:
                    break
            elif hasattr(machine, "unconsumed_tail"):
                data = machine.unconsumed_tail
                if not data and not out:
                    break
            else:
                data = b""
                if machine.needs_input:
                    break


def unpacked(raw: bytes, step: int) -> Iterator[bytes]:
    """What bytes hold, unpacked as often as needed, in blocks."""
    seen: set[bytes] = set()
    first, rest = raw, iter(())
    while (new := opener(first)) is not None and (mark := hashlib.sha256(first).digest()) not in seen:
        seen.add(mark)
        inner = inflate(chain([first], rest), new, step)
        if not (start := next(inner, b"")):
            break
        while len(start) < 6 and (more := next(inner, b"")):
            start += more
        first, rest = start, inner
    return chain([first], rest)


def readable(raw: bytes, most: int) -> tuple[str, frozenset[int]] | None:
    """Decoded bytes as text, unpacked as often as needed, and the kinds of secrets that aren't in that text; None if they aren't text.

    What unpacks to more than `most` bytes is scanned block by block; the text is then only its start and end."""
    head, size, blocks = [], 0, unpacked(raw, most)
    for block in blocks:
        head.append(block)
        size += len(block)
        if size > most:
            return in_blocks(chain(head, blocks), most)
    raw = b"".join(head)
    try:
        text = raw.decode("utf-8")
        if text and mostly_readable(text):
            return text, frozenset()
    except UnicodeDecodeError:
        pass
    # other encodings, or bytes that merely hold some text: they count if they hold a secret
    return next(((text, frozenset()) for code in encodings_of(raw) if inner_kinds(text := raw.decode(code, "replace"), most)), None)


def mostly_readable(text: str) -> bool:
    """Nine tenths are characters that texts have: also all kinds of spaces, joiners and marks of byte order."""
    if text.isprintable():
        return True
    return sum(c.isprintable() or c in "\t\n\r\f\v" or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cf", "Co", "Cn") for c in text) >= 0.9 * len(text)


def encodings_of(raw: bytes) -> list[str]:
    """Encodings under which the ASCII letters of these bytes are read."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return ["utf-16", "utf-8"]
    return ["utf-8", "utf-16-le", "utf-16-be", "latin-1"] if b"\0" in raw else ["utf-8", "latin-1"]


def in_blocks(blocks: Iterable[bytes], most: int) -> tuple[str, frozenset[int]] | None:
    """The start and end of a long text, and the kinds of secrets in any of it; blocks overlap and are cut where no encoded stretch goes on.

    It is read in each encoding that its first block may have."""
    first = next(iter(blocks))
    codes = encodings_of(first)
    decoders = [codecs.getincrementaldecoder(c)("replace") for c in codes]
    held, ends, found, good = [""] * len(codes), [("", "")] * len(codes), set(), False
    for block in chain([first], blocks, [b""]):
        for k, decoder in enumerate(decoders):
            text = decoder.decode(block, not block)
            good = good or (k == 0 and block is first and codes[0] == "utf-8" and text.count("\ufffd") <= 0.1 * len(text) and mostly_readable(text))
            start, end = ends[k]
            held[k], ends[k] = held[k] + text, ((start + text)[:EDGE] if len(start) < EDGE else start, (end + text)[-EDGE:])
            if not block:
                found |= inner_kinds(held[k], most)
            elif len(held[k]) >= most:
                stop = last_break(held[k], len(held[k]))
                keep = last_break(held[k], stop - EDGE)
                if keep:  # else an encoded stretch fills the block: it grows
                    found |= inner_kinds(held[k][:stop], most)
                    held[k] = held[k][keep:]
    return ("\n\n".join(ends[0]), frozenset(found)) if good or found else None


def last_break(text: str, before: int) -> int:
    """Behind the last character before a place that no encoded stretch has; 0 if there is none."""
    while before > 0:
        lo = max(0, before - EDGE)
        if found := BREAK.search(text[lo:before][::-1]):
            return before - found.start()
        before = lo
    return 0


def inner_kinds(text: str, most: int) -> frozenset[int]:
    """Kinds of secrets in a text and its layers; a text that holds itself is not gone into again."""
    mark = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    if (mark, most) not in KNOWN:
        if len(KNOWN) > 10_000:
            KNOWN.clear()
        KNOWN[mark, most] = frozenset()
        KNOWN[mark, most] = frozenset(k for _, _, k in all_spans(text, most)[1])
    return KNOWN[mark, most]


def from_base64(word: str, most: int) -> tuple[str, frozenset[int]] | None:
    body = word.rstrip("=").replace("-", "+").replace("_", "/").replace("\n", "").replace("\r", "")
    if len(body) % 4 == 1:
        return None
    try:
        return readable(base64.b64decode(body + "=" * (-len(body) % 4), validate=True), most)
    except (binascii.Error, ValueError):
        return None


def base64_parts(text: str, start: int, end: int, most: int) -> list[tuple[int, int, tuple[str, frozenset[int]]]]:
    """What of a run of both alphabets, over line breaks, is base64: all of it, else its blocks of lines of one length
    with or without a shorter last line, else single lines, else the stretches of one alphabet in a line."""
    if (inner := from_base64(text[start:end], most)) is not None:
        return [(start, end, inner)]
    lines, out, k = [(m.start(), m.end()) for m in LINE.finditer(text, start, end)], [], 0
    while k < len(lines):
        width, stop = lines[k][1] - lines[k][0], k + 1
        while stop < len(lines) and lines[stop][1] - lines[stop][0] == width:
            stop += 1
        short = stop < len(lines) and lines[stop][1] - lines[stop][0] < width
        tries = [n for n in ((stop + 1,) if short else ()) + (stop,) if len(lines) > 1 and lines[n - 1][1] - lines[k][0] >= 16]
        for n in tries:
            if (inner := from_base64(text[lines[k][0] : lines[n - 1][1]], most)) is not None:
                out.append((lines[k][0], lines[n - 1][1], inner))
                k = n
                break
        else:
            for a, b in lines[k:stop]:
                if stop > k + 1 and b - a >= 16 and (inner := from_base64(text[a:b], most)) is not None:
                    out.append((a, b, inner))
                else:
                    out += [(m.start(), m.end(), inner) for m in ONE_ALPHABET.finditer(text, a, b) if (inner := from_base64(m[0], most)) is not None]
            k = stop
    return out


def unescape(run: str, most: int) -> tuple[str, frozenset[int]] | None:
    """One run of escapes of a kind."""
    if run[0] == "&":
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
        return (chr(code), frozenset()) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    if run[1] == "u":
        try:
            return b"".join(int(run[i : i + 4], 16).to_bytes(2, "big") for i in range(2, len(run), 6)).decode("utf-16-be"), frozenset()
        except UnicodeDecodeError:
            return None
    raw = bytes.fromhex(run.replace("%", "").replace("\\x", ""))
    return readable(raw, most)


class Layer:
    """A text whose stretches know where they are in the original: (start here, start there, end there, verbatim)."""

    def __init__(self, text: str, stretches: list[tuple[int, int, int, bool]], inside: Iterable[tuple[int, int, int]] = ()):
        self.text, self.stretches, self.starts = text, stretches, [s[0] for s in stretches]
        self.inside = inside  # spans in the original of secrets that the text leaves out

    def stretch(self, at: int) -> tuple[int, int, int, bool]:
        return self.stretches[bisect_right(self.starts, at) - 1]

    def origin(self, start: int, end: int) -> tuple[int, int, bool]:
        """The original's span of a span here, and whether it touches an unwrapped stretch."""
        lo, hi = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, b = self.stretches[lo], self.stretches[hi]
        first = a[1] + start - a[0] if a[3] else a[1]
        last = b[1] + end - b[0] if b[3] else b[2]
        return first, last, not all(s[3] for s in self.stretches[lo : hi + 1])

    def unwrapped(self, most: int) -> Layer | None:
        """The next layer; None if nothing here can be unwrapped."""
        text, found = self.text, []
        if "%" in text or "\\" in text or "&#" in text:
            found += [(m.start(), m.end(), inner) for m in ESCAPES.finditer(text) if (inner := unescape(m[0], most)) is not None]
        for m in BASE64.finditer(text):
            found += base64_parts(text, m.start(), m.end(), most)
        if not found:
            return None
        parts, stretches, inside, at, size = [], [], [], 0, 0
        for start, end, (inner, kinds) in [*sorted(found, key=lambda x: x[0]), (len(text), len(text), ("", ()))]:
            while at < start:  # verbatim, split where this layer's own stretches end
                lo = bisect_right(self.starts, at) - 1
                stop = min(start, self.starts[lo + 1] if lo + 1 < len(self.starts) else start)
                s = self.stretches[lo]
                stretches.append((size, s[1] + at - s[0] if s[3] else s[1], s[2], s[3]))
                parts.append(text[at:stop])
                size += stop - at
                at = stop
            if inner:
                first, last, _ = self.origin(start, end)
                stretches.append((size, first, last, False))
                inside += [(first, last, kind) for kind in kinds]
                parts.append(inner)
                size += len(inner)
            at = end
        return Layer("".join(parts), stretches, inside)


def all_spans(text: str, most: int = MOST_UNPACKED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the text itself, and of the text and all its layers, each sorted."""
    base = sorted(scan(text))
    found, layer, seen = set(base), Layer(text, [(0, 0, len(text), True)]), {hash(text)}
    while (layer := layer.unwrapped(most)) is not None and (mark := hash(layer.text)) not in seen:
        seen.add(mark)
        found.update(layer.inside)
        for start, end, kind in scan(layer.text):
            first, last, inner = layer.origin(start, end)
            if inner:
                found.add((first, last, kind))
    return base, sorted(found, key=lambda s: (s[0], s[2], s[1]))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each stretch that spans cover replaced by a mark."""
    parts, at, end = [], 0, 0
    for start, stop, _ in sorted(spans):
        if start >= end:
            parts += [text[max(at, end) : start], mark]
        at = end = max(end, stop)
    return "".join([*parts, text[end:]]) if spans else text


def find_secrets(docs: DataFrame, most_unpacked: int = MOST_UNPACKED, mark: str = "[SECRET]", key: str = "doc_id", carry: tuple = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base (spans of the text itself), spans (those of all layers too),
    masked (the text with a mark in place of every span); carried: the columns of docs that are asked for."""
    docs = carrying(docs, carry, key)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text, most_unpacked)
                rows.append((*(sum(s[2] == k for s in base) for k in range(3)), told(base), told(every), masked(text, every, mark)))
            columns = [pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns, *batch.columns[2:]], [key, "n_assign", "n_access", "n_hex", "base", "spans", "masked", *batch.schema.names[2:]])

    return docs.mapInArrow(run, carried_schema(docs, f"{key} long, n_assign long, n_access long, n_hex long, base string, spans string, masked string"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
