"""Byte-level BPE pre-tokens of many texts at once, as ragged numpy arrays.

The split is that of the public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
worked out from runs of character classes instead of a regular expression, and special strings
of the vocabulary are cut out first, as the library does by default.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

from inkfold.llm.common import ragged_index

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


@functools.cache
def _tables() -> tuple[np.ndarray, frozenset[str]]:
    out = np.full(0x110000, OTHER, np.uint8)
    known = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    for c, x in enumerate(map(unicodedata.category, text)):
        known[c] = LETTER if x[0] == "L" else NUMBER if x[0] == "N" else OTHER
    # Characters that are new in Unicode are classed as the library's own tables have them.
    ask = np.flatnonzero((known != out) & (out != BLANK))
    library = ByteLevel(add_prefix_space=False)
    for c in ask:
        out[c] = next((kind for kind, x in ((LETTER, "a"), (NUMBER, "1")) if len(library.pre_tokenize_str(x + chr(c))) == 1), OTHER)
    return out, frozenset(map(chr, ask))


def classes() -> np.ndarray:
    """Class of each code point."""
    return _tables()[0]


def recent() -> frozenset[str]:
    """Characters that versions of Unicode class differently."""
    return _tables()[1]


def split(codes: np.ndarray, texts: np.ndarray, special: np.ndarray) -> np.ndarray:
    """Start of every pre-token. codes: code points; texts: start of each text (or part between
    special strings), sorted; special: starts of special strings, which are in texts too and are
    one pre-token each."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[texts[texts < n]] = True
    first[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= first
    start = change[:n].copy()
    ahead = np.append(kind[1:], BLANK)  # class of the next character
    goes_on = ~first[1:]  # the next character is of the same text
    # The last character of a run of blanks before other characters: a space belongs to what
    # follows, any other blank stands alone; the blanks before it are one pre-token.
    last_blank = (kind == BLANK) & goes_on & (ahead != BLANK)
    start[last_blank] = True
    at = np.flatnonzero(last_blank)
    glued = at[codes[at] == 32] + 1
    start[glued] = False
    # Contractions, where an apostrophe begins a pre-token.
    quote = np.flatnonzero(start & (codes == 39))
    if len(quote):
        code = np.append(codes, [0, 0])
        room = np.append(first, [True, True])
        one = np.isin(code[quote + 1], [ord("s"), ord("t"), ord("m"), ord("d")]) & ~room[quote + 1]
        c1, c2 = code[quote + 1], code[np.minimum(quote + 2, n + 1)]
        two = (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))) & ~room[quote + 1] & ~room[np.minimum(quote + 2, n + 1)]
        for hit, length in ((quote[one], 2), (quote[two & ~one], 3)):
            start[hit + 1] = False
            rest = hit + length
            rest = rest[rest < n]
            # what is left of the letters goes on as a pre-token of its own; a class that changes there has a start already
            start[rest[kind[rest] == LETTER]] = True
    if len(special):
        end = np.append(texts, n)[np.searchsorted(texts, special, "right")]
        start[ragged_index(special, end - special)] = False
        start[special] = True
    return np.flatnonzero(start)
