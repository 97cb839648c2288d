"""Snippets: the window of a text that has the most distinct words searched for, with marks around them."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def cut_snippet(text: str | None, terms: frozenset[str], size: int = 32, marks: tuple[str, str] = ("<b>", "</b>"), gap: str = "...") -> str:
    """The first of the best windows of `size` words; without hits the start of the text. Null or empty: empty."""
    spans = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text or "")]
    hits = [i for i, s in enumerate(spans) if s[2] in terms]
    last = max(len(spans) - size, 0)
    starts = sorted({min(i, last) for i in hits}) or [0]

    def distinct(start: int) -> int:
        return len({spans[i][2] for i in hits[bisect_left(hits, start) : bisect_left(hits, start + size)]})

    first = max(starts, key=distinct)
    end = min(first + size, len(spans))
    out, at = [gap if first else ""], spans[first][0] if first else 0
    for a, b, word in spans[first:end]:
        if word in terms:
            out += [text[at:a], marks[0], text[a:b], marks[1]]
            at = b
    cut = end < len(spans)
    return "".join([*out, (text or "")[at : spans[end - 1][1] if cut else None], gap if cut else ""])


def snippet(text: Column, terms: list[str], size: int = 32) -> Column:
    wanted = frozenset(t.lower() for t in terms)

    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_snippet(t, wanted, size) for t in texts], dtype=object)

    return F.pandas_udf(cut, "string")(text)
