"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), for search that ignores word endings.

Words come in Arrow batches and repeat a lot, so each worker keeps the stems it has found. Words with other letters than
a-z stay as they are. Null: null.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: suffixes and what replaces them, in the order of the paper.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", shape(word)))


def short_end(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((x for x in suffixes if word.endswith(x)), key=len, default=None)


def replaced(word: str, table: dict[str, str]) -> str:
    end = longest(word, table)
    return word.removesuffix(end) + table[end] if end and measure(word.removesuffix(end)) > 0 else word


def past_forms(word: str) -> str:
    """Step 1b: -eed, -ed and -ing, and what they leave."""
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    end = longest(word, ("ed", "ing"))
    if not end or "v" not in shape(word.removesuffix(end)):
        return word
    word = word.removesuffix(end)
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if shape(word).endswith("cc") and word[-1:] == word[-2:-1] and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if measure(word) == 1 and short_end(word) else word


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    word = past_forms(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP_2), STEP_3)
    end = longest(word, STEP_4)
    if end and measure(word.removesuffix(end)) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word.removesuffix(end)
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def _stems(words: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [stem(w) for w in x] for x in words], dtype=object)


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words, in their places."""
    return F.pandas_udf(_stems, "array<string>")(words)
