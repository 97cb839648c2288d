"""Quality rules, line first (operator 10); DataFrame functions only.

Every line with a word is judged by itself: navigation (many separators for its words), symbols (many of its
characters), boilerplate (a stock phrase in a short line) and punctuation (a fragment of a word or two that no mark ends).
Lines that fail go. A document is rejected if it fails the base rules, or loses more than `most_lost` of its word characters.

Null or empty text: no words, fails the base rules. Repeated rows: one result each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>•·»"
BOILERPLATE = "cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|subscribe to|sign (in|up)|log in|click here|read more|share (this|on)|skip to"
ENDS = r"[.!?:;,…。！？\"'”’»)\]]\s*$"


def once(value: Column, use) -> Column:
    """use(value), with value worked out once for each row, however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def packed_length(text: Column) -> Column:
    """Code points that are not blank."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.length(text)


def how_many(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit("[" + chars + "]"))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def line_fails(line: Column) -> Column:
    n_words = F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))

    def judged(q: Column) -> Column:
        return (
            ((q["separators"] >= 3) & (q["separators"] * 4 >= n_words))
            | (q["symbols"] * 10 > q["chars"])
            | ((q["chars"] <= 200) & F.lower(line).rlike(BOILERPLATE))
            | ((q["chars"] <= 24) & ~line.rlike(ENDS) & (n_words <= 2))
        )

    return once(F.struct(packed_length(line).alias("chars"), how_many(line, SEPARATORS).alias("separators"), how_many(line, SYMBOLS).alias("symbols")), judged)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more."""

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def of(w: Column) -> Column:
        def window(i: Column) -> Column:
            a, b, c = F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)
            return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("i"))

        windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))
        again = once(windows, lambda s: F.filter(F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"])), lambda i: i.isNotNull()))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

    return once(words, lambda w: F.when(F.size(w) >= 4, of(w)).otherwise(0))


def assess(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, most_lost: float = 0.5) -> DataFrame:
    """All columns of docs, and struct `quality` (in place of a column of that name): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lost (share of word characters in failed lines), clean (the text without them)."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def measure(t: Column) -> Column:
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        counted = once(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
        lines = F.split(t, "\n")

        def judged(ls: Column) -> Column:
            full = F.filter(ls, has_word)
            good = F.filter(ls, lambda x: ~has_word(x) | ~line_fails(x))
            return F.struct(once(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), F.array_join(good, "\n").alias("clean"))

        return F.struct(
            counted.alias("words"), how_many(t, SYMBOLS).cast("long").alias("n_symbols"), once(lines, judged).alias("lines"),
        )

    def verdict(q: Column) -> Column:
        n_words, n_repeated = q["words"]["n_words"], q["words"]["n_repeat_words"]
        failed = (n_words < least_words) | (100 * n_repeated > most_repeated * n_words)

        def told(lost: Column) -> Column:
            return F.struct(
                n_words.alias("n_words"), q["words"]["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["lines"]["n_dup_lines"].cast("long").alias("n_dup_lines"), n_repeated.alias("n_repeat_words"),
                failed.alias("base_failed"), (~failed & (lost <= most_lost)).alias("kept"), lost.alias("lost"), q["lines"]["clean"].alias("clean"),
            )

        return once(F.when(n_words > 0, 1 - packed_length(q["lines"]["clean"]) / q["words"]["word_chars"]).otherwise(0.0), told)

    return docs.withColumn("quality", once(once(text, measure), verdict))
