"""A training corpus from documents: quality rules, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. The result is the last stage's: one row
for each packed piece.

Lines that fail the line rules go, and rejected documents, all but the least doc_id of each group of near duplicates and documents with a
benchmark window; secrets are replaced by a mark in the text. Rows that repeat a doc_id with the
same text are copies of each other, of which the near-duplicate stage keeps one. Every other row, also one
whose doc_id is null or has several texts, is a document of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import decontamination, near_duplicates, packing, quality_rules, secrets
from inkfold.llm.common import if_small, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the line rules go; the document stays if the rules keep it. n_chars is that of the text that is left.

    Null and empty texts, and very long ones without words, go; rows are judged one by one, so null or repeated ids, ties and repeated rows change nothing."""
    told = quality_rules.assess(docs).select(*COLUMNS, F.explode(F.array("quality")).alias("quality"))  # a filter is not moved below an explode, so rules are worked out once
    judged = told.filter("quality.kept").select("doc_id", F.col("quality.clean").alias("clean"), "text", "lang", "source", "n_chars")
    n_chars = F.when(F.col("clean") == F.col("text"), F.col("n_chars")).otherwise(F.length("clean")).cast("long")
    return judged.select("doc_id", F.col("clean").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class stays, null after all others.

    Rows know each other by a 64-bit hash of doc_id and text: rows with both alike are one document, of which one row stays (the least lang, source, n_chars);
    rows that share an id, or have none, and differ in text are documents of their own. Texts without words are alone in their class and stay."""
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"))
    found = near_duplicates.join(docs.select(F.col("row_key").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("row_key")).agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    classes = materialize(found, "stage-classes")
    ids = docs.select("row_key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    # only rows that go, or are repeated, have to be told apart
    mixed = classes.groupBy("class_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    first = classes.join(mixed, "class_id").join(ids, "row_key").groupBy("class_id").agg(F.min(order)["row_key"].alias("first"))
    told = classes.join(first, "class_id", "left").select("row_key", (F.coalesce("first", "row_key") == F.col("row_key")).alias("stays"), (F.col("n") > 1).alias("again")).filter("NOT stays OR again")
    marked = docs.join(if_small(materialize(told, "stage-told")), "row_key", "left")
    once = marked.filter("stays AND again").groupBy("row_key").agg(F.min_by(F.struct(*COLUMNS), F.struct("lang", "source", "n_chars")).alias("row")).select("row.*")
    return marked.filter("stays IS NULL").select(*COLUMNS).unionByName(once)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document with any benchmark window goes.

    Null and empty texts hold none and stay; rows are judged one by one, so null or repeated ids, ties and repeated rows change nothing. Null items have no window."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return found.filter("n_hit = 0").select("carried.*")


def secret_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret; n_chars is that of the new text.

    Every row stays, null and empty texts as they are; rows are masked one by one, so null or repeated ids, ties and repeated rows change nothing."""
    found = secrets.find_secrets(docs, carry=("doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("no_text")))
    changed = F.col("spans") != ""
    text = F.when(~F.col("carried.no_text"), F.col("masked"))  # the text itself where there is no span
    n_chars = F.when(changed, F.length("masked").cast("long")).otherwise(F.col("carried.n_chars"))
    return found.select("carried.doc_id", text.alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a packed document.

    Null and empty texts are packed as their end alone, very long ones in many pieces, repeated rows as often as they occur; null ids stay null."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_dups), ("decontamination", benchmarks), ("secrets", secret_marks), ("packing", packed)]

#: SQL can't express signatures, decoding layers and tokenizing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
