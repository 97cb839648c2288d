"""Change events: the same projection over a batch table and a stream, and what a change of snapshots emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = ("kind", "document_id", "document_type", "timestamp")


def change_events(events: DataFrame, kind: Column, document_id: Column, document_type: Column, timestamp: Column) -> DataFrame:
    """kind (created, updated, deleted), document_id, document_type, timestamp of each row of any table of changes."""
    return events.select(kind.alias("kind"), document_id.alias("document_id"), document_type.alias("document_type"), timestamp.alias("timestamp"))


def emitted(old: DataFrame, new: DataFrame, timestamp: str) -> DataFrame:
    """Events for the difference of two snapshots (id, type, content): one for each document that is new, gone or other."""
    a = old.select("id", F.col("type").alias("old_type"), F.xxhash64("content").alias("a"))
    b = new.select("id", "type", F.xxhash64("content").alias("b"))
    kind = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").otherwise("updated")
    found = a.join(b, "id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return change_events(found, kind, F.col("id"), F.coalesce("type", "old_type"), F.lit(timestamp))


def wanted(events: DataFrame, kind: str | None = None, document_type: str | None = None, documents: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Events of one kind or type, joined with the documents as they are now unless deleted."""
    if kind:
        events = events.filter(F.col("kind") == kind)
    if document_type:
        events = events.filter(F.col("document_type") == document_type)
    if documents is not None:
        events = events.join(documents, (events.document_id == documents[key]) & (F.col("kind") != "deleted"), "left")
    return events


def subscribe(spark: SparkSession, folder: str, columns: dict[str, Column], kind: str | None = None, document_type: str | None = None, documents: DataFrame | None = None, key: str = "id") -> DataFrame:
    """A stream of changes from a folder of event files; columns: how kind, document_id, document_type and timestamp are read from them."""
    schema = spark.read.parquet(folder).schema
    found = change_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder), *(columns[c] for c in EVENT))
    return wanted(found, kind, document_type, documents, key)


def publish(changed: DataFrame, folder: str) -> None:
    """Adds events to the folder that subscribers read; nothing waits for them."""
    changed.write.mode("append").parquet(folder)
