"""References followed to the documents they name: one join each, however many rows ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference_ids(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def expand_one(rows: DataFrame, column: str, target: DataFrame, name: str | None = None, key: str = "id") -> DataFrame:
    """rows with a struct of the document that the first reference names (null if there is none); the ids stay as {name}_id."""
    name = name or (column.removesuffix("_id") or column)
    packed = target.select(F.col(key).cast("string").alias("_key"), F.struct(*target.columns).alias("_target"))
    joined = rows.withColumn("_first", F.try_element_at(reference_ids(F.col(column).cast("string")), F.lit(1))).join(packed, F.col("_first") == F.col("_key"), "left")
    kept = [c for c in rows.columns if c not in (column, name)]
    return joined.select(*kept, F.col(column).alias(f"{name}_id"), F.col("_target").alias(name))


def expand_many(rows: DataFrame, row_key: str, column: str, target: DataFrame, name: str, key: str = "id", order: str | None = None, direction: str = "ASC", limit: int | None = None) -> DataFrame:
    """rows with an array of the documents that the references name: in the order of the references, or by one field (numbers as numbers, null
    last, ties in the order of the references), and no more than `limit`. Ids that no document has are left out."""
    refs = rows.select(F.col(row_key).alias("_row"), F.posexplode(reference_ids(F.col(column).cast("string"))).alias("_at", "_ref"))
    packed = target.select(F.col(key).cast("string").alias("_ref"), F.struct(*target.columns).alias("_target"))
    by = F.col(f"_target.{order}") if order else F.lit(None).cast("string")
    found = refs.join(packed, "_ref").groupBy("_row").agg(F.collect_list(F.struct(by.isNull().alias("none"), by.alias("by"), F.col("_at").alias("at"), F.col("_target").alias("target"))).alias("_all"))
    down = direction.upper() == "DESC"

    def before(x: Column, y: Column) -> Column:
        less, more = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
        at = F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)
        return F.when(x["none"] & ~y["none"], 1).when(~x["none"] & y["none"], -1).when(x["by"] < y["by"], less).when(x["by"] > y["by"], more).otherwise(at)

    targets = F.transform(F.array_sort("_all", before), lambda x: x["target"])
    found = found.select("_row", (F.slice(targets, 1, limit) if limit is not None else targets).alias("_many"))
    joined = rows.join(found, rows[row_key] == found["_row"], "left")
    empty = F.array().cast(found.schema["_many"].dataType)
    return joined.withColumn(name, F.coalesce("_many", empty)).drop("_row", "_many")


def typed_accessor(docs: DataFrame, type_name: str, table: DataFrame, key: str = "id") -> DataFrame:
    """docs with a struct of the typed row if the document is of that type, else null."""
    packed = table.select(F.col(key).alias("_key"), F.struct(*table.columns).alias(type_name))
    return docs.join(packed, (docs[key] == F.col("_key")) & (docs["type"] == type_name), "left").drop("_key")


def enriched(hits: DataFrame, tags: DataFrame, fields: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """hits (id) with their tags and a map of their fields; values of typed columns (a map `typed` by id) win over those of fields."""
    with_tags = tags.join(hits.select(F.col("id").alias("document_id")), "document_id", "left_semi").groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    pairs = fields.join(hits.select(F.col("id").alias("document_id")), "document_id", "left_semi").groupBy(F.col("document_id").alias("id"), "key").agg(F.min("value").alias("value"))
    maps = pairs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))
    out = hits.join(with_tags, "id", "left").join(maps, "id", "left")
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce("fields", none)
    if typed is not None:
        out = out.join(typed.select("id", F.col("typed").alias("_typed")), "id", "left")
        over = F.coalesce("_typed", none)
        own = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(over, k)), over)
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("fields", own).drop("_typed")
