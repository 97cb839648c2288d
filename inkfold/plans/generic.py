"""Lists over all documents, whatever their type: filters by type, tag, backlink and field, tag entries, checkboxes, pages with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.plans.where import FilterError, like

# What a generic list can be ordered by, and the direction where none is given.
SORTABLE = {"id": "DESC", "title": "ASC", "date": "DESC", "type": "ASC", "updated_at": "ASC"}
MOST_ROWS = 10_000


def valid_page(limit: int | None = None, offset: int | None = None, default: int = 50) -> tuple[int, int]:
    """limit and offset, or an error if they are out of bounds."""
    limit, offset = default if limit is None else limit, offset or 0
    if not 1 <= limit <= MOST_ROWS:
        raise FilterError(f"limit must be between 1 and {MOST_ROWS}")
    if offset < 0:
        raise FilterError("offset must be 0 or more")
    return limit, offset


def clamped_page(page: int = 1, per_page: int = 50, most: int = 200) -> tuple[int, int]:
    """limit and offset of a numbered page; the size is forced into its bounds."""
    size = min(max(per_page, 1), most)
    return size, (max(page, 1) - 1) * size


def order_keys(sort: str | None = None, direction: str | None = None) -> list[Column]:
    if sort is None:
        return [F.col("date").desc_nulls_last(), F.col("id").desc_nulls_last()]
    if sort not in SORTABLE:
        raise FilterError(f"can't sort by {sort}")
    way = (direction or SORTABLE[sort]).upper()
    if way not in ("ASC", "DESC"):
        raise FilterError(f"unknown direction: {direction}")
    key = F.col(sort).desc_nulls_last() if way == "DESC" else F.col(sort).asc_nulls_first()
    return [key] if sort == "id" else [key, F.col("id").desc_nulls_last()]


def filtered(docs: DataFrame, tags: DataFrame | None = None, links: DataFrame | None = None, fields: DataFrame | None = None, type_: str | None = None, tag: str | None = None, backlinks_of: str | None = None, field: dict[str, str] | None = None) -> DataFrame:
    """Documents that meet all conditions; each condition on another table is a semi join."""
    if type_ is not None:
        docs = docs.filter(F.col("type") == type_)
    if tag is not None:
        docs = docs.join(tags.filter(F.col("tag") == tag).select(F.col("document_id").alias("id")), "id", "left_semi")
    if backlinks_of is not None:
        docs = docs.join(links.filter(F.col("target") == backlinks_of).select(F.col("source_id").alias("id")), "id", "left_semi")
    for key, value in (field or {}).items():
        docs = docs.join(fields.filter((F.col("key") == key) & (F.col("value") == value)).select(F.col("document_id").alias("id")), "id", "left_semi")
    return docs


def listed(docs: DataFrame, sort: str | None = None, direction: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    limit, offset = valid_page(limit, offset)
    return docs.orderBy(*order_keys(sort, direction)).offset(offset).limit(limit)


def count_of(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("count"))


def with_total(found: DataFrame, page: DataFrame) -> DataFrame:
    """The rows of a page and the number of all rows found, counted by an aggregate of its own (one row to broadcast)."""
    return page.join(F.broadcast(found.agg(F.count("*").alias("total"))))


def tag_entries(tags: DataFrame, document_id: dict | None = None, tag: dict | None = None) -> DataFrame:
    """document_id, tag (eq, in; tag also contains), ordered; an empty `in` finds nothing."""
    for name, spec in (("document_id", document_id or {}), ("tag", tag or {})):
        for op, value in spec.items():
            if op == "contains" and name == "tag":
                tags = tags.filter(like(F.col("tag"), "%", value, "%"))
            elif op in ("eq", "in"):
                tags = tags.filter(F.col(name) == value if op == "eq" else F.col(name).isin(list(value)) if value else F.lit(False))
            else:
                raise FilterError(f"operator {op} does not apply to {name}")
    return tags.select("document_id", "tag").orderBy("document_id", "tag")


def tag_prefix(tags: DataFrame, prefix: str) -> DataFrame:
    """Ids of documents with a tag under a prefix."""
    return tags.filter(like(F.col("tag"), "", prefix, "%")).select("document_id").distinct()


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag")


def checkboxes(boxes: DataFrame, docs: DataFrame, state: str | None = None, document_id: str | None = None) -> DataFrame:
    """Checkboxes with the titles of their documents; newest document first, lines in order."""
    if state is not None:
        boxes = boxes.filter(F.col("state") == state)
    if document_id is not None:
        boxes = boxes.filter(F.col("document_id") == document_id)
    return boxes.join(docs.select(F.col("id").alias("document_id"), "title"), "document_id").orderBy(F.desc("document_id"), "line_number")


def open_actions(boxes: DataFrame, docs: DataFrame) -> DataFrame:
    return checkboxes(boxes, docs, "open")


def output_tags(frontmatter: Column, body: Column) -> Column:
    """Tags of the frontmatter, then those of the body, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(frontmatter, none), F.coalesce(body, none)))
