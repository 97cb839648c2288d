"""Scalar functions with the engine's own semantics, as Column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_null(*values: Column) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | v.isNull()
    return out


def scalar_min(*values: Column) -> Column:
    """Null if any argument is null."""
    return F.when(~any_null(*values), F.least(*values))


def scalar_max(*values: Column) -> Column:
    return F.when(~any_null(*values), F.greatest(*values))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(value: Column) -> Column:
    return F.translate(value, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def type_name(value: Column) -> Column:
    """integer, real, text or null."""
    kind = F.typeof(value)
    return F.when(value.isNull(), "null").when(kind.isin("tinyint", "smallint", "int", "bigint", "boolean"), "integer").when(kind.isin("float", "double") | kind.startswith("decimal"), "real").when(kind == "binary", "blob").otherwise("text")


def kebab_case(value: Column) -> Column:
    """Words of a key in lower case, joined by hyphens."""
    split = F.regexp_replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.regexp_replace(F.lower(F.regexp_replace(split, r"[\s_-]+", "-")), "^-+|-+$", "")


def title_from_path(path: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")
    words = F.trim(F.regexp_replace(F.regexp_replace(stem, "^[0-9]{14}[-_ ]?", ""), "[-_]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))


def boolean_value(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin("true", "1", "yes"), 1).when(low.isin("false", "0", "no"), 0)


def typed_value(value: Column, kind: str) -> Column:
    if kind == "BOOLEAN":
        return F.lower(value).isin("true", "1", "yes")
    return value.try_cast({"INTEGER": "bigint", "REAL": "double"}.get(kind, "string"))


def date_from_id(value: Column) -> Column:
    return F.concat_ws("-", value.substr(1, 4), value.substr(5, 2), value.substr(7, 2))


def parsed_date(value: Column) -> Column:
    """RFC 3339, then a plain date, then a date and time with a zone; null if none fits."""
    return F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")))


# Media types by file extension.
MEDIA = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "ico": "image/x-icon",
    "pdf": "application/pdf", "json": "application/json", "xml": "application/xml", "zip": "application/zip", "gz": "application/gzip", "gzip": "application/gzip", "tar": "application/x-tar",
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv", "js": "text/javascript",
    "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime",
}


def media_type(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(name, ".", -1))), F.lit("application/octet-stream"))


def template_title(template: Column | str, values: dict[str, Column], kind: Column, key: Column) -> Column:
    """Each {column} replaced by its value, what isn't known by nothing; if nothing is left, type and id."""
    out = template if isinstance(template, Column) else F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    out = F.trim(F.regexp_replace(out, r"\{[^}]*\}", ""))
    return F.when(out == "", F.concat_ws(" ", kind, key)).otherwise(out)


def stamp_of(digest: Column) -> Column:
    """14 digits in the form of a time, from the first 64 bits of a hex digest; days stop at 28."""
    n = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    field = lambda step, size, first: F.pmod(F.floor(n / F.lit(step).cast("decimal(20,0)")), F.lit(size).cast("decimal(20,0)")).cast("int") + first
    day = 86_400
    return F.format_string("%04d%02d%02d%02d%02d%02d", field(day * 28 * 12, 100, 2000), field(day * 28, 12, 1), field(day, 28, 1), field(3600, 24, 0), field(60, 60, 0), field(1, 60, 0))


def content_ids(rows: DataFrame, old_id: str, content: str, taken: DataFrame) -> DataFrame:
    """rows with new_id, which depends on old_id and content only; ids that are taken (or minted for a lesser old_id of the batch) move on to the next attempt.
    Rows are tried all at once, and those that collide again, until none does."""
    open_rows, done = rows.withColumn("_try", F.lit(0)), None
    used = taken.select(F.col("id").cast("string").alias("new_id"))
    while not open_rows.isEmpty():
        tried = open_rows.withColumn("new_id", stamp_of(F.sha2(F.concat_ws(":", F.col(old_id), F.col(content), F.col("_try").cast("string")), 256)))
        nth = F.row_number().over(Window.partitionBy("new_id").orderBy(old_id, content))
        judged = tried.withColumn("_nth", nth).join(used.distinct().withColumn("_used", F.lit(True)), "new_id", "left").persist()
        good = judged.filter("_nth = 1 AND _used IS NULL").select(*rows.columns, "new_id")
        done = good if done is None else done.unionByName(good)
        used = used.unionByName(good.select("new_id"))
        open_rows = judged.filter("_nth > 1 OR _used").select(*rows.columns, (F.col("_try") + 1).alias("_try"))
    return done if done is not None else rows.withColumn("new_id", F.lit(None).cast("string"))


# --- paths into nested values -------------------------------------------------------------------


class PathError(ValueError):
    """A path that can't be read, or that a value doesn't have."""


def path_steps(path: str) -> list[str | int]:
    """Keys and indexes of a.b[0].c; \\\\ takes the next character as it is."""
    steps: list[str | int] = []
    key, at, open_key = "", 0, True
    while at < len(path):
        c = path[at]
        if c == "\\" and at + 1 < len(path):
            key, at = key + path[at + 1], at + 1
        elif c == ".":
            if open_key and not key:
                raise PathError(f"empty key in {path}")
            steps += [key] if open_key else []
            key, open_key = "", True
            if at == len(path) - 1:
                raise PathError(f"{path} ends in a dot")
        elif c == "[":
            if open_key and not key:
                raise PathError(f"empty key in {path}")
            steps += [key] if open_key else []
            key, open_key, end = "", False, path.find("]", at)
            if end < 0 or not path[at + 1 : end].isdigit():
                raise PathError(f"bad index in {path}")
            steps.append(int(path[at + 1 : end]))
            at = end
        elif not open_key:
            raise PathError(f"a key must follow a dot in {path}")
        else:
            key += c
        at += 1
    if open_key:
        if not key:
            raise PathError("empty path")
        steps.append(key)
    if isinstance(steps[0], int):
        raise PathError(f"{path} begins with an index")
    return steps


def value_at(value, path: str):
    for step in path_steps(path):
        if not isinstance(value, list if isinstance(step, int) else dict):
            raise PathError(f"{path}: wrong kind of value at {step}")
        if (step >= len(value)) if isinstance(step, int) else (step not in value):
            raise PathError(f"{path}: nothing at {step}")
        value = value[step]
    return value


def with_value(value: dict, path: str, new):
    """value with new at a path: maps and lists on the way are made, lists are filled up with empty texts."""
    steps = path_steps(path)
    here = value
    for step, after in zip(steps, [*steps[1:], None], strict=True):
        if not isinstance(here, list if isinstance(step, int) else dict):
            raise PathError(f"{path}: wrong kind of value at {step}")
        if isinstance(step, int):
            here += [""] * (step + 1 - len(here))
        if after is None:
            here[step] = new
        else:
            empty = [] if isinstance(after, int) else {}
            if (here[step] == "" if isinstance(step, int) else step not in here):
                here[step] = empty
            here = here[step]
    return value


def without_value(value: dict, path: str):
    value_at(value, path)
    here, steps = value, path_steps(path)
    for step in steps[:-1]:
        here = here[step]
    del here[steps[-1]]
    return value


def on_paths(function, document: Column, path: Column, new: Column | None = None) -> Column:
    """One of the three functions above on a JSON text, in Arrow batches; null where it fails. Values are JSON too."""

    def run(documents, paths, values=None):
        out = []
        for k, (d, p) in enumerate(zip(documents, paths, strict=True)):
            try:
                more = () if values is None else (json.loads(values.iloc[k]),)
                out.append(None if d is None or p is None else json.dumps(function(json.loads(d), p, *more), ensure_ascii=False, sort_keys=True))
            except PathError:
                out.append(None)
        return pd.Series(out, dtype=object)

    def two(d: pd.Series, p: pd.Series) -> pd.Series:
        return run(d, p)

    def three(d: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
        return run(d, p, n)

    return F.pandas_udf(two, "string")(document, path) if new is None else F.pandas_udf(three, "string")(document, path, new)


def merged_fields(fields: Column, changes: Column) -> Column:
    """A map of fields with changes: a null value takes a field away, any other sets it."""
    kept = F.map_filter(fields, lambda k, v: ~F.map_contains_key(changes, k))
    return F.map_concat(kept, F.map_filter(changes, lambda k, v: v.isNotNull()))
