"""Zones of a document file: YAML frontmatter, body with sections, reference lines.

Which line is a border depends on all lines before it (fences), so these are pandas UDFs on Arrow batches. Null content: null.
"""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the document format.
BORDER = "---"
FENCES = ("```", "~~~")
REFERENCE = re.compile(r"- \w[\w\s-]*:: ?.*")
HEADING = re.compile(r"(#{1,6})\s+(.+?)(?:\s+#+)?")
MOST_BYTES = 256 * 1024

ZONES = "raw_frontmatter string, body string, reference_section string"
META = "id string, meta string, error string"
SECTIONS = "array<struct<heading:string,level:tinyint,content:string>>"


@cache
def loader():
    """Dates stay text and only true and false are booleans. Aliases are refused, as they can grow without bound."""
    import yaml  # not everywhere; only frontmatter needs it

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(tag, rule) for tag, rule in v if not tag.endswith((":timestamp", ":bool"))] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def compose_node(self, parent, index):
            if self.check_event(yaml.AliasEvent):
                raise yaml.YAMLError("aliases are not read")
            return super().compose_node(parent, index)

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("(?:true|false|True|False|TRUE|FALSE)$"), list("tTfF"))
    return Loader


def lines_of(text: str) -> list[str]:
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    return lines[:-1] if not lines[-1] else lines


def open_fences(lines: list[str], indented: bool) -> list[bool]:
    """Whether a fence is open after each line."""
    return list(accumulate(((x.strip() if indented else x).startswith(FENCES) for x in lines), lambda a, b: a != b))


def split_zones(text: str | None) -> tuple[str | None, ...]:
    """Frontmatter, body, references; three nulls if there is no frontmatter."""
    lines = lines_of(text or "")
    borders = [i for i, x in enumerate(lines) if x.strip() == BORDER][:2]
    if len(borders) < 2:
        return None, None, None
    front, rest = lines[borders[0] + 1 : borders[1]], lines[borders[1] + 1 :]
    inside = open_fences(rest, True)
    cuts = [i for i, x in enumerate(rest) if x.strip() == BORDER and not inside[i]]
    body, references = rest, []
    for a, b in reversed(list(pairwise([*cuts, len(rest)]))):
        full = [x for x in rest[a + 1 : b] if x.strip()]
        if full:  # the last block that has any text decides
            if all(REFERENCE.fullmatch(x) for x in full):
                body, references = rest[:a], rest[a + 1 : b]
            break
    return "\n".join(front), "\n".join(body), "\n".join(references)


def read_frontmatter(raw: str | None, path: str | None) -> tuple[str | None, ...]:
    """id, JSON of all keys, error. Without an id the name of the file counts if it is 14 digits."""
    if raw is None:
        return None, None, "no frontmatter"
    if len(raw.encode()) > MOST_BYTES:
        return None, None, "frontmatter is too long"
    import yaml

    try:
        found = yaml.load(raw, loader()) or {}
        if not isinstance(found, dict):
            return None, None, "frontmatter has no keys"
        meta = json.dumps({str(k): v for k, v in found.items()}, ensure_ascii=False, default=str)
    except (yaml.YAMLError, ValueError, TypeError, RecursionError) as e:
        return None, None, f"malformed YAML: {type(e).__name__}"
    stem = (path or "").rpartition("/")[2].rpartition(".")[0]
    own = found.get("id")
    return str(own) if own is not None else stem if re.fullmatch("[0-9]{14}", stem) else None, meta, None


def split_sections(body: str | None) -> list[tuple[str, int, str]] | None:
    """heading, level and text of each section; what comes before any heading has level 0."""
    if body is None:
        return None
    lines = lines_of(body)
    inside = open_fences(lines, False)
    heads = {i: m for i, x in enumerate(lines) if not inside[i] and not x.startswith(FENCES) and (m := HEADING.fullmatch(x))}
    starts = sorted(heads)
    out = [("", 0, "\n".join(lines[: min(starts, default=len(lines))]))] if lines and 0 not in heads else []
    return out + [(heads[a][2], len(heads[a][1]), "\n".join(lines[a + 1 : b])) for a, b in pairwise([*starts, len(lines)])]


def _zones(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_zones(x) for x in content], columns=["raw_frontmatter", "body", "reference_section"], dtype=object)


def _meta(raw: pd.Series, path: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_frontmatter(r, p) for r, p in zip(raw, path, strict=True)], columns=["id", "meta", "error"], dtype=object)


def _sections(body: pd.Series) -> pd.Series:
    return pd.Series([None if (s := split_sections(x)) is None else [{"heading": h, "level": n, "content": c} for h, n, c in s] for x in body], dtype=object)


def zones(content: Column) -> Column:
    return F.pandas_udf(_zones, ZONES)(content)


def frontmatter(raw: Column, path: Column) -> Column:
    return F.pandas_udf(_meta, META)(raw, path)


def sections(body: Column) -> Column:
    return F.pandas_udf(_sections, SECTIONS)(body)
