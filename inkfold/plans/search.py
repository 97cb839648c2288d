"""The boolean search language: tokens, tree, canonical text, match, BM25 ranking."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.stemming import stem, stems


class SearchError(ValueError):
    """A query that can't be searched for."""


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False


@dataclass(frozen=True)
class Field:
    name: str
    value: str


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Group:
    kind: str  # and, or
    items: tuple


TOKEN = re.compile(r'\s*(?:([()])|([A-Za-z_][\w.]*)[=:](?:"([^"]*)"|([^\s()]+))|"([^"]*)"|([^\s()"]+))')


def tokens(query: str) -> list:
    out, at = [], 0
    while at < len(query.rstrip()):
        m = TOKEN.match(query, at)
        if not m:
            raise SearchError(f"can't read the query at {at}")
        paren, name, quoted, bare, phrase, word = m.groups()
        if paren:
            out.append(paren)
        elif name:
            out.append(Field(name.lower(), (quoted if quoted is not None else bare).lower()))
        elif phrase is not None:
            out.append(Term(phrase.lower(), " " in phrase.strip()))
        elif word.lower() in ("and", "or", "not"):
            out.append(word.lower())
        else:
            out.append(Term(word.lower()))
        at = m.end()
    return out


def parse(query: str):
    """Tree of a query; NOT binds before AND (also between neighbours), AND before OR."""
    rest = tokens(query)

    def level(kind: str, below):
        items = [below()]
        while rest and (rest[0] == kind or (kind == "and" and rest[0] not in ("or", ")"))):
            if rest[0] == kind:
                rest.pop(0)
            items.append(below())
        flat = [y for x in items for y in (x.items if isinstance(x, Group) and x.kind == kind else (x,))]
        return flat[0] if len(flat) == 1 else Group(kind, tuple(flat))

    def unary():
        if not rest:
            raise SearchError("the query ends too early")
        head = rest.pop(0)
        if head == "not":
            return Not(unary())
        if head == "(":
            inner = either()
            if not rest or rest.pop(0) != ")":
                raise SearchError("a parenthesis is open")
            return inner
        if head in (")", "and", "or"):
            raise SearchError(f"unexpected {head}")
        return head

    def both():
        return level("and", unary)

    def either():
        return level("or", both)

    tree = either()
    if rest:
        raise SearchError("something is left over")
    return tree


def canonical(tree, inside: str = "") -> str:
    match tree:
        case Term(text, phrase):
            return f'"{text}"' if phrase or text in ("and", "or", "not") else text
        case Field(name, value):
            return f'{name}="{value}"' if " " in value else f"{name}={value}"
        case Not(item):
            inner = canonical(item)
            return f"not ({inner})" if isinstance(item, Group) else f"not {inner}"
        case Group("and", items):
            return " and ".join(sorted(canonical(i, "and") for i in items))
        case Group(_, items):
            text = " or ".join(canonical(i) for i in items)
            return f"({text})" if inside == "and" else text
    raise SearchError("not a query")


def normalized(query: str) -> str:
    """Canonical text; of what can't be parsed, lower case with single spaces."""
    try:
        return canonical(parse(query))
    except SearchError:
        return " ".join(query.lower().split())


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def terms_of(tree) -> list[str]:
    match tree:
        case Term(text, _):
            return query_words(text)
        case Field(_, value):
            return query_words(value)
        case Group(_, items):
            return list(dict.fromkeys(w for i in items for w in terms_of(i)))
    return []


def stemmed(tree):
    """The tree with each word of a term replaced by its stem; fields stay."""
    match tree:
        case Term(text, phrase):
            return Term(" ".join(stem(w) for w in query_words(text)), phrase)
        case Not(item):
            return Not(stemmed(item))
        case Group(kind, items):
            return Group(kind, tuple(stemmed(i) for i in items))
    return tree


def matches(tree, text: Column, fields: dict[str, Column]) -> Column:
    """Whether a row matches. text: its words; fields: arrays (exact) or texts (contains) by name."""
    match tree:
        case Term(value, _) | Field("", value):
            own = query_words(value)
            if not own:
                raise SearchError("nothing to search for")
            return F.array_contains(text, own[0]) if len(own) == 1 else F.contains(F.concat(F.lit(" "), F.array_join(text, " "), F.lit(" ")), F.lit(" " + " ".join(own) + " "))
        case Field(name, value):
            if name == "tag":
                return F.exists(fields["tag"], lambda t: F.lower(t) == value)
            if name not in fields:
                raise SearchError(f"unknown field: {name}")
            return F.contains(F.lower(fields[name]), F.lit(value))
        case Not(item):
            return ~matches(item, text, fields)
        case Group(kind, items):
            return functools.reduce(operator.and_ if kind == "and" else operator.or_, [matches(i, text, fields) for i in items])
    raise SearchError("not a query")


def occurrences(text: Column, word: str) -> Column:
    return F.size(F.filter(text, lambda w: w == word))


def search(docs: DataFrame, query: str, fields: dict[str, Column], k1: float = 1.2, b: float = 0.75, stemming: bool = False) -> DataFrame:
    """id, title, rank of matching documents, best (least) first; with stemming, words match whatever their endings. One pass counts lengths and term
    frequencies, one scores; nothing is shuffled but the final order."""
    tree, text = parse(query), words(F.concat_ws(" ", "title", "body"))
    if stemming:
        tree, text = stemmed(tree), stems(text)
    rows = docs.withColumn("_words", text)
    terms = terms_of(tree)
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("_words")).alias("len"), *(F.count_if(F.array_contains("_words", t)).alias(f"df{i}") for i, t in enumerate(terms))).first()
    hits = rows.filter(matches(tree, F.col("_words"), fields))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.greatest(F.ln(F.lit((stats.n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))), F.lit(1e-6))
        tf = occurrences(F.col("_words"), t).cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("_words") / F.lit(float(stats.len or 1))))
    return hits.select("id", "title", F.round(-score, 6).alias("rank")).orderBy("rank", "id")
