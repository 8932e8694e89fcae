"""Query clauses as column predicates.

A clause is a dictionary with one key, as in {"term": {"status": "open"}}. Predicates are plain columns, so filters reach
the Parquet scan where Spark can push them. A predicate may be null where a row has no value, which a filter takes as
false; where it is negated or counted, null is made false first, so that must_not keeps rows without a value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, TimestampNTZType, TimestampType

from sealframe.functions import text


class Fields:
    """A schema's fields by dotted path; `text` names those that are analyzed, and with which analyzer."""

    def __init__(self, schema: StructType, analyzed: Mapping[str, str] | None = None):
        self.schema, self.analyzed = schema, dict(analyzed or {})

    def type_of(self, path: str) -> DataType:
        found: DataType = self.schema
        for name in path.split("."):
            found = found.elementType if isinstance(found, ArrayType) else found
            if not isinstance(found, StructType) or name not in found.names:
                raise KeyError(f"no field {path}")
            found = found[name].dataType
        return found

    def raw(self, path: str) -> str:
        """The column's own path: x.keyword is the unanalyzed x."""
        return path.removesuffix(".keyword")

    def is_text(self, path: str) -> bool:
        return path in self.analyzed

    def tokens(self, path: str) -> Column:
        return text.ANALYZERS[self.analyzed.get(path, "standard")](F.col(path))


def _value(of: DataType, value: Any) -> Column:
    if isinstance(of, (TimestampType, TimestampNTZType)) and isinstance(value, str):
        return F.lit(value.replace("Z", "")).cast(of)
    return F.lit(value)


def _term(fields: Fields, body: Mapping[str, Any]) -> Column:
    ((path, value),) = body.items()
    value = value["value"] if isinstance(value, Mapping) else value
    if fields.is_text(path):
        return text.may_hold(F.col(path), [value]) & F.array_contains(fields.tokens(path), value)  # the value itself isn't analyzed
    path = fields.raw(path)
    kind = fields.type_of(path)
    return F.array_contains(F.col(path), value) if isinstance(kind, ArrayType) else F.col(path) == _value(kind, value)


def _terms(fields: Fields, body: Mapping[str, Any]) -> Column:
    ((path, values),) = body.items()
    path = fields.raw(path)
    if isinstance(fields.type_of(path), ArrayType):
        return F.arrays_overlap(F.col(path), F.array(*map(F.lit, values)))
    return F.col(path).isin(list(values))


def _range(fields: Fields, body: Mapping[str, Any]) -> Column:
    ((path, limits),) = body.items()
    path, kind, out = fields.raw(path), fields.type_of(fields.raw(path)), F.lit(True)
    tests: dict[str, Callable[[Column, Column], Column]] = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    for name, value in limits.items():
        out = out & tests[name](F.col(path), _value(kind, value))
    return out


def _match(fields: Fields, body: Mapping[str, Any]) -> Column:
    ((path, query),) = body.items()
    options = query if isinstance(query, Mapping) else {"query": query}
    if not fields.is_text(path) and not isinstance(fields.type_of(fields.raw(path)), StringType):
        return _term(fields, {path: options["query"]})
    operator, analyzer, raw = options.get("operator", "or"), fields.analyzed.get(path, "standard"), fields.raw(path)
    may = text.may_hold(F.col(raw), text.terms_of(options["query"], analyzer), operator == "and")
    return may & text.match(fields.tokens(raw), options["query"], operator, analyzer)


def _match_phrase(fields: Fields, body: Mapping[str, Any]) -> Column:
    ((path, query),) = body.items()
    query, raw = query["query"] if isinstance(query, Mapping) else query, fields.raw(path)
    return text.may_hold(F.col(raw), text.terms_of(query), every=True) & text.match_phrase(fields.tokens(raw), query)


def _multi_match(fields: Fields, body: Mapping[str, Any]) -> Column:
    out = F.lit(False)
    for path in body["fields"]:
        out = out | _match(fields, {path: body["query"]})
    return out


def _query_string(fields: Fields, body: Mapping[str, Any]) -> Column:
    """Words or one quoted phrase over the given fields, or all analyzed ones; a phrase keeps its stop words."""
    query, out = body["query"].strip(), F.lit(False)
    for path in body.get("fields") or fields.analyzed or [f.name for f in fields.schema if isinstance(f.dataType, StringType)]:
        if len(query) > 1 and query[0] == query[-1] == '"':
            out = out | text.may_hold(F.col(path), text.terms_of(query[1:-1]), every=True) & text.match_phrase(text.standard(F.col(path)), query[1:-1])
        else:
            out = out | text.may_hold(F.col(path), text.terms_of(query)) & text.match(fields.tokens(path), query)
    return out


def _bool(fields: Fields, body: Mapping[str, Any]) -> Column:
    def each(name: str) -> list[Column]:
        clauses = body.get(name, [])
        return [predicate(fields, q) for q in ([clauses] if isinstance(clauses, Mapping) else clauses)]

    out = F.lit(True)
    for p in [*each("must"), *each("filter")]:
        out = out & p
    for p in each("must_not"):
        out = out & ~F.coalesce(p, F.lit(False))
    should = each("should")
    least = int(body.get("minimum_should_match", 0 if "must" in body or "filter" in body else 1))
    if should and least:
        held = F.lit(0)
        for p in should:
            held = held + F.coalesce(p, F.lit(False)).cast("int")
        any_of = should[0]
        for p in should[1:]:
            any_of = any_of | p
        out = out & (any_of if least == 1 else held >= least)
    return out


_CLAUSES: dict[str, Callable[[Fields, Mapping[str, Any]], Column]] = {
    "match_all": lambda fields, body: F.lit(True),
    "term": _term,
    "terms": _terms,
    "range": _range,
    "match": _match,
    "match_phrase": _match_phrase,
    "multi_match": _multi_match,
    "query_string": _query_string,
    "bool": _bool,
}


def predicate(fields: Fields, query: Mapping[str, Any]) -> Column:
    """The clause as a boolean column; null counts as false."""
    if len(query) != 1:
        raise ValueError(f"a clause has one key, not {sorted(query)}")
    ((kind, body),) = query.items()
    if kind not in _CLAUSES:
        raise ValueError(f"no such clause: {kind}")
    return _CLAUSES[kind](fields, body)
