"""Search over a DataFrame: filter, order, page, count, resume."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sealframe.functions.predicates import Fields, predicate

#: Hits of a page unless the request says otherwise.
PAGE = 10


def where(df: DataFrame, query: Mapping[str, Any], analyzed: Mapping[str, str] | None = None) -> DataFrame:
    """The rows that match the query."""
    return df.where(predicate(Fields(df.schema, analyzed), query))


def order(sort: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort columns; missing values come last in both directions. End with a unique key for a total order."""
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in sort]


def page(df: DataFrame, sort: Sequence[tuple[str, str]], size: int = PAGE, start: int = 0) -> DataFrame:
    """Rows start to start + size in order; a page past the end is shorter or empty. Spark keeps start + size rows a task."""
    ordered = df.orderBy(*order(sort))
    return (ordered.offset(start) if start else ordered).limit(size)


def after(df: DataFrame, sort: Sequence[tuple[str, str]], values: Sequence[Any]) -> DataFrame:
    """The rows strictly after the sort values of the last hit. They may not be null."""
    keep, equal = F.lit(False), F.lit(True)
    for (name, way), value in zip(sort, values, strict=True):
        c = F.col(name)
        beyond = c < F.lit(value) if way == "desc" else c > F.lit(value)
        keep = keep | (equal & (beyond | c.isNull()))
        equal = equal & (c == F.lit(value))
    return df.where(keep)


def total(df: DataFrame, track: bool | int = True) -> dict[str, Any] | None:
    """The number of matches: exact, none (False), or counted up to a bound (reads no further than it must)."""
    if track is False:
        return None
    if track is True:
        return {"value": df.count(), "relation": "eq"}
    n = df.limit(track + 1).count()
    return {"value": min(n, track), "relation": "gte" if n > track else "eq"}


def search(df: DataFrame, query: Mapping[str, Any] | None = None, sort: Sequence[tuple[str, str]] = (), size: int = PAGE, start: int = 0, search_after: Sequence[Any] | None = None, analyzed: Mapping[str, str] | None = None) -> DataFrame:
    """The hits of a request as a DataFrame; nothing runs until it is asked for rows."""
    found = where(df, query, analyzed) if query else df
    if search_after is not None:
        found = after(found, sort, search_after)
    return page(found, sort, size, start) if sort else found.limit(size)


def scroll(df: DataFrame, key: str, size: int):
    """Batches of a frozen view in order of a unique key, until one is empty. Each is a bounded top-k after the last key."""
    last: Any = None
    while True:
        batch = search(df, sort=[(key, "asc")], size=size, search_after=None if last is None else [last])
        rows = batch.collect()
        if not rows:
            return
        yield rows
        last = rows[-1][key]


@dataclass
class Scroll:
    """Pages of a frozen view (a table's live(version)), as DataFrames in order of a unique key that is never null.

    Each page is a top-k after the last key of the page before, which alone is known here. A scroll ends keep_alive seconds
    after it was last asked, or when it is cleared; asking it later is an error.
    """

    df: DataFrame
    key: str
    size: int
    keep_alive: float = 60.0
    clock: Callable[[], float] = time.monotonic
    _last: Any = None
    _until: float = field(init=False)

    def __post_init__(self) -> None:
        self._until = self.clock() + self.keep_alive

    def page(self, path: str) -> DataFrame | None:
        """Write the next page to a path and read it from there; None after the last page."""
        if self.clock() >= self._until:
            raise LookupError("the scroll has ended")
        seen = Observation()
        found = search(self.df, sort=[(self.key, "asc")], size=self.size, search_after=None if self._last is None else [self._last])
        found.observe(seen, F.max(self.key).alias("last")).write.parquet(path)
        self._until = self.clock() + self.keep_alive
        if seen.get["last"] is None:
            return None
        self._last = seen.get["last"]
        return self.df.sparkSession.read.schema(found.schema).parquet(path)

    def clear(self) -> None:
        self._until = float("-inf")
