"""Bucket and metric aggregations.

Sibling metrics are one aggregation; named and range buckets may overlap, so they are conditional aggregates of one pass
over the data, turned into rows afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values, about, that exact percentiles leave to one task; ranges that more of them are dealt to.
DISTINCT, RANGES = 1_000_000, 64


def terms(df: DataFrame, key: str, size: int | None = None, min_count: int = 1, metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """key, doc_count and metrics by value, most frequent first, ties by value; null values have no bucket."""
    out = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("doc_count"), *(m.alias(n) for n, m in (metrics or {}).items()))
    out = out.where(F.col("doc_count") >= min_count) if min_count > 1 else out
    out = out.orderBy(F.desc("doc_count"), "key")
    return out.limit(size) if size is not None else out


def nested_terms(df: DataFrame, parent: str, child: str, size: int = 10) -> DataFrame:
    """parent, child, doc_count: the most frequent children of each parent. Ranks counts, not rows."""
    counts = df.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).groupBy(F.col(parent).alias("parent"), F.col(child).alias("child")).agg(F.count("*").alias("doc_count"))
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("doc_count"), "child"))
    return counts.withColumn("n", rank).where(F.col("n") <= size).drop("n")


def day(ts: str) -> Column:
    """The calendar day's start, in UTC, as a timestamp without time zone."""
    return F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")


def date_histogram(df: DataFrame, ts: str, calendar: str | None = None, fixed: str | None = None, metrics: Mapping[str, Column] | None = None, min_count: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """key and doc_count by calendar unit or by fixed interval from the epoch, and by the columns `by`.

    min_count 0 lists the empty buckets between the first and the last too, of each group.
    """
    key = F.date_trunc(calendar, F.col(ts)).cast("timestamp_ntz") if calendar else F.window(ts, fixed).getField("start")
    out = df.where(F.col(ts).isNotNull()).groupBy(*by, key.alias("key")).agg(F.count("*").alias("doc_count"), *(m.alias(n) for n, m in (metrics or {}).items()))
    if min_count > 1:
        return out.where(F.col("doc_count") >= min_count)
    if min_count == 0:
        step = F.expr(f"interval 1 {calendar}" if calendar else f"interval {fixed}")
        every = out.groupBy(*by).agg(F.min("key").alias("a"), F.max("key").alias("b")).select(*by, F.explode(F.sequence("a", "b", step)).alias("key"))
        out = every.join(out, [*by, "key"], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    return out


def buckets(df: DataFrame, named: Mapping[str, Column], metrics: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """bucket, doc_count and metrics (name: (function, column)) of each predicate's rows; empty buckets are listed."""
    metrics = dict(metrics or {})
    call = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    cells = [F.struct(F.lit(name).alias("bucket"), F.count_if(p).alias("doc_count"), *(call[f](F.when(p, F.col(c))).alias(m) for m, (f, c) in metrics.items())) for name, p in named.items()]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def ranges(df: DataFrame, column: str, limits: Sequence[tuple[str, float | str | None, float | str | None]]) -> DataFrame:
    """bucket, doc_count by (name, from, to): from is inside, to outside; ranges may overlap."""
    kind = df.schema[column].dataType

    def inside(a, b) -> Column:
        out = F.col(column).isNotNull()
        out = out & (F.col(column) >= F.lit(a).cast(kind)) if a is not None else out
        return out & (F.col(column) < F.lit(b).cast(kind)) if b is not None else out

    return buckets(df, {name: inside(a, b) for name, a, b in limits})


def stats(column: str, extended: bool = False) -> list[Column]:
    """count, min, max, avg, sum and, extended, sum of squares, population variance and deviation; put them in one agg()."""
    c = F.col(column)
    out = [F.count(c).alias("count"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("avg"), F.sum(c).cast("double").alias("sum")]
    return out + [F.sum(c.cast("double") * c).alias("sum_of_squares"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("std_deviation")] if extended else out


def cardinality(column: str, precision: float | None = None) -> Column:
    """Distinct values: exact, or by a sketch of bounded size with the given relative error."""
    return F.count_distinct(column) if precision is None else F.approx_count_distinct(column, precision)


def percentiles(df: DataFrame, column: str, percents: Sequence[float], accuracy: int | None = None, most: int = DISTINCT) -> DataFrame:
    """percent, value: interpolated and exact, or by a sketch of bounded size.

    Exact ones are Spark's own, which hold all distinct values in one task, up to about `most` of these; beyond it
    values are dealt to ranges, and only the ranges with a wanted rank are put in order.
    """
    points = [p / 100 for p in percents]
    x = F.col(column).cast("double")
    if accuracy is None and df.agg(F.approx_count_distinct(x)).first()[0] > most:
        return df.sparkSession.createDataFrame(list(zip(map(float, percents), at_points(df, x, points), strict=True)), "percent double, value double")
    values = F.percentile(column, points) if accuracy is None else F.percentile_approx(x, points, accuracy)
    return df.agg(values.alias("v")).select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, map(float, percents))), F.col("i") + 1).alias("percent"), "value")


def at_points(df: DataFrame, x: Column, points: Sequence[float]) -> list[float]:
    """The values at these shares of the ranks, interpolated. The driver sees counts of RANGES ranges and the values at the ranks."""
    bounds = sorted(set(df.agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]))
    place = F.lit(0)
    for b in bounds:
        place = place + (x >= b).cast("int")
    counted = df.select(x.alias("x"), place.alias("range")).where("x is not null").groupBy("range", "x").count()
    sizes = {r["range"]: r["n"] for r in counted.groupBy("range").agg(F.sum("count").alias("n")).collect()}
    starts = dict(zip(sorted(sizes), accumulate((sizes[k] for k in sorted(sizes)), initial=0), strict=False))
    positions = [p * (sum(sizes.values()) - 1) for p in points]
    wanted = {rank: max((k for k in starts if starts[k] <= rank)) for at in positions for rank in (math.floor(at), math.ceil(at))}
    upto = counted.where(F.col("range").isin(list(set(wanted.values())))).withColumn("upto", F.sum("count").over(Window.partitionBy("range").orderBy("x")))
    holds = F.lit(False)
    for rank, k in wanted.items():
        holds = holds | (F.col("range") == k) & (F.col("upto") > rank - starts[k]) & (F.col("upto") - F.col("count") <= rank - starts[k])
    found = upto.where(holds).collect()
    value = {rank: next(r["x"] for r in found if r["range"] == k and r["upto"] - r["count"] <= rank - starts[k] < r["upto"]) for rank, k in wanted.items()}
    return [value[math.floor(at)] if at == math.floor(at) else (math.ceil(at) - at) * value[math.floor(at)] + (at - math.floor(at)) * value[math.ceil(at)] for at in positions]


def percentile_ranks(df: DataFrame, column: str, values: Sequence[float]) -> DataFrame:
    """value, rank: the share of values up to it, in percent."""
    cells = [F.struct(F.lit(float(v)).alias("value"), (F.lit(100.0).cast("double") * F.count_if(F.col(column) <= v) / F.count(column)).alias("rank")) for v in values]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def median_absolute_deviation(df: DataFrame, column: str, most: int = DISTINCT) -> DataFrame:
    """mad: the median distance from the median; medians are exact, as percentiles are."""
    middle = percentiles(df, column, [50], most=most).first()
    if middle is None:
        return df.sparkSession.createDataFrame([(None,)], "mad double")
    away = df.select(F.abs(F.col(column) - F.lit(middle["value"])).alias("away"))
    return percentiles(away, "away", [50], most=most).select(F.col("value").alias("mad"))


def composite(df: DataFrame, keys: Sequence[str], size: int, after: Sequence | None = None) -> DataFrame:
    """keys and doc_count in order of the keys, a page of so many buckets after the given one."""
    from sealframe.plans.search import after as beyond
    from sealframe.plans.search import page

    out = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("doc_count"))
    sort = [(k, "asc") for k in keys]
    return page(beyond(out, sort, after) if after is not None else out, sort, size)
