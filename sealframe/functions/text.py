"""Full text: analyzers, match predicates and BM25, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English stop words that the stop analyzer removes.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

_BREAK = r"[^\p{L}\p{N}_]+"


def standard(text: Column) -> Column:
    """Lower-cased words; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), lambda x: x != "")


def stop(text: Column) -> Column:
    """Lower-cased words without stop words; repeats stay."""
    return F.filter(standard(text), lambda x: ~x.isin(STOP_WORDS))


ANALYZERS = {"standard": standard, "stop": stop}


def terms_of(query: str, analyzer: str = "standard") -> list[str]:
    """A query text's words by the analyzer's rule."""
    import re

    words = [x for x in re.split(r"[^\w]+", query.lower()) if x]
    return [x for x in words if analyzer != "stop" or x not in STOP_WORDS]


def may_hold(text: Column, words: list[str], every: bool = False) -> Column:
    """Whether a text can have any (or every) of these tokens: a token is a part of the text in small letters.

    It stands before a predicate on tokens, so that most texts need not be cut into words.
    """
    low, out = F.lower(text), F.lit(every)
    for w in words:
        out = out & low.contains(w) if every else out | low.contains(w)
    return out


def match(tokens: Column, query: str, operator: str = "or", analyzer: str = "standard") -> Column:
    """Any (or all) of the query's words is among the tokens."""
    words = terms_of(query, analyzer)
    if not words:
        return F.lit(False)
    if operator == "and":
        return F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(tokens, w))
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def match_phrase(tokens: Column, query: str, analyzer: str = "standard") -> Column:
    """The query's words stand next to each other in order. Candidates are the places of the first word."""
    words = terms_of(query, analyzer)
    if not words:
        return F.lit(False)
    whole = F.array(*map(F.lit, words))
    starts = F.filter(F.transform(tokens, lambda x, i: F.when(x == words[0], i)), lambda i: i.isNotNull())
    return F.exists(starts, lambda i: F.slice(tokens, i + 1, len(words)) == whole)


def bm25(df: DataFrame, text: str, query: str, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the rows that match any query word, by the published BM25 formula.

    Document frequencies and the mean length are one aggregation of a single row over all texts; for the scores only texts
    that may hold a query word are cut into words again.
    """
    words = sorted(set(terms_of(query)))
    times = lambda w: F.size(F.filter("t", lambda x: x == w))
    counted = lambda some: some.select(F.col(key), standard(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), *(times(w).alias(f"tf{i}") for i, w in enumerate(words)))
    totals = counted(df).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    joined = counted(df.where(may_hold(F.col(text), words))).where(" or ".join(f"tf{i} > 0" for i in range(len(words)))).join(F.broadcast(totals))  # one row
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    score = part(0)
    for i in range(1, len(words)):
        score = score + part(i)
    return joined.select(key, score.alias("score"))
