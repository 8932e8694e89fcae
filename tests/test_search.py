"""Golden requests over small tables: clauses, text, order, paging, cursors."""

import pytest

from sealframe.functions import text
from sealframe.operators import aggs
from sealframe.plans import search as S


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [(1, "open", 5, "Encrypting the Disk", ["a", "b"], ("x", 1)), (2, "open", 3, "Encryption of indexes", [], ("y", 2)), (3, "closed", None, None, None, None), (4, None, 8, "disk the quick brown fox", ["b"], ("x", 3))]
    return spark.createDataFrame(rows, "id int, status string, priority int, title string, tags array<string>, meta struct<kind:string,version:int>")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"match_all": {}}, [1, 2, 3, 4]),
        ({"term": {"status": "open"}}, [1, 2]),
        ({"term": {"status.keyword": {"value": "open"}}}, [1, 2]),
        ({"terms": {"status": ["open", "closed"]}}, [1, 2, 3]),
        ({"range": {"priority": {"gt": 3, "lte": 8}}}, [1, 4]),
        ({"term": {"tags": "b"}}, [1, 4]),
        ({"terms": {"tags": ["a", "z"]}}, [1]),
        ({"term": {"meta.kind": "x"}}, [1, 4]),
        ({"bool": {"must_not": {"term": {"status": "open"}}}}, [3, 4]),
        ({"bool": {"must_not": [{"range": {"priority": {"gte": 5}}}, {"term": {"tags": "a"}}]}}, [2, 3]),
        ({"bool": {"should": [{"term": {"status": "open"}}, {"term": {"tags": "b"}}]}}, [1, 2, 4]),
        ({"bool": {"should": [{"term": {"status": "open"}}, {"term": {"tags": "b"}}], "minimum_should_match": 2}}, [1]),
        ({"bool": {"must": {"match_all": {}}, "should": {"term": {"status": "closed"}}}}, [1, 2, 3, 4]),
        ({"match": {"title": "DISK"}}, [1, 4]),
        ({"match": {"title": "encryption"}}, [2]),
        ({"match": {"title": {"query": "disk the", "operator": "and"}}}, [1, 4]),
        ({"match_phrase": {"title": "the disk"}}, [1]),
        ({"match_phrase": {"title": "disk indexes"}}, []),
        ({"match": {"title": ""}}, []),
        ({"multi_match": {"query": "fox", "fields": ["title", "status"]}}, [4]),
        ({"query_string": {"query": '"the quick brown fox"'}}, [4]),
        ({"query_string": {"query": "indexes fox"}}, [2, 4]),
    ],
)
def test_clauses(tickets, query, want):
    assert ids(S.where(tickets, query, {"title": "standard"})) == want


def test_unknown_clauses_and_fields(tickets):
    with pytest.raises(ValueError, match="no such clause"):
        S.where(tickets, {"fuzzy": {}})
    with pytest.raises(KeyError):
        S.where(tickets, {"term": {"nothing": 1}})
    with pytest.raises(ValueError, match="one key"):
        S.where(tickets, {"term": {}, "match": {}})


def test_analyzers(spark):
    df = spark.createDataFrame([("The quick Brown-fox, the FOX_1!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.standard(df.t)).collect()] == [["the", "quick", "brown", "fox", "the", "fox_1"], [], []]
    assert [r[0] for r in df.select(text.stop(df.t)).collect()][0] == ["quick", "brown", "fox", "fox_1"]


def test_filters_reach_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    plan = S.where(df, {"bool": {"filter": [{"term": {"o_orderstatus": "O"}}, {"range": {"o_orderkey": {"gte": 5}}}]}}).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "PushedFilters: [IsNotNull" in plan and "coalesce" not in plan and "o_custkey" not in plan


def test_pages(spark):
    df = spark.range(1, 16).toDF("id")
    page = lambda size, start: [r["id"] for r in S.page(df, [("id", "asc")], size, start).collect()]
    assert page(10, 0) == list(range(1, 11)) and page(10, 10) == [11, 12, 13, 14, 15] and page(10, 20) == []
    assert "TakeOrderedAndProject" in S.page(df, [("id", "asc")], 5)._jdf.queryExecution().executedPlan().toString()
    assert S.total(df) == {"value": 15, "relation": "eq"} and S.total(df, 5) == {"value": 5, "relation": "gte"} and S.total(df, False) is None
    assert [[r["id"] for r in b] for b in S.scroll(df, "id", 6)] == [[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12], [13, 14, 15]]


def test_missing_values_come_last_and_cursors_resume(tickets):
    sort = [("priority", "desc"), ("id", "asc")]
    order = [r["id"] for r in S.search(tickets, sort=sort).collect()]
    assert order == [4, 1, 2, 3]
    assert [r["id"] for r in S.search(tickets, sort=[("priority", "asc")]).collect()] == [2, 1, 4, 3]
    assert [r["id"] for r in S.search(tickets, sort=sort, search_after=[5, 1]).collect()] == [2, 3]


def test_aggregations(spark, tickets):
    assert [tuple(r) for r in aggs.terms(tickets, "status").collect()] == [("open", 2), ("closed", 1)]
    assert {tuple(r) for r in aggs.ranges(tickets, "priority", [("low", None, 5), ("high", 5, None), ("all", 0, 100), ("none", 50, None)]).collect()} == {("low", 1), ("high", 2), ("all", 3), ("none", 0)}
    days = spark.sql("select timestamp_ntz'2024-01-01 10:00' as ts, 350.0D as v union all select timestamp_ntz'2024-01-04 23:59', 1.0D")
    assert [r["doc_count"] for r in aggs.date_histogram(days, "ts", "day", min_count=0).orderBy("key").collect()] == [1, 0, 0, 1]
    stats = spark.createDataFrame([(x,) for x in (100, 150, 200, 250, 300)], "v long").agg(*aggs.stats("v", extended=True)).first()
    assert (stats["count"], stats["min"], stats["max"], stats["avg"], stats["sum"], stats["variance"]) == (5, 100.0, 300.0, 200.0, 1000.0, 5000.0)
    empty = tickets.limit(0)
    assert aggs.terms(empty, "status").collect() == [] and aggs.ranges(empty, "priority", [("a", 0, 1)]).first()["doc_count"] == 0


def test_exact_percentiles_of_many_values(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for values in (rng.normal(size=5000).round(2), np.repeat([3.0, 1.0], [4999, 1]), np.array([7.0]), np.arange(100.0)):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
        got = aggs.percentiles(df, "x", [0, 5, 33.3, 50, 99, 100], most=0).collect()
        assert np.allclose([r["value"] for r in got], np.percentile(values, [0, 5, 33.3, 50, 99, 100]))
        assert aggs.median_absolute_deviation(df, "x", most=0).first()["mad"] == pytest.approx(float(np.median(np.abs(values - np.median(values)))))
