"""The search engine's registered queries, each over encrypted copies of the tables, and their SQL on the plain ones."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealframe.crypto.keys import DummyProvider, KeyDirectory
from sealframe.crypto.parquet import enable, read_options, write_options
from sealframe.functions import text
from sealframe.operators import aggs
from sealframe.plans import search as S
from sealframe.session import scratch
from sealframe.sources.table import Catalog, Table, count_tables_for_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_sealed: dict[tuple[str, str, str], str] = {}
_keys: dict[str, tuple[KeyDirectory, str]] = {}


def _key(spark: SparkSession) -> tuple[KeyDirectory, str]:
    app = spark.sparkContext.applicationId
    if app not in _keys:
        top = os.path.join(scratch(spark), f"sealframe-{uuid.uuid4().hex}")
        os.makedirs(top)
        keys = KeyDirectory(os.path.join(top, "keys"))
        _keys[app] = keys, keys.create(os.path.join(top, "keyfile"), {"key_provider": "dummy"})
    return _keys[app]


def sealed(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The encrypted copy of a table, written once a session."""
    keys, key_id = _key(spark)
    enable(spark)
    name = (spark.sparkContext.applicationId, sf_dir, table)
    if name not in _sealed:
        path = os.path.join(scratch(spark), f"sealed-{uuid.uuid4().hex}", table)
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.options(**write_options(keys.path, key_id)).parquet(path)
        _sealed[name] = path
    return spark.read.options(**read_options(keys.path)).parquet(_sealed[name])


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def _search(name: str, table: str, query: dict, columns: list[str], sql: str, analyzed: dict | None = None) -> None:
    """A query that filters a table and returns some columns of the matches."""
    _query(sql, name)(lambda spark, sf_dir: S.where(sealed(spark, sf_dir, table), query, analyzed).select(*columns))


_ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_search("match_all", "nation", {"match_all": {}}, ["n_nationkey", "n_name"], "select n_nationkey, n_name from nation")
_search("term_eq", "orders", {"term": {"o_orderstatus.keyword": "O"}}, _ORDER, "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'O'")
_search("terms_in", "orders", {"terms": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}}, ["o_orderkey", "o_orderpriority"], "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
_search("range_num", "orders", {"range": {"o_totalprice": {"gte": 100000, "lt": 200000}}}, _ORDER, "select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice >= 100000 and o_totalprice < 200000")
_search("range_date", "events", {"range": {"ts": {"gte": "2024-01-05", "lt": "2024-01-12T12:00:00Z"}}}, ["event_id", "ts"], "select event_id, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12 12:00:00'")
_search("bool_must", "events", {"bool": {"must": [{"term": {"event_type": "purchase"}}, {"range": {"value": {"gt": 50}}}]}}, ["event_id", "value"], "select event_id, value from events where event_type = 'purchase' and value > 50")
_search("bool_should", "orders", {"bool": {"should": [{"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gt": 200000}}}, {"term": {"o_orderpriority": "1-URGENT"}}], "minimum_should_match": 2}}, ["o_orderkey"], "select o_orderkey from orders where (o_orderstatus = 'F')::int + (o_totalprice > 200000)::int + (o_orderpriority = '1-URGENT')::int >= 2")
_search("bool_complex", "orders", {"bool": {"must": [{"range": {"o_totalprice": {"gte": 50000}}}], "should": [{"term": {"o_orderpriority": "1-URGENT"}}], "must_not": [{"term": {"o_orderstatus": "F"}}], "filter": [{"range": {"o_orderdate": {"gte": "1996-01-01"}}}]}}, ["o_orderkey"], "select o_orderkey from orders where o_totalprice >= 50000 and not o_orderstatus = 'F' and o_orderdate >= timestamp '1996-01-01'")
_search("bool_must_not", "events", {"bool": {"must_not": [{"term": {"event_type": "click"}}]}}, ["event_id", "event_type"], "select event_id, event_type from events where event_type is distinct from 'click'")
_search("bool_filter", "lineitem", {"bool": {"filter": [{"term": {"l_returnflag": "R"}}, {"range": {"l_quantity": {"lte": 10}}}]}}, ["l_orderkey", "l_linenumber"], "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_quantity <= 10")

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_TEXT = {"text": "standard"}
_search("match_or", "documents", {"match": {"text": "License the thereou"}}, ["doc_id"], f"select doc_id from documents where list_has_any({_TOKENS}, ['license', 'the', 'thereou'])", _TEXT)
_search("match_and", "documents", {"match": {"text": {"query": "released License", "operator": "and"}}}, ["doc_id"], f"select doc_id from documents where list_has_all({_TOKENS}, ['released', 'license'])", _TEXT)
_search("term_text", "documents", {"term": {"text": "license"}}, ["doc_id"], f"select doc_id from documents where list_contains({_TOKENS}, 'license')", _TEXT)
_search("match_phrase", "documents", {"match_phrase": {"text": "Released under the MIT"}}, ["doc_id"], f"select doc_id from documents where contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' released under the mit ')", _TEXT)
_search("query_string_phrase", "documents", {"query_string": {"query": '"under the apache license"'}}, ["doc_id"], f"select doc_id from documents where contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' under the apache license ')", {"text": "stop"})
_search("multi_match", "part", {"multi_match": {"query": "brand green steel", "fields": ["p_name", "p_brand", "p_type"]}}, ["p_partkey"], "select p_partkey from part where " + " or ".join(f"list_has_any(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''), ['brand', 'green', 'steel'])" for c in ("p_name", "p_brand", "p_type")), {"p_name": "standard", "p_brand": "standard", "p_type": "standard"})


@_query(f"select doc_id, len({_TOKENS})::int as n, md5(array_to_string({_TOKENS}, ' ')) as tokens from documents")
def analyze_standard(spark, sf_dir):
    """All tokens of each text, as a digest."""
    t = text.standard(F.col("text"))
    return sealed(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@_query("select doc_id, len(t)::int as n, md5(array_to_string(t, ' ')) as tokens from (select doc_id, list_filter(" + _TOKENS + ", lambda x: x not in (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")) as t from documents)")
def analyze_stop(spark, sf_dir):
    t = text.stop(F.col("text"))
    return sealed(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


_WORDS = ("license", "released", "under")
_BM25 = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(_WORDS)))


@_query(
    f"with d as (select doc_id, {_TOKENS} as t from documents), c as (select doc_id, len(t) as dl, "
    + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(_WORDS))
    + " from d), s as (select count(*) as n, avg(dl) as avgdl, "
    + ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(_WORDS)))
    + f" from c) select doc_id, round({_BM25}, 6) as score from c, s where tf0 > 0 or tf1 > 0 or tf2 > 0 order by score desc, doc_id limit 20"
)
def match_bm25(spark, sf_dir):
    scores = text.bm25(sealed(spark, sf_dir, "documents"), "text", "released under license", "doc_id").withColumn("score", F.round("score", 6))
    return S.page(scores, [("score", "desc"), ("doc_id", "asc")], 20)


@_query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where cast(json_extract_string(props, '$.k') as bigint) = 7")
def term_path(spark, sf_dir):
    df = sealed(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k long"))
    return S.where(df, {"term": {"props.k": 7}}).select("event_id", F.col("props.k").alias("k"))


@_query("select p_partkey from part where list_contains(string_split(p_name, ' '), 'ring')")
def term_array(spark, sf_dir):
    """Any element of an array of words."""
    df = sealed(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " "))
    return S.where(df, {"term": {"tags": "ring"}}).select("p_partkey")


# order, pages, counts


def _page(name: str, table: str, columns: list[str], sort: list[tuple[str, str]], size: int, start: int = 0, after: list | None = None, where: str = "", limit_of: dict | None = None) -> None:
    order = ", ".join(f"{c} {w} nulls last" for c, w in sort)
    sql = f"select {', '.join(columns)} from {table} {where} order by {order} limit {size} offset {start}"
    _query(sql, name)(lambda spark, sf_dir: S.search(sealed(spark, sf_dir, table), limit_of, sort, size, start, after).select(*columns))


_page("sort_keyword", "customer", ["c_mktsegment", "c_name"], [("c_mktsegment", "asc"), ("c_name", "desc")], 100)
_page("sort_numeric", "orders", ["o_orderkey", "o_totalprice"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 100)
_page("sort_date", "events", ["event_id", "ts"], [("ts", "desc"), ("event_id", "asc")], 100)
_page("page_from_size", "orders", ["o_orderkey"], [("o_orderkey", "asc")], 10, 25)
_page("page_past_end", "region", ["r_regionkey"], [("r_regionkey", "asc")], 10, 3)
_page("top_k", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"], [("l_extendedprice", "desc"), ("l_orderkey", "asc"), ("l_linenumber", "asc")], 50)
_page("search_after", "orders", ["o_orderkey", "o_orderstatus"], [("o_orderstatus", "asc"), ("o_orderkey", "desc")], 20, after=["F", 900], where="where o_orderstatus > 'F' or o_orderstatus = 'F' and o_orderkey < 900")
_page("product_search", "part", ["p_partkey", "p_retailprice"], [("p_retailprice", "desc"), ("p_partkey", "asc")], 10, where="where p_size between 10 and 30", limit_of={"range": {"p_size": {"gte": 10, "lte": 30}}})


@_query("select count(*) as n from lineitem where l_quantity < 24")
def hits_total(spark, sf_dir):
    return S.where(sealed(spark, sf_dir, "lineitem"), {"range": {"l_quantity": {"lt": 24}}}).agg(F.count("*").alias("n"))


@_query("select count(*) as n from orders")
def count_all(spark, sf_dir):
    return sealed(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


@_query("select least(count(*), 100) as value, case when count(*) > 100 then 'gte' else 'eq' end as relation from orders where o_orderstatus = 'O'")
def track_total_hits(spark, sf_dir):
    few = S.where(sealed(spark, sf_dir, "orders"), {"term": {"o_orderstatus": "O"}}).limit(101)
    return few.agg(F.count("*").alias("n")).select(F.least("n", F.lit(100)).cast("long").alias("value"), F.when(F.col("n") > 100, "gte").otherwise("eq").alias("relation"))


@_query("select o_orderkey, ((row_number() over (order by o_orderkey) - 1) // (select greatest(ceil(count(*) / 5), 1)::bigint from orders))::int as page from orders")
def scroll_page(spark, sf_dir):
    """All orders in five pages of a frozen view, each written to a shared folder before the next is asked for."""
    df, top = sealed(spark, sf_dir, "orders").select("o_orderkey"), os.path.join(scratch(spark), f"scroll-{uuid.uuid4().hex}")
    scroll, out, n = S.Scroll(df, "o_orderkey", max(1, -(-df.count() // 5)), 3600), spark.createDataFrame([], "o_orderkey long, page int"), 0
    while (page := scroll.page(f"{top}/{n}")) is not None:
        out, n = out.unionByName(page.withColumn("page", F.lit(n))), n + 1
    scroll.clear()
    return out


# aggregations


def _agg(name: str, table: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _query(sql, name)(lambda spark, sf_dir: build(sealed(spark, sf_dir, table)))


_rounded = lambda df, *names: df.withColumns({n: F.round(n, 4) for n in names})
_agg("agg_terms", "events", lambda d: aggs.terms(d, "event_type"), "select event_type as key, count(*) as doc_count from events group by 1")
_agg("agg_terms_size", "part", lambda d: aggs.terms(d, "p_brand", 3), "select p_brand as key, count(*) as doc_count from part group by 1 order by 2 desc, 1 limit 3")
_agg("agg_terms_min_count", "customer", lambda d: aggs.terms(d, "c_nationkey", min_count=60), "select c_nationkey as key, count(*) as doc_count from customer group by 1 having count(*) >= 60")
_agg("agg_top_users", "events", lambda d: aggs.terms(d, "user_id", 5), "select user_id as key, count(*) as doc_count from events group by 1 order by 2 desc, 1 limit 5")
_agg("agg_terms_nested", "orders", lambda d: aggs.nested_terms(d, "o_orderstatus", "o_orderpriority", 2), "select parent, child, doc_count from (select o_orderstatus as parent, o_orderpriority as child, count(*) as doc_count, row_number() over (partition by o_orderstatus order by count(*) desc, o_orderpriority) as n from orders group by 1, 2) where n <= 2")
_agg("agg_date_hist_day", "events", lambda d: aggs.date_histogram(d, "ts", "day").withColumn("key_as_string", F.date_format("key", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), "select date_trunc('day', ts)::timestamp as key, count(*) as doc_count, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S.000Z') as key_as_string from events group by 1, 3")
_agg("agg_date_hist_12h", "events", lambda d: aggs.date_histogram(d, "ts", fixed="12 hours"), "select time_bucket(interval '12 hours', ts, timestamp '1970-01-01') as key, count(*) as doc_count from events group by 1")
_agg("agg_date_hist_sum", "events", lambda d: _rounded(aggs.date_histogram(d, "ts", "day", metrics={"total": F.sum("value")}), "total"), "select date_trunc('day', ts)::timestamp as key, count(*) as doc_count, round(sum(value), 4) as total from events group by 1")
_agg("agg_date_hist_min_count", "events", lambda d: aggs.date_histogram(d, "ts", "day", min_count=300), "select date_trunc('day', ts)::timestamp as key, count(*) as doc_count from events group by 1 having count(*) >= 300")
_agg("agg_date_hist_gapfill", "events", lambda d: aggs.date_histogram(d, "ts", "day", min_count=0, by=["user_id"]), "with c as (select user_id, date_trunc('day', ts)::timestamp as key, count(*) as n from events group by 1, 2), e as (select user_id, unnest(generate_series(min(key), max(key), interval 1 day)) as key from c group by 1) select user_id, key, coalesce(n, 0) as doc_count from e left join c using (user_id, key)")
_agg("agg_range", "part", lambda d: aggs.ranges(d, "p_retailprice", [("low", None, 1000), ("mid", 1000, 1500), ("high", 1500, None), ("none", 1e9, None)]), "select 'low' as bucket, count(*) filter (p_retailprice < 1000) as doc_count from part union all select 'mid', count(*) filter (p_retailprice >= 1000 and p_retailprice < 1500) from part union all select 'high', count(*) filter (p_retailprice >= 1500) from part union all select 'none', 0")
_agg("agg_range_keyed", "customer", lambda d: aggs.ranges(d, "c_acctbal", [("debt", None, 0), ("small", 0, 5000), ("positive", 0, None)]), "select 'debt' as bucket, count(*) filter (c_acctbal < 0) as doc_count from customer union all select 'small', count(*) filter (c_acctbal >= 0 and c_acctbal < 5000) from customer union all select 'positive', count(*) filter (c_acctbal >= 0) from customer")
_agg("agg_date_range", "lineitem", lambda d: aggs.ranges(d, "l_shipdate", [("q1_1995", "1995-01-01", "1995-04-01"), ("since_1997", "1997-01-01", None)]), "select 'q1_1995' as bucket, count(*) filter (l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1995-04-01') as doc_count from lineitem union all select 'since_1997', count(*) filter (l_shipdate >= timestamp '1997-01-01') from lineitem")
_agg("agg_filters", "orders", lambda d: aggs.buckets(d, {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 150000, "not_urgent": F.col("o_orderpriority") != "1-URGENT"}), "select 'open' as bucket, count(*) filter (o_orderstatus = 'O') as doc_count from orders union all select 'large', count(*) filter (o_totalprice > 150000) from orders union all select 'not_urgent', count(*) filter (o_orderpriority <> '1-URGENT') from orders")
_agg("agg_filters_sum", "orders", lambda d: _rounded(aggs.buckets(d, {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 150000}, {"total": ("sum", "o_totalprice")}), "total"), "select 'open' as bucket, count(*) filter (o_orderstatus = 'O') as doc_count, round(sum(o_totalprice) filter (o_orderstatus = 'O'), 4) as total from orders union all select 'large', count(*) filter (o_totalprice > 150000), round(sum(o_totalprice) filter (o_totalprice > 150000), 4) from orders")
_agg("agg_filter_avg", "events", lambda d: S.where(d, {"term": {"event_type": "purchase"}}).agg(F.count("*").alias("doc_count"), F.round(F.avg("value"), 4).alias("value")), "select count(*) as doc_count, round(avg(value), 4) as value from events where event_type = 'purchase'")
_agg("agg_stats", "lineitem", lambda d: _rounded(d.agg(*aggs.stats("l_quantity")), "avg", "sum"), "select count(l_quantity) as count, min(l_quantity)::double as min, max(l_quantity)::double as max, round(avg(l_quantity), 4) as avg, round(sum(l_quantity)::double, 4) as sum from lineitem")
_agg("agg_extended_stats", "lineitem", lambda d: _rounded(d.agg(*aggs.stats("l_quantity", extended=True)), "avg", "sum", "sum_of_squares", "variance", "std_deviation"), "select count(l_quantity) as count, min(l_quantity)::double as min, max(l_quantity)::double as max, round(avg(l_quantity), 4) as avg, round(sum(l_quantity)::double, 4) as sum, round(sum(l_quantity * l_quantity)::double, 4) as sum_of_squares, round(var_pop(l_quantity), 4) as variance, round(stddev_pop(l_quantity), 4) as std_deviation from lineitem")
_agg("agg_metrics", "orders", lambda d: d.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.sum("o_totalprice"), 2).alias("total")), "select min(o_totalprice) as low, max(o_totalprice) as high, round(avg(o_totalprice), 4) as mean, round(sum(o_totalprice), 2) as total from orders")
_agg("agg_value_count", "events", lambda d: d.agg(F.count("value").alias("n")), "select count(value) as n from events")
_agg("agg_cardinality", "events", lambda d: d.agg(aggs.cardinality("user_id").alias("users"), aggs.cardinality("event_type").alias("kinds")), "select count(distinct user_id) as users, count(distinct event_type) as kinds from events")
_agg("agg_percentiles", "events", lambda d: _rounded(aggs.percentiles(d, "value", [5, 25, 50, 95, 99]), "value"), "select p * 1.0::double as percent, round(v, 4) as value from (select unnest([5, 25, 50, 95, 99]) as p, unnest(quantile_cont(value, [0.05, 0.25, 0.5, 0.95, 0.99])) as v from events)")
_agg("agg_percentile_ranks", "events", lambda d: _rounded(aggs.percentile_ranks(d, "value", [10, 50]), "rank"), "select 10::double as value, round(100::double * count(*) filter (value <= 10) / count(value), 4) as rank from events union all select 50::double, round(100::double * count(*) filter (value <= 50) / count(value), 4) from events")
_agg("agg_mad", "events", lambda d: _rounded(aggs.median_absolute_deviation(d, "value"), "mad"), "select round(mad(value), 4) as mad from events")
_agg("agg_composite", "events", lambda d: aggs.composite(d, ["user_id", "event_type"], 20, [3, "click"]), "select user_id, event_type, count(*) as doc_count from events group by 1, 2 having user_id > 3 or user_id = 3 and event_type > 'click' order by 1, 2 limit 20")
_agg("agg_cardinality_sketch", "events", lambda d: d.agg((F.abs(aggs.cardinality("user_id", 0.02) - aggs.cardinality("user_id")) <= F.greatest(F.lit(1.0), 0.1 * aggs.cardinality("user_id"))).alias("close")), "select true as close")


# documents and versions: a table of orders keyed by order key, changed by rule


def _changed(spark: SparkSession, sf_dir: str) -> tuple[Table, int]:
    """Orders loaded, then one added to each price whose key is divisible by 5 and keys divisible by 7 deleted; and the version before."""
    keys, _ = _key(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    table = Table.create(spark, os.path.join(scratch(spark), f"orders-{uuid.uuid4().hex}"), keys)
    table.load(orders, "o_orderkey")
    before = table.version()
    table.update(orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("_id"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(True).alias("changed")))
    table.delete(orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("string").alias("_id")), refresh=True)
    return table, before


_PRICED = "case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, case when o_orderkey % 5 = 0 then true end as changed"


@_query(f"select o_orderkey, o_orderstatus, {_PRICED} from orders where o_orderkey % 7 <> 0")
def doc_update(spark, sf_dir):
    return _changed(spark, sf_dir)[0].live().select("o_orderkey", "o_orderstatus", "o_totalprice", "changed")


@_query("select count(*) as n, count(*) filter (o_orderkey % 5 = 0) as n_fifth from orders where o_orderkey % 7 <> 0")
def doc_delete(spark, sf_dir):
    return _changed(spark, sf_dir)[0].live().agg(F.count("*").alias("n"), F.count_if(F.expr("o_orderkey % 5 = 0")).alias("n_fifth"))


@_query("select o_orderkey, o_totalprice from orders")
def pit_snapshot(spark, sf_dir):
    table, before = _changed(spark, sf_dir)
    return table.live(before).select("o_orderkey", "o_totalprice")


@_query("select o_orderkey, o_orderstatus from orders where o_orderkey = 10")
def doc_get(spark, sf_dir):
    return _changed(spark, sf_dir)[0].live().where("_id = '10'").select("o_orderkey", "o_orderstatus")


@_query("select n_nationkey, n_name from nation")
def doc_index(spark, sf_dir):
    keys, _ = _key(spark)
    table = Table.create(spark, os.path.join(scratch(spark), f"nation-{uuid.uuid4().hex}"), keys)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    table.upsert(nation.withColumn("n_name", F.lit("?")), "n_nationkey")
    table.upsert(nation, "n_nationkey", refresh=True)
    return table.live().select("n_nationkey", "n_name")


@_query("select c_custkey, case when c_custkey % 4 = 0 then 'moved' else c_mktsegment end as c_mktsegment, case when c_custkey % 6 = 0 then -1.5 else c_acctbal end as c_acctbal from customer where c_custkey % 9 <> 0")
def bulk_mixed(spark, sf_dir):
    """One request of index, update and delete actions in order, several for some ids."""
    keys, _ = _key(spark)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    table = Table.create(spark, os.path.join(scratch(spark), f"customer-{uuid.uuid4().hex}"), keys)
    table.load(customer, "c_custkey")
    row = customer.select(F.col("c_custkey").cast("string").alias("_id"), "c_custkey")
    action = lambda at, kind, cond, source: row.where(cond).select(F.lit(at).alias("ordinal"), F.lit(kind).alias("action"), "_id", F.lit(source).alias("source"))
    actions = action(1, "update", "c_custkey % 4 = 0", '{"c_mktsegment": "lost"}').unionAll(action(2, "update", "c_custkey % 4 = 0", '{"c_mktsegment": "moved"}'))
    actions = actions.unionAll(action(3, "update", "c_custkey % 6 = 0", '{"c_acctbal": -1.5}')).unionAll(action(4, "delete", "c_custkey % 9 = 0", None))
    table.bulk(actions, refresh=True)
    return table.live().select("c_custkey", "c_mktsegment", "c_acctbal")


@_query("select s_suppkey, s_name from supplier")
def reindex_copy(spark, sf_dir):
    keys, _ = _key(spark)
    table = Table.create(spark, os.path.join(scratch(spark), f"supplier-{uuid.uuid4().hex}"), keys)
    table.load(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey")
    return table.reindex(os.path.join(scratch(spark), f"supplier-{uuid.uuid4().hex}")).live().select("s_suppkey", "s_name")


def _catalog(spark: SparkSession) -> Catalog:
    keys, _ = _key(spark)
    return Catalog(spark, os.path.join(scratch(spark), f"catalog-{uuid.uuid4().hex}"), KeyDirectory(keys.path, {"dummy": DummyProvider(), "aws-kms": DummyProvider()}))


def _orders(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog of orders, changed by rule in two further batches, and of events as they are."""
    catalog, orders = _catalog(spark), spark.read.parquet(f"{sf_dir}/orders.parquet")
    table = catalog.create("orders", {"shards": 2})
    table.load(orders, "o_orderkey")
    table.update(orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("_id"), (F.col("o_totalprice") + 1).alias("o_totalprice")))
    table.delete(orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("string").alias("_id")), refresh=True)
    catalog.create("events", {"key_arn": "arn:aws:kms:r:1:key/a"}).load(spark.read.parquet(f"{sf_dir}/events.parquet").drop("ts"), "event_id")
    return catalog


@_query("select 'nation' as _index, n_nationkey as key, n_name as name from nation union all select 'region', r_regionkey, r_name from region")
def alias_search(spark, sf_dir):
    catalog = _catalog(spark)
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey")):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        catalog.create(name).load(df.select(F.col(key).alias("key"), F.col(f"{name[0]}_name").alias("name")), "key")
    catalog.alias("places", ["nation", "region"])
    return catalog.read("places").select("_index", "key", "name")


@_query("select 2 as n")
def count_for_key(spark, sf_dir):
    """Tables of a key: others have another key, another provider, or no context; one has the context in another order."""
    catalog = _catalog(spark)
    for name, provider, arn, context in (("a", "aws-kms", "k1", "x=1,y=2"), ("b", "aws-kms", "k1", "y=2,x=1"), ("c", "aws-kms", "k2", "x=1,y=2"), ("d", "dummy", "k1", "x=1,y=2"), ("e", "aws-kms", "k1", "")):
        catalog.create(name, {"key_provider": provider, "key_arn": f"arn:aws:kms:{arn}", "encryption_context": context})
    return count_tables_for_key(catalog.listing(), "arn:aws:kms:k1", "aws-kms", "x=1,y=2")


@_query("select 'orders' as name, count(*) filter (o_orderkey % 7 <> 0) as docs from orders union all select 'events', count(*) from events")
def table_counts(spark, sf_dir):
    catalog = _orders(spark, sf_dir)
    return catalog.read("orders").unionByName(catalog.read("events"), allowMissingColumns=True).groupBy(F.col("_index").alias("name")).agg(F.count("*").alias("docs"))


@_query("select * from (values ('events', 'encryption_context', ''), ('events', 'key_arn', 'arn:aws:kms:r:1:key/a'), ('events', 'key_provider', 'dummy'), ('events', 'shards', '1'), ('orders', 'encryption_context', ''), ('orders', 'key_provider', 'dummy'), ('orders', 'shards', '2')) as t(\"table\", setting, value)")
def get_settings(spark, sf_dir):
    return _orders(spark, sf_dir).settings()


@_query("select 'orders' as \"table\", 'encrypted' as store, 3 as batches, count(*) + count(*) filter (o_orderkey % 5 = 0) + count(*) filter (o_orderkey % 7 = 0) as rows from orders union all select 'events', 'encrypted', 1, count(*) from events")
def cat_indices(spark, sf_dir):
    return _orders(spark, sf_dir).listing().select("table", "store", "batches", "rows")


@_query("select 'orders' as name, count(*) as rows, count(*) filter (o_orderkey % 7 = 0) as deleted, count(*) filter (o_orderkey % 7 <> 0) as docs from orders union all select 'events', count(*), 0, count(*) from events")
def index_stats(spark, sf_dir):
    """Documents that were added, deleted, and are there."""
    catalog = _orders(spark, sf_dir)
    added = catalog.segments().where("segment = 0").select(F.col("table").alias("name"), "rows")
    docs = catalog.read("orders").unionByName(catalog.read("events"), allowMissingColumns=True).groupBy(F.col("_index").alias("name")).agg(F.count("*").alias("docs"))
    return added.join(docs, "name").select("name", "rows", (F.col("rows") - F.col("docs")).alias("deleted"), "docs")


@_query("select 'orders' as \"table\", 0 as segment, count(*) as rows, true as searchable from orders union all select 'orders', 1, count(*), true from orders where o_orderkey % 5 = 0 union all select 'orders', 2, count(*), true from orders where o_orderkey % 7 = 0 union all select 'events', 0, count(*), true from events")
def cat_segments(spark, sf_dir):
    return _orders(spark, sf_dir).segments()


@_query(f"select 'orders' as _index, o_orderkey, {_PRICED.split(', case')[0]} from orders where o_orderkey % 7 <> 0")
def snapshot_restore(spark, sf_dir):
    """A table is snapshotted, dropped with what nothing names, and restored under a new key."""
    catalog = _orders(spark, sf_dir)
    catalog.snapshot("s", ["orders"])
    catalog.table("orders").delete(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("_id")), refresh=True)
    catalog.drop("orders")
    catalog.vacuum(0)
    catalog.restore("s", key_arn="arn:aws:kms:r:1:key/b")
    return catalog.read("orders").select("_index", "o_orderkey", "o_totalprice")


@_query("select c_custkey, 1 as ordinal, case when c_custkey % 9 = 0 then 404 else 200 end as status from customer where c_custkey % 4 = 0 union all select c_custkey, 2, 200 from customer where c_custkey % 6 = 0 and c_custkey % 9 <> 0 union all select c_custkey, 2, 404 from customer where c_custkey % 6 = 0 and c_custkey % 9 = 0 union all select c_custkey, 3, case when c_custkey % 9 = 0 or c_custkey % 6 = 0 then 201 else 200 end from customer where c_custkey % 10 = 0 union all select c_custkey, 4, case when c_custkey % 10 = 0 or c_custkey % 9 <> 0 and c_custkey % 6 <> 0 then 200 else 404 end from customer where c_custkey % 12 = 0")
def bulk_results(spark, sf_dir):
    """The result of each action: updates, deletes, index, updates in a row; every ninth customer isn't there at first."""
    keys, _ = _key(spark)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    table = Table.create(spark, os.path.join(scratch(spark), f"customer-{uuid.uuid4().hex}"), keys)
    table.load(customer.where("c_custkey % 9 <> 0"), "c_custkey")
    action = lambda at, kind, cond: customer.where(cond).select(F.lit(at).alias("ordinal"), F.lit(kind).alias("action"), F.col("c_custkey").alias("_id"), F.lit('{"c_acctbal": 1.5}').alias("source"))
    actions = action(1, "update", "c_custkey % 4 = 0").unionAll(action(2, "delete", "c_custkey % 6 = 0")).unionAll(action(3, "index", "c_custkey % 10 = 0")).unionAll(action(4, "update", "c_custkey % 12 = 0"))
    return table.bulk_items(actions).select(F.col("_id").cast("long").alias("c_custkey"), F.col("ordinal").cast("int").alias("ordinal"), "status")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a period by day, over the encrypted events."""
    found = S.where(sealed(spark, sf_dir, "events"), {"bool": {"filter": [{"term": {"event_type": "purchase"}}, {"range": {"value": {"gt": 10}}}]}})
    return aggs.date_histogram(found, "ts", "day", metrics={"total": F.sum("value")})
