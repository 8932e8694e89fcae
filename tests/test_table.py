"""Encrypted tables: writes, versions, copies, secrecy, concurrency."""

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sealframe.crypto.keys import DummyProvider, KeyDirectory
from sealframe.plans.search import Scroll
from sealframe.sources.table import Catalog, Conflict, Missing, Table, count_tables_for_key, watched
from sealframe.streaming.ingest import ingest


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "tables"), KeyDirectory(str(tmp_path / "keys")))


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "_id string, title string, count long")


def test_put_update_delete(spark, catalog):
    t = catalog.create("crud")
    t.upsert(docs(spark, ("1", "a", 100), ("2", "b", 200), ("3", "c", 300)), refresh=True)
    t.update(spark.createDataFrame([("1", 150, True), ("9", 1, True)], "_id string, count long, updated boolean"), refresh=True)
    assert t.get("1") == {"_id": "1", "title": "a", "count": 150, "updated": True}
    t.update(spark.createDataFrame([("2", None)], "_id string, title string"), refresh=True)
    assert t.get("2")["title"] is None and t.get("2")["count"] == 200
    t.delete(docs(spark, ("3", "", 0)), refresh=True)
    with pytest.raises(Missing):
        t.get("3")
    with pytest.raises(Missing):
        t.get("9")
    assert t.live().count() == 2


def test_bulk_is_applied_in_order(spark, catalog):
    t = catalog.create("bulk")
    t.upsert(docs(spark, ("1", "a", 1), ("2", "b", 2), ("3", "c", 3)), refresh=True)
    actions = [(0, "update", "1", '{"count": 10}'), (1, "delete", "2", None), (2, "index", "4", '{"title": "d"}'), (3, "update", "3", '{"status": "merged"}'), (4, "update", "4", '{"count": 4}'), (5, "index", "5", '{"title": "e"}'), (6, "delete", "5", None), (7, "update", "1", '{"title": "z"}')]
    result = t.bulk(spark.createDataFrame(actions, "ordinal int, action string, _id string, source string"), refresh=True)
    assert {(r["_id"], r["result"]) for r in result.collect()} == {("1", "updated"), ("2", "deleted"), ("3", "updated"), ("4", "updated"), ("5", "deleted")}
    got = {r["_id"]: (r["title"], r["count"], r["status"]) for r in t.live().collect()}
    assert got == {"1": ("z", 10, None), "3": ("c", 3, "merged"), "4": ("d", 4, None)}


def test_durable_and_searchable_are_apart(spark, catalog):
    t = catalog.create("refresh")
    t.upsert(docs(spark, ("1", "a", 1)), refresh=True)
    t.upsert(docs(spark, ("2", "b", 2)))
    assert t.live().count() == 1 and t.live(durable=True).count() == 2 and t.stats()["uncommitted"] == 1
    again = Table(spark, t.path, t.keys)  # another reader, after the writer is gone
    again.refresh()
    assert again.live().count() == 2 and again.stats()["uncommitted"] == 0


def test_a_version_stays_as_it_was(spark, catalog):
    t = catalog.create("pit")
    t.upsert(docs(spark, *[(str(i), "x", i) for i in range(5)]), refresh=True)
    frozen = t.version()
    t.upsert(docs(spark, ("5", "y", 5), ("0", "changed", 0)), refresh=True)
    t.delete(docs(spark, ("4", "", 0)), refresh=True)
    assert t.live(frozen).count() == 5 and t.get("0", frozen)["title"] == "x" and t.get("4", frozen)["count"] == 4
    assert t.live().count() == 5 and t.get("0")["title"] == "changed"
    t.compact()
    assert t.live().count() == 5 and t.live(frozen).count() == 5 and t.stats()["batches"] == 1


def test_filters_on_old_values_do_not_bring_them_back(spark, catalog):
    t = catalog.create("old")
    t.upsert(docs(spark, ("1", "before", 1)), refresh=True)
    t.upsert(docs(spark, ("1", "after", 1)), refresh=True)
    assert t.live().where("title = 'before'").count() == 0


def test_nothing_is_readable_on_disk(spark, catalog, tmp_path):
    t = catalog.create("secret")
    t.upsert(docs(spark, ("1", "credit_card 192.168.1.1 /secret/data", 1)), refresh=True)
    for d, _, files in os.walk(t.path):
        for f in files:
            whole = Path(d, f).read_bytes()
            assert b"credit_card" not in whole and b"192.168" not in whole and b"title" not in whole or f.startswith("manifest")
            assert b"credit_card" not in whole
            if f.endswith(".parquet"):
                assert whole[-4:] == b"PARE"
    part = next(Path(t.path).rglob("*.parquet"))
    with pytest.raises(Exception, match="(?i)encrypted|footer|schema"):
        spark.read.parquet(str(part)).collect()
    from sealframe.crypto.parquet import read_options

    other = tmp_path / "other"
    other.mkdir()
    with pytest.raises(Exception, match="(?i)key"):  # no such key
        spark.read.options(**read_options(str(other))).parquet(str(part)).collect()
    for key in Path(catalog.keys.path).glob("*.key"):
        (other / key.name).write_bytes(b"\x01" * 32)  # another key
    with pytest.raises(Exception, match="(?i)key"):
        spark.read.options(**read_options(str(other))).parquet(str(part)).collect()


def test_a_flipped_bit_is_found(spark, catalog):
    t = catalog.create("tamper")
    t.upsert(docs(spark, *[(str(i), f"title {i}", i) for i in range(200)]).coalesce(1), refresh=True)
    part = next(Path(t.path).rglob("*.parquet"))
    whole = bytearray(part.read_bytes())
    whole[len(whole) // 3] ^= 1
    part.write_bytes(whole)
    Path(part.parent, f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)tag|decrypt|GCM|crypto|footer"):
        t.live().collect()


def test_blocks(spark, catalog):
    t = catalog.create("blocked")
    t.upsert(docs(spark, ("1", "a", 1)), refresh=True)
    t.block("write")
    with pytest.raises(PermissionError):
        t.upsert(docs(spark, ("2", "b", 2)))
    assert t.live().count() == 1
    t.block("closed")
    with pytest.raises(PermissionError):
        t.live()
    t.block()
    assert t.live().count() == 1


def test_two_writers(spark, catalog):
    t = catalog.create("race")
    body = t.manifest()
    t._publish(1, body)
    with pytest.raises(Conflict):
        t._publish(1, body)


def test_one_key_of_many_creators(tmp_path):
    keys, keyfile = KeyDirectory(str(tmp_path / "keys")), str(tmp_path / "keyfile")
    with ThreadPoolExecutor(16) as pool:
        found = set(pool.map(lambda _: keys.create(keyfile, {"key_provider": "dummy"}), range(64)))
    assert len(found) == 1


def test_snapshots(spark, catalog):
    for n in ("one", "two"):
        catalog.create(n).upsert(docs(spark, ("1", n, 1), ("2", n, 2)), refresh=True)
    catalog.snapshot("s1")
    catalog.table("one").upsert(docs(spark, ("1", "new", 1), ("3", "new", 3)), refresh=True)
    catalog.snapshot("s2", ["one"])
    assert catalog.restore("s1", ["one"], ("^one$", "old-one")) == ["old-one"]
    assert catalog.restore("s2", rename=("^one$", "newer-one")) == ["newer-one"]
    assert catalog.table("old-one").live().count() == 2 and catalog.table("newer-one").live().count() == 3
    restored = catalog.table("old-one")
    restored.upsert(docs(spark, ("9", "after", 9)), refresh=True)
    assert restored.live().count() == 3 and catalog.table("one").live().count() == 3
    with pytest.raises(Conflict):
        catalog.restore("s1", ["two"])  # not over an existing table
    with pytest.raises(Missing):
        catalog.restore("none")


def test_clone_reindex_and_drop(spark, catalog):
    t = catalog.create("source")
    t.upsert(docs(spark, ("1", "a", 1), ("2", "b", 2)), refresh=True)
    c = t.clone(os.path.join(catalog.root, "copy"))
    assert Path(c._keyfile).read_text() == Path(t._keyfile).read_text() and c.live().count() == 2
    c.compact(shards=2)
    assert c.live().count() == 2 and c.manifest()["settings"]["shards"] == 2
    r = t.reindex(os.path.join(catalog.root, "again"))
    assert Path(r._keyfile).read_text() != Path(t._keyfile).read_text() and {x["_id"] for x in r.live().collect()} == {"1", "2"}
    r.drop()
    assert "again" not in catalog.names()
    with pytest.raises(Missing):
        catalog.table("again")


def test_templates_aliases_rollover(spark, catalog):
    catalog.put_template("logs-*", {"shards": 1, "key_arn": "arn:aws:kms:low"}, 1)
    catalog.put_template("logs-*", {"shards": 2, "key_arn": "arn:aws:kms:high"}, 5)
    t = catalog.create("logs-000001")
    assert t.manifest()["settings"]["shards"] == 2 and t.manifest()["settings"]["key_arn"] == "arn:aws:kms:high"
    catalog.alias("logs", ["logs-000001"], "logs-000001")
    t.upsert(docs(spark, ("1", "a", 1), ("2", "b", 2)), refresh=True)
    assert catalog.rollover("logs", max_docs=3) is None
    assert catalog.rollover("logs", max_docs=2, max_age=1e9) == "logs-000002"
    catalog.table("logs-000002").upsert(docs(spark, ("3", "c", 3)), refresh=True)
    assert {(r["_index"], r["_id"]) for r in catalog.read("logs").collect()} == {("logs-000001", "1"), ("logs-000001", "2"), ("logs-000002", "3")}
    assert count_tables_for_key(catalog.listing(), "arn:aws:kms:high", "dummy").first()["n"] == 2
    with pytest.raises(ValueError):
        count_tables_for_key(catalog.listing(), " ", "dummy")


def test_streams_are_stored_once(spark, catalog, tmp_path):
    t = catalog.create("stream")
    source = tmp_path / "in"
    docs(spark, ("1", "a", 1), ("2", "b", 2)).write.parquet(str(source))
    read = lambda: spark.readStream.schema("_id string, title string, count long").parquet(str(source))
    ingest(read(), t, str(tmp_path / "cp")).awaitTermination()
    assert t.live().count() == 0 and t.live(durable=True).count() == 2
    docs(spark, ("2", "newer", 5), ("3", "c", 3)).write.mode("append").parquet(str(source))
    ingest(read(), t, str(tmp_path / "cp")).awaitTermination()
    t.refresh()
    assert {r["_id"]: r["title"] for r in t.live().collect()} == {"1": "a", "2": "newer", "3": "c"}
    # the same batch again, as after a failure between the write and the stream's commit
    before = t.stats()["batches"]
    t.upsert(docs(spark, ("2", "twice", 0)), tag="ingest-1")
    assert t.stats()["batches"] == before


def test_snapshots_and_clones_outlive_their_source(spark, catalog):
    t = catalog.create("source")
    t.upsert(docs(spark, ("1", "a", 1), ("2", "b", 2), ("3", "c", 3)), refresh=True)
    catalog.snapshot("s")
    copy = t.clone(os.path.join(catalog.root, "copy"))
    t.upsert(docs(spark, ("4", "d", 4)), refresh=True)
    catalog.drop("source")
    assert "source" not in catalog.names() and copy.live().count() == 3
    assert len(catalog.vacuum(0)) == 1  # what was written after the snapshot
    assert copy.live().count() == 3
    assert [tuple(r) for r in catalog.snapshots().collect()] == [("s", "source", 1, 1, 3, "complete")]
    catalog.restore("s", ["source"])
    back = catalog.table("source")
    assert back.live().count() == 3
    back.upsert(docs(spark, ("4", "d", 4)), refresh=True)
    assert back.live().count() == 4 and catalog.vacuum() == []
    catalog.drop("source")
    catalog.drop("copy")
    catalog.delete_snapshot("s")
    catalog.vacuum(0)
    assert list(Path(catalog.root).rglob("*.parquet")) == []
    with pytest.raises(Missing):
        catalog.delete_snapshot("s")


def test_restore_under_another_key(spark, catalog):
    t = catalog.create("old", {"key_arn": "arn:aws:kms:one"})
    t.upsert(docs(spark, ("1", "a", 1)), refresh=True)
    catalog.snapshot("s")
    catalog.restore("s", rename=("old", "new"), key_arn="arn:aws:kms:two")
    new = catalog.table("new")
    new.upsert(docs(spark, ("2", "b", 2)), refresh=True)
    assert {r["_id"] for r in new.live().collect()} == {"1", "2"} and new.manifest()["settings"]["key_arn"] == "arn:aws:kms:two"
    assert Path(new._keyfile).read_text() != Path(t._keyfile).read_text()
    for key in Path(catalog.keys.path).glob("*.key"):
        key.unlink()  # the keys of both are put in place again
    assert catalog.table("new").live().count() == 2


def test_a_batch_of_another_type_is_refused(spark, catalog):
    t = catalog.create("typed")
    t.upsert(docs(spark, ("1", "a", 1)), refresh=True)
    with pytest.raises(ValueError, match="count is bigint, not double"):
        t.upsert(spark.createDataFrame([("2", 2.5)], "_id string, count double"), refresh=True)
    t.upsert(spark.createDataFrame([("2", 7)], "_id string, count int"), refresh=True)
    assert {r["_id"]: r["count"] for r in t.live().collect()} == {"1": 1, "2": 7}


def test_no_update_is_lost(spark, catalog, monkeypatch):
    t = catalog.create("lost")
    t.upsert(docs(spark, ("1", "a", 1)), refresh=True)
    other, plain, tries = Table(spark, t.path, t.keys), Table.upsert, []

    def late(self, *args, **options):
        tries.append(1)
        if len(tries) == 1:  # another writer comes between this one's reading and its writing
            other.update(spark.createDataFrame([("1", "theirs")], "_id string, title string"), refresh=True)
        plain(self, *args, **options)

    monkeypatch.setattr(Table, "upsert", late)
    t.update(spark.createDataFrame([("1", 99)], "_id string, count long"), refresh=True)
    assert t.get("1") == {"_id": "1", "title": "theirs", "count": 99}


def test_rows_of_one_id_need_an_order(spark, catalog):
    t = catalog.create("order")
    twice = spark.createDataFrame([("1", "first", 1), ("1", "last", 2), ("2", "b", 1)], "_id string, title string, count long")
    with pytest.raises(ValueError, match="more than once"):
        t.upsert(twice, refresh=True)
    assert t.live(durable=True).count() == 0
    t.upsert(twice, order="count", refresh=True)
    assert t.get("1")["title"] == "last" and t.live().count() == 2


def test_bulk_of_what_is_not_there_and_of_nested_columns(spark, catalog):
    t = catalog.create("nested")
    t.upsert(spark.createDataFrame([("1", {"a": 1}, [1, 2], ("x",))], "_id string, m map<string,int>, l array<int>, s struct<k:string>"), refresh=True)
    actions = [(0, "update", "1", '{"l": [3]}'), (1, "update", "9", '{"l": [3]}'), (2, "delete", "8", None), (3, "index", "7", '{"m": {"b": 2}}'), (4, "delete", "7", None), (5, "update", "7", '{"l": [1]}')]
    rows = spark.createDataFrame(actions, "ordinal int, action string, _id string, source string")
    items = [tuple(r) for r in t.bulk_items(rows).orderBy("ordinal").select("_id", "status", "result").collect()]
    assert items == [("1", 200, "updated"), ("9", 404, "missing"), ("8", 404, "missing"), ("7", 201, "created"), ("7", 200, "deleted"), ("7", 404, "missing")]
    assert {(r["_id"], r["result"]) for r in t.bulk(rows, refresh=True).collect()} == {("1", "updated"), ("9", "missing"), ("8", "missing"), ("7", "missing")}
    assert [r.asDict(recursive=True) for r in t.live().collect()] == [{"_id": "1", "m": {"a": 1}, "l": [3], "s": {"k": "x"}}]


def test_changes_are_read_without_moving_the_base(spark, catalog):
    t = catalog.create("plan")
    t.load(spark.range(2000).selectExpr("id", "id as a", "id as b", "id as c"), "id")
    t.update(spark.createDataFrame([("5", -1)], "_id string, a long"), refresh=True)
    found = t.live().select("a")
    assert found.agg({"a": "min"}).first()[0] == -1 and found.count() == 2000
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "ReadSchema" in x]
    assert all("b:bigint" not in x and "c:bigint" not in x for x in scans) and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning(_id" in plan  # the changes alone
    assert plan.index("LeftAnti") < plan.index("hashpartitioning(_id")


def test_a_lost_key_blocks_writes_then_reads(spark, tmp_path):
    lost, now = [], [0.0]

    class Service(DummyProvider):
        def unwrap(self, wrapped, context):
            if lost:
                raise PermissionError("key disabled")
            return super().unwrap(wrapped, context)

    keys = KeyDirectory(str(tmp_path / "keys"), {"dummy": Service()})
    health = watched(keys, ttl=100)
    health.clock = health.cache.clock = lambda: now[0]
    catalog = Catalog(spark, str(tmp_path / "tables"), keys, health)
    t = catalog.create("t")
    t.upsert(docs(spark, ("1", "a", 1)), refresh=True)
    lost.append(1)
    assert [health.check(x) for x in catalog.paths()] == ["critical"] and t.live().count() == 1  # the held key still serves
    now[0] = 200.0
    health.failures.clear()
    assert health.check(t.path) == "critical"
    with pytest.raises(PermissionError, match="its key is lost"):
        t.upsert(docs(spark, ("2", "b", 2)))
    assert health.may_read(t.path)
    now[0] = 211.0
    with pytest.raises(PermissionError, match="its key is lost"):
        t.live()
    lost.clear()
    assert health.check(t.path) == "healthy" and t.live().count() == 1
    t.upsert(docs(spark, ("2", "b", 2)), refresh=True)
    assert t.live().count() == 2
    seen, stop = [], None
    health.check = lambda x: seen.append(x) or stop.set()
    stop = health.watch(catalog.paths, 0.01, 0.0)
    assert stop.wait(10) and seen[0] == t.path


def test_components_and_write_aliases(spark, catalog):
    catalog.put_component("base", {"shards": 3, "key_arn": "arn:aws:kms:low"}, StructType([StructField("count", LongType())]))
    catalog.put_template("logs-*", {"key_arn": "arn:aws:kms:high"}, 1, StructType([StructField("title", StringType())]), ["base"])
    t = catalog.create("logs-1")
    assert t.manifest()["settings"]["shards"] == 3 and t.manifest()["settings"]["key_arn"] == "arn:aws:kms:high"
    assert [(r["column"], r["type"]) for r in catalog.mappings().collect()] == [("count", "bigint"), ("title", "string")]
    catalog.create("logs-2")
    catalog.alias("logs", ["logs-1", "logs-2"])
    with pytest.raises(ValueError, match="none to write to"):
        catalog.writer("logs")
    catalog.alias("logs", ["logs-1", "logs-2"], "logs-2")
    catalog.writer("logs").upsert(docs(spark, ("1", "a", 1)), refresh=True)
    assert [r["_index"] for r in catalog.read("logs").collect()] == ["logs-2"]
    t.block("write")
    with pytest.raises(PermissionError):
        t.compact()


def test_versions_expire(spark, catalog):
    t = catalog.create("old")
    for k in range(3):
        t.upsert(docs(spark, ("1", "a", k)), refresh=True)
    t.compact()
    t.expire()
    assert len(catalog.vacuum(0)) == 3 and t.get("1")["count"] == 2


def test_scrolls_are_frozen_and_end(spark, catalog, tmp_path):
    t, now = catalog.create("scroll"), [0.0]
    t.upsert(docs(spark, *[(str(i), "x", i) for i in range(8)]), refresh=True)
    scroll = Scroll(t.live(t.version()), "count", 3, 60, lambda: now[0])
    first = scroll.page(str(tmp_path / "0"))
    t.upsert(docs(spark, ("8", "x", 8), ("9", "x", 9)), refresh=True)
    now[0] = 50.0
    sizes = [first.count(), *(scroll.page(str(tmp_path / str(k))).count() for k in (1, 2))]
    assert sizes == [3, 3, 2] and scroll.page(str(tmp_path / "3")) is None and t.live().count() == 10
    now[0] = 111.0
    with pytest.raises(LookupError):
        scroll.page(str(tmp_path / "4"))
    other = Scroll(t.live(), "count", 3)
    other.clear()
    with pytest.raises(LookupError):
        other.page(str(tmp_path / "5"))
