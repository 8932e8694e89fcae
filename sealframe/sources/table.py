"""Encrypted tables of documents: versions, updates, views, snapshots, copies, aliases.

A table is a directory: `keyfile`, encrypted Parquet batches under `data/`, and manifests `manifest-N.json` that list the
batches of version N. Batches are immutable; a version is published by creating its manifest exclusively, so of two
writers one fails and tries again. Manifests hold paths, counts and settings, no document. Snapshots and clones name the
same batches, so dropping a table removes its manifests alone; vacuum() removes the batches that nothing names.

A batch has `_id`, `_seq_no` and `_deleted` beside the document's columns. A document's newest row counts. The first
`base` batches of a version hold each id once; only rows of later ones, and base rows with their ids, are looked at again.

Local paths and mounted shared folders are served; keys are named by id everywhere and lie in the key directory.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, LongType, MapType, StringType, StructField, StructType

from sealframe.crypto.keys import Health, KeyCache, KeyDirectory, merge_context
from sealframe.crypto.parquet import enable, read_options, write_options

_OWN = [StructField("_id", StringType()), StructField("_seq_no", LongType()), StructField("_deleted", BooleanType())]


#: Rows of changed ids up to which they are broadcast to the base; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000

#: Types that a column of another type takes without loss, by the column's type.
_WIDER = {"bigint": ("int", "smallint", "tinyint"), "int": ("smallint", "tinyint"), "double": ("float", "int", "smallint", "tinyint")}


class Conflict(RuntimeError):
    """Another writer published this version first."""


class Missing(LookupError):
    """No such table, document, snapshot or version."""


def _versions(path: str) -> list[int]:
    return [int(m[1]) for x in (os.listdir(path) if os.path.isdir(path) else []) if (m := re.fullmatch(r"manifest-(\d+)\.json", x))]


def _key_settings(settings: Mapping[str, Any]) -> dict[str, str]:
    return {k: str(v) for k, v in settings.items() if k in ("key_provider", "key_arn", "encryption_context")}


def open_keys(keys: KeyDirectory, path: str) -> str:
    """Put all keys of a table in place, older ones too; the id of the one that writes use."""
    for x in sorted(os.listdir(path)):
        if re.fullmatch(r"keyfile-old-\d+", x):
            keys.open(os.path.join(path, x))
    return keys.open(os.path.join(path, "keyfile"))


def watched(keys: KeyDirectory, ttl: float = 86_400, grace: float = 10.0) -> Health:
    """A health whose cache opens tables' keys, by the tables' paths."""
    return Health(KeyCache(lambda path: open_keys(keys, path), ttl), grace)


def _nested(kind: DataType) -> bool:
    return isinstance(kind, (StructType, ArrayType, MapType))


def _fitting(field: StructField, kind: DataType) -> DataType:
    """The table's type for a field that it has; ValueError if values could be lost."""
    given = field.dataType.simpleString()
    if given not in (kind.simpleString(), "void", *_WIDER.get(kind.simpleString(), ())):
        raise ValueError(f"{field.name} is {kind.simpleString()}, not {given}")
    return kind


def _seen(tags: Mapping[str, int], tag: str) -> bool:
    """Whether a batch of this tag, or a later one of its stream ("name-number"), has been stored."""
    name, _, number = tag.rpartition("-")
    return int(number) <= tags.get(name, -1) if name and number.isdecimal() else tag in tags


def _tagged(tags: Mapping[str, int], tag: str | None) -> dict[str, int]:
    name, _, number = (tag or "").rpartition("-")
    return dict(tags) | ({name: int(number)} if name and number.isdecimal() else {tag: 0} if tag else {})


@dataclass
class Table:
    """A table by its directory. Writes become durable at once and searchable at refresh()."""

    spark: SparkSession
    path: str
    keys: KeyDirectory
    health: Health | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, keys: KeyDirectory, settings: Mapping[str, Any] | None = None, schema: StructType | None = None, health: Health | None = None) -> Table:
        """A new empty table with its own key. settings: key_provider, key_arn, encryption_context, shards, ..."""
        if _versions(path):
            raise FileExistsError(path)
        settings = {"key_provider": "dummy", "shards": 1} | dict(settings or {})
        settings["encryption_context"] = ",".join(f"{k}={v}" for k, v in merge_context(settings.pop("default_context", None), settings.get("encryption_context")).items())
        os.makedirs(path, exist_ok=True)
        table = cls(spark, path, keys, health)
        keys.create(table._keyfile, _key_settings(settings))
        table._publish(0, {"settings": settings, "schema": (schema or StructType([])).jsonValue(), "batches": [], "seq": 0, "searchable": 0, "base": 0, "blocks": [], "uuid": uuid.uuid4().hex})
        return table

    @property
    def _keyfile(self) -> str:
        return os.path.join(self.path, "keyfile")

    def _key(self) -> str:
        """The id of the table's key, held by the health's cache if there is one; keys of before a restore are put in place too."""
        return self.health.cache.get(self.path) if self.health else open_keys(self.keys, self.path)

    # versions

    def version(self) -> int:
        """The newest version."""
        found = _versions(self.path)
        if not found:
            raise Missing(self.path)
        return max(found)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        try:
            with open(os.path.join(self.path, f"manifest-{self.version() if version is None else version}.json")) as f:
                return json.load(f)
        except FileNotFoundError as e:
            raise Missing(f"{self.path} has no version {version}") from e

    def _publish(self, version: int, body: dict[str, Any]) -> None:
        part = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(part, "w") as f:
            json.dump(body, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, os.path.join(self.path, f"manifest-{version}.json"))
        except FileExistsError as e:
            raise Conflict(f"version {version} of {self.path}") from e
        finally:
            os.unlink(part)

    def _change(self, edit, tries: int = 20) -> dict[str, Any]:
        for k in range(tries):
            version = self.version()
            body = edit(self.manifest(version))
            try:
                self._publish(version + 1, body)
                return body
            except Conflict:
                if k == tries - 1:
                    raise
                time.sleep(0.01 * 2 ** min(k, 6))
        raise AssertionError

    def block(self, *kinds: str) -> None:
        """Set the table's blocks ("write", "read", "closed"); none lifts all."""
        self._change(lambda m: m | {"blocks": list(kinds)})

    def _allow(self, *kinds: str) -> dict[str, Any]:
        body = self.manifest()
        if held := [x for x in (*kinds, "closed") if x in body["blocks"]]:
            raise PermissionError(f"{self.path} is blocked: {', '.join(held)}")
        if self.health and ("write" in kinds and not self.health.may_write(self.path) or "read" in kinds and not self.health.may_read(self.path)):
            raise PermissionError(f"{self.path} is blocked: its key is lost")
        return body

    # writes

    def _store(self, rows: DataFrame, shards: int | None = None) -> tuple[str, int, int | None]:
        """Write a batch: its path, its rows and its highest number."""
        enable(self.spark)
        path, seen = os.path.join(self.path, f"data/{uuid.uuid4().hex}"), Observation()
        rows = rows.repartition(shards, "_id") if shards and shards > 1 else rows
        counted = rows.observe(seen, F.count("*").alias("n"), F.max("_seq_no").alias("top"))
        counted.write.options(**write_options(self.keys.path, self._key())).parquet(path)
        return path, seen.get["n"], seen.get["top"]

    def _append(self, rows: DataFrame, fields: list[StructField], refresh: bool, tag: str | None = None, distinct: bool = False, once: bool = False, seq: int | None = None, tries: int = 10) -> None:
        """rows: _id, _deleted, _order (within the batch) and documents' columns.

        distinct: ids are new. once: an id that occurs twice is an error. seq: the table's number that the rows were made
        from; another writer's batch since then is a Conflict. Without it the batch is numbered and stored anew.
        """
        body = self._allow("write")
        if seq is not None and body["seq"] != seq:
            raise Conflict(self.path)
        have = {f["name"]: f for f in body["schema"]["fields"]}
        fields = [StructField(f.name, _fitting(f, StructType.fromJson({"type": "struct", "fields": [have[f.name]]})[f.name].dataType) if f.name in have else f.dataType) for f in fields]
        start = body["seq"]
        # numbers go up within a batch by _order; later batches start above all of them
        stored = rows.withColumn("_seq_no", F.lit(start) + F.col("_order") + 1)
        path, n, top = self._store(stored.select("_id", "_seq_no", "_deleted", *[F.col(f.name).cast(f.dataType) for f in fields]))
        if once and not self.spark.read.options(**read_options(self.keys.path)).parquet(path).groupBy("_id").count().where("count > 1").isEmpty():
            raise ValueError("an id occurs more than once; say which column orders its rows")

        def edit(m: dict[str, Any]) -> dict[str, Any]:
            if tag is not None and _seen(m.get("tags", {}), tag):
                return m
            if m["seq"] != start:
                raise Conflict(self.path)  # numbers were given to another batch
            schema = {f.name: f for f in StructType.fromJson(m["schema"]).fields}
            schema |= {f.name: f for f in fields if f.name not in schema}
            batches = [*m["batches"], {"path": path, "rows": n, "columns": [f.name for f in fields]}]
            base = len(batches) if distinct and m["base"] == len(m["batches"]) == 0 else m["base"]
            return m | {"batches": batches, "schema": StructType(list(schema.values())).jsonValue(), "seq": top or start, "base": base, "searchable": len(batches) if refresh else m["searchable"], "tags": _tagged(m.get("tags", {}), tag)}

        if tag is not None and _seen(body.get("tags", {}), tag):
            return
        try:
            self._change(edit)
        except Conflict:
            if seq is not None or not tries:
                raise
            self._append(rows, fields, refresh, tag, distinct, once, None, tries - 1)

    def load(self, docs: DataFrame, id_column: str, refresh: bool = True) -> None:
        """Add documents whose ids are new and occur once (not checked): the table is then read without a search for newer rows."""
        fields = [f for f in docs.schema.fields if not f.name.startswith("_")]
        self._append(docs.select(F.col(id_column).cast("string").alias("_id"), F.lit(False).alias("_deleted"), F.lit(0).cast("long").alias("_order"), *[f.name for f in fields]), fields, refresh, distinct=True)

    def upsert(self, docs: DataFrame, id_column: str = "_id", order: str | None = None, refresh: bool = False, tag: str | None = None, seq: int | None = None) -> None:
        """Add or replace documents; of several rows of an id the one of the highest `order` counts, without it they are an error.

        Columns that the table has are brought to its types where nothing is lost, else the batch is refused.
        """
        fields = [f for f in docs.schema.fields if not f.name.startswith("_")]
        at = F.col(order).cast("long") if order else F.lit(0).cast("long")
        rows = docs.select(F.col(id_column).cast("string").alias("_id"), F.lit(False).alias("_deleted"), at.alias("_order"), *[f.name for f in fields])
        self._append(rows, fields, refresh, tag, once=order is None, seq=seq)

    def delete(self, ids: DataFrame, id_column: str = "_id", refresh: bool = False) -> None:
        """Drop documents by id; ids without a document are ignored, and those that occur twice are one."""
        self._append(ids.select(F.col(id_column).cast("string").alias("_id")).distinct().select("_id", F.lit(True).alias("_deleted"), F.lit(0).cast("long").alias("_order")), [], refresh)

    def _again(self, write, tries: int = 10):
        """write(seq) until no other writer comes between its reading and its writing."""
        for k in range(tries):
            try:
                return write(self.manifest()["seq"])
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    def update(self, patch: DataFrame, id_column: str = "_id", refresh: bool = False) -> None:
        """Set the patch's columns of existing documents (to null as well) and keep the others; new columns extend the table."""
        names = [c for c in patch.columns if c != id_column and not c.startswith("_")]

        def write(seq: int) -> None:
            old = self.live(durable=True).withColumnRenamed("_id", "__id")
            kept = [c for c in old.columns if c not in (*names, "__id")]
            joined = old.select("__id", *kept).join(patch.select(F.col(id_column).cast("string").alias("_id"), *names), F.col("__id") == F.col("_id")).drop("__id")
            self.upsert(joined, refresh=refresh, seq=seq)

        self._again(write)

    def bulk(self, actions: DataFrame, refresh: bool = False) -> DataFrame:
        """Apply actions (ordinal, action, _id, source as JSON) in order; returns _id and the last result of each.

        index replaces, update merges fields into what is there, delete removes; an update or delete of what isn't there
        is "missing" and changes nothing. What counts of an id is its last index or delete and, field by field, the last
        update after an index, so a hot id is aggregated, not gathered. bulk_items() tells the result of each action.
        """
        return self._again(lambda seq: self._bulk(actions, refresh, seq))

    def _bulk(self, actions: DataFrame, refresh: bool, seq: int) -> DataFrame:
        schema = StructType.fromJson(self.manifest()["schema"])
        parsed = actions.select(F.col("ordinal").cast("long").alias("ordinal"), "action", F.col("_id").cast("string").alias("_id"), F.from_json("source", "map<string,string>").alias("fields"))
        last = parsed.groupBy("_id").agg(F.max(F.when(F.col("action") != "update", F.struct("ordinal", "action"))).alias("reset"), F.max_by("action", "ordinal").alias("result"), F.max(F.col("action") == "index").alias("made"))
        old = self.live(durable=True)
        there = old.select("_id").join(last.select("_id"), "_id", "left_semi").withColumn("there", F.lit(True))
        last = last.join(there, "_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))
        known = F.array(*(F.struct(F.lit(f.name).alias("key"), F.lit(-1).cast("long").alias("ordinal"), (F.to_json(f.name) if _nested(f.dataType) else F.col(f.name).cast("string")).alias("value")) for f in schema.fields)) if schema.fields else F.array().cast("array<struct<key:string,ordinal:long,value:string>>")
        was = old.join(last.select("_id"), "_id", "left_semi").select("_id", F.explode(known).alias("f")).select("_id", "f.*")
        said = parsed.select("_id", "ordinal", F.explode("fields").alias("key", "value")).select("_id", "key", "ordinal", "value")
        both = was.unionByName(said).join(last, "_id")
        both = both.where(F.when(F.col("reset").isNull(), F.col("there")).otherwise((F.col("reset.action") == "index") & (F.col("ordinal") >= F.col("reset.ordinal"))))
        merged = both.groupBy("_id", "key").agg(F.max_by("value", "ordinal").alias("value")).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))
        # new fields come from the batch itself, as strings unless the table's schema names them
        new = [r[0] for r in said.select("key").distinct().limit(1001).collect() if r[0] not in schema.names]
        if len(new) > 1000:
            raise ValueError("a bulk request adds more than 1000 fields")
        fields = [*schema.fields, *(StructField(n, StringType()) for n in sorted(new))]
        value = lambda f: F.from_json(F.try_element_at("fields", F.lit(f.name)), f.dataType.simpleString()) if _nested(f.dataType) else F.try_element_at("fields", F.lit(f.name)).cast(f.dataType)
        alive = merged.select("_id", F.lit(False).alias("_deleted"), F.lit(0).cast("long").alias("_order"), *(value(f).alias(f.name) for f in fields))
        gone = last.where("reset.action = 'delete' and there").select("_id", F.lit(True).alias("_deleted"), F.lit(0).cast("long").alias("_order"))
        results = last.select("_id", F.when(F.col("result") == "delete", F.when(F.col("there") | F.col("made"), "deleted").otherwise("missing")).when(F.col("result") == "index", "indexed").when(F.coalesce(F.col("reset.action") == "index", F.col("there")), "updated").otherwise("missing").alias("result"))
        self._append(alive.unionByName(gone, allowMissingColumns=True), fields, refresh, seq=seq)
        return results

    def bulk_items(self, actions: DataFrame, version: int | None = None) -> DataFrame:
        """ordinal, action, _id, status, result of each action of a request on top of a version, the newest by default.

        status: 201 for a new document, 200 for a changed one, 404 for an update or delete of what isn't there. Asked
        before bulk(), or with the version of before it. An id's actions within the request are put in order.
        """
        parsed = actions.select(F.col("ordinal").cast("long").alias("ordinal"), "action", F.col("_id").cast("string").alias("_id"))
        old = self.live(version, durable=True).select(F.col("_id").alias("__id"))
        before = Window.partitionBy("_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
        previous = F.last(F.when(F.col("action") != "update", F.col("action")), ignorenulls=True).over(before)
        out = parsed.join(old, F.col("_id") == F.col("__id"), "left").withColumn("there", F.coalesce(previous == "index", F.col("__id").isNotNull()))
        result = F.when(F.col("action") == "index", F.when(F.col("there"), "updated").otherwise("created")).when(~F.col("there"), "missing").when(F.col("action") == "delete", "deleted").otherwise("updated")
        return out.withColumn("result", result).select("ordinal", "action", "_id", F.when(F.col("result") == "created", 201).when(F.col("result") == "missing", 404).otherwise(200).alias("status"), "result")

    def refresh(self) -> int:
        """Make all durable writes searchable; returns the version."""
        self._change(lambda m: m | {"searchable": len(m["batches"])})
        return self.version()

    def compact(self, shards: int | None = None) -> None:
        """Rewrite the live documents as one batch without old rows; older versions stay readable."""
        before = self._allow("write")
        live = self.live(durable=True)
        path, n, _ = self._store(live.select("_id", F.lit(before["seq"]).cast("long").alias("_seq_no"), F.lit(False).alias("_deleted"), *[c for c in live.columns if c != "_id"]), shards)
        batch = {"path": path, "rows": n, "columns": [c for c in live.columns if c != "_id"]}

        def edit(m: dict[str, Any]) -> dict[str, Any]:
            if m["seq"] != before["seq"]:
                raise Conflict(self.path)
            settings = m["settings"] | ({"shards": shards} if shards else {})
            return m | {"batches": [batch], "base": 1, "searchable": 1, "settings": settings}

        self._change(edit)

    def expire(self, keep: int = 1) -> None:
        """Forget all but the newest versions; vacuum() then removes batches that only they named."""
        for v in sorted(_versions(self.path))[:-keep]:
            os.remove(os.path.join(self.path, f"manifest-{v}.json"))

    # reads

    def live(self, version: int | None = None, durable: bool = False) -> DataFrame:
        """_id and the documents of a version, by default the newest; durable: with writes that aren't searchable yet.

        The base is read without the ids that later batches name, and of those the newest row of each id is added. So few
        changes to a large table move few rows, columns that aren't asked for are not read, and filters reach the base's scan.
        """
        body = self._allow("read") if version is None else self.manifest(version)
        schema = StructType.fromJson(body["schema"])
        batches = body["batches"][: None if durable else body["searchable"]]
        whole = StructType([*_OWN, *schema.fields])
        if not batches:
            return self.spark.createDataFrame([], whole).drop("_seq_no", "_deleted")
        enable(self.spark)
        self._key()
        # one scan of the base and one of the changes; columns that a batch lacks are null
        read = lambda some: self.spark.read.options(**read_options(self.keys.path)).schema(whole).parquet(*[b["path"] for b in some])
        first, later = batches[: body["base"]], batches[body["base"] :]
        base = read(first).drop("_seq_no", "_deleted") if first else None
        if not later:
            return base
        changes = read(later)
        newest = changes.groupBy("_id").agg(*(F.max_by(c, "_seq_no").alias(c) for c in ("_deleted", *schema.names)))
        newest = newest.where("not _deleted").drop("_deleted")
        if base is None:
            return newest
        ids = changes.select(F.col("_id").alias("__changed"))
        ids = F.broadcast(ids) if sum(b["rows"] for b in later) <= BROADCAST_ROWS else ids
        return base.join(ids, F.col("_id") == F.col("__changed"), "left_anti").unionByName(newest)

    def get(self, doc_id: str, version: int | None = None) -> dict[str, Any]:
        found = self.live(version).where(F.col("_id") == doc_id).head(1)
        if not found:
            raise Missing(doc_id)
        return found[0].asDict(recursive=True)

    def stats(self) -> dict[str, Any]:
        """Counts from the manifest: batches, rows stored, durable and searchable batches."""
        body = self.manifest()
        return {"version": self.version(), "batches": len(body["batches"]), "searchable": body["searchable"], "uncommitted": len(body["batches"]) - body["searchable"], "rows": sum(b["rows"] for b in body["batches"])}

    # copies

    def clone(self, path: str) -> Table:
        """A table of the same files and keys under another path; existing key files are not overwritten."""
        os.makedirs(path, exist_ok=True)
        target = Table(self.spark, path, self.keys, self.health)
        for x in os.listdir(self.path):
            if re.fullmatch(r"keyfile(-old-\d+)?", x) and not os.path.exists(os.path.join(path, x)):
                shutil.copyfile(os.path.join(self.path, x), os.path.join(path, x))
        if not os.path.exists(target._keyfile):
            warnings.warn(f"{self.path} has no key file; {path} gets a key of its own", stacklevel=2)
            self.keys.create(target._keyfile, _key_settings(self.manifest()["settings"]))
        target._publish(0, self.manifest() | {"uuid": uuid.uuid4().hex, "blocks": []})
        return target

    def reindex(self, path: str, settings: Mapping[str, Any] | None = None) -> Table:
        """A new table with a key of its own and this one's live documents."""
        target = Table.create(self.spark, path, self.keys, settings, health=self.health)
        target.load(self.live().withColumn("__id", F.col("_id")).drop("_id").withColumnRenamed("__id", "_source_id"), "_source_id")
        return target

    def drop(self) -> None:
        """Remove the table; its batches stay until vacuum(), as snapshots and clones may name them."""
        for v in sorted(_versions(self.path)):
            os.remove(os.path.join(self.path, f"manifest-{v}.json"))
        for x in os.listdir(self.path):
            if x.startswith("keyfile"):
                os.remove(os.path.join(self.path, x))
        if self.health:
            self.health.cache.invalidate(self.path)


@dataclass
class Catalog:
    """Tables under one directory, with aliases, templates and snapshots.

    health: opens the tables' keys through its cache and blocks tables whose key is lost (watched()); health.watch(catalog.paths)
    looks at them regularly.
    """

    spark: SparkSession
    root: str
    keys: KeyDirectory
    health: Health | None = None

    def _state(self) -> dict[str, Any]:
        try:
            with open(os.path.join(self.root, "catalog.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"aliases": {}, "templates": []}

    def _save(self, state: dict[str, Any]) -> None:
        os.makedirs(self.root, exist_ok=True)
        part = os.path.join(self.root, f".{uuid.uuid4().hex}")
        with open(part, "w") as f:
            json.dump(state, f)
        os.replace(part, os.path.join(self.root, "catalog.json"))

    def names(self) -> list[str]:
        return sorted(x for x in os.listdir(self.root) if _versions(os.path.join(self.root, x))) if os.path.isdir(self.root) else []

    def paths(self) -> list[str]:
        """The tables' paths, which are their keys' names in a health."""
        return [os.path.join(self.root, x) for x in self.names()]

    def table(self, name: str) -> Table:
        if name not in self.names():
            raise Missing(name)
        return Table(self.spark, os.path.join(self.root, name), self.keys, self.health)

    def put_component(self, name: str, settings: Mapping[str, Any] | None = None, schema: StructType | None = None) -> None:
        """A part that templates are composed of."""
        state = self._state()
        self._save(state | {"components": state.get("components", {}) | {name: {"settings": dict(settings or {}), "schema": (schema or StructType([])).jsonValue()}}})

    def put_template(self, pattern: str, settings: Mapping[str, Any], priority: int = 0, schema: StructType | None = None, components: Iterable[str] = ()) -> None:
        state = self._state()
        self._save(state | {"templates": [*state["templates"], {"pattern": pattern, "settings": dict(settings), "priority": priority, "schema": (schema or StructType([])).jsonValue(), "components": list(components)}]})

    def create(self, name: str, settings: Mapping[str, Any] | None = None, schema: StructType | None = None) -> Table:
        """A table with the settings and columns of the matching templates, higher priorities over lower, and its own over all.

        A template's own settings and columns go over its components', later components over earlier ones.
        """
        merged, columns, state = {}, {}, self._state()
        for t in sorted(state["templates"], key=lambda t: t["priority"]):
            if re.fullmatch(re.escape(t["pattern"]).replace(r"\*", ".*"), name):
                for part in (*(state.get("components", {})[c] for c in t.get("components", [])), t):
                    merged |= part["settings"]
                    columns |= {f.name: f for f in StructType.fromJson(part.get("schema", {"type": "struct", "fields": []})).fields}
        columns |= {f.name: f for f in (schema or StructType([])).fields}
        return Table.create(self.spark, os.path.join(self.root, name), self.keys, merged | dict(settings or {}), StructType(list(columns.values())), self.health)

    def alias(self, name: str, tables: Iterable[str], write: str | None = None) -> None:
        state = self._state()
        self._save(state | {"aliases": state["aliases"] | {name: {"tables": list(tables), "write": write}}})

    def writer(self, name: str) -> Table:
        """The table that writes to a name go to: the table itself, or an alias' write table or only member."""
        alias = self._state()["aliases"].get(name)
        if alias is None:
            return self.table(name)
        target = alias["write"] or (alias["tables"][0] if len(alias["tables"]) == 1 else None)
        if target is None:
            raise ValueError(f"{name} has several tables and none to write to")
        return self.table(target)

    def read(self, name: str) -> DataFrame:
        """A table's or an alias' documents with _index, the table's name."""
        members = self._state()["aliases"].get(name, {"tables": [name]})["tables"]
        out: DataFrame | None = None
        for m in members:
            part = self.table(m).live().withColumn("_index", F.lit(m))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise Missing(name)
        return out

    def rollover(self, alias: str, max_docs: int | None = None, max_age: float | None = None, max_bytes: int | None = None) -> str | None:
        """A new table behind the alias if any condition holds, or None. Names end with a number that goes up."""
        members = self._state()["aliases"][alias]
        current = members["write"] or members["tables"][-1]
        table = self.table(current)
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(table.path) for f in files)
        age = time.time() - os.path.getmtime(os.path.join(table.path, f"manifest-{min(_versions(table.path))}.json"))
        docs = table.live(durable=True).count() if max_docs is not None else 0
        if not any(limit is not None and now >= limit for now, limit in ((docs, max_docs), (age, max_age), (size, max_bytes))):
            return None
        stem, _, number = current.rpartition("-")
        new = f"{stem}-{int(number) + 1:0{len(number)}d}"
        self.create(new)
        self.alias(alias, [*members["tables"], new], new)
        return new

    def snapshot(self, name: str, tables: Iterable[str] | None = None) -> dict[str, int]:
        """Name the tables' newest versions; files are shared, nothing is copied."""
        held = {t: self.table(t).version() for t in tables or self.names()}
        os.makedirs(os.path.join(self.root, "_snapshots"), exist_ok=True)
        keyfiles = lambda path: {x: Path(path, x).read_text() for x in os.listdir(path) if re.fullmatch(r"keyfile(-old-\d+)?", x)}
        with open(os.path.join(self.root, "_snapshots", f"{name}.json"), "x") as f:
            json.dump({t: {"version": v, "manifest": self.table(t).manifest(v), "keyfiles": keyfiles(self.table(t).path)} for t, v in held.items()}, f)
        return held

    def _snapshot(self, name: str) -> dict[str, Any]:
        try:
            with open(os.path.join(self.root, "_snapshots", f"{name}.json")) as f:
                return json.load(f)
        except FileNotFoundError as e:
            raise Missing(name) from e

    def snapshots(self) -> DataFrame:
        """snapshot, table, version, batches, rows, state of all snapshots: complete if all batches are there."""
        top = os.path.join(self.root, "_snapshots")
        rows = []
        for x in sorted(os.listdir(top)) if os.path.isdir(top) else []:
            for t, held in self._snapshot(x.removesuffix(".json")).items():
                batches = held["manifest"]["batches"]
                rows.append((x.removesuffix(".json"), t, held["version"], len(batches), sum(b["rows"] for b in batches), "complete" if all(os.path.isdir(b["path"]) for b in batches) else "damaged"))
        return self.spark.createDataFrame(rows, "snapshot string, table string, version int, batches int, rows long, state string")

    def delete_snapshot(self, name: str) -> None:
        """Forget a snapshot; batches that only it named go with the next vacuum()."""
        self._snapshot(name)
        os.remove(os.path.join(self.root, "_snapshots", f"{name}.json"))

    def restore(self, name: str, tables: Iterable[str] | None = None, rename: tuple[str, str] | None = None, key_arn: str | None = None) -> list[str]:
        """Bring snapshot tables back, all or some, by their own or renamed names; existing ones are not overwritten.

        key_arn: what is written from now on goes under a new key of this name; what is there stays under its own.
        """
        held, made = self._snapshot(name), []
        for t in tables or held:
            target = Table(self.spark, os.path.join(self.root, re.sub(*rename, t) if rename else t), self.keys, self.health)
            if _versions(target.path):
                raise Conflict(f"{target.path} exists")
            os.makedirs(target.path, exist_ok=True)
            body, keyfiles = held[t]["manifest"], dict(held[t]["keyfiles"])
            if key_arn is not None:
                keyfiles[f"keyfile-old-{len(keyfiles)}"] = keyfiles.pop("keyfile")
                body = body | {"settings": body["settings"] | {"key_arn": key_arn}}
            for x, content in keyfiles.items():
                Path(target.path, x).write_text(content)
            if key_arn is not None:
                self.keys.create(target._keyfile, _key_settings(body["settings"]))
            target._publish(0, body)
            made.append(os.path.basename(target.path))
        return made

    def drop(self, name: str) -> None:
        """Remove a table and its name from aliases."""
        self.table(name).drop()
        state = self._state()
        left = {a: {"tables": [t for t in x["tables"] if t != name], "write": None if x["write"] == name else x["write"]} for a, x in state["aliases"].items()}
        self._save(state | {"aliases": {a: x for a, x in left.items() if x["tables"]}})

    def vacuum(self, older: float = 86_400) -> list[str]:
        """Remove batches under the root that no version of a table here and no snapshot names, and that are older than so
        many seconds, so that a writer's are left alone; returns their paths."""
        named = {b["path"] for t in self.names() for v in _versions(os.path.join(self.root, t)) for b in self.table(t).manifest(v)["batches"]}
        top = os.path.join(self.root, "_snapshots")
        named |= {b["path"] for x in (os.listdir(top) if os.path.isdir(top) else []) for held in self._snapshot(x.removesuffix(".json")).values() for b in held["manifest"]["batches"]}
        found = [os.path.join(self.root, t, "data", x) for t in os.listdir(self.root) if os.path.isdir(os.path.join(self.root, t, "data")) for x in os.listdir(os.path.join(self.root, t, "data"))]
        gone = [x for x in found if x not in named and time.time() - os.path.getmtime(x) >= older]
        for x in gone:
            shutil.rmtree(x)
        return gone

    def settings(self) -> DataFrame:
        """table, setting, value of all tables."""
        rows = [(n, k, str(v)) for n in self.names() for k, v in sorted(self.table(n).manifest()["settings"].items())]
        return self.spark.createDataFrame(rows, "table string, setting string, value string")

    def mappings(self) -> DataFrame:
        """table, column, type of all tables."""
        rows = [(n, f.name, f.dataType.simpleString()) for n in self.names() for f in StructType.fromJson(self.table(n).manifest()["schema"]).fields]
        return self.spark.createDataFrame(rows, "table string, column string, type string")

    def segments(self) -> DataFrame:
        """table, segment, rows, searchable of all batches of the newest versions."""
        rows = []
        for n in self.names():
            body = self.table(n).manifest()
            rows += [(n, i, b["rows"], i < body["searchable"]) for i, b in enumerate(body["batches"])]
        return self.spark.createDataFrame(rows, "table string, segment int, rows long, searchable boolean")

    def listing(self) -> DataFrame:
        """table, store, provider, key_arn, context (sorted k=v list), version, batches, rows: from manifests alone."""
        rows = []
        for n in self.names():
            t, s = self.table(n), self.table(n).manifest()["settings"]
            st = t.stats()
            rows.append((n, "encrypted", s.get("key_provider"), s.get("key_arn"), s.get("encryption_context") or "", st["version"], st["batches"], st["rows"]))
        return self.spark.createDataFrame(rows, "table string, store string, provider string, key_arn string, context string, version int, batches int, rows long")


def count_tables_for_key(listing: DataFrame, key_arn: str, provider: str, context: str = "") -> DataFrame:
    """n: encrypted tables of this key, provider and context; contexts are compared without regard to order."""
    if not key_arn.strip() or not provider.strip():
        raise ValueError("a key and a provider are needed")
    pairs = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, ","), lambda x: x != "")))
    same = (F.col("store") == "encrypted") & (F.col("key_arn") == key_arn) & (F.col("provider") == provider) & (pairs(F.coalesce("context", F.lit(""))) == pairs(F.lit(context)))
    return listing.where(same).agg(F.count("*").alias("n"))
