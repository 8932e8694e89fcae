"""WARC archives with revisit records instead of repeated payloads.

Headers (id, target, date, payload digest) are shuffled by digest, so that each group of equal payloads finds its original,
the record of the smallest id; repeats refer to it. Payloads don't move: the tasks that read them write the archives, a
response with its payload or a revisit record with fresh headers that name the original, its target and its date. Archives
are gzip members, one a record after a warcinfo record, and are read back record by record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealframe.llm.shared import as_table, by_rows, cut, scratch_path, small
from sealframe.llm.token_files import filesystem

#: Fixed values of WARC 1.1: version, revisit profile.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Not an id: the record has none.
NO_ID = "-"
#: Bytes of an archive, after which a task begins another.
FILE_BYTES = 1 << 30


def record_id(*parts: object) -> str:
    """A record's URN, the same whenever it is made of these parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def record(head: dict[str, str], block: bytes) -> bytes:
    head = head | {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}
    return "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def format_info(file: str, date: str) -> bytes:
    """The record at an archive's start."""
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(file), "WARC-Date": date, "WARC-Filename": file, "Content-Type": "application/warc-fields"}
    return record(head, b"software: sealframe\r\nformat: WARC File Format 1.1\r\n")


def format_record(name: int | None, url: str | None, payload: bytes, digest: str, original: dict | None, date: str, urn: str) -> bytes:
    """One record: a response with the payload, or a revisit without it that names the original (name, url, date)."""
    head = {"WARC-Type": "revisit" if original else "response", "WARC-Record-ID": urn, "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = " ".join(url.split())
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Source-Id": NO_ID if name is None else str(name), "X-Payload-Length": str(len(payload))}
    if original:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(original["name"], digest), "WARC-Refers-To-Date": original["date"], "X-Refers-To-Source-Id": str(original["name"])}
        if original["url"] is not None:
            head["WARC-Refers-To-Target-URI"] = " ".join(original["url"].split())
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record(head | {"Content-Type": "application/http;msgtype=response"}, status + (b"" if original else payload))


def parse_record(whole: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises ValueError if a response's payload doesn't match its digest."""
    top, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(head["Content-Length"])]
    if version != VERSION or len(rest) != len(block) + 4:
        raise ValueError("not a WARC record")
    payload = block.partition(b"\r\n\r\n")[2]
    if head["WARC-Type"] == "response" and f"sha1:{sha1_base32(payload)}" != head["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {head['X-Source-Id']} is damaged")
    return head, payload


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def originals(headers: DataFrame) -> DataFrame:
    """digest, original (name, url, date): the row of the smallest name of each digest that several rows have (a checkpoint).

    headers: name, url, date, digest. Counted before the shuffle, so a payload that a third of all rows have is one row
    from each task.
    """
    least = F.min(F.when(F.col("name").isNotNull(), F.struct("name", "url", "date")))
    groups = headers.groupBy("digest").agg(least.alias("original"), F.count("*").alias("n"))
    return cut(groups.where("n > 1 and original is not null").select("digest", "original"))


def write(pages: DataFrame, name: str = "page_id", url: str = "url", html: str = "html", smallest: int = 0, path: str | None = None, date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives; returns the stored manifest: path, n_records, n_bytes.

    A null html is an empty payload, a null url has no target; null names come last in a group and never are what
    others refer to, so a group of nulls alone is all responses. Of rows of one name and payload the first is what the
    name's type is and the others revisit the original. Payloads of fewer bytes than `smallest` are always responses.
    date: a column of timestamps; where there is none, the time of this call. Other columns are ignored, a payload of any
    length is one record, an empty table makes no archives. A task goes on in a new archive after `file_bytes`.
    """
    path, now = path or scratch_path(pages.sparkSession, "warc"), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    when = F.date_format(F.to_utc_timestamp(F.col(date).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date else F.lit(None).cast("string")
    rows = pages.select(F.col(name).cast("long").alias("name"), F.col(url).alias("url"), F.coalesce(when, F.lit(now)).alias("date"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    headers = cut(rows.where(F.octet_length("payload") >= smallest).select("name", "url", "date", "digest"))
    first = originals(headers)
    # the records that are repeats, by name and digest: narrow rows, split by Spark where one digest has many
    repeats = headers.select("name", "digest").distinct().join(small(first), "digest")
    repeats = cut(repeats.where(F.col("name").isNull() | (F.col("name") != F.col("original.name"))).select(F.col("name").alias("__name"), F.col("digest").alias("__digest"), "original"))
    # rows that have an original's own name and payload again
    twins = headers.where("name is not null").groupBy("name", "digest").count().where("count > 1").join(small(first), "digest").where("name = original.name")
    twins = cut(twins.select(F.col("name").alias("__name"), F.col("digest").alias("__digest")))
    is_of = F.col("name").eqNullSafe(F.col("__name")) & (F.col("digest") == F.col("__digest"))
    single = rows if twins.isEmpty() else rows.join(small(twins), is_of, "left_anti")
    marked = single.join(small(repeats), is_of, "left").select("name", "url", "date", "payload", "original")
    if not twins.isEmpty():
        again = as_table(rows.join(small(twins), is_of, "left_semi").withColumn("row", F.monotonically_increasing_id()), "warc-twins")
        ahead = cut(again.groupBy(F.col("name").alias("__name"), F.col("digest").alias("__digest")).agg(F.min(F.struct("row", "name", "url", "date")).alias("first")))
        other = F.when(F.col("row") != F.col("first.row"), F.struct("first.name", "first.url", "first.date"))
        marked = marked.unionByName(again.join(small(ahead), is_of).select("name", "url", "date", "payload", other.alias("original")))

    def save(batches):
        from pyspark import TaskContext

        task, out, n, size, files = TaskContext.get(), None, 0, 0, 0
        fs, top = filesystem(path)

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{file}"], "n_records": [n], "n_bytes": [size]})

        for names, urls, dates, payloads, firsts in by_rows(batches, "name", "url", "date", "payload", "original"):
            for who, link, at, body, original in zip(names, urls, dates, payloads, firsts, strict=True):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    file = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz"
                    out, n, files = fs.open_output_stream(f"{top}/{file}", compression=None), 0, files + 1
                    info = gzip.compress(format_info(file, now), 6, mtime=0)
                    out.write(info)
                    size = len(info)
                digest = sha1_base32(body)
                # what others refer to is known by its name and digest, the rest by its place
                urn = record_id(file, n) if original or who is None or len(body) < smallest else record_id(who, digest)
                member = gzip.compress(format_record(who, link, body, digest, original, at, urn), 6, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return as_table(marked.mapInArrow(save, "path string, n_records long, n_bytes long"), "warc-manifest")


def members(data, size: int = 1 << 20):
    """The gzip members of a stream, one by one."""
    member, parts = zlib.decompressobj(31), []
    while chunk := data.read(size):
        while chunk:
            parts.append(member.decompress(chunk))
            chunk = member.unused_data
            if member.eof:
                yield b"".join(parts)
                member, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("an archive ends inside a record")


def read_back(manifest: DataFrame) -> DataFrame:
    """name, url, record_type, payload_digest (base32 SHA-1), payload_bytes, refers_to, payload (null for a revisit)."""
    tasks = max(1, manifest.count())  # a file is at most FILE_BYTES and a record
    types = {"name": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def load(batches):
        for (paths,) in by_rows(batches, "path"):
            for path in paths:
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for member in members(source):
                        head, payload = parse_record(member)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        kind, who, refers = head["WARC-Type"], head["X-Source-Id"], head.get("X-Refers-To-Source-Id")
                        rows.append((None if who == NO_ID else int(who), head.get("WARC-Target-URI"), kind, head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), refers and int(refers), payload if kind == "response" else None))
                        held += len(member)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))

    schema = "name long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    return manifest.select("path").repartition(tasks).mapInArrow(load, schema)


def digests(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back and return each record's headers."""
    return read_back(write(pages)).select(F.col("name").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: digests() in DuckDB's SQL, for page_ids that are neither null nor repeated: five hexadecimal digits are four of base 32.
SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as hex, min(page_id) over (partition by body) as original from p),
v as (select *, list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda k: instr('0123456789abcdef', hex[i * 5 + k + 1]) - 1), lambda a, b: a * 16 + b)) as parts from h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = original then 'response' else 'revisit' end as record_type,
  case when page_id <> original then original end as refers_to
from v
"""
