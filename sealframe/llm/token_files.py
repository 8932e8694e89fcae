"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document (its ids as little-endian unsigned 32-bit integers), a skippable frame with the
documents' ids in the same order and a bit for each that is null, and the seek table of the public zstd seekable format: for each frame its compressed
size, its decompressed size and the low 32 bits of the XXH64 of its content. Any zstd tool can decompress such a file;
a reader takes the seek table from the file's end and decompresses only the frames it was asked for.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealframe.llm.shared import as_table, by_rows, parts, scratch_path

#: Fixed values of the zstd seekable format: skippable frames' magic numbers, the footer's magic number, the flag for checksums.
SKIPPABLE, SEEK_TABLE, FOOTER, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Stands in the place of a null doc_id; bits after the names tell it from a doc_id of this value.
NO_ID = -(2**63)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds a path (a local path or a URI) and the path in it."""
    if "://" in path or path.startswith("file:"):
        parts = urlparse(path)
        return (pafs.LocalFileSystem(), parts.path) if parts.scheme == "file" else pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


class Writer:
    """Writes documents to one file. A file counts once it is closed under its own name."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.compress = out, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.entries, self.names = bytearray(), []

    def add(self, name: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compress(ids)
        self.out.write(frame)
        self.entries += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.names.append(name)

    def finish(self) -> None:
        import numpy as np
        import xxhash

        names = struct.pack(f"<{len(self.names)}q", *(NO_ID if x is None else x for x in self.names))
        names += np.packbits([x is None for x in self.names], bitorder="little").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(names)) + names)
        # the frame of names has no content, so the table lists it with its size and nothing decompressed
        table = bytes(self.entries) + struct.pack("<III", 8 + len(names), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.names) + 1, CHECKSUMS, FOOTER))


class Reader:
    """Reads chosen documents of one file by its seek table."""

    def __init__(self, source: pa.NativeFile):
        import numpy as np

        self.source, end = source, source.size()
        if end < 17:
            raise ValueError("not a seekable token file")
        source.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(end - 9 - 12 * frames)
        table = np.frombuffer(source.read(12 * frames), dtype="<u4").reshape(-1, 3)
        self.sizes, self.lengths, self.sums = table[:-1].T.astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        source.seek(int(self.offsets[-1]) + 8)
        self.names = np.frombuffer(source.read(8 * (frames - 1)), dtype="<i8")
        self.nulls = np.unpackbits(np.frombuffer(source.read(int(table[-1, 0]) - 8 - 8 * (frames - 1)), dtype=np.uint8), count=frames - 1, bitorder="little")

    def read(self, k: int) -> bytes:
        """The ids of the k-th document; raises ValueError if they don't match their checksum."""
        import xxhash
        import zstandard

        self.source.seek(int(self.offsets[k]))
        frame = self.source.read(int(self.sizes[k]))
        try:
            ids = zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(1, int(self.lengths[k])))
        except zstandard.ZstdError as e:
            raise ValueError(f"document {k} is damaged: {e}") from e
        if len(ids) != self.lengths[k] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"document {k} is damaged: its checksum differs")
        return ids


def read_documents(path: str, names: Iterable[int]) -> Iterator[tuple[int, bytes]]:
    """(doc_id, ids) of the named documents of one file; decompresses these frames only."""
    import numpy as np

    fs, at = filesystem(path)
    with fs.open_input_file(at) as source:
        reader = Reader(source)
        for k in np.flatnonzero(np.isin(reader.names, np.fromiter(names, dtype=np.int64))):
            yield int(reader.names[k]), reader.read(int(k))


def write(docs: DataFrame, tokenizer: str, chunks: str, end_id: int, path: str | None = None, files: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the stored manifest.

    Manifest: part (order of the files), path, n_docs, n_tokens. files: by default one for each 256 MB of the table, as
    Spark estimates it. Null doc_ids come first, repeated ones stand together,
    null and empty texts are end_id alone, other columns are ignored; an empty table makes no files. Files are written
    under the task attempt's name, and the manifest names those of the attempts that ended well, so a lost executor or
    a second attempt leaves nothing wrong behind.
    """
    path = path or scratch_path(docs.sparkSession, "token-files")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    files = files or parts(source)
    # rows of one doc_id, or none, are dealt by their texts and places, so that many of them are many ranges
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    dealt = source.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order).drop("row")

    def save(batches):
        from pyspark import TaskContext

        from sealframe.llm.tokens import encoder

        ids_of, end, task = encoder(tokenizer, chunks), end_id.to_bytes(4, "little"), TaskContext.get()
        fs, top = filesystem(path)
        name, out, writer, tokens = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tokens.zst", None, None, 0
        for names, texts in by_rows(batches, "doc_id", "text"):
            for d, ids in zip(names, ids_of.encode_all(texts), strict=True):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    writer = Writer(out)
                ids += end
                tokens += len(ids) // 4
                writer.add(d, ids)
        if writer is not None:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{path}/{name}"], "n_docs": [len(writer.names)], "n_tokens": [tokens]})

    return as_table(dealt.mapInArrow(save, "part long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of all documents of the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    dealt = files.repartition(max(1, manifest.count()))

    def load(batches):
        for paths, starts in by_rows(batches, "path", "start"):
            for path, start in zip(paths, starts, strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as source:
                    reader = Reader(source)
                    for k in range(0, len(reader.names), 256):
                        ids = [reader.read(i) for i in range(k, min(k + 256, len(reader.names)))]
                        n = [len(x) // 4 for x in ids]
                        *at_start, start = accumulate(n, initial=start)
                        names = [None if no else x for x, no in zip(reader.names[k : k + 256].tolist(), reader.nulls[k : k + 256].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at_start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return dealt.select("path", "start").mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, tokenizer: str, chunks: str = "words", end_id: int = 1) -> DataFrame:
    """Write all documents, read the files back and return a checksum of each document's ids."""
    return read_back(write(docs, tokenizer, chunks, end_id)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
