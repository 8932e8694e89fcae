"""Token counts of documents in flat token files that have no index.

A file is nothing but ids (little-endian, 2 or 4 bytes), each document ended by a separator id. Files are cut into
blocks; each block is searched for separators at once (a vector comparison), and what a block cannot know, the part of a
document that lies in earlier blocks, comes from a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealframe.llm.shared import as_table, by_rows, scratch_path, slices
from sealframe.llm.token_files import filesystem

#: Ids in a block.
BLOCK = 1 << 20


def write_flat(docs: DataFrame, tokenizer: str, chunks: str, separator: int, width: int = 2, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts into flat files; returns the stored list of documents: path, ordinal, doc_id.

    Files follow the input's partitions and keep its order. Null and empty texts are a separator alone; null and
    repeated doc_ids stay as they are. An id that equals the separator or needs more than `width` bytes raises an
    error. Only files of attempts that ended well are listed.
    """
    path, kind = path or scratch_path(docs.sparkSession, "flat-tokens"), docs.schema[doc_id].dataType
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def save(batches):
        import numpy as np
        from pyspark import TaskContext

        from sealframe.llm.tokens import encoder

        ids_of, task, ordinal, out = encoder(tokenizer, chunks, plain=True), TaskContext.get(), 0, None
        fs, top = filesystem(path)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tokens"
        for batch in slices(batches):
            if out is None and batch.num_rows:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(f"{top}/{name}", compression=None)
            for t in batch.column("text").to_pylist():
                ids = np.frombuffer(ids_of.encode(t), dtype="<u4")
                if (ids == separator).any() or (ids >> (8 * width - 1) >> 1).any():
                    raise ValueError("a text has the separator's id, or an id that is too large for the file")
                out.write(np.append(ids, np.uint32(separator)).astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"] * batch.num_rows), pa.array(range(ordinal, ordinal + batch.num_rows), pa.int64()), batch.column("doc_id")], ["path", "ordinal", "doc_id"])
            ordinal += batch.num_rows
        if out is not None:
            out.close()

    return as_table(source.mapInArrow(save, f"path string, ordinal long, doc_id {kind.simpleString()}"), "flat-documents")


def scan(paths: DataFrame, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Documents of flat files: path, ordinal (from 0), start (its first id's place in the file), n_tokens without the separator.

    paths: a column `path`, each file once. Ids after a file's last separator are one more document without an end.
    An empty file has no documents; a file that isn't a whole number of ids raises an error.
    """
    spark = paths.sparkSession
    files = max(1, paths.count())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files)

    def cut_up(batches):
        for (names,) in by_rows(batches, "path"):
            for p in names:
                fs, at = filesystem(p)
                size = fs.get_file_info(at).size
                if size % width:
                    raise ValueError(f"{p} is not a whole number of ids")
                n = -(-size // (width * block))
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([size // width] * n, pa.int64())], ["path", "block", "size"])

    def search(batches):
        import numpy as np

        for names, numbers, sizes in by_rows(batches, "path", "block", "size"):
            for p, k, size in zip(names, numbers, sizes, strict=True):
                fs, at = filesystem(p)
                with fs.open_input_file(at) as source:
                    source.seek(k * block * width)
                    ids = np.frombuffer(source.read(min(block, size - k * block) * width), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == separator) + k * block
                if k * block + len(ids) == size and (not len(ends) or ends[-1] != size - 1):
                    ends = np.append(ends, size)  # the file's last document has no separator
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([k], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([[None, *(ends[:-1] + 1).tolist()][: len(ends)]], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["path", "block", "n", "starts", "ends"])

    blocks = paths.select("path").repartition(files).mapInArrow(cut_up, "path string, block long, size long")
    found = as_table(blocks.repartition(tasks).mapInArrow(search, "path string, block long, n long, starts array<long>, ends array<long>"), "separators")
    # a row for each block: how many documents end before it, and where the last of them ends
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("last"))
    each = found.where("n > 0").join(carried, ["path", "block"])
    each = each.select("path", "first", "last", F.posexplode(F.arrays_zip("starts", "ends")).alias("k", "x"))
    start = F.coalesce("x.starts", F.col("last") + 1)  # the first document of a block begins after the last end before it
    return each.select("path", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("x.ends") - start).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, chunks: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every document, from flat files that are written, then scanned without an index."""
    listed = write_flat(docs, tokenizer, chunks, separator, width)
    counts = scan(listed.select("path").distinct(), separator, width, block)
    return listed.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")
