"""What the corpus operators share: the cluster's scratch folder, narrow checkpoints and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast. Sides that use it have a few narrow columns,
#: so that this is some tens of MB; a larger side is joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Bytes of the rows that a worker turns into Python objects at a time.
SLICE = 4 << 20

#: Characters that separate words, as a regular expression class for the JVM: space and \t to \r.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; unset, a local one in local mode, else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if found is None:
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="spark-llm-")
    if not current.isDefined():
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there, columns can be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for narrow rows; Spark cleans it up when df is gone."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to have at most so many rows, else as it is.

    df should be cheap to count: a checkpoint or a written table of narrow rows.
    """
    return F.broadcast(df) if df.count() <= rows else df


def parts(df: DataFrame, size: int = 256 << 20) -> int:
    """Partitions of about `size` bytes by Spark's own estimate of df, no fewer than spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # where Spark knows nothing, its estimate is beyond any table
    return least if estimate >= 1 << 60 else max(least, -(-estimate // size))


def opaque(column: Column) -> Column:
    """The column, computed where it stands: Catalyst doesn't push a filter on it further down.

    A filter that is pushed below a projection carries the projected expression with it, in the place of each use; for
    an expression over whole texts that is used inside a lambda, this means once for each element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def slices(batches, size: int = SLICE):
    """Arrow batches cut into runs of rows of about `size` bytes, one row at least, so that what Python makes of them stays small."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_rows(it, *columns):
    """Arrow batches as tuples of Python lists, one list for each of the columns."""
    for batch in slices(it):
        yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
