"""Session helpers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies on the driver's path (local mode, shared installs)."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark


def scratch(spark: SparkSession) -> str:
    """A mounted folder that driver and executors share, from spark.checkpoint.dir; unset, a local one in local mode, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="spark-sealframe-")
        _local[spark.sparkContext.applicationId] = found
    found = found.removeprefix("file://")
    if "://" in found:
        raise ValueError(f"encrypted tables need a mounted folder, not {found}")
    return found


_local: dict[str, str | None] = {}
