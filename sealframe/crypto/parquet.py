"""Parquet modular encryption: options for reads and writes, and the session's key client."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

JAR = Path(__file__).with_name("kms.jar")
CLIENT = "sealframe.KeyDirectoryKmsClient"


def enable(spark: SparkSession) -> None:
    """Make the key client known to driver and executors of a running session."""
    if not any(str(x).endswith("/kms.jar") for x in spark.sql("LIST JARS").toPandas().iloc[:, 0]):
        spark.sql(f"ADD JAR '{JAR}'")


def read_options(keys: str) -> dict[str, str]:
    """Options by which files with encrypted footers are read; they name a directory of keys, never a key."""
    return {
        "parquet.crypto.factory.class": "org.apache.parquet.crypto.keytools.PropertiesDrivenCryptoFactory",
        "parquet.encryption.kms.client.class": CLIENT,
        # caches of clients and unwrapped keys are kept apart by instance and token
        "parquet.encryption.kms.instance.id": keys,
        "parquet.encryption.kms.instance.url": keys,
        "parquet.encryption.key.access.token": keys,
    }


def write_options(keys: str, key_id: str) -> dict[str, str]:
    """Options that encrypt and authenticate all columns and the footer under one table key, with 256 bits."""
    return read_options(keys) | {"parquet.encryption.uniform.key": key_id, "parquet.encryption.algorithm": "AES_GCM_V1", "parquet.encryption.data.key.length.bits": "256"}
