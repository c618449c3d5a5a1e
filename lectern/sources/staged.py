"""Replacing a file or folder in any store at once: written beside it, then renamed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    store, p, _ = _store(spark, path)
    return store.exists(p)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` writes to the path it is given; only when it is done does that take the place of ``path``. If it
    fails, ``path`` is as it was."""
    store, p, kind = _store(spark, path)
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        write(new)
        store.delete(p, True)
        if not store.rename(kind(new), p):
            raise OSError(f"{path}: not renamed")
    finally:
        store.delete(kind(new), True)
