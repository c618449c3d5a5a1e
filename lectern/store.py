"""Written intermediates in the folder that all executors share, and what bounds batches and spreads small tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where it is unset, a temporary folder is set
    on a local master alone (tests); a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str = "plan") -> DataFrame:
    """``df``, written as Parquet in the shared folder and read back: it cuts lineage, survives lost executors (the files
    belong to the shared store), and later reads prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, each: int = 64 << 20) -> DataFrame:
    """``df``, dealt to all cores if its plan expects fewer than ``each`` bytes for each of them: a small table is often one
    file of one row group, which one task would read and work on. Larger tables stay where they are read. Rows are the same
    either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * each else df


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Batches between the JVM and Python hold at most ``most`` bytes (or one row) in this session. A smaller limit that
    the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    m = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).strip().lower())
    now = int(m[1]) << 10 * " kmgt".index(m[2] or " ") if m and int(m[1]) > 0 else most + 1
    if now > most:
        spark.conf.set(key, str(most))


def clean(spark: SparkSession) -> None:
    """Deletes all intermediates: when every result that was returned has been read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lectern")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
