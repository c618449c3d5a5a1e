"""Incremental ingestion: each new file is processed once, and the query ends when none is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, progress: str, files_per_batch: int = 1000) -> int:
    """Runs ``work`` over the Parquet files in ``source`` that no earlier call with the same ``progress`` folder saw, and
    appends its rows to ``sink``. Returns how many batches there were. A batch that is repeated after a failure
    replaces what it wrote before."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    query = rows.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])
