"""Glossaries as tab-separated text. Nothing is quoted; tabs and line ends inside a field become spaces on writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "english string, chinese string, freq string, confidence string, alternatives string, note string, context string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a name and a value; a frequency that is no number is 0; missing text is empty."""
    rows = spark.read.csv(path, schema=SCHEMA, sep="\t", header=True, quote="", escape="", nullValue="\0").na.fill("")
    rows = rows.where("trim(english) <> '' and trim(chinese) <> ''")
    return rows.withColumn("freq", F.expr("coalesce(try_cast(freq as bigint), 0)"))


def write(entries: DataFrame, path: str) -> None:
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ").alias(c) for c in (x.split()[0] for x in SCHEMA.split(", "))]
    entries.select(*clean).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", quoteAll=False, emptyValue="")
