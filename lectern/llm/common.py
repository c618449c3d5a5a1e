"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import BATCH_BYTES, bounded_batches, written  # noqa: F401  used by the operators

#: Split size (bytes of text) up to which Python stages gather documents before they hash them together.
CHUNK_BYTES = 4 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df``, written in the shared folder and read back."""
    return written(df, name)


def text_bytes(rows: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scan of one column."""
    return int(rows.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0)


def buckets_for(spark: SparkSession, size: int, each: int) -> int:
    """How many buckets ``size`` bytes take at ``each`` bytes a bucket, at least two for each shuffle partition."""
    return max(2 * partitions(spark), -(-size // each))


def text_bytes_col(col: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else. ASCII texts (as many bytes as characters) take the faster built-in."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, low))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the identifier as text leaves remainder 1."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor == 1


def public_vocabulary(name: str) -> str:
    """Where an installed public vocabulary lies: a parameter of the operators, never part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_encoder(path: str):
    """Makes the encoder in the Python worker, where its cache lasts."""

    def make():
        from .wordids import word_ids

        return word_ids(path)

    return make
