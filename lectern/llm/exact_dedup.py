"""Exact dedup by content sort, in DataFrame operations alone.

Sampled splitters range-partition the rows by content, an external sort places equal contents next to each other,
and each group is found by comparing whole neighbouring contents; one row of it stays.

* The sort key is (first bytes, 64-bit hash, salt, whole content, id). Only the first three, of bounded length, are
  sampled for splitters: no whole text goes to the driver. The whole content decides equality.
* Hot contents: hashes with more than 1/1000 of the rows are at most 1000, so their table is small by proof and is
  broadcast. Their rows get a salt, as many values as keep a salted group below that share, so splitters fall inside
  a hot group. The winners of its salted parts (at most 2000 rows or so) are compared once more, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, partitions, text_bytes_col

#: A content with more than this share of all rows is hot; at most HOT_PARTS hot contents can exist.
HOT_PARTS = 1000
#: Bytes (characters) of the content in the sampled sort key.
KEY_CHARS = 32


def content_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise=lower_ascii,
    digest: bool = True,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept and, with ``digest``, text_sha256 of the
    normalised content.

    ``keep``: which identifier stays, "min" or "max". Null text counts as empty, and all empty texts are one group.
    A null identifier loses to any other; a group of null identifiers alone has keep_id null. Exactly one row of a group
    is kept, also where rows repeat an identifier with equal content; all count in group_size. Other columns, of
    whatever name, play no part. An empty table gives an empty result."""
    local = _in_parts(docs, id_col, text_col, keep, normalise)
    local = materialize(local.select(*_PLACE, *([F.sha2("_norm", 256).alias("text_sha256")] if digest else []), _among_parts()), "exact-dedup")
    out, keep_id, size, stays = _met(local, keep)
    return out.select(F.col("_id").alias(id_col), keep_id.alias("keep_id"), size.alias("group_size"), stays.alias("kept"), *(["text_sha256"] if digest else []))


def distinct_contents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=lower_ascii) -> DataFrame:
    """The rows of ``docs``, all columns, that ``content_groups`` keeps: exactly one of each content. Rows go through the
    operator whole, so identifiers that are null or repeated, with equal contents or others, make no difference."""
    if not docs.columns:
        return docs
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.lit(0).alias("_")).alias("_rest")
    local = _in_parts(docs, id_col, text_col, keep, normalise, F.col(text_col).alias("_whole"), rest).where("_leads")
    local = materialize(local.select(*_PLACE, "_whole", "_rest", _among_parts()), "exact-dedup")
    out, _, _, stays = _met(local, keep)
    return out.where(stays).select(*(F.col("_whole").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in docs.columns))


_PLACE = ("_id", "_hash", "_salt", "_lead", "_n", "_leads")


def _among_parts() -> Column:
    """The content, of the first row of each part of a hot content alone."""
    return F.when((F.col("_salt") >= 0) & F.col("_leads"), F.col("_norm")).alias("_norm")


def _in_parts(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise, *carry: Column) -> DataFrame:
    """Every row with what its part of its content knows: the identifier that leads there (_lead), rows (_n), and whether
    it is the row that leads (_leads)."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep: {keep}")
    spark = docs.sparkSession
    first = F.col("_id").asc_nulls_last() if keep == "min" else F.col("_id").desc_nulls_last()
    # lower() of the whole text is a function of the normalised text, and cheaper: equal contents have equal hashes
    rows = docs.select(F.col(id_col).alias("_id"), text_bytes_col(F.col(text_col)).alias("_text"), *carry)
    rows = rows.withColumn("_hash", F.xxhash64(F.lower("_text"))).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(_hot(docs.select(F.xxhash64(F.lower(text_bytes_col(F.col(text_col)))).alias("_hash")))), "_hash", "left")
    # by row, not by identifier alone: a hot content may come with one identifier, or none
    rows = rows.withColumn("_salt", F.when(F.col("_parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("_id", "_row"), F.col("_parts")))).drop("_parts", "_row")
    rows = rows.withColumn("_head", F.substring(F.lower(F.substring("_text", 1, KEY_CHARS)), 1, KEY_CHARS))
    rows = rows.repartitionByRange(partitions(spark), "_head", "_hash", "_salt")
    rows = rows.withColumn("_norm", normalise(F.col("_text"))).drop("_text")
    ordered = Window.partitionBy("_head", "_hash", "_salt", "_norm").orderBy(first)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead, n, leads = F.first("_id").over(whole).alias("_lead"), F.count(F.lit(1)).over(whole).alias("_n"), (F.row_number().over(ordered) == 1).alias("_leads")
    return rows.select("*", lead, n, leads)


def _met(local: DataFrame, keep: str) -> tuple[DataFrame, Column, Column, Column]:
    """The parts of hot contents meet: few rows, compared whole. Returns rows, and columns: keep_id, group_size, and
    whether the row stays."""
    best = F.min if keep == "min" else F.max
    parts = local.where(F.col("_norm").isNotNull())
    met = parts.groupBy("_norm").agg(best("_lead").alias("_keep"), F.sum("_n").alias("_size"), F.collect_list(F.struct("_hash", "_salt", "_lead")).alias("_of"))
    winner = F.expr("array_min(transform(filter(_of, x -> x._lead <=> _keep), x -> x._salt))")
    met = met.select("_keep", "_size", winner.alias("_w"), F.explode("_of").alias("_o")).select("_keep", "_size", "_w", F.col("_o._hash").alias("_h"), F.col("_o._salt").alias("_s"), F.col("_o._lead").alias("_l"))
    same = (F.col("_hash") == F.col("_h")) & (F.col("_salt") == F.col("_s")) & F.col("_lead").eqNullSafe(F.col("_l"))
    out = local.drop("_norm").join(F.broadcast(met), same, "left")
    alone = F.col("_s").isNull()
    keep_id = F.when(alone, F.col("_lead")).otherwise(F.col("_keep"))
    stays = F.col("_leads") & (alone | (F.col("_salt") == F.col("_w")))
    return out, keep_id, F.coalesce("_size", "_n").cast("long"), stays


def _hot(rows: DataFrame) -> DataFrame:
    """(_hash, _parts) of the contents with over 1/HOT_PARTS of the rows (and over 20 rows): at most HOT_PARTS rows,
    whatever the input. The one-row total is the only thing that the filter needs from the whole."""
    counts = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 20")
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * HOT_PARTS > F.col("_all"))
    return hot.select("_hash", F.ceil(F.col("_n") * HOT_PARTS / F.col("_all")).alias("_parts"))
