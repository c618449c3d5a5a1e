"""Numbers and digests over a whole table, without one task that holds it."""

from __future__ import annotations

from itertools import batched

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import Md5
from ..store import bounded_batches

#: Bytes of text that one task of ``joined_md5`` reads, about
PART_BYTES = 128 << 20


def number_globally(rows: DataFrame, order: list[Column], name: str, checkpoint) -> DataFrame:
    """``rows`` with a gapless number from 0 in the order of ``order`` (which should leave no ties). Rows are range-partitioned
    and sorted; what is counted in one place is a row for each partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # both are fixed by writing them: the partition, and the place in it
    parts = checkpoint(parts.withColumn("_lectern_part", F.spark_partition_id()).withColumn("_lectern_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = parts.groupBy("_lectern_part").agg(F.count(F.lit(1)).alias("_lectern_size"))
    before = Window.orderBy("_lectern_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_lectern_part", F.coalesce(F.sum("_lectern_size").over(before), F.lit(0)).alias("_lectern_start"))
    return parts.join(F.broadcast(starts), "_lectern_part").withColumn(name, F.col("_lectern_start") + F.col("_lectern_nth")).drop("_lectern_part", "_lectern_nth", "_lectern_start")  # a row a partition


def _digests(rows: DataFrame, sep: bytes, states: dict[str, bytes], first: bytes) -> DataFrame:
    """(grp, state): what sorted rows (grp, txt) add to the digests of their groups."""
    import pyarrow as pa

    def ends(batches):
        now = md5 = None
        for b in batches:
            for grp, txt in zip(b.column(0), b.column(1), strict=True):
                grp = grp.as_py()
                begun = grp == now
                if not begun:
                    if md5:
                        yield now, md5.state()
                    begun, now, md5 = grp in states, grp, Md5(states.get(grp))
                md5.update(sep if begun else first)
                md5.update(txt.as_py().encode())
        if md5:
            yield now, md5.state()

    def run(batches):
        for some in batched(ends(batches), 4096):
            yield pa.RecordBatch.from_pydict({"grp": [x[0] for x in some], "state": [x[1] for x in some]})

    return rows.select("grp", "txt").mapInArrow(run, "grp string, state binary")


def joined_md5(rows: DataFrame, group: str, order: list[str], text: str, sep: str, checkpoint, first: str = "", each: int = PART_BYTES) -> DataFrame:
    """(group, md5) of ``first`` and a group's texts in order, ``sep`` between them, none of which is ever in one place. Groups
    are strings or null; null texts are left out.

    Rows are range-partitioned by (group, order) into parts of about ``each`` bytes. A group inside one part is digested there. One
    that crosses parts, of which there are fewer than parts, goes part by part: a round is a job in which each such group has one
    part at most, and what passes from round to round is the state of its digest, of 92 bytes."""
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.where(F.col(text).isNotNull())
    size = int(rows.agg(F.sum(F.octet_length(text).cast("long") + 16)).first()[0] or 0)
    n = max(1, -(-size // each))
    keys = [f"_k{i}" for i in range(len(order))]
    rows = rows.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("grp"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.col(text).alias("txt"))
    parts = checkpoint(rows.repartitionByRange(n, "grp", *keys).withColumn("_part", F.spark_partition_id()))
    span = parts.groupBy("grp").agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).where("lo < hi").collect()  # fewer than parts
    whole = parts.where(~F.col("grp").isin([r.grp for r in span])) if span else parts
    done = _digests(whole.repartition(n, "_part").sortWithinPartitions("grp", *keys), sep.encode(), {}, first.encode())
    states: dict[str, bytes] = {}
    for i in range(max((r.hi - r.lo + 1 for r in span), default=0)):
        at = [r for r in span if r.lo + i <= r.hi]
        here = F.lit(False)
        for r in at:
            here = here | ((F.col("grp") == r.grp) & (F.col("_part") == r.lo + i))
        some = parts.where(F.col("_part").isin([r.lo + i for r in at]) & here).repartition(len(at), "grp").sortWithinPartitions("grp", *keys)
        states |= {r.grp: bytes(r.state) for r in _digests(some, sep.encode(), states, first.encode()).collect()}
    ends = done.unionByName(spark.createDataFrame(list(states.items()), "grp string, state binary")) if span else done
    hexed = F.udf(lambda x: Md5(bytes(x)).hexdigest(), "string")
    return ends.select(F.when(F.col("grp") != "", F.expr("substr(grp, 2)")).alias(group), hexed("state").alias("md5"))
