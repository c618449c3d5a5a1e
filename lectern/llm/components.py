"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every endpoint with the smallest identifier that it reaches.

    A round takes the smallest label among neighbours, then the label's own label, so long chains shrink by powers; each
    round is written to the shared folder. A vertex with very many neighbours meets them only in joins of two exchanges
    (which adaptive execution splits) and in sums with partial aggregation. Nothing is collected. No edges: no rows."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(both.union(both.select("v", "u")).where("u <> v").distinct(), "edges")
    label = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("c")), "labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = materialize(label.join(near, "u").select("u", F.col("c").alias("was"), F.least("c", "m").alias("c")), "labels")
        root = step.select(F.col("u").alias("c"), F.col("c").alias("r"))
        jumped = step.join(root, "c", "left").select("u", "was", F.coalesce("r", "c").alias("c"))
        label = materialize(jumped, "labels")
        if label.where("was <> c").isEmpty():
            return label.select(F.col("u").alias("id"), F.col("c").alias("component"))
        label = label.select("u", "c")
