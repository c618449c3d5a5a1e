"""Batch enrichment: batches, pluggable resolvers, the failure budget, and work that was done before."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..store import written
from .ordering import number_globally

RESOLVED = "en string, zh string, confidence string, alt string, note string, batch long, failed boolean, reason string"


def ranked(rows: DataFrame, order: list, name: str, checkpoint) -> DataFrame:
    """Rows numbered from 0 over the whole table."""
    return number_globally(rows, [F.col(o) if isinstance(o, str) else o for o in order], name, checkpoint)


def batches(rows: DataFrame, order: list, size: int = rules.BATCH, parts: str | None = None, checkpoint=None) -> DataFrame:
    """Adds batch: consecutive rows, ``size`` to a batch. With ``parts``, numbering starts anew in each; without, it runs over
    the whole table in range partitions, which needs ``checkpoint``."""
    if parts is None:
        return ranked(rows, order, "_nth", checkpoint or written).withColumn("batch", F.floor(F.col("_nth") / size).cast("long")).drop("_nth")
    w = Window.partitionBy(parts).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def resolve(rows: DataFrame, resolver: Callable[[list[dict]], list[dict]], pauses: tuple[float, ...] = (0, 0), check: Callable[[list[dict]], str | None] | None = None) -> DataFrame:
    """Calls ``resolver`` with the rows (all columns but batch) of each batch, in tasks. A failure, or an answer that
    ``check`` gives a reason against, is tried again after each of ``pauses`` seconds. A batch that keeps failing
    loses only itself: its rows come back failed, with the reason. Materialise the result: calls aren't repeatable.
    Requests at once are bounded by the number of tasks, and in a process by ``connectors.gate``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, batch, reason = pdf.drop(columns="batch").to_dict("records"), int(pdf["batch"].iloc[0]), ""
        for pause in (0, *pauses):
            time.sleep(pause)
            try:
                said = resolver(asked)
                reason = (check(said) if check else None) or ""
            except Exception as e:  # noqa: BLE001  any failure of an external service is a failed try
                reason = f"{type(e).__name__}: {e}"
            if not reason:
                empty = {"zh": "", "confidence": "", "alt": "", "note": ""}
                return pd.DataFrame([{**empty, **r, "batch": batch, "failed": False, "reason": ""} for r in said], columns=names)
        return pd.DataFrame([{"en": a["en"], "zh": "", "confidence": "", "alt": "", "note": "", "batch": batch, "failed": True, "reason": reason} for a in asked], columns=names)

    names = [c.split()[0] for c in RESOLVED.split(", ")]
    return rows.groupBy("batch").applyInPandas(run, RESOLVED)


def failure_ratio(resolved: DataFrame) -> DataFrame:
    """(n_batches, n_failed, ratio, over_budget)"""
    each = resolved.groupBy("batch").agg(F.bool_or("failed").alias("failed"))
    out = each.agg(F.count(F.lit(1)).alias("n_batches"), F.count_if("failed").alias("n_failed"))
    ratio = F.col("n_failed") / F.greatest("n_batches", F.lit(1))
    return out.withColumn("ratio", ratio).withColumn("over_budget", ratio > rules.FAILURE_BUDGET)


def check_budget(resolved: DataFrame) -> None:
    row = failure_ratio(resolved).first()
    if row.n_batches and row.over_budget:
        raise RuntimeError(f"{row.n_failed} of {row.n_batches} batches failed")


def last_wins(rows: DataFrame, key: str = "en", order: str = "batch") -> DataFrame:
    """For each key the row of the last batch."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def apply_resolution(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entries with zh, confidence, alt and note by exact name, empty where there is none; "skip" goes."""
    good = last_wins(resolved.where(~F.coalesce("failed", F.lit(False)))).select("en", "zh", "confidence", "alt", "note")
    out = entries.join(good, "en", "left").na.fill("", ["zh", "confidence", "alt", "note"])
    return out.where(F.col("confidence") != "skip")


def pending(rows: DataFrame, done: DataFrame, content: str = "text") -> DataFrame:
    """Rows whose content's hash isn't in ``done`` (key): what a resumed run still has to do."""
    return rows.withColumn("key", F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).join(done.select("key"), "key", "left_anti")


def progress(rows: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """Adds delta: the growth since the row before, never negative."""
    w = Window.partitionBy(part).orderBy(order)
    return rows.withColumn("delta", F.greatest(F.lit(0), F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))))


def partition_resolver(resolver) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A resolver as a mapInPandas function, for services that want one connection per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame(resolver(pdf.to_dict("records")))

    return run


def watched(rows: DataFrame, name: str, **measures):
    """``rows``, and an observation that has their number and ``measures`` (columns) once an action has read them: progress
    without a pass of its own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items())), seen
