"""Conversations: shaping and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def merge_roles(messages: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text): neighbouring messages of one role joined by a blank line, in order. Every role but
    assistant is user; system messages are left out. A conversation of nothing else is one empty user turn."""
    system = F.coalesce("role", F.lit("")) == "system"
    rows = messages.where(~system).select("conv_id", "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1)
    rows = rows.withColumn("nth", F.sum(new).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    said = rows.groupBy("conv_id", "nth").agg(F.min("role").alias("role"), joined.alias("text"))
    silent = messages.groupBy("conv_id").agg(F.bool_and(system).alias("s")).where("s")
    return said.unionByName(silent.select("conv_id", F.lit(1).cast("long").alias("nth"), F.lit("user").alias("role"), F.lit("").alias("text")))


def system_prompt(messages: DataFrame, skip_empty: bool = False) -> DataFrame:
    """(conv_id, prompt): a conversation's system messages joined by a blank line."""
    rows = messages.where("role = 'system'")
    rows = rows.where("trim(text) <> ''") if skip_empty else rows
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("conv_id").agg(joined.alias("prompt"))


def transcript(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, transcript): of a single message its text; else a line of the role and text each."""
    rows = messages.where(F.coalesce("role", F.lit("")) != "system")
    line = F.concat(F.upper(F.substring("role", 1, 1)), F.substring("role", 2, 100), F.lit(": "), F.col("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", line.alias("line"))))
    out = rows.groupBy("conv_id").agg(turns.alias("t"))
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.when(F.size("t") == 1, F.element_at("t", 1)["text"]).otherwise(F.array_join(F.transform("t", lambda x: x["line"]), "\n\n")).alias("transcript"))


def framed(messages: DataFrame, registry: DataFrame, prefix: str, framed_kind: str = "translate", hardening: str = "") -> DataFrame:
    """(conv_id, kind, language, key, system, prompt): one request for a conversation. ``registry`` (text, kind, language)
    tells what a system prompt is for; unknown ones have neither. A single turn of the framed kind gets ``prefix`` before
    it, and its system prompt ``hardening`` after it; several turns are a transcript of User and Assistant. ``key`` is made of
    the messages as they are, so a framing that changes repeats no work."""
    system = system_prompt(messages, skip_empty=True)
    said = messages.where(F.coalesce("role", F.lit("")) != "system")
    line = F.concat(F.when(F.col("role") == "assistant", "Assistant").otherwise("User"), F.lit(":\n"), F.coalesce("text", F.lit("")))
    turns = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), line.alias("line")))).alias("t"))
    rows = turns.join(system, "conv_id", "left").join(registry.select(F.col("text").alias("prompt"), "kind", "language"), "prompt", "left").na.fill("", ["kind", "language"])
    one, ours = F.size("t") == 1, F.col("kind") == framed_kind
    every = F.array_join(F.transform("t", lambda x: x["line"]), "\n\n")
    text = F.when(one, F.concat(F.when(ours, F.lit(prefix)).otherwise(""), F.element_at("t", 1)["text"])).otherwise(every)
    key = F.sha2(F.concat(F.coalesce("prompt", F.lit("")), F.lit("\0"), every), 256)
    return rows.select("conv_id", "kind", "language", key.alias("key"), F.when(ours, F.concat("prompt", F.lit(hardening))).otherwise(F.col("prompt")).alias("system"), text.alias("prompt"))


def validate(source: Column, answer: Column, language: str) -> Column:
    """Why an answer is rejected, or null. Only languages with a script of their own can reject."""
    script = rules.SCRIPTS.get(language.strip().lower())
    if script is None:
        return F.lit(None).cast("string")
    s, a = T.fingerprint(source), T.fingerprint(answer)
    inside = (s != "") & (a != "") & (F.contains(a, s) | F.contains(s, a)) & (F.length(a) <= 2 * F.length(s) + 20)
    passes = answer.rlike(f"[{script}]") | (s == "") | (s == a) | inside
    return F.when(~passes, f"no {language} script")


def fill_has_markup(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit("<xml"))


def is_fatal(message: Column) -> Column:
    low = F.lower(message)
    return F.exists(F.array(*map(F.lit, rules.FATAL_MARKERS)), lambda m: F.contains(low, m))


def is_retryable(status: Column, wide: bool = False) -> Column:
    return status.isin(rules.RETRY_STATUS_WIDE if wide else rules.RETRY_STATUS)


def delay(attempt: Column, base: float = 5.0, cap: float = 60.0) -> Column:
    """Seconds before the next try, doubling up to a cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def endpoint(url: Column, last: str = "messages") -> Column:
    """A base address completed to /v1/``last``, whatever part of it is there already."""
    bare = F.regexp_replace(url, "/+$", "")
    rest = F.when(bare.endswith(f"/{last}"), "").when(bare.endswith("/v1"), f"/{last}").otherwise(f"/v1/{last}")
    return F.concat(bare, rest)
