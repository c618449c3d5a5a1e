"""Queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import enrich, messages
from .base import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_T = "t as (select conv_id, turn, case when role = 'assistant' then 'assistant' else 'user' end as role, coalesce(text, '') as text from conversations where coalesce(role, '') <> 'system')"


@query(f"""with {_T}, n as (select *, case when lag(role) over (partition by conv_id order by turn) is not distinct from role then 0 else 1 end as new from t),
g as (select *, sum(new) over (partition by conv_id order by turn) as nth from n)
select conv_id, cast(nth as bigint) as nth, min(role) as role, md5(string_agg(text, chr(10) || chr(10) order by turn)) as text_md5 from g group by conv_id, nth
union all select conv_id, 1, 'user', md5('') from conversations group by conv_id having bool_and(coalesce(role, '') = 'system')""")
def role_merge(spark, sf_dir):
    return messages.merge_roles(table(spark, sf_dir, "conversations")).select("conv_id", "nth", "role", F.md5("text").alias("text_md5"))


@query("select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as prompt from conversations where role = 'system' group by conv_id")
def system_prompt(spark, sf_dir):
    return messages.system_prompt(table(spark, sf_dir, "conversations"))


@query("""with r as (select * from conversations where coalesce(role, '') <> 'system')
select conv_id, count(*) as n_turns, md5(case when count(*) = 1 then min(text) else string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) || chr(10) order by turn) end) as transcript_md5 from r group by conv_id""")
def transcript(spark, sf_dir):
    return messages.transcript(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", F.md5("transcript").alias("transcript_md5"))


_FP = lambda x: f"regexp_replace(lower({x}), '[^0-9a-z\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')"
_V = f"""p as (select a.conv_id, a.turn, a.text as source, b.text as answer, {_FP('a.text')} as s, {_FP('b.text')} as r
  from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"""


@query(f"""with {_V} select conv_id, turn, length(s) as source_len, md5(r) as answer_md5,
  case when regexp_matches(answer, '[{rules.HAN}]') or s = '' or s = r or (s <> '' and r <> '' and (contains(r, s) or contains(s, r)) and length(r) <= 2 * length(s) + 20) then '' else 'no simplified chinese script' end as reason,
  contains(lower(answer), '<xml') as has_xml from p""")
def response_validation(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    said = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = asked.join(said, ["conv_id", "turn"])
    reason = messages.validate(F.col("source"), F.col("answer"), "simplified chinese")
    return rows.select("conv_id", "turn", F.length(T.fingerprint(F.col("source"))).cast("long").alias("source_len"), F.md5(T.fingerprint(F.col("answer"))).alias("answer_md5"), F.coalesce(reason, F.lit("")).alias("reason"), messages.fill_has_markup(F.col("answer")).alias("has_xml"))


_K = "cast(json_extract_string(props, '$.k') as bigint)"
_MSG = "case k % 4 when 0 then 'Error: NOT LOGGED IN, ' || event_type when 1 then 'Invalid API key' when 2 then 'timeout' else 'credit balance too low' end"
_FATAL = " or ".join(f"contains(lower(message), '{m}')" for m in rules.FATAL_MARKERS)
_URLS = "case k % 4 when 0 then 'https://x.example/' when 1 then 'https://x.example/v1' when 2 then 'https://x.example/v1/messages/' else 'https://x.example/v1/messages' end"


@query(f"""with e as (select event_id, event_type, {_K} as k from events), m as (select *, {_MSG} as message, {_URLS} as url, 420 + k as status from e),
u as (select *, regexp_replace(url, '/+$', '') as bare from m)
select event_id, {_FATAL} as fatal, status in ({', '.join(map(str, rules.RETRY_STATUS))}) as retryable, status in ({', '.join(map(str, rules.RETRY_STATUS_WIDE))}) as retryable_wide, least(5.0 * pow(2.0, k % 8), 60.0)::double as delay,
  case when bare like '%/messages' then bare when bare like '%/v1' then bare || '/messages' else bare || '/v1/messages' end as endpoint from u""")
def error_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = rows.select("event_id", "k", F.expr(_MSG).alias("message"), F.expr(_URLS).alias("url"))
    return rows.select("event_id", messages.is_fatal(F.col("message")).alias("fatal"), messages.is_retryable(F.lit(420) + F.col("k")).alias("retryable"), messages.is_retryable(F.lit(420) + F.col("k"), wide=True).alias("retryable_wide"), messages.delay((F.col("k") % 8).cast("double")).alias("delay"), messages.endpoint(F.col("url")).alias("endpoint"))


_SYS = "s as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as sys from conversations where role = 'system' and trim(text) <> '' group by conv_id)"


@query(f"""with {_SYS}, reg as (select distinct sys, case when length(sys) % 2 = 0 then 'translate' else 'fill' end as kind from s),
t as (select conv_id, count(*) as n, min(coalesce(text, '')) as one, string_agg(case when role = 'assistant' then 'Assistant' else 'User' end || ':' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn) as every
  from conversations where coalesce(role, '') <> 'system' group by conv_id)
select t.conv_id, coalesce(reg.kind, '') as kind, sha256(coalesce(s.sys, '') || chr(0) || every) as key, md5(coalesce(case when reg.kind = 'translate' then s.sys || '!' else s.sys end, '')) as system_md5,
  md5(case when n = 1 then (case when reg.kind = 'translate' then 'Source: ' else '' end) || one else every end) as prompt_md5
from t left join s on t.conv_id = s.conv_id left join reg on s.sys = reg.sys""")
def framed_turns(spark, sf_dir):
    """Requests with the framing of what their system prompt is registered for; half of the prompts are."""
    talk = table(spark, sf_dir, "conversations")
    known = messages.system_prompt(talk, skip_empty=True).select(F.col("prompt").alias("text")).distinct()
    known = known.select("text", F.when(F.length("text") % 2 == 0, "translate").otherwise("fill").alias("kind"), F.lit("").alias("language"))
    out = messages.framed(talk, known, "Source: ", hardening="!")
    return out.select("conv_id", "kind", "key", F.md5(F.coalesce("system", F.lit(""))).alias("system_md5"), F.md5("prompt").alias("prompt_md5"))


@query("select conv_id, cast(to_json(list(struct_pack(role := role, text := text) order by turn)) as varchar) as turns from conversations group by conv_id")
def turns_as_json(spark, sf_dir):
    each = F.array_sort(F.collect_list(F.struct("turn", F.struct("role", "text").alias("m"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(each, lambda x: x["m"]).alias("t"))
    return rows.select("conv_id", F.to_json("t", {"ignoreNullFields": "false"}).alias("turns"))


@query(f"select event_id, {_K} as k, {_K} is not null as parsed from events")
def json_rows(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n["), F.col("props"), F.lit("]\n```"))
    rows = T.json_rows(fenced, "array<struct<k:bigint>>")
    return table(spark, sf_dir, "events").select("event_id", F.get(rows, F.lit(0))["k"].alias("k"), rows.isNotNull().alias("parsed"))


@query("select conv_id, turn, length(text) as chars, case when length(text) > 120 then substr(text, 1, 120) || '…' else text end as clipped from conversations")
def clipped_context(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"), T.clip(F.col("text"), 120).alias("clipped"))


@query("select conv_id, turn, greatest(0, length(text) - coalesce(lag(length(text)) over (partition by conv_id order by turn), 0)) as delta from conversations")
def progress_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return enrich.progress(rows, "conv_id", "turn", "n").select("conv_id", "turn", F.col("delta").cast("long").alias("delta"))
