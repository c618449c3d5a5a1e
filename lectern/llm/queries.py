"""The queries of the training-data operators, one opN_<name> for each, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .common import held_out, public_vocabulary, read, word_encoder


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector with all others."""
    from .topk import quantise, top_k

    rows = quantise(read(spark, sf_dir, "embeddings"))
    return top_k(rows.where("id % 20 = 0"), rows, k=20)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents; no SQL: counts are tested against brute force, the gain on held-out text, and that factors are distributions."""
    from .lm import score_documents

    return score_documents(read(spark, sf_dir, "documents"), held_out(5))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    from .warc import read_archives, resolved, write_archives

    records = resolved(read_archives(write_archives(read(spark, sf_dir, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "resolved")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; the largest doc_id stays."""
    from .exact_dedup import content_groups

    return content_groups(read(spark, sf_dir, "documents"), keep="max")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and back; no SQL: exact round trips and the library's own unigram are the test."""
    from .unigram import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), public_vocabulary("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; no SQL: held-out accuracy is tested."""
    from .quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out(3))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    from .jaccard_join import similarity_classes

    return similarity_classes(read(spark, sf_dir, "documents"), n=4, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 ids; no SQL: the ids and the gapless windows are tested."""
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), word_encoder(public_vocabulary("word_bpe_49k.json")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeat a window of 13 from a document with a smaller doc_id go."""
    from .substring_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts in all documents; no SQL: retrieval is by bands, tested against brute force."""
    from .license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_topk": op1_topk,
    "op2_lm_score": op2_lm_score,
    "op3_warc": op3_warc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL = {
    "op1_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, r.vec_id, cast(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v r on q.vec_id <> r.vec_id
  where q.vec_id % 20 = 0),
t as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from t where rank <= 20""",
    "op4_exact_dedup": """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc) = 1 as kept, sha256(t) as text_sha256
from n""",
    "op3_warc": """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h,
    min(page_id) over (partition by sha1(coalesce(html, '')), strlen(coalesce(html, ''))) as first
  from pages),
b as (select *, cast(cast(unhex(h) as bit) as varchar) as bits from p)
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * cast(bits[5 * i + 1] as integer) + 8 * cast(bits[5 * i + 2] as integer) + 4 * cast(bits[5 * i + 3] as integer)
    + 2 * cast(bits[5 * i + 4] as integer) + cast(bits[5 * i + 5] as integer), 1)), '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to, true as resolved
from b""",
    "op7_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
k as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id < b.doc_id and a.n * 100 >= b.n * 85 and b.n * 100 >= a.n * 85
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l as (select a, b from k union select b, a from k),
r as (select doc_id as id, doc_id as c from s union select l.b, r.c from r join l on r.id = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.c as component_id from s join (select id, min(c) as c from r group by id) m on s.doc_id = m.id""",
    "op9_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 11)) as p, w from w where len(w) >= 13),
k as (select doc_id, p, min(doc_id) over (partition by array_to_string(w[p:p + 12], ' ')) < doc_id as gone from p),
g as (select distinct doc_id, unnest(range(p, p + 13)) as i from k where gone),
x as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from w),
j as (select x.doc_id, count(*) as n, count(g.i) as gone, string_agg(x.word, ' ' order by x.i) filter (g.i is null) as kept
  from x left join g on x.doc_id = g.doc_id and x.i = g.i group by x.doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(j.gone, 0) as n_removed, sha256(coalesce(j.kept, '')) as kept_sha256
from w left join j on w.doc_id = j.doc_id""",
}
