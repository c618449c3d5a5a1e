"""Queries over web pages: a page is a document, its host a book, page_id the reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import books, catalog, editing, markup, masking
from ..sources import options
from ..store import spread
from .base import table, written

HOST, PATH, STEM = r"^[a-z]+://([^/:?#]+)", r"^[a-z]+://[^/?#]+(/[^/?#]*)", r"^[a-z]+://[^/?#]+([^?#]*)"
SCRIPTS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return spread(table(spark, sf_dir, "pages")).select(
        "page_id", F.regexp_extract(url, HOST, 1).alias("book_id"), F.regexp_extract(url, PATH, 1).alias("path"), F.regexp_extract(url, STEM, 1).alias("file"), F.coalesce("html", F.lit("")).alias("html")
    )


def _strip(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '{SCRIPTS}', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&[#a-zA-Z0-9]{{1,8}};', ' ', 'g'), '\s+', ' ', 'g'))"""


_P = f"""p as (
  select page_id, regexp_extract(url, '{HOST}', 1) as book_id, regexp_extract(url, '{PATH}', 1) as path,
    regexp_extract(url, '{STEM}', 1) as file, coalesce(html, '') as html
  from pages)"""
_HEAD = _strip(r"array_to_string(regexp_extract_all(html, '(?is)<h[1-6]\b.*?</h[1-6]\s*>'), ' ')")
_LINKS = _strip(r"array_to_string(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a\s*>'), ' ')")
_M = f"""{_P},
m as (select *, length({_strip('html')}) as text_len, length({_HEAD}) as heading_len, length({_LINKS}) as link_len from p)"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {_P} select page_id, length({_strip('html')}) as text_len, md5({_strip('html')}) as text_md5 from p")
def html_strip(spark, sf_dir):
    text = T.strip_markup(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.length(text).cast("long").alias("text_len"), F.md5(text).alias("text_md5"))


def measured(spark, sf_dir) -> DataFrame:
    html = F.col("html")
    return pages(spark, sf_dir).select("*", *(F.length(f(html)).cast("long").alias(n) for n, f in (("text_len", T.strip_markup), ("heading_len", T.heading_text), ("link_len", T.link_text))))


@query(f"""with {_M} select page_id, length(html) as size, text_len, heading_len, link_len,
  round(link_len / greatest(text_len, 1), 6) as link_ratio, link_len / greatest(text_len, 1) >= {rules.CONTENTS_LEAST_LINKS} as like_contents from m""")
def page_metrics(spark, sf_dir):
    ratio = T.link_ratio(F.col("link_len"), F.col("text_len"))
    return measured(spark, sf_dir).select("page_id", F.length("html").cast("long").alias("size"), "text_len", "heading_len", "link_len", F.round(ratio, 6).alias("link_ratio"), (ratio >= rules.CONTENTS_LEAST_LINKS).alias("like_contents"))


_INLINE = ", ".join(f"'{t}'" for t in rules.INLINE_TAGS)


@query(rf"""with {_P}, t as (
  select page_id, list_filter(list_transform(regexp_extract_all(substr(regexp_replace(html, '(?is)^.*?<body\b[^>]*>', ''), 1, {rules.STRUCTURE_WINDOW}),
    '<([a-zA-Z][\w:-]*)\b[^>]*>', 1), lambda x: lower(x)), lambda x: x not in ({_INLINE}))[1:{rules.STRUCTURE_RANK}] as tags from p)
select page_id, array_to_string(tags, ' ') as tags, '' as types from t""")
def structural_tags(spark, sf_dir):
    after = F.regexp_replace("html", r"(?is)^.*?<body\b[^>]*>", "")
    names = F.transform(F.regexp_extract_all(F.substring(after, 1, rules.STRUCTURE_WINDOW), F.lit(r"<([a-zA-Z][\w:-]*)\b[^>]*>"), 1), F.lower)
    tags = F.slice(F.filter(names, lambda t: ~t.isin(rules.INLINE_TAGS)), 1, rules.STRUCTURE_RANK)
    return pages(spark, sf_dir).select("page_id", F.array_join(tags, " ").alias("tags"), F.array_join(T.structural_types(F.col("html")), " ").alias("types"))


_NAMES = r"trim(regexp_replace(lower('page ' || regexp_replace(regexp_extract(file, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')), '[^a-z0-9]+', ' ', 'g'))"


def _named(table_) -> str:
    return "case " + " ".join(f"when regexp_matches(' ' || names || ' ', ' (?:{p})\\d* ') then '{label}'" for p, label in table_) + " end"


@query(f"with {_P}, n as (select page_id, {_NAMES} as names from p) select page_id, names, coalesce({_named(rules.NAME_RULES)}, {_named(rules.SHORT_RULES)}, '') as label from n")
def url_name_tokens(spark, sf_dir):
    names = pages(spark, sf_dir).select("page_id", T.name_tokens(F.lit("page"), F.col("file")).alias("names"))
    found = [F.when(T.name_matches(F.col("names"), p), label) for p, label in [*rules.NAME_RULES, *rules.SHORT_RULES]]
    return names.select("page_id", "names", F.coalesce(*found, F.lit("")).alias("label"))


_SPINE = "cast(row_number() over (partition by book_id order by page_id) - 1 as integer) as spine_index"


@query(f"with {_P} select page_id, book_id, {_SPINE} from p")
def spine_order(spark, sf_dir):
    return catalog.number_in_order(pages(spark, sf_dir).select("page_id", "book_id"), "book_id", ["page_id"])


_HREF = r"""unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1)) as href"""
_L = rf"""l as (select page_id, book_id, path, href from (select page_id, book_id, path, {_HREF} from p)
  where trim(href) <> '' and href not like '#%' and href not like '//%' and not regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.\-]*:'))"""


def links(spark, sf_dir) -> DataFrame:
    return editing.references(pages(spark, sf_dir).select("page_id", "book_id", "path", "html"))


@query(f"with {_P}, {_L} select page_id, href, count(*) as n from l group by page_id, href")
def link_edges(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_P}, {_L} select book_id, href as path, arg_min(path, page_id) as first_from from l group by book_id, href")
def pointer_first_wins(spark, sf_dir):
    rows = links(spark, sf_dir).select("book_id", F.lit("link").alias("kind"), F.col("page_id").alias("pos"), F.col("path").alias("type"), F.col("href").alias("path"))
    return catalog.first_pointer(rows).select("book_id", "path", F.col("type").alias("first_from"))


# a page's declared roles stand in for what an archive would say; all pages have them
_ROLES = """case when page_id % 5 = 0 then 'chapter' when page_id % 11 = 0 then 'frontmatter' when page_id % 13 = 0 then 'part' when page_id % 19 = 1 then 'epigraph' else '' end as own,
  case page_id % 7 when 0 then 'cover' when 1 then 'toc' when 2 then 'preface' end as guide_type,
  case when page_id % 17 = 3 then 'bodymatter' when page_id % 6 = 5 then 'toc' end as landmark_type"""


def classified(spark, sf_dir) -> DataFrame:
    rows = measured(spark, sf_dir).select("*", F.expr("case when page_id % 5 = 0 then 'chapter' when page_id % 11 = 0 then 'frontmatter' when page_id % 13 = 0 then 'part' when page_id % 19 = 1 then 'epigraph' else '' end").alias("own"))
    rows = rows.select(
        "page_id", "book_id", "path", F.col("page_id").cast("string").alias("idref"), "text_len", "heading_len", T.link_ratio(F.col("link_len"), F.col("text_len")).alias("link_ratio"),
        F.filter(F.array("own"), lambda x: x != "").alias("epub_types"), F.array().cast("array<string>").alias("properties"), T.name_tokens(F.lit("page"), F.col("file")).alias("names"),
        F.expr("case page_id % 7 when 0 then 'cover' when 1 then 'toc' when 2 then 'preface' end").alias("guide_type"),
        F.expr("case when page_id % 17 = 3 then 'bodymatter' when page_id % 6 = 5 then 'toc' end").alias("landmark_type"),
    )
    rows = catalog.classify(catalog.number_in_order(rows, "book_id", ["page_id"])).withColumn("divider", catalog.part_divider())
    first = lambda c: F.min(F.when(c, F.col("spine_index"))).over(Window.partitionBy("book_id"))
    return rows.withColumn("landmark_body", first(F.col("landmark_type") == "bodymatter")).withColumn("guide_body", first(F.col("page_id") % 10 == 4))


_TOC = f"link_ratio >= {rules.CONTENTS_LEAST_LINKS}"
_C = f"""{_M},
r as (select *, {_ROLES}, link_len / greatest(text_len, 1) as link_ratio, {_NAMES} as names, {_SPINE} from m),
a as (select *, case
  when own in ('chapter') then null
  when landmark_type = 'toc' and {_TOC} then 'landmarks|table of contents'
  when guide_type = 'cover' then 'guide|cover'
  when guide_type = 'preface' then 'guide|preface'
  when guide_type = 'toc' and {_TOC} then 'guide|table of contents'
  when own = 'epigraph' then 'type|epigraph'
  when landmark_type = 'bodymatter' then null
  when text_len <= {rules.NAME_MOST_TEXT} and {_named(rules.NAME_RULES)} is not null then 'name|' || {_named(rules.NAME_RULES)}
  when text_len <= {rules.SHORT_MOST_TEXT} and {_named(rules.SHORT_RULES)} is not null then 'short name|' || {_named(rules.SHORT_RULES)}
  when own = 'frontmatter' and text_len <= {rules.TINY_MOST_TEXT} then 'tiny|front matter' end as hit,
  text_len <= {rules.DIVIDER_MOST_TEXT} and text_len - heading_len <= {rules.DIVIDER_MOST_BODY}
    and (own = 'part' or (regexp_matches(' ' || names || ' ', ' (?:part|section|book|division)\\d* ') and heading_len > 0)) as divider from r),
b as (select *, hit is not null or divider as front, min(case when landmark_type = 'bodymatter' then spine_index end) over (partition by book_id) as lb,
  min(case when page_id % 10 = 4 then spine_index end) over (partition by book_id) as gb from a),
c as (select *, max(case when spine_index = lb and not front then lb end) over (partition by book_id) as l,
  max(case when spine_index = gb and not front then gb end) over (partition by book_id) as g,
  min(case when not front then spine_index end) over (partition by book_id) as f, count(*) over (partition by book_id) as n from b),
d as (select *, cast(coalesce(l, g, f, n) as integer) as body_index, case when l is not null then 'landmarks' when g is not null then 'guide' when f is not null then 'first unclassified' else 'none' end as body_layer from c),
e as (select *, case when spine_index < body_index then front or (body_layer = 'landmarks' and text_len <= {rules.UNCLASSIFIED_MOST_TEXT}) else divider end as excluded from d)"""


@query(f"""with {_C} select page_id, book_id, spine_index, split_part(hit, '|', 1) as layer, split_part(hit, '|', 2) as label, excluded,
  case when not excluded then 'kept' when hit is not null then split_part(hit, '|', 2) when divider then 'part divider' else 'before the body' end as reason from e""")
def front_decisions(spark, sf_dir):
    return catalog.decide(classified(spark, sf_dir)).select("page_id", "book_id", "spine_index", "layer", "label", "excluded", "reason")


@query(f"with {_C} select book_id, count(*) as n_docs, min(body_index) as body_index, min(body_layer) as body_layer, count(*) filter (excluded) as n_excluded from e group by book_id")
def body_start(spark, sf_dir):
    return catalog.decide(classified(spark, sf_dir)).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("body_index").alias("body_index"), F.min("body_layer").alias("body_layer"), F.count_if("excluded").alias("n_excluded"))


@query(f"with {_C} select book_id, page_id, cast(row_number() over (partition by book_id order by page_id) - 1 as integer) as position from e where not excluded")
def trim_exclude(spark, sf_dir):
    rows = catalog.decide(classified(spark, sf_dir))
    kept = catalog.trim(rows.select("book_id", "idref", "page_id"), rows.where("excluded"))
    return catalog.number_in_order(kept, "book_id", ["page_id"], "position").select("book_id", "page_id", "position")


@query(f"""with {_C} select book_id, cast(page_id as varchar) as idref, cast(row_number() over (partition by book_id order by page_id) - 1 as integer) as position
from e where excluded or page_id % 9 <> 4""")
def restore_order(spark, sf_dir):
    """Of what isn't excluded a ninth was lost in between, so anchors are missing."""
    rows = written(catalog.decide(classified(spark, sf_dir)).select("page_id", "book_id", "idref", "spine_index", "excluded"))
    gone = rows.where("excluded").select("book_id", "idref")
    return catalog.restore(rows.select("book_id", "idref", "spine_index"), rows.where("not excluded and page_id % 9 <> 4").select("book_id", "idref", "spine_index"), gone)


@query(f"""with {_P}, s as (select book_id, page_id, {_SPINE} from p) select book_id, page_id, spine_index from s where spine_index in (0, 1, 2, 5)""")
def spine_selection(spark, sf_dir):
    spine = catalog.number_in_order(pages(spark, sf_dir).select("page_id", "book_id", F.col("page_id").cast("string").alias("idref")), "book_id", ["page_id"])
    return books.select_spine(spine, options.index_ranges("0-2,5", 6)).select("book_id", "page_id", "spine_index")


@query(f"""with {_P}, {_L}, k as (select distinct book_id, path from p)
select l.page_id, count(*) as n_links, count(*) filter (k.path is null) as n_dangling
from l left join k on l.book_id = k.book_id and l.href = k.path group by l.page_id""")
def dangling_by_doc(spark, sf_dir):
    rows = links(spark, sf_dir).select("page_id", "book_id", F.col("href").alias("path"))
    gone = editing.dangling(rows, pages(spark, sf_dir)).groupBy("page_id").agg(F.count(F.lit(1)).alias("d"))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links")).join(gone, "page_id", "left").select("page_id", "n_links", F.coalesce("d", F.lit(0)).cast("long").alias("n_dangling"))


@query(f"""with {_P}, {_L}, i as (select book_id, path, 'page' as kind from p union select book_id, href, 'link' from l),
f as (select book_id, path, min(kind) = 'link' as is_image, count(*) = 2 as referenced from i group by book_id, path),
g as (select book_id, path, bool_or(page_id % 3 = 0) as forced, bool_and(page_id % 4 = 1) as dropped from p group by book_id, path)
select f.book_id, f.path, case when coalesce(forced, false) then true when coalesce(dropped, false) then false when referenced then true else not is_image end as kept
from f left join g on f.book_id = g.book_id and f.path = g.path""")
def manifest_keep(spark, sf_dir):
    page = pages(spark, sf_dir)
    both = page.select("book_id", "path", F.lit("page").alias("kind")).union(links(spark, sf_dir).select("book_id", "href", F.lit("link"))).distinct()
    flags = both.groupBy("book_id", "path").agg((F.min("kind") == "link").alias("is_image"), (F.count(F.lit(1)) == 2).alias("referenced"))
    own = page.groupBy("book_id", "path").agg(F.bool_or(F.expr("page_id % 3 = 0")).alias("forced"), F.bool_and(F.expr("page_id % 4 = 1")).alias("dropped"))
    items = flags.join(own, ["book_id", "path"], "left").na.fill(False, ["forced", "dropped"])
    kept = editing.keep_manifest(items).select("book_id", "path", F.lit(True).alias("k"))
    return items.join(kept, ["book_id", "path"], "left").select("book_id", "path", F.coalesce("k", F.lit(False)).alias("kept"))


@query(f"""with recursive {_P}, {_L}, e as (select distinct book_id, path as src, href as dst from l),
s as (select book_id, arg_min(path, page_id) as node from p group by book_id),
c as (select book_id, node from s union select e.book_id, e.dst from c join e on c.book_id = e.book_id and c.node = e.src)
select book_id, node from c""")
def ref_closure(spark, sf_dir):
    edges = links(spark, sf_dir).select("book_id", F.col("path").alias("src"), F.col("href").alias("dst")).distinct()
    start = pages(spark, sf_dir).groupBy("book_id").agg(F.min_by("path", "page_id").alias("node"))
    return editing.closure(start, written(edges), written)


@query(rf"""with {_P}, n as (select page_id, book_id, len(regexp_extract_all(html, '(?i)<li\b')) as n from p)
select page_id, book_id, n as n_items, cast(coalesce(sum(n) over (partition by book_id order by page_id rows between unbounded preceding and 1 preceding), 0) + 1 as bigint) as first_no from n where n > 0""")
def nav_renumber(spark, sf_dir):
    found = masking.occurrences(pages(spark, sf_dir), r"(?i)<li\b", "book_id", ["page_id"])
    return found.groupBy("page_id", "book_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("idx").cast("long").alias("first_no"))


_NUMBERED = rf"""o as (select page_id, book_id, unnest(regexp_extract_all(html, '{SCRIPTS}')) as original, generate_subscripts(regexp_extract_all(html, '{SCRIPTS}'), 1) as nth from p),
i as (select book_id, page_id, cast(row_number() over (partition by book_id order by page_id, nth) as integer) as idx, original from o)"""


@query(f"with {_P}, {_NUMBERED} select book_id, page_id, idx, printf('[[CODE%05d]]', idx) as token, md5(original) as original_md5 from i")
def placeholder_numbering(spark, sf_dir):
    found = masking.occurrences(pages(spark, sf_dir), SCRIPTS, "book_id", ["page_id"])
    return found.select("book_id", "page_id", "idx", F.format_string("[[CODE%05d]]", "idx").alias("token"), F.md5("original").alias("original_md5"))


@query(f"""with {_P}, {_NUMBERED}, b as (select book_id, idx, case idx % 5 when 0 then 0 when 1 then 2 else 1 end as times from i)
select book_id, count(*) as placeholders, cast(sum(times) as bigint) as occurrences, count(*) filter (times > 0) as restored, count(*) filter (times = 0) as lost from b group by book_id""")
def restore_coverage(spark, sf_dir):
    mapping = masking.occurrences(pages(spark, sf_dir), SCRIPTS, "book_id", ["page_id"]).select("book_id", "idx")
    back = mapping.select("book_id", "idx", F.expr("explode(array_repeat(1, case idx % 5 when 0 then 0 when 1 then 2 else 1 end))").alias("x"))
    return masking.completeness(mapping, back)


@query(f"""with {_P}, s as (select page_id, strlen(html) as bytes, strlen(regexp_replace(html, '(?is)<footer\\b.*$', '')) as rest from p)
select page_id, bytes, rest as rest_bytes, rest < {rules.TAIL_LEAST_BYTES} or rest < {rules.TAIL_LEAST_SHARE} * bytes as keep_whole from s""")
def ref_guard(spark, sf_dir):
    rest = F.octet_length(F.regexp_replace("html", r"(?is)<footer\b.*$", ""))
    rows = pages(spark, sf_dir).select("page_id", F.octet_length("html").cast("long").alias("bytes"), rest.cast("long").alias("rest_bytes"))
    return rows.withColumn("keep_whole", editing.tail_guard(F.col("rest_bytes"), F.col("bytes")))


@query(f"""with {_P}, h as (select page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6]\\b.*?</h[1-6]\\s*>')) as h, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6]\\b.*?</h[1-6]\\s*>'), 1) as pos from p)
select page_id, arg_min({_strip('h')}, substr(h, 3, 1) || lpad(cast(pos as varchar), 9, '0')) as heading from h group by page_id""")
def first_heading(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6]\b.*?</h[1-6]\s*>"), 0)).alias("pos", "h"))
    return rows.groupBy("page_id").agg(F.min_by(T.strip_markup(F.col("h")), F.struct(F.substring("h", 3, 1), "pos")).alias("heading"))


@query(rf"""with {_P} select page_id, length(regexp_replace(html, '(?is)<annotation\b.*?</annotation\s*>|<!--.*?-->', '', 'g')) as left_chars,
  len(regexp_extract_all(html, '<!--')) as n_comments from p""")
def strip_annotations(spark, sf_dir):
    bare = F.regexp_replace("html", r"(?is)<annotation\b.*?</annotation\s*>|<!--.*?-->", "")
    return pages(spark, sf_dir).select("page_id", F.length(bare).cast("long").alias("left_chars"), F.regexp_count("html", F.lit("<!--")).cast("long").alias("n_comments"))


@query()
def html_text(spark, sf_dir):
    text = pages(spark, sf_dir).select("page_id", T.html_to_text(F.col("html")).alias("text"))
    return text.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query(rf"""with {_P} select book_id, page_id, cast(len(regexp_extract_all(html, '(?is)<script\b.*?</script\s*>')) as bigint) as n_masked, true as identical from p""")
def mask_round_trip(spark, sf_dir):
    """Scripts as code elements, masked in whole books and put back."""
    docs = pages(spark, sf_dir).select("book_id", F.format_string("%012d", "page_id").alias("path"), F.regexp_replace("html", r"(?i)(</?)script\b", "$1code").alias("html"))
    hidden = written(masking.mask_books(docs, written, "code"))
    back = masking.unmask_books(hidden).select("book_id", "path", F.col("html").alias("again"), "restored")
    both = back.join(docs.withColumnRenamed("html", "was"), ["book_id", "path"])
    return both.select("book_id", F.col("path").cast("long").alias("page_id"), F.size("restored").cast("long").alias("n_masked"), (F.col("again") == F.col("was")).alias("identical"))


_KEPT = "k as (select distinct book_id, path from p where page_id % 3 <> 0)"


@query(rf"""with {_P}, {_KEPT}, a as (select page_id, book_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a\s*>')) as a from p),
h as (select page_id, book_id, regexp_extract(a, '\bhref\s*=\s*"([^"]*)"', 1) as href, strlen(a) - strlen(regexp_replace(regexp_replace(a, '(?is)^<a\b[^>]*>', ''), '(?i)</a\s*>$', '')) as shorter from a),
d as (select h.page_id, count(*) as n, sum(shorter) as bytes from h left join k on h.book_id = k.book_id and split_part(h.href, '#', 1) = k.path
  where h.href <> '' and h.href not like '#%' and h.href not like '//%' and not regexp_matches(h.href, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') and k.path is null group by h.page_id)
select p.page_id, cast(coalesce(n, 0) as bigint) as n_degraded, cast(strlen(html) - coalesce(bytes, 0) as bigint) as bytes_after from p left join d on p.page_id = d.page_id""")
def degraded_links(spark, sf_dir):
    """Links to the third of the pages that is cut are replaced by their text, each page with what its host keeps."""
    page = pages(spark, sf_dir)
    kept = page.where("page_id % 3 <> 0").groupBy("book_id").agg(F.collect_set("path").alias("kept"))
    rows = page.select("page_id", "book_id", "path", "html").join(kept, "book_id", "left")

    def run(frames):
        for f in frames:
            made = [markup.degrade_links(p, h, () if k is None else k) for p, h, k in zip(f["path"], f["html"], f["kept"], strict=True)]
            yield pd.DataFrame({"page_id": f["page_id"], "n_degraded": [m[1] for m in made], "bytes_after": [len(m[0].encode()) for m in made]})

    return rows.select("page_id", "path", "html", "kept").mapInPandas(run, "page_id long, n_degraded long, bytes_after long")


@query(f"with {_P}, {_L}, {_KEPT} select l.book_id, count(*) as n_references from l join k on l.book_id = k.book_id and l.href = k.path group by l.book_id")
def guide_keep(spark, sf_dir):
    kept = pages(spark, sf_dir).where("page_id % 3 <> 0")
    return editing.keep_guide(links(spark, sf_dir).select("book_id", "href", F.col("href").alias("path")), kept).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_references"))


@query(f"""with {_P}, {_L}, k as (select distinct book_id, path from p), d as (select l.book_id, l.page_id from l left join k on l.book_id = k.book_id and l.href = k.path where k.path is null)
select coalesce(book_id, '') as book_id, count(*) as n_dangling, count(distinct page_id) as n_pages from d group by rollup (book_id)""")
def dangling_totals(spark, sf_dir):
    gone = editing.dangling(links(spark, sf_dir).select("page_id", "book_id", F.col("href").alias("path")), pages(spark, sf_dir))
    return gone.rollup("book_id").agg(F.count(F.lit(1)).alias("n_dangling"), F.countDistinct("page_id").alias("n_pages")).na.fill("", ["book_id"])


@query(rf"""with {_P}, r as (select page_id, regexp_replace(html, '(?i)<(h[1-6]|p|div|ul)\b', '<\1 role="R-\1 x" data-type="\1"', 'g') as html from p),
t as (select page_id, list_filter(list_transform(regexp_extract_all(substr(regexp_replace(html, '(?is)^.*?<body\b[^>]*>', ''), 1, {rules.STRUCTURE_WINDOW}),
    '<([a-zA-Z][\w:-]*)\b[^>]*>', 1), lambda x: lower(x)), lambda x: x not in ({_INLINE}))[1:{rules.STRUCTURE_RANK}] as tags from r)
select page_id, array_to_string(list_sort(list_distinct(flatten(list_transform(tags, lambda t: case when regexp_matches(t, '^(h[1-6]|p|div|ul)$') then [t, 'r-' || t, 'x'] else [] end)))), ' ') as types from t""")
def structural_types(spark, sf_dir):
    html = F.regexp_replace("html", r"(?i)<(h[1-6]|p|div|ul)\b", '<$1 role="R-$1 x" data-type="$1"')
    return pages(spark, sf_dir).select("page_id", F.array_join(F.array_sort(T.structural_types(html)), " ").alias("types"))


@query(f"""with {_P}, {_L}, h as (select page_id, length(html) / 2 as hint, html from p), x as (select page_id, hint, unnest(generate_series(0, 9)) * length(html) // 9 as place from h)
select page_id, arg_min(place, (abs(place - hint), place)) as place from x group by page_id""")
def nearest_place(spark, sf_dir):
    page = pages(spark, sf_dir).select("page_id", F.length("html").alias("n"))
    places = page.select("page_id", F.explode(F.expr("transform(sequence(0, 9), i -> bigint(i * n div 9))")).alias("place"))
    return editing.nearest(places, page.select("page_id", (F.col("n") / 2).alias("hint")), "page_id").select("page_id", "place")


@query(f"""with {_P}, {_L}, f as (select distinct book_id, path from p where path <> '/'), r as (select distinct book_id, substr(href, 2) as href from l),
c as (select r.book_id, r.href, unnest([1, 2, 3, 4, 5]) as rank, unnest(['/' || r.href, '/' || regexp_extract(r.href, '[^/]*$'), '/assets/' || regexp_extract(r.href, '[^/]*$'), '/assets/' || regexp_extract(r.href, '[^/]*$'),
  '/_tmp/assets/' || regexp_extract(r.href, '[^/]*$')]) as path from r where r.href <> '' and r.href not like '%/' and r.href not like '/%'),
b as (select c.book_id, c.href, c.path, c.rank from c join f on c.book_id = f.book_id and c.path = f.path
  union all select r.book_id, r.href, f.path, 6 from r join f on r.book_id = f.book_id and regexp_extract(f.path, '[^/]*$') = regexp_extract(r.href, '[^/]*$'))
select c.book_id, c.href, coalesce(min(b.p), '') as path from (select distinct book_id, href from c) c left join (select book_id, href, arg_min(path, (rank, path)) as p from b group by book_id, href) b
on c.book_id = b.book_id and c.href = b.href group by c.book_id, c.href""")
def image_places(spark, sf_dir):
    hrefs = links(spark, sf_dir).select("book_id", F.lit("").alias("folder"), F.expr("substr(href, 2)").alias("href")).where("href <> '' and href not like '%/' and href not like '/%'")
    found = editing.find_images(hrefs, pages(spark, sf_dir).where("path <> '/'"))
    return found.select("book_id", "href", F.coalesce("path", F.lit("")).alias("path"))


@query(f"with {_P}, {_L} select count(*) as n_links, count(distinct href) as n_targets, count(distinct page_id) as n_pages from l")
def link_totals(spark, sf_dir):
    return links(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("href").alias("n_targets"), F.countDistinct("page_id").alias("n_pages"))
