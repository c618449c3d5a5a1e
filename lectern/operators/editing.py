"""Editing collections: references, reachability, what to keep, dangling links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T

def references(docs: DataFrame, html: str = "html", css: bool = False, base: str | None = None) -> DataFrame:
    """One row per reference: the columns of ``docs`` but the markup, and href; empty, fragment-only and external ones
    are left out. With ``base`` (a column: the path of the document) also target, the path that the href leads to."""
    c = F.col(html)
    found = lambda pattern: F.regexp_extract_all(c, F.lit(pattern), 1)
    in_css = F.transform(found(rules.CSS_URL_PATTERN), lambda x: F.regexp_replace(x, r"""^["']+|["']+$""", ""))
    in_sets = F.flatten(F.transform(found(rules.SRCSET_PATTERN), lambda s: F.transform(F.split(s, ","), lambda p: F.regexp_extract(F.trim(p), r"^\S*", 0))))
    refs = in_css if css else F.concat(F.flatten(F.array(*map(found, rules.REFERENCE_PATTERNS))), in_sets, in_css)
    rest = [x for x in docs.columns if x != html]
    out = docs.select(*rest, F.explode(refs).alias("href")).withColumn("href", F.trim("href"))
    out = out.where((F.col("href") != "") & ~F.col("href").startswith("#") & ~T.is_external(F.col("href")))
    return out if base is None else out.withColumn("target", T.resolve_href(T.folder(F.col(base)), F.col("href"))).where("target <> ''")


def resources(start: DataFrame, files: DataFrame, checkpoint) -> DataFrame:
    """(book_id, path) of everything that the documents ``start`` (book_id, path) refer to: their references, then those of
    every style sheet among these that exists in ``files`` (book_id, path, html: documents and style sheets), and on.
    Nothing but style sheets is followed. Sheets that import each other end the search."""
    pages = files.join(start.select("book_id", "path").distinct(), ["book_id", "path"], "left_semi")
    of_pages = checkpoint(references(pages.select("book_id", "path", "html"), base="path").select("book_id", F.col("target").alias("path")).distinct())
    sheets = files.where(F.lower("path").endswith(".css"))
    edges = checkpoint(references(sheets.select("book_id", F.col("path").alias("src"), "html"), css=True, base="src").select("book_id", "src", F.col("target").alias("dst")).distinct())
    return closure(of_pages.withColumnRenamed("path", "node"), edges, checkpoint).withColumnRenamed("node", "path")


def closure(start: DataFrame, edges: DataFrame, checkpoint) -> DataFrame:
    """All nodes reachable from ``start`` (book_id, node) over ``edges`` (book_id, src, dst), the start included. Each
    round follows only what the round before found, so cycles end, and rounds are as many as the longest shortest path. ``checkpoint``: DataFrame -> DataFrame, cuts lineage."""
    keys = ["book_id", "node"]
    seen = checkpoint(start.select(*keys).distinct())
    new = seen
    while True:
        step = new.withColumnRenamed("node", "src").join(edges, ["book_id", "src"]).select("book_id", F.col("dst").alias("node")).distinct()
        new = checkpoint(step.join(seen, keys, "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpoint(seen.union(new))


def keep_manifest(items: DataFrame, prune_all: bool = False) -> DataFrame:
    """Items (forced, dropped, referenced, is_image flags) that stay: forced ids first, then never a dropped path, then
    what is referenced, then anything that is no image."""
    rest = F.lit(False) if prune_all else ~F.col("is_image")
    return items.where(F.when(F.col("forced"), True).when(F.col("dropped"), False).when(F.col("referenced"), True).otherwise(rest))


def forced(manifest: DataFrame, kept_spine: DataFrame, covers: DataFrame) -> DataFrame:
    """(book_id, id) that stay whatever happens: kept spine ids, navigation documents, NCX files and covers."""
    props, ids = F.col("properties"), manifest.select("book_id", "id", "properties", "media_type")
    own = ids.where(F.array_contains(props, "nav") | F.array_contains(props, "cover-image") | (F.col("media_type") == "application/x-dtbncx+xml"))
    return own.select("book_id", "id").union(kept_spine.select("book_id", F.col("idref").alias("id"))).union(covers.select("book_id", "id")).distinct()


def keep_guide(pointers: DataFrame, kept: DataFrame) -> DataFrame:
    """Guide references (book_id, href, path, ...) that stay: external ones, and those whose path is kept."""
    inside = pointers.where(~T.is_external(F.col("href"))).join(kept.select("book_id", "path").distinct(), ["book_id", "path"], "left_semi")
    return inside.unionByName(pointers.where(T.is_external(F.col("href"))))


def find_images(links: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, folder, href, path): where an image of a Markdown document in ``folder`` is: the first of five places that
    exists in ``files`` (book_id, path), else the first file of that name below the folder, else null (it stays as it is).
    External and absolute hrefs are left out."""
    rows = links.where(~F.col("href").rlike("^(?:https?://|/)")).select("book_id", "folder", "href").distinct()
    name, last = F.regexp_extract("href", r"[^/]*$", 0), F.regexp_extract("folder", r"[^/]*$", 0)
    # fixed values: the places, in order
    places = [F.col("href"), name, F.concat(F.lit("assets/"), name), F.concat(last, F.lit("/assets/"), name), F.concat(F.lit("_tmp/assets/"), name)]
    tried = rows.select("*", F.posexplode(F.array(*(T.normal_path(F.concat("folder", F.lit("/"), p)) for p in places))).alias("rank", "path"))
    direct = tried.join(files.select("book_id", "path").distinct(), ["book_id", "path"])
    named = rows.withColumn("name", name).join(files.select("book_id", "path", F.regexp_extract("path", r"[^/]*$", 0).alias("name")), ["book_id", "name"])
    below = named.where(F.startswith("path", F.concat("folder", F.lit("/")))).select("book_id", "folder", "href", "path", F.lit(len(places)).alias("rank"))
    best = direct.select(below.columns).union(below).groupBy("book_id", "folder", "href").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return rows.join(best, ["book_id", "folder", "href"], "left")


def nearest(rows: DataFrame, hints: DataFrame, key: str, place: str = "place", hint: str = "hint") -> DataFrame:
    """For each hint the row of its key that is nearest, the earlier one of two."""
    both = hints.join(rows, key)
    return both.groupBy(*hints.columns).agg(F.min_by(place, F.struct(F.abs(F.col(place) - F.col(hint)), F.col(place))).alias(place))


def dangling(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links (book_id, path, ...) whose target isn't kept (book_id, path)."""
    return links.join(kept.select("book_id", "path").distinct(), ["book_id", "path"], "left_anti")


def tail_guard(rest_bytes, all_bytes):
    """Whether too little would remain for a cut to be right."""
    return (rest_bytes < rules.TAIL_LEAST_BYTES) | (rest_bytes < rules.TAIL_LEAST_SHARE * all_bytes)
