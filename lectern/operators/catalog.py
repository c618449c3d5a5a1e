"""Ordered collections: reading order, pointers, front-matter classification, body start and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from .ordering import number_globally


def number_in_order(docs: DataFrame, book: str, order: list[str], name: str = "spine_index", start: int = 0) -> DataFrame:
    """Gapless numbers in a book's order."""
    return docs.withColumn(name, (F.row_number().over(Window.partitionBy(book).orderBy(*order)) - 1 + start).cast("int"))


def join_manifest(spine: DataFrame, manifest: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Spine entries with what the manifest says of their id; of a repeated id the last entry counts. Unknown ids go,
    or stay without a path (``keep_unknown``)."""
    last = manifest.groupBy("book_id", "id").agg(F.max_by(F.struct(*(c for c in manifest.columns if c not in ("book_id", "id"))), "pos").alias("m"))
    return spine.join(last.withColumnRenamed("id", "idref"), ["book_id", "idref"], "left" if keep_unknown else "inner").select(*spine.columns, "m.*")


def first_pointer(pointers: DataFrame) -> DataFrame:
    """(book_id, kind, path, type): the first type that names a path."""
    return pointers.groupBy("book_id", "kind", "path").agg(F.min_by("type", "pos").alias("type"))


def _label(types: Column, table: dict[str, str]) -> Column:
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return lookup[types]


def classify(docs: DataFrame, tolerant_names: bool = False) -> DataFrame:
    """Adds layer and label (both null: not front matter), by the first rule that holds.

    Needs epub_types, guide_type, landmark_type, properties, names, text_len, link_ratio. ``tolerant_names``: a space in
    a name may also stand for the separators of the patterns."""
    contents = F.col("link_ratio") >= rules.CONTENTS_LEAST_LINKS
    believed = lambda label: F.when((label != rules.CONTENTS) | contents, label)
    own = F.array_sort(F.col("epub_types"))
    of_types = F.filter(F.transform(own, lambda t: believed(_label(t, rules.STRUCTURE_LABELS))), lambda x: x.isNotNull())
    pattern = lambda p: p.replace("[-_]?", "[-_ ]?") if tolerant_names else p
    named = lambda table: F.coalesce(*(F.when(T.name_matches(F.col("names"), pattern(p)), believed(F.lit(label))) for p, label in table))
    veto = F.arrays_overlap("epub_types", F.array(*map(F.lit, rules.BODY_TYPES)))
    short = lambda n: F.col("text_len") <= n
    layers = [
        ("landmarks", believed(_label(F.col("landmark_type"), rules.STRUCTURE_LABELS))),
        ("guide", believed(_label(F.col("guide_type"), rules.GUIDE_LABELS))),
        ("type", F.get(of_types, F.lit(0))),
        ("", F.when(F.col("landmark_type") == "bodymatter", F.lit(""))),
        ("nav", F.when(F.array_contains("properties", "nav"), F.lit(rules.CONTENTS))),
        ("name", F.when(short(rules.NAME_MOST_TEXT), named(rules.NAME_RULES))),
        ("short name", F.when(short(rules.SHORT_MOST_TEXT), named(rules.SHORT_RULES))),
        ("tiny", F.when(F.array_contains("epub_types", "frontmatter") & short(rules.TINY_MOST_TEXT), F.lit("front matter"))),
    ]
    first = F.coalesce(*(F.when(label.isNotNull(), F.struct(F.lit(name).alias("layer"), label.alias("label"))) for name, label in layers))
    found = docs.withColumn("_c", F.when(~F.coalesce(veto, F.lit(False)), first))
    kept = F.col("_c.layer") != ""
    return found.withColumn("layer", F.when(kept, F.col("_c.layer"))).withColumn("label", F.when(kept, F.col("_c.label"))).drop("_c")


def part_divider() -> Column:
    """A page that is a part's heading and little else. Needs epub_types, names, text_len, heading_len."""
    typed = F.array_contains("epub_types", "part")
    named = T.name_matches(F.col("names"), "part|section|book|division")
    small = (F.col("text_len") <= rules.DIVIDER_MOST_TEXT) & (F.col("text_len") - F.col("heading_len") <= rules.DIVIDER_MOST_BODY)
    return small & (typed | (named & (F.col("heading_len") > 0)))


def decide(docs: DataFrame, keep_ids: list[str] = ()) -> DataFrame:
    """Adds body_index, body_layer, excluded and reason to classified documents with spine_index and divider.

    ``landmark_body`` and ``guide_body`` (spine indexes named as the body's start, null if none) are believed unless the
    document that they name is classified. Before the start go classified documents and, if landmarks named it, short
    ones; after it part dividers alone. Identifiers in ``keep_ids`` stay."""
    book = Window.partitionBy("book_id")
    classified = F.col("layer").isNotNull() | F.col("divider")
    is_front = docs.withColumn("_front", classified)
    trusted = lambda c: F.max(F.when((F.col("spine_index") == F.col(c)) & ~F.col("_front"), F.col(c))).over(book)
    first = F.min(F.when(~F.col("_front"), F.col("spine_index"))).over(book)
    out = is_front.withColumn("_l", trusted("landmark_body")).withColumn("_g", trusted("guide_body")).withColumn("_f", first).withColumn("_n", F.count(F.lit(1)).over(book).cast("int"))
    out = out.withColumn("body_index", F.coalesce("_l", "_g", "_f", "_n"))
    out = out.withColumn("body_layer", F.when(F.col("_l").isNotNull(), "landmarks").when(F.col("_g").isNotNull(), "guide").when(F.col("_f").isNotNull(), "first unclassified").otherwise("none"))
    before = F.col("spine_index") < F.col("body_index")
    early = F.col("_front") | ((F.col("body_layer") == "landmarks") & (F.col("text_len") <= rules.UNCLASSIFIED_MOST_TEXT))
    drop = F.when(before, early).otherwise(F.col("divider"))
    kept = F.col("idref").isin(list(keep_ids)) if keep_ids else F.lit(False)
    out = out.withColumn("excluded", drop & ~kept)
    reason = F.when(kept & drop, "config").when(~drop, "kept").when(F.col("label").isNotNull(), F.col("label")).when(F.col("divider"), "part divider").otherwise("before the body")
    return out.withColumn("reason", reason).drop("_front", "_l", "_g", "_f", "_n")


def trim(spine: DataFrame, excluded: DataFrame) -> DataFrame:
    """The spine without the excluded ids, in its order."""
    return spine.join(excluded.select("book_id", "idref"), ["book_id", "idref"], "left_anti")


def restore(source: DataFrame, target: DataFrame, excluded: DataFrame) -> DataFrame:
    """(book_id, idref, position): the target's order with excluded ids back, each right after the id that precedes it in
    the source (at the head if none does). An id whose anchor is gone from the target follows the last anchor there."""
    put = source.join(excluded.select("book_id", "idref"), ["book_id", "idref"], "left_semi").join(target.select("book_id", "idref"), ["book_id", "idref"], "left_anti").select("book_id", "idref", F.lit(True).alias("put"))
    marked = source.join(put, ["book_id", "idref"], "left").join(target.select("book_id", "idref", F.col("spine_index").alias("at")), ["book_id", "idref"], "left")
    past = Window.partitionBy("book_id").orderBy("spine_index").rowsBetween(Window.unboundedPreceding, -1)
    anchored = marked.withColumn("anchor", F.last("at", ignorenulls=True).over(past)).where("put")
    rows = target.select("book_id", "idref", F.col("spine_index").alias("a"), F.lit(-1).alias("b")).union(anchored.select("book_id", "idref", F.coalesce("anchor", F.lit(-1)), "spine_index"))
    return number_in_order(rows, "book_id", ["a", "b"], "position").select("book_id", "idref", "position")


def union_in_order(checkpoint, *parts: DataFrame) -> DataFrame:
    """(id, pos): ids of all parts, each at its first place; earlier parts come first. Numbers come from range partitions."""
    tagged = [p.select("id", F.lit(i).alias("part"), "pos") for i, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, tagged)
    first = both.groupBy("id").agg(F.min(F.struct("part", "pos")).alias("k"))
    return number_globally(first, [F.col("k"), F.col("id")], "pos", checkpoint).select("id", "pos")
