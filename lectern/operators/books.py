"""Runs over whole books: cutting them to a part, splitting off references, repairing formulas, front-matter analysis,
glossaries and translation. Plans are joins over catalog tables; text is rewritten in Arrow batches, a document at a time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..store import spread
from . import catalog, editing, enrich, glossary, markup, masking

XHTML = ["application/xhtml+xml", "text/html"]


def decoded(members: DataFrame) -> DataFrame:
    """(book_id, path, html) of archive members, bad bytes replaced."""
    return members.select("book_id", F.col("name").alias("path"), F.expr("make_valid_utf8(cast(data as string))").alias("html"))


def spine_texts(spine: DataFrame, manifest: DataFrame, members: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """(book_id, spine_index, idref, path, html, text): documents in reading order. Spine ids that the manifest, or paths
    that the archive lacks, are left out, or (``keep_unknown``) stay with no text."""
    rows = catalog.join_manifest(spine, manifest, keep_unknown)
    docs = rows.join(decoded(members), ["book_id", "path"], "left" if keep_unknown else "inner").withColumn("html", F.coalesce("html", F.lit("")))
    return docs.select("book_id", "spine_index", "idref", "path", "html", T.html_to_text(F.col("html")).alias("text"))


def whole_text(docs: DataFrame) -> DataFrame:
    """(book_id, text): a book's documents in order, a line end between. For small books; operators work on documents."""
    lines = F.array_sort(F.collect_list(F.struct("spine_index", "text")))
    return docs.groupBy("book_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def select_spine(spine: DataFrame, indexes: list[int] | None = None, ids: list[str] | None = None) -> DataFrame:
    """The spine's entries at some places, or with some ids, in its order: exactly one of the two is given."""
    if (indexes is None) == (ids is None):
        raise ValueError("give indexes or ids")
    return spine.where(F.col("spine_index").isin(indexes) if ids is None else F.col("idref").isin(ids))


def missing_ids(spine: DataFrame, ids: list[str]) -> DataFrame:
    """(book_id, idref) of wanted ids that a book's spine lacks."""
    wanted = spine.select("book_id").distinct().select("book_id", F.explode(F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")).alias("idref"))
    return wanted.join(spine, ["book_id", "idref"], "left_anti")


def plan_cut(spine: DataFrame, manifest: DataFrame, covers: DataFrame, members: DataFrame, kept_spine: DataFrame, checkpoint, prune_all: bool = False) -> DataFrame:
    """The manifest with ``stays``: which items remain when a book is cut to ``kept_spine`` (book_id, idref)."""
    items = manifest.withColumn("media_type", F.coalesce("media_type", F.lit("")))
    must = checkpoint(editing.forced(items, kept_spine, covers))
    named = lambda d: catalog.join_manifest(d, items)
    gone = named(spine.join(kept_spine.select("book_id", "idref"), ["book_id", "idref"], "left_anti")).select("book_id", "path").distinct()
    pages = named(kept_spine).where(F.col("media_type").isin(XHTML)).select("book_id", "path")
    navs = items.where(F.array_contains("properties", "nav")).select("book_id", "path")
    text = decoded(members.where(F.lower("name").rlike(r"\.(xhtml|html|htm|css|xml)$")))
    used = checkpoint(editing.resources(pages.union(navs).distinct(), text, checkpoint))
    flag = lambda d, keys, name: d.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = items.join(flag(must, ["book_id", "id"], "forced"), ["book_id", "id"], "left")
    rows = rows.join(flag(gone, ["book_id", "path"], "dropped"), ["book_id", "path"], "left").join(flag(used, ["book_id", "path"], "referenced"), ["book_id", "path"], "left")
    rows = rows.na.fill(False, ["forced", "dropped", "referenced"]).withColumn("is_image", F.startswith("media_type", F.lit("image/")))
    kept = editing.keep_manifest(rows, prune_all).select("book_id", "id").distinct().withColumn("stays", F.lit(True))
    return rows.join(kept, ["book_id", "id"], "left").na.fill(False, ["stays"]).select(*manifest.columns, "stays")


def cut_members(planned: DataFrame, packages: DataFrame, members: DataFrame, kept_spine: DataFrame) -> DataFrame:
    """(book_id, entry_no, name, data, changes): the archive members of the cut books, rewritten: links to what is gone are
    degraded in kept documents, tables of contents and package documents pruned. ``packages``: (book_id, path)."""
    stays = planned.where("stays")
    own = stays.groupBy("book_id").agg(F.collect_set("path").alias("kept"), F.collect_set("id").alias("ids"))
    own = own.join(packages.select("book_id", F.col("path").alias("package")), "book_id", "left").withColumn("kept", F.array_union("kept", F.array(F.coalesce("package", F.lit("")))))
    in_spine = catalog.join_manifest(kept_spine.select("book_id", "idref"), stays).where(F.col("media_type").isin(XHTML)).select("book_id", "path", F.lit("page").alias("role"))
    role = F.when(F.array_contains("properties", "nav"), "nav").when(F.col("media_type") == "application/x-dtbncx+xml", "ncx")
    roles = stays.select("book_id", "path", role.alias("role")).where("role is not null").union(packages.select("book_id", "path", F.lit("package"))).union(in_spine)
    roles = roles.groupBy("book_id", "path").agg(F.max("role").alias("role"))  # a nav in the spine is both: page counts last
    both = stays.where(F.array_contains("properties", "nav")).select("book_id", "path", F.lit(True).alias("nav")).distinct()
    rows = members.withColumn("path", F.col("name")).join(own, "book_id")
    rows = rows.where((F.col("path") == "mimetype") | F.startswith("path", F.lit("META-INF/")) | F.array_contains("kept", F.col("path")))
    rows = rows.join(roles, ["book_id", "path"], "left").join(both, ["book_id", "path"], "left")

    def rewrite(path, data, kept, ids, role, nav):
        if role is None and not nav:
            return data, 0
        text = data.decode("utf-8", "replace")
        if nav:
            text, n = markup.prune_nav(path, text, kept)
        elif role == "page":
            text, n = markup.degrade_links(path, text, kept)
        elif role == "ncx":
            text, n, _ = markup.prune_ncx(path, text, kept)
        else:
            text, n = markup.rewrite_package(path, text, ids, kept), 0
        return text.encode(), n

    def run(frames):
        for f in frames:
            made = [rewrite(*x) for x in zip(f["path"], f["data"], f["kept"], f["ids"], f["role"].where(f["role"].notna(), None), f["nav"].fillna(False), strict=True)]
            yield pd.DataFrame({"book_id": f["book_id"], "entry_no": f["entry_no"], "name": f["name"], "data": [m[0] for m in made], "changes": [m[1] for m in made]})

    chosen = rows.select("book_id", "entry_no", "name", "path", "data", "kept", "ids", "role", "nav")
    return chosen.mapInPandas(run, "book_id string, entry_no int, name string, data binary, changes long")


def cut(files: DataFrame, checkpoint, indexes: list[int] | None = None, ids: list[str] | None = None, prune_all: bool = False) -> DataFrame:
    """(book_id, content): books (path, content) cut to some places or ids of their spines. Ids or places that no book has
    are an error; archives without a package document are left out (see ``epub.problems``)."""
    from ..sources import epub

    table = {t: checkpoint(epub.catalog(files, t, decode=True)) for t in ("manifest", "spine", "cover", "package")}
    lacking = missing_ids(table["spine"], ids).head(5) if ids is not None else []
    if indexes is not None:
        lacking = table["spine"].groupBy("book_id").agg(F.max("spine_index").alias("last")).where(F.col("last") < max(indexes, default=0)).head(5)
    if lacking:
        raise ValueError(f"not in the spine: {lacking}")
    kept_spine = checkpoint(select_spine(table["spine"], indexes, ids))
    members = checkpoint(epub.entries(files))
    planned = checkpoint(plan_cut(table["spine"], table["manifest"], table["cover"], members, kept_spine, checkpoint, prune_all))
    return epub.write(cut_members(planned, table["package"], members, kept_spine))


def cut_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book_id, entries_before, entries_after, bytes_before, bytes_after, share) of two member tables."""
    of = lambda d, x: d.groupBy("book_id").agg(F.count(F.lit(1)).alias(f"entries_{x}"), F.sum(F.octet_length("data")).alias(f"bytes_{x}"))
    return of(before, "before").join(of(after, "after"), "book_id").withColumn("share", F.col("bytes_after") / F.greatest("bytes_before", F.lit(1)))


def per_document(docs: DataFrame, change: Callable[[str], tuple[str, int]], gate: str) -> DataFrame:
    """(book_id, path, html, changes): documents that match ``gate`` changed, the others as they are."""
    import re

    wanted = re.compile(gate)

    def run(frames):
        for f in frames:
            made = [change(h) if wanted.search(h) else (h, 0) for h in f["html"].fillna("")]
            yield pd.DataFrame({"book_id": f["book_id"], "path": f["path"], "html": [m[0] for m in made], "changes": [m[1] for m in made]})

    return docs.select("book_id", "path", "html").mapInPandas(run, "book_id string, path string, html string, changes long")


def repair_math(docs: DataFrame) -> DataFrame:
    """Documents with the namespaces of their formulas repaired."""
    return per_document(docs, markup.repair_math, "<m:math")


def de_escape_latex(docs: DataFrame) -> DataFrame:
    def change(text: str) -> tuple[str, int]:
        new = markup.de_escape_latex(text)
        return new, (len(text) - len(new))

    return per_document(docs, change, r"\\[\[(]")


def split_references(docs: DataFrame) -> DataFrame:
    """(book_id, path, html): the documents, and for the first of a book (by path) that has a list of references to split
    off, a further document references.xhtml beside it."""

    def run(frames):
        for f in frames:
            made = [markup.split_references(h) for h in f["html"].fillna("")]
            yield pd.DataFrame({"book_id": f["book_id"], "path": f["path"], "html": f["html"], "left": [m and m[0] for m in made], "refs": [m and m[1] for m in made], "has": [markup.reference_heading(h) >= 0 for h in f["html"].fillna("")]})

    rows = docs.select("book_id", "path", "html").mapInPandas(run, "book_id string, path string, html string, left string, refs string, has boolean")
    first = rows.where("has").groupBy("book_id").agg(F.min("path").alias("first"))
    rows = rows.join(first, "book_id", "left").withColumn("cut", F.coalesce((F.col("path") == F.col("first")) & F.col("refs").isNotNull(), F.lit(False)))
    beside = F.concat(F.regexp_extract("path", r"^(?:.*/)?", 0), F.lit("references.xhtml"))
    parts = F.when(F.col("cut"), F.array(F.struct("path", F.col("left").alias("html")), F.struct(beside.alias("path"), F.col("refs").alias("html")))).otherwise(F.array(F.struct("path", "html")))
    return rows.select("book_id", F.explode(parts).alias("d")).select("book_id", "d.*")


def analyse(spine_docs: DataFrame, pointers: DataFrame, keep_ids: list[str] = ()) -> DataFrame:
    """Front-matter decisions of books: documents (book_id, spine_index, idref, path, html, properties) with their pointers
    (book_id, kind, pos, type, path). Adds layer, label, excluded, reason, body_index and body_layer."""
    html = F.col("html")
    rows = spine_docs.withColumns({n: F.length(f(html)).cast("long") for n, f in (("text_len", T.strip_markup), ("heading_len", T.heading_text), ("link_len", T.link_text))})
    rows = rows.withColumns({"link_ratio": T.link_ratio(F.col("link_len"), F.col("text_len")), "epub_types": T.structural_types(html), "names": T.name_tokens(F.col("idref"), F.col("path"))})
    first = catalog.first_pointer(pointers)
    for kind in ("guide", "landmarks"):
        name = "guide_type" if kind == "guide" else "landmark_type"
        rows = rows.join(first.where(F.col("kind") == kind).select("book_id", "path", F.col("type").alias(name)), ["book_id", "path"], "left")
    index = rows.groupBy("book_id", "path").agg(F.max("spine_index").alias("at"))  # of a repeated path the last place counts
    # the first pointer to the body of each kind, whether or not its path is in the spine
    starts = pointers.where(F.when(F.col("kind") == "landmarks", F.col("type") == "bodymatter").otherwise(F.col("type") == "text"))
    starts = starts.groupBy("book_id", "kind").agg(F.min_by("path", "pos").alias("path")).join(index, ["book_id", "path"])
    body = starts.groupBy("book_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("at"))).alias(n) for k, n in (("landmarks", "landmark_body"), ("guide", "guide_body"))))
    rows = catalog.classify(rows.drop("html", "link_len")).withColumn("divider", catalog.part_divider()).join(body, "book_id", "left")
    return catalog.decide(rows, list(keep_ids))


def mine(docs: DataFrame, checkpoint, key: str = "doc_id", least: int = 1, most: int | None = None) -> DataFrame:
    """(term, freq, context, first_seq): names and acronyms of (key, text) documents, the most frequent first."""
    rows = checkpoint(glossary.sentence_rows(spread(docs.select(key, "text")), key))
    runs = glossary.name_run_rows(rows, checkpoint(glossary.trusted_tokens(rows)), key)
    both = runs.unionByName(glossary.acronym_rows(rows, key).select(runs.columns))
    found = glossary.candidates(both, key, least)
    return found if most is None else glossary.top(found, most)


def make_glossary(docs: DataFrame, resolver, checkpoint, key: str = "doc_id", least: int = 1, most: int | None = None, unify=None) -> DataFrame:
    """(en, zh, freq, confidence, alt, note, context, pos): mined terms with what ``resolver`` answers about them, without
    those it skips, reconciled. Too many failed batches are an error. ``unify``: a resolver of conflicting groups
    ([(en, zh, context)] to {en: zh}); without one, conflicts are flagged."""
    found = checkpoint(mine(docs, checkpoint, key, least, most))
    terms = enrich.ranked(found.select(F.col("term").alias("en"), "freq", "context", "first_seq"), [F.desc("freq"), F.lower("en"), F.col("first_seq")], "pos", checkpoint).drop("first_seq")
    answered = checkpoint(enrich.resolve(terms.withColumn("batch", F.floor(F.col("pos") / enrich.rules.BATCH).cast("long")), resolver))
    enrich.check_budget(answered)
    entries = checkpoint(enrich.apply_resolution(terms, answered))
    merged = glossary.collapse_same_value(glossary.dedup_casefold(glossary.drop_coordinations(entries)))
    merged = checkpoint(merged.join(entries.select("en", "alt", "context"), "en", "left"))
    if unify is None:
        return glossary.flag_conflicts(merged, checkpoint)
    groups = glossary.conflict_groups(merged, checkpoint).groupBy("component").applyInPandas(
        lambda g: pd.DataFrame(list(unify(list(zip(g["en"], g["zh"], g["context"], strict=True))).items()), columns=["en", "zh"]), "en string, zh string"
    )
    return glossary.apply_consistent(merged, checkpoint(groups))


def ensure_glossary(spark, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The glossary at ``path``; if there is none, what ``make`` gives is written there first."""
    from ..sources import glossary_tsv, staged

    if not staged.exists(spark, path):
        e = make()
        rows = e.select(F.col("en").alias("english"), F.col("zh").alias("chinese"), "freq", "confidence", F.col("alt").alias("alternatives"), "note", "context", "pos")
        staged.replace(spark, path, lambda p: glossary_tsv.write(rows.orderBy(F.desc("freq"), F.lower("english"), "pos"), p))
    return glossary_tsv.read(spark, path)


def translate(docs: DataFrame, translator: Callable[[str], str], language: str, done: DataFrame | None, checkpoint, code: bool = True, math: bool = True) -> DataFrame:
    """(book_id, path, key, html, error): documents translated one request each: math, then code is masked, what ``done``
    (key, html) holds is taken from there, answers are validated, and code, then math is put back. ``key`` names the masked
    source, so a resumed run repeats nothing; ``error`` tells why a document is as it was."""
    from . import messages

    rows = docs.select("book_id", "path", F.coalesce("html", F.lit("")).alias("html"))
    maps = {}
    for kind, wanted in (("math", math), ("code", code)):
        if wanted:
            maps[kind] = checkpoint(masking.mask_books(rows, checkpoint, kind))
            rows = maps[kind].select("book_id", "path", "html")
    rows = checkpoint(rows.withColumn("key", F.sha2("html", 256)))
    fresh = rows if done is None else rows.join(done.select("key"), "key", "left_anti")

    def run(frames):
        for f in frames:
            out = []
            for source in f["html"]:
                try:
                    out.append((translator(source), ""))
                except Exception as e:  # noqa: BLE001  any failure of an external service is that document's
                    out.append(("", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"key": f["key"], "source": f["html"], "answer": [x[0] for x in out], "error": [x[1] for x in out]})

    asked = fresh.select("key", "html").dropDuplicates(["key"]).mapInPandas(run, "key string, source string, answer string, error string")
    why = F.coalesce(messages.validate(F.col("source"), F.col("answer"), language), F.lit(""))
    asked = checkpoint(asked.withColumn("error", F.when(F.col("error") == "", why).otherwise(F.col("error"))))
    answers = asked.where("error = ''").select("key", F.col("answer").alias("new"))
    if done is not None:
        answers = answers.unionByName(done.select("key", F.col("html").alias("new")))
    out = rows.join(answers.dropDuplicates(["key"]), "key", "left").join(asked.where("error <> ''").select("key", "error"), "key", "left")
    out = out.select("book_id", "path", "key", F.coalesce("new", "html").alias("html"), F.coalesce("error", F.lit("")).alias("error"))
    for kind in ("code", "math"):
        if kind in maps:
            own = maps[kind].groupBy("book_id").agg(F.flatten(F.collect_list("idx")).alias("idx"), F.flatten(F.collect_list("original")).alias("original"))
            back = masking.unmask_books(out.join(own, "book_id"), code=kind == "code")  # a placeholder may have moved to another document
            out = out.drop("html").join(back.select("book_id", "path", "html"), ["book_id", "path"]).select("book_id", "path", "key", "html", "error")
    return out


def with_documents(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Archive members with the text of ``docs`` (book_id, path, html) in place of theirs."""
    new = docs.select("book_id", F.col("path").alias("name"), F.encode("html", "UTF-8").alias("new"))
    return members.join(new, ["book_id", "name"], "left").select("book_id", "entry_no", "name", F.coalesce("new", "data").alias("data"))


def repair_math_books(files: DataFrame, checkpoint) -> DataFrame:
    """(book_id, content): books with the namespaces of their formulas repaired."""
    from ..sources import epub

    members = checkpoint(epub.entries(files))
    return epub.write(with_documents(members, repair_math(epub.content_files(members)).where("changes > 0")))


def translate_books(files: DataFrame, translator: Callable[[str], str], language: str, checkpoint, done: DataFrame | None = None, exclude: tuple = (), keep: tuple = (), detect: bool = True) -> tuple[DataFrame, DataFrame]:
    """Books (book_id, content) whose reading order is translated but for ``exclude`` and, with ``detect``, front matter that
    isn't in ``keep``; those stay in the book, as they are. And the translations by key, for ``done`` of the next run."""
    from ..sources import epub

    table = {t: checkpoint(epub.catalog(files, t)) for t in ("spine", "manifest", "pointer")}
    members = checkpoint(epub.entries(files))
    docs = spine_texts(table["spine"], table["manifest"], members)
    if detect:
        props = table["manifest"].groupBy("book_id", "path").agg(F.max_by("properties", "pos").alias("properties"))
        found = analyse(docs.drop("text").join(props, ["book_id", "path"], "left"), table["pointer"], list(keep))
        docs = docs.join(found.where("excluded").select("book_id", "idref"), ["book_id", "idref"], "left_anti")
    if exclude:
        docs = docs.where(~F.col("idref").isin(list(exclude)))
    chosen = docs.select("book_id", "path", "html").dropDuplicates(["book_id", "path"])
    out = checkpoint(translate(chosen, translator, language, done, checkpoint))
    return epub.write(with_documents(members, out.where("error = ''"))), out
