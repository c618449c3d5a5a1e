"""Masking markup behind numbered placeholders, and putting it back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import bounded_batches

NAMESPACE = "http://www.w3.org/1998/Math/MathML"
MATH = re.compile(r"<math\b.*?</math\s*>", re.S | re.I)
TAG = re.compile(r"""<(?P<close>/?)(?P<name>pre|code)(?=[\s>/])(?:[^>"'/]|/(?!>)|"[^"]*"|'[^']*')*+(?P<self>/(?=>))?(?P<end>>)?""", re.I)
OPEN_TAG = re.compile(r"""<math(?:[^>"']|"[^"]*"|'[^']*')*+>?""", re.I)
#: Placeholders, and what is taken for one when they come back
MATH_TOKEN, CODE_TOKEN, BLOCK = "[[MATH{:04d}]]", "[[CODE{:05d}]]", '<pre data-code-id="{:d}"></pre>'
BACK = re.compile(r'\[\[\s*(MATH|CODE)\s*0*(\d+)\s*\]\]|<pre\s+data-code-id\s*=\s*"\s*0*(\d+)\s*"\s*(?:/>|>\s*</pre\s*>)', re.I)


def occurrences(pages: DataFrame, pattern: str, book: str, order: list[str], html: str = "html") -> DataFrame:
    """One row per match of ``pattern``: numbered 1, 2, ... in a book by document order, then place."""
    found = pages.select(book, *order, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), 0)).alias("nth", "original"))
    w = Window.partitionBy(book).orderBy(*order, "nth")
    return found.withColumn("idx", F.row_number().over(w))


def completeness(mapping: DataFrame, restored: DataFrame) -> DataFrame:
    """Per book: placeholders, occurrences put back, distinct ones put back, and ones that are lost. Occurrences may
    hide a loss (one twice, another never), so both counts are reported."""
    back = restored.groupBy("book_id", "idx").agg(F.count(F.lit(1)).alias("times"))
    each = mapping.join(back, ["book_id", "idx"], "left")
    return each.groupBy("book_id").agg(F.count(F.lit(1)).alias("placeholders"), F.coalesce(F.sum("times"), F.lit(0)).alias("occurrences"), F.count("times").alias("restored"), F.count_if(F.col("times").isNull()).alias("lost"))


def code_spans(html: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the outermost pre and code elements, an element being closed by the tag of its name that
    balances it. A tag whose quotes never close ends the search for the ends of all that is open."""
    pairs, open_ = {}, {"pre": [], "code": []}
    for m in TAG.finditer(html):
        name, whole = m["name"].lower(), m["end"] is not None
        if not whole:
            open_ = {"pre": [], "code": []}
        elif m["close"]:
            if open_[name]:
                pairs[open_[name].pop()] = (m.end(), name)
        elif m["self"]:
            pairs[m.start()] = (m.end(), name)
        else:
            open_[name].append(m.start())
    out, reached = [], 0
    for start in sorted(pairs):
        if start >= reached:
            reached, name = pairs[start]
            out.append((start, reached, name))
    return out


def split_code(html: str) -> tuple[list[str], list[str]]:
    """What stands between the top-level pre and code elements (one more than these), and the elements; what is never closed
    is no element."""
    spans = code_spans(html)
    cuts = [0, *(x for start, end, _ in spans for x in (start, end)), len(html)]
    return [html[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)], [html[i:j] for i, j, _ in spans]


def split_math(html: str, strict: bool = False) -> tuple[list[str], list[str]]:
    """As ``split_code``, for math elements, each with a namespace. Unless ``strict``, a document is looked at only if it
    has '<math' in lower case."""
    found = list(MATH.finditer(html)) if strict or "<math" in html else []
    cuts = [0, *(x for m in found for x in m.span()), len(html)]
    return [html[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)], [with_namespace(m[0]) for m in found]


def placeholder(original: str, idx: int) -> str:
    kind = original[:5].lower()
    return MATH_TOKEN.format(idx) if kind == "<math" else BLOCK.format(idx) if kind[:4] == "<pre" else CODE_TOKEN.format(idx)


def masked(parts: list[str], originals: list[str], first: int = 1) -> tuple[str, dict[int, str]]:
    """A document with its elements behind placeholders numbered from ``first``, and these by number."""
    held = dict(enumerate(originals, first))
    return parts[0] + "".join(placeholder(x, i) + after for (i, x), after in zip(held.items(), parts[1:], strict=True)), held


def mask_code(html: str, first: int = 1) -> tuple[str, dict[int, str]]:
    return masked(*split_code(html), first)


def mask_math(html: str, first: int = 1, strict: bool = False) -> tuple[str, dict[int, str]]:
    return masked(*split_math(html, strict), first)


def with_namespace(math: str) -> str:
    """A math element with the default namespace, added if its open tag declares none."""
    return math if "xmlns" in OPEN_TAG.match(math)[0] else f'<math xmlns="{NAMESPACE}"{math[5:]}'


def unmask(html: str, code: dict[int, str] | None = None, math: dict[int, str] | None = None) -> tuple[str, list[int]]:
    """Placeholders of the maps given replaced in one pass, at every occurrence; unknown ones stay. Mask math, then code;
    unmask code, then math: a later map may hold earlier placeholders."""
    done: list[int] = []

    def put(m: re.Match) -> str:
        held = math if (m[1] or "").upper() == "MATH" else code
        idx = int(m[2] or m[3])
        if held is None or idx not in held:
            return m[0]
        done.append(idx)
        return held[idx]

    return BACK.sub(put, html), done


def mask_books(docs: DataFrame, checkpoint, kind: str = "code") -> DataFrame:
    """(book_id, path, html, idx[], original[]): each document masked, numbers running over a book's paths in order.

    Documents are scanned once, in Arrow batches, into elements and what stands between; a window over (book, path, number
    of elements) gives where a document's numbers begin, and column functions put the placeholders in. A document without
    the kind's markup is not scanned. A book never has to fit in one task."""
    import pandas as pd

    bounded_batches(docs.sparkSession)

    split, gate = (split_code, r"(?i)<(?:pre|code)[\s>/]") if kind == "code" else (split_math, "<math")

    def run(frames):
        for f in frames:
            made = [split(h) if re.search(gate, h) else ([h], []) for h in f["html"].fillna("")]
            yield pd.DataFrame({"book_id": f["book_id"], "path": f["path"], "parts": [m[0] for m in made], "original": [m[1] for m in made]})

    own = checkpoint(docs.select("book_id", "path", "html").mapInPandas(run, "book_id string, path string, parts array<string>, original array<string>"))
    before = Window.partitionBy("book_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    first = own.select("book_id", "path", F.size("original").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int")).drop("n")
    rows = own.join(first, ["book_id", "path"]).withColumn("idx", F.transform("original", lambda x, i: (F.col("first") + i + 1).cast("int")))
    is_pre = lambda x: F.lower(F.substring(x, 1, 4)) == "<pre"
    token = lambda x, i: F.when(is_pre(x), F.format_string('<pre data-code-id="%d"></pre>', i)).otherwise(F.format_string("[[CODE%05d]]", i)) if kind == "code" else F.format_string("[[MATH%04d]]", i)
    pieces = F.transform(F.arrays_zip("original", "idx", F.slice("parts", F.lit(2), F.size("original")).alias("after")), lambda x: F.concat(token(x["original"], x["idx"]), x["after"]))
    return rows.select("book_id", "path", F.concat(F.element_at("parts", 1), F.array_join(pieces, "")).alias("html"), "idx", "original")


def unmask_books(masked: DataFrame, code: bool = True) -> DataFrame:
    """(book_id, path, html, restored): documents with their own placeholders put back, and the numbers that were."""
    import pandas as pd

    bounded_batches(masked.sparkSession)

    def run(frames):
        for f in frames:
            made = [unmask(h, **{"code" if code else "math": dict(zip(i, o, strict=True))}) for h, i, o in zip(f["html"], f["idx"], f["original"], strict=True)]
            yield pd.DataFrame({"book_id": f["book_id"], "path": f["path"], "html": [m[0] for m in made], "restored": [m[1] for m in made]})

    return masked.select("book_id", "path", "html", "idx", "original").mapInPandas(run, "book_id string, path string, html string, restored array<int>")
