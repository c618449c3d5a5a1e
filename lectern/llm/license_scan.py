"""License scans, in DataFrame operations alone: MinHash bands over overlapping text windows retrieve templates, and
exact shingle containment verifies them.

Shingles are five words (lower-cased A-Z, split at ASCII white space). Templates of about the same number m of shingles
form a class with windows made for it: blocks of B shingles (about m / 2), and a window of consecutive blocks from each
block on, long enough to hold any m + g shingles in a row, where g is how many words may be inserted (``inserted``: names,
years, marks of comments). So wherever a notice stands with up to g words in it, some window holds it whole, and what a
match at the least containment leaves of the Jaccard similarity has a floor J. Each band is one MinHash value,
and the number of bands is the smallest with 1 - (1 - J) ** bands >= ``certainty``. A window whose band equals that of
a template is compared with it: the distinct shingles of the template that the window holds, as text, over their number.

Before that, texts that cannot hold any template are passed over: of m shingles, a match lacks m - ceil(containment m) at
most, so it has one of the template's first m - ceil(containment m) + 1; likewise for each class.

Everything happens inside a row, so there is no shuffle, no skew, and nothing to broadcast but the stated templates.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_bytes_col

SHINGLE = 5
CONTAINMENT = 0.8
#: So many inserted words are allowed at least, or a quarter of the template's shingles.
LEAST_INSERTED = 24
#: Templates of one scan; more are scanned in several.
MOST_TEMPLATES = 256

#: Short notices of common licenses.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
]


#: What stands between words: white space; or all but letters and digits, so that quotes, stops and comment marks at
#: the edge of a word do not change it.
SPACE = r"[ \t\n\x0B\f\r]+"
MARKS = r"[^a-z0-9\u00C0-\u1FFF\u2070-\u2FFF\u3040-\uFFFF]+"
SPDX = r"spdx-license-identifier:[ \t]*\(*([a-z0-9.+:-]+(?:[ \t()]+(?:or|and|with)[ \t()]+[a-z0-9.+:-]+)*)"


def template_words(text: str, apart: str = SPACE) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    if apart != SPACE:
        return [w for w in re.split(apart, low) if w]
    return [w.decode() for w in low.encode().split()]


def inserted(m: int, containment: float = CONTAINMENT) -> int:
    """How many words in all may stand inside a template of m shingles. Each place with such words costs four shingles, so
    a template that cannot lack four allows none."""
    return max(LEAST_INSERTED, m // 4) if m - math.ceil(containment * m - 1e-9) >= SHINGLE - 1 else 0


def window_shape(m: int, containment: float = CONTAINMENT, certainty: float = 0.999) -> tuple[int, int, int]:
    """(shingles of a block, blocks of a window, bands) for templates of m distinct shingles."""
    block = 1 << max(0, (m // 2).bit_length() - 1) if m > 1 else 1
    blocks = math.ceil((m + inserted(m, containment) + block - 1) / block)
    found = math.ceil(containment * m - 1e-9)
    floor = found / (block * blocks + m - found)
    bands = 1 if floor >= 1 else math.ceil(math.log(1 - certainty) / math.log(1 - floor))
    return block, blocks, bands


def _once(rows: DataFrame, keep: list[str], made: dict[str, Column]) -> DataFrame:
    """``rows`` with new columns that are computed once. A generator stands between, for the optimiser would write an
    expression in place of its name into filters and into the functions of arrays, and compute it for each element."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(name) for name, c in made.items())))))


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
    certainty: float = 0.999,
    apart: str = SPACE,
) -> DataFrame:
    """One row for each document and template that it holds: id, license_id, containment (the best), n_windows (how many
    windows hold it), first_word (place of the first such window, in words). ``apart``: what separates words.

    A template needs five words; a shorter one is refused. Null and short texts hold nothing. Rows that repeat an
    identifier are scanned each; a null identifier gets rows like any other. Other columns play no part."""
    if len(templates) > MOST_TEMPLATES:  # each is a constant of a plan: more are scanned in groups
        groups = [templates[i : i + MOST_TEMPLATES] for i in range(0, len(templates), MOST_TEMPLATES)]
        return reduce(DataFrame.unionByName, (scan(docs, g, id_col, text_col, containment, certainty, apart) for g in groups))
    known = []
    for name, text in templates:
        w = template_words(text, apart)
        if len(w) < SHINGLE:
            raise ValueError(f"{name}: fewer than {SHINGLE} words")
        known.append((name, list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))))
    rows = docs.select(F.col(id_col).alias("_id"), lower_ascii(text_bytes_col(F.col(text_col).cast("string"))).alias("_text"))
    rows = _once(rows, ["_id"], {"_w": F.filter(F.split("_text", apart), lambda x: x != "")}).where(F.size("_w") >= SHINGLE)
    parts = ", ".join(f"_w[i + {k}]" for k in range(SHINGLE))
    rows = _once(rows, ["_id", "_w"], {"_s": F.expr(f"transform(sequence(0, size(_w) - {SHINGLE}), i -> xxhash64({parts}))")})
    classes: dict[tuple, list] = {}
    for i, t in enumerate(known):
        classes.setdefault(window_shape(len(t[1]), containment, certainty), []).append(i)
    hashes, all_keys = _template_hashes(docs, known, max((c[2] for c in classes), default=0))
    lead = [h[: len(h) - math.ceil(containment * len(h) - 1e-9) + 1] for h in hashes]
    holds = lambda members: f"exists(_s, s -> s in ({', '.join(f'{v}L' for v in sorted({v for i in members for v in lead[i]}))}))"
    rows = rows.where(holds(range(len(known)))) if known else rows.limit(0)
    rows = _once(rows, ["_id", "_w", "_s"], {f"_c{n}": F.expr(holds(members)) for n, members in enumerate(classes.values())}) if known else rows
    minima, near, held, found = {}, {}, {}, []
    for n, ((block, blocks, bands), members) in enumerate(classes.items()):
        keys = [all_keys[i][:bands] for i in members]
        each = []
        for k in range(bands):
            least = f"array_min(transform(slice(_s, j * {block} + 1, {block}), s -> xxhash64(s, {k})))"
            minima[f"_m{n}_{k}"] = F.expr(f"if(_c{n}, " + (f"transform(sequence(0, int(ceil(size(_s) / {block})) - 1), j -> {least})" if block > 1 else f"transform(_s, s -> xxhash64(s, {k}))") + ", null)")
            value = f"_m{n}_{k}[j]" if blocks == 1 else "least(" + ", ".join(f"get(_m{n}_{k}, j + {b})" for b in range(blocks)) + ")"
            wanted = ", ".join(f"{v}L" for v in sorted({row[k] for row in keys}))
            each.append(f"filter(sequence(0, size(_m{n}_{k}) - 1), j -> {value} in ({wanted}))")
        near[f"_near{n}"] = F.expr(f"if(_c{n}, array_sort(array_distinct(concat({', '.join(each)}))), cast(array() as array<int>))")
        texts = f"transform(sequence(j * {block}, least(j * {block} + {block * blocks}, size(_w) - {SHINGLE - 1}) - 1), i -> array_join(slice(_w, i + 1, {SHINGLE}), ' '))"
        held[f"_held{n}"] = F.expr(f"transform(_near{n}, j -> named_struct('j', j, 'held', {texts}))")
        found += [_matches(f"_held{n}", *known[i], block, containment) for i in members]
    rows = _once(rows, ["_id", "_w", *(f"_c{n}" for n in range(len(classes)))], minima)
    rows = _once(rows, ["_id", "_w"], near).where(" or ".join(f"size({c}) > 0" for c in near))
    rows = _once(rows, ["_id"], held)
    rows = rows.select("_id", F.explode(F.filter(F.array(*found), lambda x: x["n_windows"] > 0)).alias("x"))
    return rows.select(F.col("_id").alias(id_col), "x.license_id", "x.containment", "x.n_windows", "x.first_word")


def _matches(held: str, name: str, shingles: list[str], block: int, containment: float) -> Column:
    template = F.split(F.lit("\n".join(shingles)), "\n")  # one constant
    share = lambda x: F.size(F.array_intersect(template, x["held"])) / F.lit(len(shingles))
    scored = F.filter(F.transform(F.col(held), lambda x: F.struct(x["j"].alias("j"), share(x).alias("c"))), lambda x: x["c"] >= containment)
    return F.struct(
        F.lit(name).alias("license_id"),
        F.array_max(F.transform(scored, lambda x: x["c"])).alias("containment"),
        F.size(scored).cast("long").alias("n_windows"),
        (F.array_min(F.transform(scored, lambda x: x["j"])) * block).cast("long").alias("first_word"),
    )


def _template_hashes(docs: DataFrame, known: list, bands: int) -> tuple[list[list[int]], list[list[int]]]:
    """Of each template the hashes of its shingles, in order, and its MinHash values, by the same expressions as those of
    the windows."""
    rows = docs.sparkSession.createDataFrame([(i, s.split(" ")) for i, (_, shingles) in enumerate(known) for s in shingles], "t int, w array<string>")
    parts = ", ".join(f"w[{k}]" for k in range(SHINGLE))
    hashed = rows.select("t", F.expr(f"xxhash64({parts})").alias("h"))
    mins = [F.expr(f"min(xxhash64(h, {k}))").alias(f"m{k}") for k in range(bands)]
    hashes = [[] for _ in known]
    for t, h in hashed.collect():  # the templates' size
        hashes[t].append(h)
    return hashes, [list(r)[1:] for r in hashed.groupBy("t").agg(F.count(F.lit(1)).alias("n"), *mins).orderBy("t").drop("n").collect()]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` for all templates of ``license_texts``, words being runs of letters and digits; and a row for each SPDX
    expression of a document: license_id "spdx:" and the expression in lower case, containment 1, n_windows how often it
    occurs, first_word the number of words before it."""
    from .license_texts import licenses

    text = lower_ascii(text_bytes_col(F.col(text_col).cast("string")))
    tags = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).where(F.contains("_text", F.lit("spdx-license-identifier:")))
    tags = tags.select("_id", F.expr("uuid()").alias("_row"), F.split("_text", "(?=spdx-license-identifier:)").alias("_p"))
    tags = tags.select("_id", "_row", "_p", F.posexplode("_p").alias("_at", "_part"))
    before = F.size(F.filter(F.split(F.array_join(F.slice("_p", F.lit(1), F.col("_at")), ""), MARKS), lambda x: x != ""))
    tags = tags.select("_id", "_row", F.regexp_replace(F.regexp_extract("_part", "^" + SPDX, 1), r"[ \t()]+", " ").alias("_e"), before.cast("long").alias("_n")).where("_e <> ''")
    tags = tags.groupBy("_row", "_id", "_e").agg(F.count(F.lit(1)).alias("n_windows"), F.min("_n").alias("first_word"))
    tags = tags.select(F.col("_id").alias(id_col), F.concat(F.lit("spdx:"), "_e").alias("license_id"), F.lit(1.0).alias("containment"), "n_windows", "first_word")
    return scan(docs, licenses(), id_col, text_col, apart=MARKS).unionByName(tags)
