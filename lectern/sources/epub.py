"""EPUB archives: scanned into catalog tables, and written again. One task holds one archive at a time."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "book_id string, entry_no int, name string, size long, data binary"
CONTENT = r"(?i)\.(xhtml|html|htm)$"


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of .epub files in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _opened(frames: Iterator[pd.DataFrame]):
    """(path, archive, why not) of each file."""
    for pdf in frames:
        for book, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield book, z, ""
            except (zipfile.BadZipFile, OSError, EOFError, zlib.error, RuntimeError, NotImplementedError, KeyError) as e:
                yield book, None, f"{type(e).__name__}: {e}"


def _frames(rows: Iterator[list[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    for made in rows:
        yield pd.DataFrame(made, columns=columns)


def entries(files: DataFrame, only: str | None = None) -> DataFrame:
    """The members of the archives in archive order. ``only``: a pattern that names must match; others aren't unpacked.
    Archives and members that can't be read have no rows; ``problems`` tells them."""
    wanted = re.compile(only) if only else None

    def members(frames):
        for book, z, _ in _opened(frames):
            rows = []
            for i, x in enumerate(z.infolist() if z else []):
                if not wanted or wanted.search(x.filename):
                    try:
                        rows.append((book, i, x.filename, x.file_size, z.read(x)))
                    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
                        continue
            yield rows

    return files.mapInPandas(lambda frames: _frames(members(frames), ["book_id", "entry_no", "name", "size", "data"]), ENTRY)


def problems(files: DataFrame) -> DataFrame:
    """(book_id, name, reason): archives that can't be read, or have no package document, and members that can't."""

    def found(frames):
        for book, z, why in _opened(frames):
            if z is None:
                yield [(book, "", why)]
                continue
            rows, broken = [], set()
            for x in z.infolist():
                try:
                    z.read(x)
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
                    broken.add(x.filename)
                    rows.append((book, x.filename, f"{type(e).__name__}: {e}"))
            names = z.namelist()
            container = "META-INF/container.xml"
            text = z.read(container).decode("utf-8", "replace") if container in names and container not in broken else None
            if locate_package(names, text) is None:
                rows.append((book, "", "no package document"))
            yield rows

    return files.mapInPandas(lambda frames: _frames(found(frames), ["book_id", "name", "reason"]), "book_id string, name string, reason string")


def content_files(members: DataFrame) -> DataFrame:
    """(book_id, path, html) of the markup members, bad bytes replaced."""
    rows = members.where(F.col("name").rlike(CONTENT))
    return rows.select("book_id", F.col("name").alias("path"), F.expr("make_valid_utf8(cast(data as string))").alias("html"))


def _attr(tag: str, name: str) -> str | None:
    m = re.search(rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag, re.I)
    return None if m is None else m[1] if m[1] is not None else m[2]


def locate_package(names: list[str], container: str | None, first: bool = False) -> str | None:
    """The package document: what the container names, else (or, with ``first``, always) the first member that ends in
    .opf."""
    m = None if first else re.search(r"""<rootfile\b[^>]*?\bfull-path\s*=\s*["']([^"']+)["']""", container or "", re.I | re.S)
    if m and m[1] in names:
        return m[1]
    return next((n for n in names if n.lower().endswith(".opf")), None)


def parse_package(book_id: str, path: str, opf: str, decode: bool = False) -> dict[str, list[tuple]]:
    """Manifest, spine and guide rows of a package document, in order."""
    base = posixpath.dirname(path)

    def resolve(href: str) -> str:
        href = unquote(href.partition("#")[0]) if decode else href.partition("#")[0]
        return posixpath.normpath(posixpath.join(base, href)) if href else ""

    tags = lambda name: (m[0] for m in re.finditer(rf"<(?:\w+:)?{name}\b[^>]*>", opf, re.I | re.S))
    manifest, spine, guide = [], [], []
    for t in tags("item"):
        i, href = _attr(t, "id"), _attr(t, "href")
        if i and href is not None:
            manifest.append((book_id, len(manifest), i, href, _attr(t, "media-type") or "", (_attr(t, "properties") or "").split(), resolve(href)))
    for t in tags("itemref"):
        if i := _attr(t, "idref"):
            spine.append((book_id, len(spine), i, t))
    whole = re.search(r"(?is)<(?:\w+:)?guide\b.*?</(?:\w+:)?guide\s*>", opf)
    for t in re.findall(r"(?is)<(?:\w+:)?reference\b[^>]*>", whole[0] if whole else ""):
        kind, href = _attr(t, "type"), _attr(t, "href")
        if kind and href:
            guide.append((book_id, "guide", len(guide), kind.lower(), resolve(href)))
    covers = [(book_id, _attr(t, "content")) for t in tags("meta") if (_attr(t, "name") or "").lower() == "cover" and _attr(t, "content")]
    return {"manifest": manifest, "spine": spine, "pointer": guide, "cover": covers, "package": [(book_id, path)]}


def landmarks(book_id: str, nav_path: str, nav: str) -> list[tuple]:
    """Pointer rows of a navigation document's landmarks; a link with several types has a row for each."""
    out, base = [], posixpath.dirname(nav_path)
    for block in re.finditer(r"""<nav\b[^>]*\bepub:type\s*=\s*["'][^"']*\blandmarks\b[^"']*["'][^>]*>(.*?)</nav\s*>""", nav, re.I | re.S):
        for t in re.finditer(r"<a\b[^>]*>", block[1], re.I | re.S):
            href = (_attr(t[0], "href") or "").partition("#")[0]
            for kind in (_attr(t[0], "epub:type") or "").lower().split():
                if href:
                    out.append((book_id, "landmarks", len(out), kind, posixpath.normpath(posixpath.join(base, href))))
    return out


TABLES = {
    "manifest": "book_id string, pos int, id string, href string, media_type string, properties array<string>, path string",
    "spine": "book_id string, spine_index int, idref string, itemref_xml string",
    "pointer": "book_id string, kind string, pos int, type string, path string",
    "cover": "book_id string, id string",
    "package": "book_id string, path string",
}


def catalog(files: DataFrame, table: str, decode: bool = False, first: bool = False) -> DataFrame:
    """One catalog table of the archives: manifest, spine, pointer (guide, then landmarks), cover (ids that the metadata
    names) or package (where its document is). Archives that ``problems`` names whole have no rows. ``first``: the package
    document is the first .opf member, whatever the container says."""

    def made(frames):
        for book, z, _ in _opened(frames):
            names = z.namelist() if z else []
            try:
                text = lambda n: z.read(n).decode("utf-8", "replace")  # noqa: B023, E731
                opf = locate_package(names, text("META-INF/container.xml") if "META-INF/container.xml" in names else None, first)
                found = parse_package(book, opf, text(opf), decode) if opf else {t: [] for t in TABLES}
                if table == "pointer":
                    for m in found["manifest"]:
                        if "nav" in m[5] and m[6] in names:
                            found["pointer"] += landmarks(book, m[6], text(m[6]))
            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
                continue
            yield found[table]

    columns = [c.split()[0] for c in re.split(r", (?=\w+ )", TABLES[table])]
    return files.mapInPandas(lambda frames: _frames(made(frames), columns), TABLES[table])


def pack(members: list[tuple[str, bytes]]) -> bytes:
    """An archive: mimetype first and stored, the rest deflated, in the order given."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in sorted(members, key=lambda m: m[0] != "mimetype"):
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write(members: DataFrame) -> DataFrame:
    """(book_id, content): each book's members (book_id, entry_no, name, data) as an archive; a book fits in a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("entry_no")
        return pd.DataFrame({"book_id": [rows["book_id"].iloc[0]], "content": [pack(list(zip(rows["name"], rows["data"], strict=True)))]})

    return members.select("book_id", "entry_no", "name", "data").groupBy("book_id").applyInPandas(run, "book_id string, content binary")
