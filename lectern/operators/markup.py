"""Rewriting markup: links to what is gone, tables of contents, package documents, lists of references, formulas.

Functions of one document's text; ``operators.books`` applies them in Arrow batches."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from html import unescape
from urllib.parse import unquote

from ..functions import rules

HREF = re.compile(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']""")
SRC = re.compile(r"""(?is)<content\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']""")
ANCHOR = re.compile(rules.ANCHOR_PATTERN)


def attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)
    return m and (m[1] if m[1] is not None else m[2])


def external(href: str) -> bool:
    return href.startswith("//") or bool(re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*:", href))


def target(path: str, href: str) -> str:
    """Where an href of the document at ``path`` leads: no fragment, decoded, dots resolved; "" for the document itself."""
    bare = unquote(href.partition("#")[0])
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), bare)) if bare else ""


def goes_nowhere(path: str, kept: Iterable[str]) -> Callable[[str], bool]:
    """A test of whether an href of the document at ``path`` leads to a document that isn't kept."""
    kept = frozenset(kept)
    return lambda href: not (href.startswith("#") or external(href)) and target(path, href) not in kept


def degrade_links(path: str, html: str, kept: Iterable[str]) -> tuple[str, int]:
    """Anchors whose target isn't kept are replaced by what they hold. Links inside the document, external ones and anchors
    without an href stay."""
    gone, kept = 0, frozenset(kept)

    def shown(m: re.Match) -> str:
        nonlocal gone
        href = attribute(f"<a{m[1]}>", "href")
        to = target(path, href) if href and not href.startswith("#") and not external(href) else ""
        if not to or to in kept:
            return m[0]
        gone += 1
        return m[2]

    return ANCHOR.sub(shown, html), gone


@dataclass
class Block:
    """An element of one name, with those of its name directly inside it."""

    start: int
    inside: int
    end: int = -1
    blocks: list[Block] = field(default_factory=list)


def outline(text: str, name: str) -> list[Block]:
    """The elements of a name as a forest, in order. From an outermost element that is never closed on, there are none."""
    open_: list[Block] = []
    roots: list[Block] = []
    for m in re.finditer(rf"(?i)<(/?){name}(?:\b[^>]*>?|\s*>)", text):
        if not m[1]:
            open_.append(Block(m.start(), m.end()))
        elif open_:
            done = open_.pop()
            done.end = m.end()
            (open_[-1].blocks if open_ else roots).append(done)
    return [r for r in roots if not open_ or r.start < open_[0].start]


def prune(text: str, name: str, link: re.Pattern, dead: Callable[[str], bool]) -> tuple[str, int]:
    """Without the elements whose first link, anywhere inside, is dead, and without those that hold no link once their own
    elements are pruned; and how many went (what is inside a removed element isn't counted)."""

    def kept(b: Block) -> tuple[str, int]:
        whole = text[b.start : b.end]
        m = link.search(whole)
        if m and dead(m[1]):
            return "", 1
        left, gone = joined(b.blocks, b.start, b.end)
        return (left, gone) if re.search(r"(?i)<(?:a|content)\b", left) else ("", gone + 1)

    def joined(blocks: list[Block], start: int, end: int) -> tuple[str, int]:
        made = [kept(b) for b in blocks]
        cuts = [start, *(x for b in blocks for x in (b.start, b.end)), end]
        between = [text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)]
        return between[0] + "".join(m[0] + after for m, after in zip(made, between[1:], strict=True)), sum(m[1] for m in made)

    return joined(outline(text, name), 0, len(text))


def prune_nav(path: str, html: str, kept: Iterable[str]) -> tuple[str, int]:
    """A navigation document without entries for documents that aren't kept."""
    return prune(html, "li", HREF, goes_nowhere(path, kept))


def prune_ncx(path: str, xml: str, kept: Iterable[str]) -> tuple[str, int, int]:
    """An NCX file without entries for documents that aren't kept, playOrder numbered anew; how many went, and stay."""
    dead, total = goes_nowhere(path, kept), 0
    for name in ("navPoint", "pageTarget"):
        xml, gone = prune(xml, name, SRC, dead)
        total += gone
    numbers = iter(range(1, len(xml)))
    xml, n = re.subn(r'playOrder\s*=\s*"\d+"', lambda _: f'playOrder="{next(numbers)}"', xml)
    return xml, total, n


def rewrite_package(path: str, opf: str, keep_ids: Iterable[str], kept: Iterable[str]) -> str:
    """A package document without the items, spine entries and guide references that aren't kept; every other byte stays. A
    guide that is left empty goes."""
    ids, kept = frozenset(keep_ids), frozenset(kept)
    stays = {
        "manifest": ("item", lambda tag: attribute(tag, "id") in ids),
        "spine": ("itemref", lambda tag: attribute(tag, "idref") in ids),
        "guide": ("reference", lambda tag: external(attribute(tag, "href") or "") or target(path, attribute(tag, "href") or "") in kept),
    }
    for section, (name, stay) in stays.items():
        element = re.compile(rf"(?s)<{name}\b[^>]*?(?:/>|>.*?</{name}\s*>)")
        inside = lambda m, e=element, s=stay: e.sub(lambda x: x[0] if s(x[0]) else "", m[0])
        opf = re.sub(rf"(?s)<{section}\b.*?</{section}>", inside, opf, count=1)
    return re.sub(r"<guide\b[^>]*>\s*</guide\s*>", "", opf)


ITEMREF = re.compile(r"<itemref\b[^>]*/>")


def trim_spine(opf: str, ids: Iterable[str]) -> str:
    """A package document whose spine lacks some ids; only self-closing entries are taken out."""
    ids = frozenset(ids)
    return ITEMREF.sub(lambda m: "" if attribute(m[0], "idref") in ids else m[0], opf)


def restore_spine(source: str, opf: str, ids: Iterable[str]) -> str:
    """A package document with the entries of ``ids`` that its spine lacks put back as they stand in ``source``, each after
    the nearest entry before it there that is left here, at the head if there is none. None is doubled."""
    ids, here = frozenset(ids), {attribute(t, "idref") for t in ITEMREF.findall(opf)}
    after: dict[str | None, str] = {}
    last = None
    for tag in ITEMREF.findall(source):
        name = attribute(tag, "idref")
        if name in here:
            last = name
        elif name in ids:
            after[last] = after.get(last, "") + tag
    opf = ITEMREF.sub(lambda m: m[0] + after.pop(attribute(m[0], "idref"), ""), opf)
    return re.sub(r"<spine\b[^>]*>", lambda m: m[0] + after.get(None, ""), opf, count=1)


def register(opf: str, item_id: str, href: str, media: str = "application/xhtml+xml") -> str:
    """A package document with one more item, last in the manifest and in the spine; unchanged if it lacks either."""
    if not (re.search(r"</manifest\s*>", opf) and re.search(r"</spine\s*>", opf)):
        return opf
    opf = re.sub(r"</manifest\s*>", lambda m: f'<item id="{item_id}" href="{href}" media-type="{media}"/>{m[0]}', opf, count=1)
    return re.sub(r"</spine\s*>", lambda m: f'<itemref idref="{item_id}"/>{m[0]}', opf, count=1)


def reference_heading(html: str) -> int:
    """Where the heading of a list of references begins: of all, the highest level's first; -1 if there is none."""
    found = []
    for m in re.finditer(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>", html):
        title = unescape(re.sub(r"<[^>]*>", "", m[2])).strip().lower()
        if re.sub(rules.REFERENCE_NUMBERING, "", title) in rules.REFERENCE_TITLES:
            found.append((int(m[1]), m.start()))
    return min(found)[1] if found else -1


def split_references(html: str, least: int = rules.TAIL_LEAST_BYTES, share: float = rules.TAIL_LEAST_SHARE) -> tuple[str, str] | None:
    """(document, references document): from the heading of the references on, all that the body holds moves, whatever
    elements the heading stands in: their ends stay. None without such a heading, or if too little would be left."""
    body = re.search(r"(?is)<body\b[^>]*>(.*)</body\s*>", html)
    start = reference_heading(html)
    if not body or not body.start(1) <= start:
        return None
    depth, at, moved, stays = 0, start, [], []
    for m in re.finditer(r"""<(/?)([a-zA-Z][\w:.-]*)(?:[^>"']|"[^"]*"|'[^']*')*>|<!--.*?-->""", html[: body.end(1)][start:], re.S):
        if not m[2] or m[0].endswith("/>"):
            continue
        depth += -1 if m[1] else 1
        if depth < 0:  # the end of an element that began before the heading
            moved.append(html[at : start + m.start()])
            stays.append(m[0])
            at, depth = start + m.end(), 0
    moved.append(html[at : body.end(1)])
    left = html[body.start(1) : start] + "".join(stays)
    size = len(left.encode())
    if size < least or size < share * len(body[1].encode()):
        return None
    head = re.search(r"(?is)<head\b[^>]*>(.*?)</head\s*>", html)
    links = "".join(re.findall(r"(?is)<link\b[^>]*>", head[1])) if head else ""
    other = f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>References</title>{links}</head><body>{"".join(moved)}</body></html>'
    return html[: body.start(1)] + left + html[body.end(1) :], other


def de_escape_latex(text: str) -> str:
    """Inside formulas, a doubled backslash before a letter is single again."""
    for span in (r"(?s)\\\[.*?\\\]", r"(?s)\\\(.*?\\\)"):
        text = re.sub(span, lambda m: re.sub(r"\\\\(?=[A-Za-z])", r"\\", m[0]), text)
    return text


def repair_math(html: str) -> tuple[str, int]:
    """Formulas with prefixed names (m:) get the default namespace instead; and how many."""
    from .masking import NAMESPACE

    def plain(m: re.Match) -> str:
        return re.sub(r"<(/?)m:", r"<\1", f'<math xmlns="{NAMESPACE}"{m[0][7:]}')

    return re.subn(r"(?s)<m:math\b.*?</m:math>", plain, html)


def repoint_images(text: str, found: dict[str, str]) -> str:
    """Markdown with its images at the places that ``found`` (href: path) tells; others stay."""
    return re.sub(r"!\[\]\(([^)]*)\)", lambda m: f"![]({found[m[1]]})" if found.get(m[1]) else m[0], text)
