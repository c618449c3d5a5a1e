"""Exact self-join of n-gram sets by Jaccard similarity, with set-relation skipping; returns its classes or its links.

Lists. Documents with equal sets are one vertex. Every set's n-grams are put in one global order, rare ones first (counts
of all documents in hashed counters; ties by hash). Two similar sets share an n-gram in their first n - ceil(t n) + 1;
these entries (n-gram, position, size, vertex) are the index lists. Lists whose true length, counted, is over ``HOT`` are
dealt out in parts of about that many entries, so no task meets a longer one.

Skipping between lists and blocks. Each list (or part) is sorted by position, and its first set, the head, is compared
with every other set that size and position allow. Sets found similar join one component, and pairs inside a component
need no further look: a list whose blocks all lie in one component is skipped. What is left is compared block by block
(``BLOCK`` entries in order of position); a pair of blocks is skipped when its sizes, positions or components allow no
new link. Parts of a long list meet in cells of two parts each.

Answers from answers. Sets similar to one head differ from it little. Of each, what the head has and it lacks (L) and what
it has and the head lacks (E) are kept, and the overlap of two of them follows from these alone: size of the head - the
size of the union of their L + the number of common E. So a set's answers are derived from those of the head, and neither
texts nor sets are read again. For sets of a list that aren't similar to its head, min(o1, o2) + min(n1 - o1, n2 - o2)
bounds the overlap from the known overlaps with the head; a second bound comes from small vectors of hashed n-gram counts.
All bounds are safe, so every link between different components is found by comparing whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .caches import tidy
from .common import CHUNK_BYTES, bounded_batches, materialize, text_bytes, text_bytes_col
from .components import components
from .words import U64, Words, chunks, grams, mix, utf8

#: log2 of the hashed counters that order n-grams by frequency (4 bytes each in a task, 1 byte each when sent): a counter
#: for each COUNTER_SHARE bytes of text, between these bounds. They only decide how much is skipped.
COUNTER_BITS, COUNTER_SHARE = (16, 24), 256
COUNTER_BLOCKS = 64
#: Entries of a list, or of a part of a longer one.
HOT = 4096
#: Entries of a block of a list.
BLOCK = 128
#: log2 of the bits of the filter of documents that are compared, eight for each, between these bounds (32 MB when sent).
FILTER_BITS = (16, 28)

SET = ["s1", "s2", "n"]


def sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as ascending hashes; fewer words are one shingle; no words, none."""
    w = Words(texts, lower=True)
    whole = {k: grams(w.hashes, k) for k in range(1, n + 1)}
    out = []
    for lo, hi in zip(w.offset[:-1].tolist(), w.offset[1:].tolist(), strict=True):
        k = min(n, hi - lo)
        out.append(np.unique(whole[k][lo : hi - k + 1]) if k else np.empty(0, dtype=U64))
    return out


def _vector(s: np.ndarray) -> bytes:
    """Counts of the shingles by their low hash bits, in about size / 16 cells (a power of two), each up to 255. The
    sum of absolute differences of two vectors is at most the size of the sets' symmetric difference."""
    cells = 1 << max(3, int(len(s) // 16).bit_length())
    return np.minimum(np.bincount((s & U64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _least_difference(x: bytes, y: bytes) -> int:
    a, b = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (x, y))
    k = min(len(a), len(b))
    return int(np.abs(a.reshape(-1, k).sum(0) - b.reshape(-1, k).sum(0)).sum())


def _sums(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set its size and two 64-bit sums of its members' mixed hashes, which name it."""
    size = np.array([len(s) for s in of], dtype=np.int64)
    every = np.concatenate([*of, np.empty(0, dtype=U64)])
    at = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        run = [np.concatenate([[U64(0)], np.cumsum(mix(every ^ U64(k)), dtype=U64)]) for k in (0, 0x5851F42D4C957F2D)]
        s1, s2 = ((c[at[1:]] - c[at[:-1]]).view(np.int64) for c in run)
    return size, s1, s2


def _counters(n: int, bits: int, chunk_bytes: int):
    """Documents to a task's hashed counters of their sets' n-grams, in blocks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counters = np.zeros(1 << bits, dtype=np.uint32)
        for t in chunks(batches, "text", chunk_bytes):
            every = np.concatenate([*sets(utf8(t["text"]), n), np.empty(0, dtype=U64)])
            counters += np.bincount((every >> U64(64 - bits)).astype(np.int64), minlength=len(counters)).astype(np.uint32)
        blocks = [(i, b.astype(np.uint8 if b.max() < 256 else np.uint32).tobytes()) for i, b in enumerate(counters.reshape(COUNTER_BLOCKS, -1)) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], ["block", "counts"])

    return run


def _frequencies(rows: DataFrame, n: int, bits: int, chunk_bytes: int) -> np.ndarray:
    """The counters of all documents, added up and reduced to one byte each (a quarter of a power of two)."""
    cells = (1 << bits) // COUNTER_BLOCKS

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(data, dtype=np.uint8 if len(data) == cells else np.uint32)
                total[i] = total.get(i, 0) + c.astype(np.int64)
        data = [np.floor(4 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(data, pa.binary())], ["block", "counts"])

    out = np.zeros((COUNTER_BLOCKS, cells), dtype=np.uint8)
    made = rows.select("text").mapInArrow(tidy(_counters(n, bits, chunk_bytes)), "block int, counts binary")
    for i, data in made.repartition("block").mapInArrow(tidy(add), "block int, counts binary").collect():  # a byte a counter
        out[i] = np.frombuffer(data, dtype=np.uint8)
    return out.ravel()


def _prefixes(n: int, percent: int, rank, longest: int, chunk_bytes: int):
    """Documents to (id, th, n, s1, s2, vector, grams, maybe): the entries of the lists, in order. ``maybe``: a counter over ``longest``
    says that the list may be long; whether it is, is counted."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ranks = rank.value
        bits = len(ranks).bit_length() - 1
        hot = int(np.floor(4 * np.log2(1.0 + longest)))
        least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62  # a smaller set is similar to its equal alone, and equals are one vertex
        for t in chunks(batches, "text", chunk_bytes):
            of = sets(utf8(t["text"]), n)
            size, s1, s2 = _sums(of)
            entries, maybe, at = [], [], [0]
            for s in of:
                if len(s) >= least:
                    r = ranks[(s >> U64(64 - bits)).astype(np.int64)]
                    first = np.argsort(r, kind="stable")[: len(s) - (percent * len(s) + 99) // 100 + 1]
                    entries.append(s[first].view(np.int64))
                    maybe.append(r[first] >= hot)
                at.append(at[-1] + (len(entries[-1]) if len(s) >= least else 0))
            at = pa.array(np.array(at, dtype=np.int32))
            flat, some = (np.concatenate(x) if x else np.empty(0, dtype=k) for x, k in ((entries, np.int64), (maybe, bool)))
            arrays = [t["id"].combine_chunks(), t["th"].combine_chunks(), pa.array(size), pa.array(s1), pa.array(s2), pa.array([_vector(s) for s in of], pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(at, pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(some))], ["id", "th", "n", "s1", "s2", "vector", "grams", "maybe"])

    return run


class _Bounds:
    """Conditions on a pair of list entries, as columns; t = percent / 100."""

    def __init__(self, percent: int):
        self.p, self.q = percent, 100 + percent

    def similar(self, overlap, n1, n2):
        """overlap / (n1 + n2 - overlap) >= t."""
        return overlap * self.q >= (n1 + n2) * self.p

    def sizes(self, n1, n2):
        return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * self.p

    def places(self, n1, p1, n2, p2):
        """The n-gram at places p1 and p2 is the first that they share, or an earlier one is, which has its own list."""
        return self.similar(F.least(n1 - p1, n2 - p2), n1, n2)


class _Join:
    """The steps of one join."""

    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, chunk_bytes: int):
        if not 0 < percent <= 100:
            raise ValueError(f"percent: {percent}")
        bounded_batches(docs.sparkSession)
        self.n, self.percent, self.chunk_bytes, self.bound = n, percent, chunk_bytes, _Bounds(percent)
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes_col(F.col(text_col).cast("string")).alias("text")).withColumn("th", F.xxhash64("text"))
        low, high = COUNTER_BITS
        bits = min(high, max(low, (text_bytes(self.rows) // COUNTER_SHARE).bit_length()))
        rank = docs.sparkSession.sparkContext.broadcast(_frequencies(self.rows, n, bits, chunk_bytes))
        made = self.rows.mapInArrow(tidy(_prefixes(n, percent, rank, HOT, chunk_bytes)), "id long, th long, n long, s1 long, s2 long, vector binary, grams array<long>, maybe array<boolean>")
        self.documents = materialize(made, "profiles")
        rank.destroy()
        # one vertex for each set; its number is fixed by writing it
        known = self.documents.groupBy(*SET).agg(F.min("id").alias("rep"), F.count("id").alias("members"), F.first("vector").alias("vector"), F.first("grams").alias("grams"), F.first("maybe").alias("maybe"))
        self.sets = materialize(known.where("n > 0").withColumn("v", F.monotonically_increasing_id()), "sets")
        self.entries = materialize(self._lists(), "lists")

    def _lists(self) -> DataFrame:
        """(g, salt, id, n, pos, block, hid, hn, hpos): the lists with their heads; entries that are alone go."""
        some = lambda yes: F.expr(f"filter(transform(grams, (g, i) -> struct(g as g, i as pos)), (x, i) -> {'' if yes else 'not '}maybe[i])")
        rows = lambda which: self.sets.select(F.col("v").alias("id"), F.col("n").cast("int").alias("n"), F.explode(which).alias("e")).select("e.g", "id", "n", "e.pos")
        often = rows(some(True))
        long_ = often.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where(f"k > {HOT}").select("g", F.ceil(F.col("k") / HOT).alias("parts"))
        often = often.join(long_, "g", "left").select("g", "id", "n", "pos", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(-1)).cast("int").alias("salt"))
        every = rows(some(False)).withColumn("salt", F.lit(-1)).unionByName(often)
        lists = Window.partitionBy("g", "salt").orderBy("pos", "n", "id")
        first = F.first(F.struct("id", "n", "pos")).over(lists).alias("h")
        every = every.select("*", first, F.row_number().over(lists).alias("nth"), F.lead("id").over(lists).alias("next"))
        # alone in its list, an entry meets nobody; but a part is not the whole list
        every = every.where("nth > 1 or next is not null or salt >= 0")
        return every.select("g", "salt", "id", "n", "pos", F.floor((F.col("nth") - 1) / BLOCK).cast("int").alias("block"), F.col("h.id").alias("hid"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hpos"))

    def heads(self) -> DataFrame:
        """(a, b): the head of each list with the rest; the heads of a long list's parts with the first of them."""
        star = self.entries.where("id <> hid").select("id", "n", "pos", "hid", "hn", "hpos")
        parts = Window.partitionBy("g").orderBy("pos", "n", "id")
        tops = self.entries.where("salt >= 0 and id = hid").select("g", "id", "n", "pos", F.first(F.struct("id", "n", "pos")).over(parts).alias("h"))
        tops = tops.select("id", "n", "pos", F.col("h.id").alias("hid"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hpos")).where("id <> hid")
        star = star.union(tops).where(self.bound.sizes(F.col("n"), F.col("hn")) & self.bound.places(F.col("n"), F.col("pos"), F.col("hn"), F.col("hpos")))
        return star.select(F.least("id", "hid").alias("a"), F.greatest("id", "hid").alias("b")).distinct()

    def compare(self, pairs: DataFrame, differences: bool = False) -> DataFrame:
        """(a, b, na, nb, overlap) of those pairs (a < b) that the count vectors don't rule out, by whole sets of hashes; with
        ``differences`` also what only one of two similar sets has (only_a, only_b; else null)."""
        side = lambda x: self.sets.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("vector").alias(f"v{x}"))
        percent, n, chunk_bytes = self.percent, self.n, self.chunk_bytes

        def near(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                x = {k: b.column(i).to_pylist() for i, k in enumerate(("a", "b", "na", "nb", "va", "vb"))}
                keep = [(na + nb - _least_difference(va, vb)) // 2 * (100 + percent) >= (na + nb) * percent for na, nb, va, vb in zip(x["na"], x["nb"], x["va"], x["vb"], strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        left = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb")
        left = materialize(left.mapInArrow(tidy(near), "a long, b long"), "near-pairs")
        some = materialize(left.select(F.col("a").alias("v")).union(left.select("b")).distinct().join(self.sets.select("v", "rep", *SET), "v"), "compared")
        # the documents that are compared: a bitmap of bounded size spares hashing and shuffling the rest
        low, high = FILTER_BITS
        bits = min(high, max(low, (8 * some.count()).bit_length()))
        coded = lambda d, c: d.withColumn("_w", F.expr(f"shiftright(pmod(xxhash64({c}), {1 << bits}), 6)")).withColumn("_m", F.expr(f"shiftleft(1L, int(pmod(xxhash64({c}), {1 << bits}) % 64))"))
        words = coded(some, "rep").groupBy("_w").agg(F.bit_or("_m").alias("_bits"))
        open_ = coded(self.rows, "id").join(F.broadcast(words), "_w").where(F.col("_m").bitwiseAND(F.col("_bits")) != 0).select("id", "text")

        def hashed(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for t in chunks(batches, "text", chunk_bytes // 2):
                of = sets(utf8(t["text"]), n)
                size, s1, s2 = _sums(of)
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                flat = pa.array(np.concatenate([*of, np.empty(0, dtype=U64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), pa.array(s1), pa.array(s2), pa.array(size), pa.ListArray.from_arrays(pa.array(at), flat)], ["id", "s1", "s2", "n", "h"])

        whole = open_.mapInArrow(tidy(hashed), "id long, s1 long, s2 long, n long, h array<long>")
        whole = whole.drop("id").join(some.drop("rep"), SET).groupBy("v").agg(F.first("h").alias("h"))  # several rows may have a set
        whole = materialize(whole, "compared-sets")
        set_of = lambda x: whole.select(F.col("v").alias(x), F.col("h").alias(f"h{x}"))
        both = left.join(set_of("b"), "b").join(set_of("a"), "a").select("a", "b", F.size("ha").cast("long").alias("na"), F.size("hb").cast("long").alias("nb"), F.size(F.array_intersect("ha", "hb")).cast("long").alias("overlap"), "ha", "hb")
        if not differences:
            return materialize(both.drop("ha", "hb"), "answers")
        similar = self.bound.similar(F.col("overlap"), F.col("na"), F.col("nb"))
        only = lambda x, y: F.when(similar, F.array_except(x, y))
        return materialize(both.select("a", "b", "na", "nb", "overlap", only("ha", "hb").alias("only_a"), only("hb", "ha").alias("only_b")), "answers")

    def further(self, compared: DataFrame, label: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """(a, b): pairs of a list in different components that no bound rules out and that weren't compared. Without ``label``
        (and with differences in ``compared``), pairs inside a component too, and the answers (a, b, na, nb, overlap) of those
        that are both similar to one head, derived from its answers."""
        derive, bound = label is None, self.bound
        over = compared.select(F.col("a").alias("x"), F.col("b").alias("y"), "overlap", *(["only_a", "only_b"] if derive else []))
        own = self.entries.withColumn("c", F.col("id")) if derive else self.entries.join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        # only lists with more than one component are looked at again
        open_ = own.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("salt").alias("last")).where("lo <> hi").select("g", "last")
        own = own.join(open_, "g").withColumn("x", F.least("id", "hid")).withColumn("y", F.greatest("id", "hid"))
        own = own.join(over, ["x", "y"], "left").withColumn("o", F.when(F.col("id") == F.col("hid"), F.col("n")).otherwise(F.col("overlap")))
        if derive:
            mine = lambda p, q: F.when(F.col("id") == F.col("x"), F.col(p)).otherwise(F.col(q))
            own = own.withColumn("extra", mine("only_a", "only_b")).withColumn("lacks", mine("only_b", "only_a"))
        fields = ["g", "salt", "block", "id", "n", "pos", "hid", "hn", "c", "o", *(["extra", "lacks"] if derive else [])]
        own = materialize(own.select(*fields, "last"), "open-lists")
        blocks = own.groupBy("g", "salt", "block").agg(F.min("pos").alias("p"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("last").alias("last"))
        blocks = materialize(blocks, "blocks")
        # a cell for each two parts of a list (i <= j): the blocks of part i on one side, those of part j on the other
        side = lambda d, x: d.select(*(F.col(c).alias(c if c in ("g", "i", "j") else f"{c}{x}") for c in d.columns))
        left = side(blocks.select("*", F.col("salt").alias("i"), F.explode(F.sequence("salt", "last")).alias("j")).drop("last"), "x")
        right = side(blocks.select("*", F.explode(F.sequence(F.least(F.lit(0), F.col("salt")), F.col("salt"))).alias("i"), F.col("salt").alias("j")).drop("last"), "y")
        pair = left.join(right, ["g", "i", "j"]).where("saltx < salty or blockx <= blocky")
        pair = pair.where("not (c0x = c1x and c0y = c1y and c0x = c0y)").where(F.col("n1x") * 100 >= F.col("n0y") * bound.p).where(F.col("n1y") * 100 >= F.col("n0x") * bound.p)
        pair = pair.where(bound.similar(F.least(F.col("n1x") - F.col("px"), F.col("n1y") - F.col("py")), F.col("n0x"), F.col("n0y")))
        pair = pair.select("g", "saltx", "blockx", "salty", "blocky")
        own = own.drop("last")
        both = pair.join(side(own, "x"), ["g", "saltx", "blockx"]).join(side(own, "y"), ["g", "salty", "blocky"])
        both = both.where("idx <> idy and cx <> cy and idx <> hidy and idy <> hidx").where("saltx <> salty or blockx <> blocky or idx < idy")
        both = both.where(bound.sizes(F.col("nx"), F.col("ny")) & bound.places(F.col("nx"), F.col("posx"), F.col("ny"), F.col("posy")))
        most = F.least("ox", "oy") + F.least(F.col("nx") - F.col("ox"), F.col("ny") - F.col("oy"))
        one = F.col("hidx") == F.col("hidy")
        both = both.where(F.coalesce(~(one & ~bound.similar(most, F.col("nx"), F.col("ny"))), F.lit(True)))
        a, b = F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")
        fresh = lambda d: d.join(compared.select("a", "b"), ["a", "b"], "left_anti")
        if not derive:
            return materialize(fresh(both.select(a, b).distinct()), "further-pairs"), None
        known = one & F.col("extrax").isNotNull() & F.col("extray").isNotNull()
        overlap = F.col("hnx") - F.size(F.array_union("lacksx", "lacksy")) + F.size(F.array_intersect("extrax", "extray"))
        size = lambda p, q: F.when(F.col("idx") < F.col("idy"), F.col(p)).otherwise(F.col(q)).cast("long")
        derived = both.where(known).select(a, b, size("nx", "ny").alias("na"), size("ny", "nx").alias("nb"), overlap.cast("long").alias("overlap"))
        derived = materialize(fresh(derived.dropDuplicates(["a", "b"])), "derived-answers")
        rest = fresh(both.where(F.coalesce(~known, F.lit(True))).select(a, b).distinct()).join(derived.select("a", "b"), ["a", "b"], "left_anti")
        return materialize(rest, "further-pairs"), derived


def similarity_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id reachable over links (itself
    included). Two documents link when 100 * intersection >= percent * union of their sets of n-word shingles of
    lower-cased (A-Z) words; a shorter text is one shingle, and a text without words, or null, links with nothing.

    Equal sets are one vertex from the start. Identifiers are whole numbers. Rows that repeat one with the same text get
    the same row each; with different texts each row goes by its own text, and the identifier counts in the component of
    each. A row without an identifier links like any other and takes its component's smallest identifier, or null if there
    is none. Other columns play no part. An empty table gives an empty result."""
    join = _Join(docs, n, percent, id_col, text_col, chunk_bytes)
    out = join.documents.select("id", *SET).join(_components(join).select(*SET, "least"), SET, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _components(join: _Join) -> DataFrame:
    """(s1, s2, n, component, least) of every set: its component, and the smallest identifier there."""
    bound = join.bound
    links = lambda d: d.where(bound.similar(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")
    compared = join.compare(join.heads())
    label = components(links(compared))
    more, _ = join.further(compared, label)
    if not more.isEmpty():
        found = links(join.compare(more))
        if not found.isEmpty():
            label = components(links(compared).union(found))
    named = join.sets.select("v", "rep", *SET).join(label.select(F.col("id").alias("v"), "component"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    named = materialize(named, "vertices")
    # written first, so that a component of very many sets can be split when the two meet
    least = materialize(named.groupBy("component").agg(F.min("rep").alias("least")), "components")
    return named.join(least, "component").select(*SET, "component", "least")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component of ``similarity_classes`` one row stays, that
    of the smallest identifier (null: last), then of the largest set, then of the smallest hashes of set and text. Texts
    without words all stay. An empty table gives an empty result.

    Rows are known by identifier and text, not by identifier alone, so a text that is like no other never goes, whatever
    identifiers repeat or are null; rows that are equal in both stay once."""
    join = _Join(docs, n, percent, id_col, text_col, chunk_bytes)
    rows = join.documents.where("n > 0").select("id", "th", *SET)
    of = rows.join(_components(join).drop("least"), SET)
    place = F.struct(F.col("id").isNull().alias("p"), "id", (-F.col("n")).alias("q"), "s1", "s2", "th")
    of = materialize(of, "members")
    stays = materialize(of.groupBy("component").agg(F.min(place).alias("k")).select("component", F.struct("k.id", "k.th").alias("k")), "staying")
    gone = of.join(stays, "component").where(~(F.col("id").eqNullSafe(F.col("k.id")) & (F.col("th") == F.col("k.th"))))
    names = ["_lectern_id", "_lectern_none", "_lectern_text"]
    key = lambda i, th: [F.coalesce(i, F.lit(0)).alias(names[0]), i.isNull().alias(names[1]), th.alias(names[2])]
    gone = materialize(gone.select(*key(F.col("id"), F.col("th"))).distinct(), "near-copies")
    text = text_bytes_col(F.col(text_col).cast("string"))
    out = docs.select("*", *key(F.col(id_col).cast("long"), F.xxhash64(text))).join(gone, names, "left_anti")
    if not rows.groupBy("id", "th").count().where("count > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
        out = out.withColumn("_lectern_nth", nth).where((F.col("_lectern_nth") == 1) | ~text.rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def similarity_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every link of ``similarity_classes``, those inside a component too: (a, b, n_a, n_b, overlap, links), one row for
    each two different sets that link, by the smallest identifiers that hold them (a < b), and one with a = b for each set
    that several rows hold. ``links``: how many pairs of rows the row stands for. Rows without an identifier don't count."""
    join = _Join(docs, n, percent, id_col, text_col, chunk_bytes)
    compared = join.compare(join.heads(), differences=True)
    more, derived = join.further(compared, None)
    answers = ["a", "b", "na", "nb", "overlap"]
    every = compared.select(answers).union(derived.select(answers)).union(join.compare(more).select(answers))
    every = every.where(join.bound.similar(F.col("overlap"), F.col("na"), F.col("nb")))
    side = lambda x: join.sets.where("rep is not null").select(F.col("v").alias(x), F.col("rep").alias(f"r{x}"), F.col("members").alias(f"m{x}"))
    out = every.join(side("a"), "a").join(side("b"), "b")
    swap = F.col("ra") > F.col("rb")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    out = out.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), pick("na", "nb").alias("n_a"), pick("nb", "na").alias("n_b"), "overlap", (F.col("ma") * F.col("mb")).alias("links"))
    equal = join.sets.where("members > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").alias("overlap"), F.expr("members * (members - 1) div 2").alias("links"))
    return out.union(equal)
