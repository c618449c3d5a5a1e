"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

log P(token | history) = log P(class | history) + log P(token | class, word before). Classes are the most frequent words, each
alone, the end of a text, and groups of words by their last letters. Both factors are log-linear.

* P(class | history) is a softmax over sums of weight rows that hashed features of the history select: the word before,
  the word before that (skip), the pair of both, and the letter groups of the last three. A row's direction is one
  regularised step of iterative scaling from the counts of all training tokens (observed against expected at the class
  shares, a prior of ``PRIOR`` tokens); how far rows go, for each kind of feature and level of evidence, is trained by
  gradient updates with curvature, summed over all training tokens.
* P(token | class, word before) is a softmax over the class's words with a weight for each pair of words that training has
  seen, as many as there are. Pairs meet in buckets by word before and class, which are that factor's histories, so each
  bucket runs the gradient updates (Newton's, with a Gaussian prior) for its own weights, and the normaliser is exact: it
  differs from 1 by the seen pairs alone. Words too rare for the hot table share a place in their class; within it
  they have their smoothed shares, one unknown type included.

1. Counts of all training tokens, exact: chunks of documents send each distinct word once to its bucket.
2. Counts of features and classes, then the gradient rounds: sums that don't depend on how documents are partitioned.
3. Scores, in sparse batches. Words with at least 1/HOT_WORDS of all tokens are at most HOT_WORDS; with the end of a text,
   they are a table of bounded size that goes to every task. Rare words of a chunk meet their counts in buckets, each
   distinct word once; pairs meet there with the documents that hold them. What comes back is a sum per document: no text is
   shuffled, and no word or pair is frequent enough to fill a bucket, for the commonest words are classes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import tidy
from .common import CHUNK_BYTES, bounded_batches, buckets_for, materialize, text_bytes
from .words import U64, Words, chunks, mix, utf8

HOT_WORDS = 1 << 18
#: Classes: END, SINGLE frequent words, and LETTERS groups by last letters.
SINGLE, LETTERS = 11, 20
CLASSES = 1 + SINGLE + LETTERS
#: Kinds of features, and log2 of the rows of each kind: one for each distinct training word, between these bounds (16 MB
#: of weights at most, for they go to every task).
KINDS, ROW_BITS = 4, (10, 15)
#: Tokens that a row's prior counts for; levels of evidence; where all scales begin; the variance of a pair's weight.
PRIOR, LEVELS, FIRST_SCALE, VARIANCE = 4.0, 12, 0.4, 6.0
NEWTON_STEPS = 8
BLOCKS = 64
BATCH = 8192
#: Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20
END = U64(0x3C6EF372FE94F82B)  # stands for the end of a text among word hashes
BEGIN = U64(0xA54FF53A5F1D36F1)
END_GROUP = 255


@dataclass
class Tokens:
    """The tokens of a chunk: hashes, letter groups (END_GROUP: an end), document of each, place in it."""

    hashes: np.ndarray
    group: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    count: np.ndarray


def tokens(texts: list[bytes]) -> Tokens:
    w = Words(texts, lower=True)
    n = w.counts() + 1
    doc = np.repeat(np.arange(len(texts)), n)
    last = np.cumsum(n) - 1
    word = np.ones(len(doc), dtype=bool)
    word[last] = False
    hashes, group = np.full(len(doc), END, dtype=U64), np.full(len(doc), END_GROUP, dtype=np.uint8)
    hashes[word] = w.hashes
    final = w.buffer[w.end - 1].astype(U64)
    before = np.where(w.end - w.start > 1, w.buffer[np.maximum(w.end - 2, 0)], 0).astype(U64)
    group[word] = (mix(final | before << U64(8)) % U64(LETTERS)).astype(np.uint8)
    return Tokens(hashes, group, doc, np.arange(len(doc)) - (last - n + 1)[doc], n)


def features(t: Tokens, bits: int) -> list[np.ndarray]:
    """The rows of each token's features, one of each kind."""

    def back(values, k, fill):
        out = np.empty_like(values)
        out[:k] = fill
        out[k:] = values[:-k] if len(values) > k else out[k:]
        out[t.place < k] = fill
        return out

    one, two = back(t.hashes, 1, BEGIN), back(t.hashes, 2, BEGIN)
    letters = [back(t.group, k, 254).astype(U64) for k in (1, 2, 3)]
    row = lambda x, kind: (mix(x ^ U64(0x9E3779B97F4A7C15 * (2 * kind + 1) & 0xFFFFFFFFFFFFFFFF)) >> U64(64 - bits)).astype(np.int64) + (kind << bits)
    with np.errstate(over="ignore"):
        return [row(one, 0), row(two, 1), row(one * U64(31) + two, 2), row(letters[0] | letters[1] << U64(8) | letters[2] << U64(16), 3)]


def before(t: Tokens) -> np.ndarray:
    """The word before each token."""
    out = np.empty_like(t.hashes)
    out[1:] = t.hashes[:-1]
    out[t.place == 0] = BEGIN
    return out


def word_classes(t: Tokens, hot: np.ndarray, hot_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's class, and its place in the table of hot words (-1: not there)."""
    at = np.minimum(np.searchsorted(hot, t.hashes), max(0, len(hot) - 1))
    known = hot[at] == t.hashes if len(hot) else np.zeros(len(t.hashes), dtype=bool)
    cls = np.where(t.group == END_GROUP, 0, 1 + SINGLE + t.group.astype(np.int64))
    cls[known] = hot_class[at[known]]
    return cls, np.where(known, at, -1)


def _softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each token: log-probabilities up to the log of the second array, and the rows."""
    each = [weights.take(r, axis=0) for r in rows]
    x = each[0] + bias
    for w in each[1:]:
        x += w
    x -= x.max(axis=1, keepdims=True)
    return x, np.exp(x) @ np.ones(x.shape[1], dtype=np.float32), each


def class_log10(weights, bias, rows, cls) -> np.ndarray:
    """log10 P(class | history) of each token."""
    out = np.empty(len(cls))
    for lo in range(0, len(cls), BATCH):
        hi = lo + BATCH
        x, total, _ = _softmax(weights, bias, [r[lo:hi] for r in rows])
        y = cls[lo:hi]
        out[lo:hi] = x[np.arange(len(y)), y] - np.log(total)
    return out / np.log(10)


def gradient(direction, n, share, scales, bits, bias, rows, cls) -> np.ndarray:
    """The gradient of the log-likelihood in the scales (kind, level), its curvature (by the products of the tokens'
    gradients), and the log-likelihood, of a batch: one vector of sums. A token isn't predicted from itself: it is taken
    out of the rows' counts (n: tokens of each row), which changes its own class's entry and the level of evidence."""
    at, size = np.arange(len(cls)), KINDS * LEVELS
    each, place, x = [], [], np.repeat(bias[None], len(cls), axis=0)
    for k, r in enumerate(rows):
        w = direction.take(r, axis=0)
        held = np.exp(w[at, cls]) * share[cls] * (n[r] + PRIOR)  # smoothed count of the token's class
        w[at, cls] += np.log(np.maximum(held - 1, 1e-6) / held)
        place.append(k * LEVELS + levels(n[r] - 1))
        each.append(w)
        x += w * scales[place[-1], None].astype(np.float32)
    x -= x.max(axis=1, keepdims=True)
    p = np.exp(x)
    total = p @ np.ones(p.shape[1], dtype=np.float32)
    log_p = x[at, cls] - np.log(total)
    p *= (1 / total)[:, None]
    g = [(w[at, cls] - np.einsum("ij,ij->i", p, w)).astype(np.float64) for w in each]
    first = sum(np.bincount(i, weights=v, minlength=size) for i, v in zip(place, g, strict=True))
    second = np.zeros(size * size)
    for k in range(KINDS):
        for j in range(KINDS):
            second += np.bincount(place[k] * size + place[j], weights=g[k] * g[j], minlength=size * size)
    return np.concatenate([first, second, [log_p.sum(dtype=np.float64)]])


def levels(n: np.ndarray) -> np.ndarray:
    """Levels of evidence of rows with so many tokens."""
    return np.minimum(np.log2(1.0 + n), LEVELS - 1).astype(np.int64)


def directions(counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's direction, log of its smoothed shares of classes over the shares at large; and its tokens."""
    n = counts.sum(axis=1)
    out = np.log((counts + PRIOR * share) / (n[:, None] + PRIOR)) - np.log(share)
    return out.astype(np.float32), n.astype(np.float64)


def pair_weights(of: np.ndarray, count: np.ndarray, share: np.ndarray, histories: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of seen pairs, and log of each history's normaliser, by Newton's updates for
    sum(count * log p) - weight**2 / (2 * VARIANCE), p = share * exp(weight) / normaliser. ``of``: the history of a pair;
    ``share``: its word's share of the class. The curvature of a history is a diagonal less a product, so a step is
    exact at the cost of two sums; it moves no weight by more than 2."""
    total = np.bincount(of, weights=count, minlength=histories)[of]
    w = np.zeros(len(of))

    def normaliser():
        return 1 + np.bincount(of, weights=share * np.expm1(w), minlength=histories)

    for _ in range(NEWTON_STEPS):
        p = share * np.exp(w) / normaliser()[of]
        diagonal = total * p + 1 / VARIANCE
        step = (count - total * p - w / VARIANCE) / diagonal
        along, left = (np.bincount(of, weights=v, minlength=histories)[of] for v in (p * step, total * p * p / diagonal))
        w += np.clip(step + total * p / diagonal * along / (1 - left), -2, 2)
    return w, np.log(normaliser())


def _batch(rows: list[tuple], names: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    columns = [x.strip().split() for x in names.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], [c for c, _ in columns])


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True)) if cuts else []


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U64(32)) % U64(n)).astype(np.int64)


VOCABULARY = "bucket int, hashes binary, counts binary, groups binary, distinct long, total long, n array<long>, v array<long>"


def vocabulary(rows: DataFrame, n_buckets: int, chunk_bytes: int) -> DataFrame:
    """Counts of the tokens of (text) rows: a row for each bucket of hashes."""
    sent = "bucket int, hashes binary, counts binary, groups binary"

    def count(batches: Iterator) -> Iterator:
        for t in chunks(batches, "text", chunk_bytes):
            x = tokens(utf8(t["text"]))
            h, at, n = np.unique(x.hashes, return_index=True, return_counts=True)
            b = _bucket(h, n_buckets)
            order = np.argsort(b, kind="stable")
            h, n, g, b = h[order], n[order].astype("<u4"), x.group[at[order]], b[order]
            yield _batch([(int(b[lo]), h[lo:hi].tobytes(), n[lo:hi].tobytes(), g[lo:hi].tobytes()) for lo, hi in _spans(b)], sent)

    def add(table):
        import pyarrow as pa

        cat = lambda c, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in table[c].to_pylist()])
        h, at, of = np.unique(cat("hashes", "<u8"), return_index=True, return_inverse=True)
        c = np.bincount(of, weights=cat("counts", "<u4")).astype(np.int64)
        g = cat("groups", np.uint8)[at]
        inside = g != END_GROUP
        n = np.bincount(g[inside], weights=c[inside], minlength=LETTERS).astype(np.int64)
        v = np.bincount(g[inside], minlength=LETTERS)
        row = (table["bucket"][0].as_py(), h.tobytes(), c.tobytes(), g.tobytes(), len(h), int(c.sum()), n.tolist(), v.tolist())
        return pa.Table.from_batches([_batch([row], VOCABULARY)])

    return rows.select("text").mapInArrow(tidy(count), sent).groupBy("bucket").applyInArrow(add, VOCABULARY)


@dataclass
class Model:
    """What scores need beside the pairs; all of bounded size."""

    total: int
    distinct: int
    hot: np.ndarray  # hashes in ascending order
    hot_count: np.ndarray
    hot_class: np.ndarray
    mass: np.ndarray  # of each class: the smoothed counts of its hot words
    rare: np.ndarray  # and of all others
    bias: np.ndarray
    bits: int
    weights: np.ndarray
    likelihood: list  # mean log P(class | history) of the training tokens before each round

    def shares(self, word: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Shares of words (places in the hot table; its length and more: rare) of their classes."""
        hot = word < len(self.hot)
        n = np.where(hot, self.hot_count[np.where(hot, word, 0)] + 0.5, self.rare[cls]) if len(self.hot) else self.rare[cls]
        return n / (self.mass + self.rare)[cls]


def _narrow(block: np.ndarray) -> bytes:
    """Counts with a byte in front that tells their width."""
    width = 1 if block.max() < 1 << 8 else 2 if block.max() < 1 << 16 else 4
    return bytes([width]) + block.astype(f"<u{width}").tobytes()


def _sum_blocks(made: DataFrame) -> dict[int, np.ndarray]:
    """Blocks of counts (block int, counts binary), added up in parallel; what comes back has the size of the weights."""

    def add(batches: Iterator) -> Iterator:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)
        yield _batch([(i, v.tobytes()) for i, v in total.items()], "block int, counts binary")

    got = made.repartition("block").mapInArrow(tidy(add), "block int, counts binary").collect()
    return {i: np.frombuffer(data, dtype=np.int64) for i, data in got}


def fit(rows: DataFrame, words: DataFrame, rounds: int = 1, chunk_bytes: int = CHUNK_BYTES) -> Model:
    """Train P(class | history) on the (text) rows, whose vocabulary is ``words``."""
    spark = rows.sparkSession
    total, distinct = (int(x or 0) for x in words.agg(F.sum("total"), F.sum("distinct")).first())
    sums = words.select(F.posexplode(F.arrays_zip("n", "v"))).groupBy("pos").agg(F.sum("col.n").alias("n"), F.sum("col.v").alias("v"))
    class_n, class_v = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for k, n, v in sums.collect():  # LETTERS rows
        class_n[1 + SINGLE + k], class_v[1 + SINGLE + k] = n, v

    def frequent(batches: Iterator) -> Iterator:
        for b in batches:
            out = []
            for h, c, g in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h, c, g = np.frombuffer(h, dtype="<u8"), np.frombuffer(c, dtype="<i8"), np.frombuffer(g, dtype=np.uint8)
                k = (c * HOT_WORDS >= total) | (g == END_GROUP)  # the end is a class, however rare
                out.append((h[k].tobytes(), c[k].tobytes(), g[k].tobytes()))
            yield _batch(out, "h binary, c binary, g binary")

    found = words.select("hashes", "counts", "groups").mapInArrow(tidy(frequent), "h binary, c binary, g binary").collect()  # HOT_WORDS words at most, and the end
    h, c, g = (np.concatenate([np.frombuffer(r[i], dtype=kind) for r in found] or [np.empty(0, dtype=kind)]) for i, kind in enumerate(("<u8", "<i8", np.uint8)))
    order = np.argsort(h)
    h, c, g = h[order], c[order], g[order]
    cls = np.where(g == END_GROUP, 0, 1 + SINGLE + g.astype(np.int64))
    top = sorted(np.flatnonzero(g != END_GROUP).tolist(), key=lambda i: (-c[i], h[i]))[:SINGLE]
    for k, i in enumerate(top):
        class_n[cls[i]] -= c[i]
        class_v[cls[i]] -= 1
        cls[i] = 1 + k
        class_n[1 + k], class_v[1 + k] = c[i], 1
    class_n[0] = c[g == END_GROUP].sum()
    hot_n, hot_v = np.bincount(cls, weights=c, minlength=CLASSES), np.bincount(cls, minlength=CLASSES)
    mass, rare = hot_n + 0.5 * hot_v, class_n - hot_n + 0.5 * (np.maximum(class_v - hot_v, 0) + 1)
    share = (class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)
    bias = np.log(share).astype(np.float32)
    low, high = ROW_BITS
    bits = min(high, max(low, distinct.bit_length()))
    n_rows = KINDS << bits
    model = Model(total, distinct, h, c, cls, mass, rare, bias, bits, np.zeros((n_rows, CLASSES), dtype=np.float32), [])
    if not total:
        return model
    sent = spark.sparkContext.broadcast((h, cls))

    def count(batches: Iterator) -> Iterator:
        hot, hot_class = sent.value
        cells = np.zeros(n_rows * CLASSES, dtype=np.uint32)
        for t in chunks(batches, "text", chunk_bytes):
            x = tokens(utf8(t["text"]))
            y, _ = word_classes(x, hot, hot_class)
            for r in features(x, bits):
                lo = int(r[0]) >> bits << bits if len(r) else 0  # the kind's own cells
                part = cells[lo * CLASSES : (lo + (1 << bits)) * CLASSES]
                part += np.bincount((r - lo) * CLASSES + y, minlength=len(part)).astype(np.uint32)
        yield _batch([(i, _narrow(b)) for i, b in enumerate(cells.reshape(BLOCKS, -1)) if b.any()], "block int, counts binary")

    counts = np.zeros((BLOCKS, n_rows * CLASSES // BLOCKS), dtype=np.int64)
    for i, block in _sum_blocks(rows.select("text").mapInArrow(tidy(count), "block int, counts binary")).items():
        counts[i] = block
    sent.destroy()
    direction, n = directions(counts.reshape(n_rows, CLASSES), share)
    scales = np.full(KINDS * LEVELS, FIRST_SCALE)
    size = KINDS * LEVELS
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((h, cls, bias, direction, n.astype(np.float32), scales))

        def update(batches: Iterator, sent=sent) -> Iterator:
            hot, hot_class, bias, direction, n, scales = sent.value
            out = np.zeros(size + size * size + 1)
            for t in chunks(batches, "text", chunk_bytes):
                x = tokens(utf8(t["text"]))
                y, _ = word_classes(x, hot, hot_class)
                f = features(x, bits)
                for lo in range(0, len(y), BATCH):
                    out += gradient(direction, n, share, scales, bits, bias, [r[lo : lo + BATCH] for r in f], y[lo : lo + BATCH])
            yield _batch([(0, out.tobytes())], "block int, counts binary")

        def add(batches: Iterator) -> Iterator:
            every = [np.frombuffer(d) for b in batches for d in b.column(1).to_pylist()]
            yield _batch([(0, np.sum(every, axis=0).tobytes())] if every else [], "block int, counts binary")

        made = rows.select("text").mapInArrow(tidy(update), "block int, counts binary").repartition(16).mapInArrow(tidy(add), "block int, counts binary")
        sums = np.sum([np.frombuffer(r[1]) for r in made.collect()], axis=0)  # 16 small vectors
        sent.destroy()
        first, second = sums[:size], sums[size:-1].reshape(size, size)
        model.likelihood.append(sums[-1] / total)
        scales = np.clip(scales + np.linalg.solve(second + np.eye(size) * (1e-3 * np.trace(second) / size + 1), first), 0.0, 1.5)
    kind = np.repeat(np.arange(KINDS), 1 << bits) * LEVELS + levels(n)
    model.weights = direction * scales[kind, None].astype(np.float32)
    return model


MEET = "bucket int, chunk long, kind int, keys binary, runs binary, docs binary"
BACK = "chunk long, kind int, keys binary, runs binary, docs binary"
HEAD, RARE, PAIRS = 0, 1, 2


def _three(x: np.ndarray) -> bytes:
    """Numbers below 2**24, three bytes each."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _from_three(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
    return out.view("<u4")[:, 0].astype(np.int64)


def _runs_of(*arrays: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(arrays[0]):
        return np.empty(0, dtype=np.int64)
    new = np.ones(len(arrays[0]), dtype=bool)
    new[1:] = False
    for x in arrays:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _sizes(runs: np.ndarray) -> bytes:
    return bytes([1]) + runs.astype("<u1").tobytes() if not len(runs) or runs.max() < 256 else bytes([4]) + runs.astype("<u4").tobytes()


def score(rows: DataFrame, model: Model, words: DataFrame, n_buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of (id, text, train boolean) rows; ``train``: the model learns its pairs."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def start(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        m, task = sent.value, TaskContext.get().partitionId()
        log_count, log_rare = np.log10(m.hot_count + 0.5), np.log10(m.rare)
        for nth, t in enumerate(chunks(batches, "text", chunk_bytes)):
            x, chunk = tokens(utf8(t["text"])), task << 24 | nth
            n_docs = len(x.count)
            cls, at = word_classes(x, m.hot, m.hot_class)
            known = at >= 0
            own = class_log10(m.weights, m.bias, features(x, m.bits), cls)
            own[~known] -= log_rare[cls[~known]]  # what a rare word has of its class's rare words; its count comes from its bucket
            part = np.bincount(x.doc, weights=own, minlength=n_docs)
            common = np.bincount(x.doc[known], weights=log_count[at[known]], minlength=n_docs)
            ids = t["id"]
            head = np.column_stack([pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(), x.count, np.bincount(x.doc[known], minlength=n_docs)]).astype("<i8")
            out = [(chunk % n_buckets, chunk, HEAD, head.tobytes(), np.column_stack([part, common]).tobytes(), b"")]
            out += _rare_rows(x, ~known, chunk, n_buckets) + _pair_rows(x, cls, at, len(m.hot), t["train"].to_numpy(zero_copy_only=False), chunk, n_buckets)
            yield _batch(out, MEET)

    def meet(asked, vocabulary_):
        import pyarrow as pa

        rows_ = asked.to_pylist()
        out = [(r["chunk"], HEAD, r["keys"], r["runs"], b"") for r in rows_ if r["kind"] == HEAD]
        known, count = np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
        if vocabulary_.num_rows:
            known = np.frombuffer(vocabulary_["hashes"][0].as_py(), dtype="<u8")
            count = np.frombuffer(vocabulary_["counts"][0].as_py(), dtype="<i8")
        for r in rows_:
            if r["kind"] == RARE:
                h, size = np.frombuffer(r["keys"], dtype="<u8"), np.frombuffer(r["runs"], dtype="<u4")
                doc = np.frombuffer(r["docs"], dtype="<u2").astype(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                c = np.where(known[at] == h, count[at], 0) if len(known) else np.zeros(len(h), dtype=np.int64)
                c = np.repeat(c, size)
                sums, seen, n = np.bincount(doc, weights=np.log10(c + 0.5)), np.bincount(doc, weights=c > 0), np.bincount(doc)
                d = np.flatnonzero(n)
                out.append((r["chunk"], RARE, sums[d].tobytes(), seen[d].astype("<u4").tobytes(), d.astype("<u2").tobytes()))
        out += _pair_scores([r for r in rows_ if r["kind"] == PAIRS], sent.value)
        return pa.Table.from_batches([_batch(out, BACK)])

    total, distinct = model.total, model.distinct

    def home(table):
        import pyarrow as pa

        rows_ = table.to_pylist()
        made = next(r for r in rows_ if r["kind"] == HEAD)
        ids, none, n, known = np.frombuffer(made["keys"], dtype="<i8").reshape(-1, 4).T
        part, common = np.frombuffer(made["runs"]).reshape(-1, 2).T.copy()
        known, rare = known.copy(), np.zeros(len(ids))
        for r in sorted(rows_, key=lambda r: (r["kind"], r["keys"])):  # in one order, wherever rows come from
            if r["kind"] == RARE:
                d = np.frombuffer(r["docs"], dtype="<u2")
                rare[d] += np.frombuffer(r["keys"])
                known[d] += np.frombuffer(r["runs"], dtype="<u4")
            elif r["kind"] == PAIRS:
                part += np.frombuffer(r["keys"], dtype="<f4")
        base = common + rare - n * np.log10(total + 0.5 * (distinct + 1))
        return pa.table([pa.array(ids, mask=none.astype(bool)), pa.array(n), pa.array(known), pa.array(base), pa.array(part + rare)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    asked = rows.select("id", "text", "train").mapInArrow(tidy(start), MEET)
    vocabulary_ = words.select(F.col("bucket").alias("of"), "hashes", "counts")
    back = asked.groupBy("bucket").cogroup(vocabulary_.groupBy("of")).applyInArrow(_with(meet), BACK)
    return back.groupBy("chunk").applyInArrow(home, "id long, n_tokens long, n_known long, base_score double, score double")


def _rare_rows(x: Tokens, rare: np.ndarray, chunk: int, n_buckets: int) -> list[tuple]:
    """The rare words of a chunk, a row for each bucket of words: each distinct word, and the documents that hold it."""
    h, doc = x.hashes[rare], x.doc[rare]
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order].astype("<u2")
    first = _runs_of(h)
    size = np.diff(first, append=len(h))
    b = _bucket(h[first], n_buckets)
    by, out = np.argsort(b, kind="stable"), []
    for lo, hi in _spans(b[by]):
        k = by[lo:hi]
        entries = np.repeat(first[k] - np.concatenate([[0], np.cumsum(size[k])[:-1]]), size[k]) + np.arange(size[k].sum())
        out.append((int(b[by[lo]]), chunk, RARE, h[first[k]].tobytes(), size[k].astype("<u4").tobytes(), doc[entries].tobytes()))
    return out


def _pair_rows(x: Tokens, cls: np.ndarray, at: np.ndarray, n_hot: int, train: np.ndarray, chunk: int, n_buckets: int) -> list[tuple]:
    """The pairs of a chunk whose class has several words, a row for each bucket of histories (word before and class):
    each distinct pair, and the documents that hold it (the high bit: those that train)."""
    some = np.flatnonzero(cls > SINGLE)
    with np.errstate(over="ignore"):
        key = mix(before(x)[some] ^ (cls[some].astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93))
    word = np.where(at[some] >= 0, at[some], n_hot + cls[some])
    doc = x.doc[some]
    doc = (doc | train[doc].astype(np.int64) << 15).astype("<u2")
    pair = (key & U64(0xFFFFFFFF)) << U64(32) | word.astype(U64)
    bucket = _bucket(key, n_buckets)
    order = np.argsort(pair)
    order = order[np.argsort(bucket[order].astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32), kind="stable")]
    pair, bucket, doc = pair[order], bucket[order], doc[order]
    out = []
    for lo, hi in _spans(bucket):
        p = pair[lo:hi]
        first = _runs_of(p)
        keys = (p[first] >> U64(32)).astype("<u4").tobytes() + _three(p[first] & U64(0xFFFFFFFF))
        out.append((int(bucket[lo]), chunk, PAIRS, keys, _sizes(np.diff(first, append=len(p))), len(x.count).to_bytes(4, "little") + doc[lo:hi].tobytes()))
    return out


def _pair_scores(rows: list[dict], m: Model) -> list[tuple]:
    """A bucket's pairs: their weights, trained, and for each chunk the sum of log10 P(word | class, word before) of every
    document."""
    if not rows:
        return []
    pairs, sizes, docs = [], [], []
    for r in rows:
        n = len(r["keys"]) // 7
        pairs.append(np.frombuffer(r["keys"], dtype="<u4", count=n).astype(U64) << U64(32) | _from_three(r["keys"][4 * n :]).astype(U64))
        sizes.append(np.frombuffer(r["runs"], dtype=f"<u{r['runs'][0]}", offset=1).astype(np.int64))
        docs.append(np.frombuffer(r["docs"], dtype="<u2", offset=4))
    size, doc = np.concatenate(sizes), np.concatenate(docs)
    starts = np.cumsum(size) - size
    trained = np.add.reduceat((doc >> 15).astype(np.int64), starts)
    pair, of_pair = np.unique(np.concatenate(pairs), return_inverse=True)
    count = np.bincount(of_pair, weights=trained)
    history, word = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
    first = _runs_of(history)
    of = np.repeat(np.arange(len(first)), np.diff(first, append=len(history)))
    cls = np.where(word < len(m.hot), m.hot_class[np.minimum(word, max(0, len(m.hot) - 1))] if len(m.hot) else 0, word - len(m.hot))
    share = m.shares(word, cls)
    seen = count > 0
    log_p = np.log(share)
    if seen.any():
        weight, normaliser = pair_weights(of[seen], count[seen], share[seen], len(first))
        log_p[seen] += weight
        log_p -= normaliser[of]
    value = np.repeat((log_p / np.log(10))[of_pair], size)
    out, at = [], 0
    for r, n, d in zip(rows, map(np.sum, sizes), docs, strict=True):
        n_docs = int.from_bytes(r["docs"][:4], "little")
        sums = np.bincount((d & 0x7FFF).astype(np.int64), weights=value[at : at + n], minlength=n_docs)
        out.append((r["chunk"], PAIRS, sums.astype("<f4").tobytes(), b"", b""))
        at += int(n)
    return out


def _with(meet):
    """Buckets that nothing asked for have no rows to return."""

    def run(asked, vocabulary_):
        import pyarrow as pa

        return meet(asked, vocabulary_) if asked.num_rows else pa.Table.from_batches([_batch([], BACK)])

    return run


def score_documents(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out``: a condition on doc_id; the model learns from all other rows. Null text is empty: its one token is the
    end. Rows that repeat an identifier, or have none, are scored each; a null identifier is learned from. Without any
    training text every token is unknown. Other columns play no part; an empty table gives an empty result. Scores don't
    depend on how the rows are partitioned, beyond rounding (1e-5 of a score)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    test = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_buckets = max(2, buckets_for(spark, text_bytes(rows), BUCKET_BYTES) // 2)
    train = rows.where(~test).select("text")
    words = materialize(vocabulary(train, n_buckets, chunk_bytes), "vocabulary")
    model = fit(train, words, rounds, chunk_bytes=chunk_bytes)
    out = score(rows.select(F.col("doc_id").alias("id"), "text", (~test).alias("train")), model, words, n_buckets, chunk_bytes).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", test.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
