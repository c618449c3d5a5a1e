"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Fitting adds up each class's count, sum and sum of outer products (p + p*p numbers a class) over all labelled
training rows, so nothing is sampled and the driver gets a table of fixed size. A score is the logistic
function of the difference of the two classes' Mahalanobis log-densities (plus log prior odds), with each class's
covariance shrunk towards the pooled diagonal and its Cholesky factor computed once and sent with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import tidy
from .common import CHUNK_BYTES, bounded_batches, materialize
from .words import Words, chunks, grams, utf8

#: Document statistics, in the order of the feature vector; each is already transformed.
FEATURES = [
    "log_word_length", "sqrt_upper", "sqrt_digit", "sqrt_symbol", "sqrt_stop_mark", "sqrt_bar", "sqrt_non_ascii",
    "log_line_words", "distinct_words", "distinct_pairs", "sqrt_marked_words", "sqrt_short_words",
]
#: A document of so many words counts half: its standardised statistics are drawn to the centre by n / (n + HALF).
HALF = 10.0

#: Kinds of bytes; lead bytes stand for one character beyond ASCII each, the rest of such a character for none.
_KINDS = np.zeros(256, dtype=np.uint8)
for _kind, _chars in enumerate(
    [bytes(range(65, 91)), b"0123456789", b"!#$%&*@^~=+<>{}[]\\/_`", b".,;:?'\"-()", b"|", bytes(range(192, 256)), b"\n", bytes(range(128, 192))], start=1
):
    _KINDS[list(_chars)] = _kind
_SYMBOL = (_KINDS == 3).astype(np.float64)


def statistics(texts: list[bytes]) -> np.ndarray:
    """The feature vectors of the texts, one row each, and the number of words in the last column."""
    n = len(texts)
    if not n:
        return np.zeros((0, len(FEATURES) + 1))
    w = Words(texts, lower=False)
    kinds = np.stack([np.bincount(_KINDS[np.frombuffer(t, dtype=np.uint8)], minlength=9) for t in texts]).astype(np.float64)
    letters = np.maximum(kinds.sum(1) - kinds[:, 8] - kinds[:, 7], 1)
    words = w.counts()
    least = np.maximum(words, 1)
    of = np.repeat(np.arange(n), words)
    distinct = _distinct(w.hashes, of, n)
    pairs = grams(w.hashes, 2)
    inside = of[1:] == of[:-1]
    distinct_pairs = _distinct(pairs[inside], of[1:][inside], n) if len(pairs) else np.zeros(n)
    length = w.end - w.start
    by_doc = lambda v: np.bincount(of, weights=v, minlength=n) / least
    share = lambda k: np.sqrt(kinds[:, k] / letters)
    return np.column_stack(
        [
            np.log1p(by_doc(length)),
            *(share(k) for k in range(1, 7)),
            np.log1p(words / (kinds[:, 7] + 1)),
            # types against tokens: near 1 for the usual growth of a vocabulary, low for repetition
            np.log1p(distinct) / np.log(words + 2.0),
            (distinct_pairs + 1) / least,
            np.sqrt(by_doc(_SYMBOL[w.buffer[w.end - 1]])),
            np.sqrt(by_doc((length <= 3).astype(np.float64))),
            words,
        ]
    )


def _distinct(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each document has."""
    if not len(values):
        return np.zeros(n)
    keys = (values & np.uint64(0xFFFFFFFFFF)) | (of.astype(np.uint64) << np.uint64(40))
    keys.sort()
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> np.uint64(40)).astype(np.int64), minlength=n).astype(np.float64)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, x array<double>) of every whole text; null text counts as empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in chunks(batches, "text", chunk_bytes):
            x = statistics(utf8(t["text"]))
            flat = pa.array(x.ravel())
            at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), pa.ListArray.from_arrays(at, flat)], ["id", "x"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, x array<double>")


@dataclass
class QuadraticModel:
    """Class 0 and class 1: means, inverse Cholesky factors of the shrunk covariances, and constants."""

    centre: np.ndarray
    scale: np.ndarray
    mean: list = field(default_factory=list)
    inverse: list = field(default_factory=list)
    constant: list = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = standard(x, self.centre, self.scale)
        density = []
        for m, inverse, c in zip(self.mean, self.inverse, self.constant, strict=True):
            y = (z - m) @ inverse.T
            density.append(c - 0.5 * np.einsum("ij,ij->i", y, y))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, strictly between 0 and 1 as far as doubles go."""
        t = self.log_odds(x)
        e = np.exp(-np.abs(t))
        p = np.where(t >= 0, 1 / (1 + e), e / (1 + e))
        return np.clip(p, 2.0**-1022, 1 - 2.0**-53)  # what doubles leave of 0 and 1


def standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics, those of short texts drawn to the centre."""
    return (x[:, :-1] - centre) / scale * (x[:, -1:] / (x[:, -1:] + HALF))


def _sums(rows: DataFrame, of) -> np.ndarray:
    """For each class: count, sum and sum of outer products of of(x), added up over all rows: 2 * (1 + p + p*p)
    numbers reach the driver, whatever the number of rows."""
    p = len(FEATURES)
    size = 1 + p + p * p

    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((2, size))
        for b in batches:
            if b.num_rows:
                z = of(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1))
                y = b.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    v = z[y == k]
                    total[k] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        k, i = np.repeat(np.arange(2, dtype=np.int32), size), np.tile(np.arange(size, dtype=np.int32), 2)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(total.ravel())], ["k", "i", "v"])

    got = np.zeros((2, size))
    for k, i, v in rows.mapInArrow(moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect():
        got[k, i] = v
    return got


def fit(rows: DataFrame, x_col: str = "x", label_col: str = "label", shrinkage: float = 0.2) -> QuadraticModel:
    """Fit on every row with label 0 or 1 (others, and null, are left out): one pass for centre and scale, one for the
    classes' moments. ``shrinkage``: weight of the pooled diagonal in each class's covariance. A class without rows
    gets the pooled figures; without any row every score is one half."""
    p = len(FEATURES)
    known = rows.where(F.col(label_col).isin(0, 1)).select(F.col(x_col).alias("x"), F.col(label_col).cast("int").alias("y"))
    both = _sums(known, lambda x: x[:, :-1]).sum(0)
    if not both[0]:
        return QuadraticModel(np.zeros(p), np.ones(p), [np.zeros(p)] * 2, [np.eye(p)] * 2, [0.0, 0.0])
    centre = both[1 : 1 + p] / both[0]
    scale = np.sqrt(np.maximum(np.diag(both[1 + p :].reshape(p, p)) / both[0] - centre**2, 0))
    scale[scale < 1e-6] = 1
    model = QuadraticModel(centre, scale)
    got = _sums(known, lambda x: standard(x, centre, scale))
    n = got[:, 0]
    pooled = np.diag(np.maximum(np.diag(got.sum(0)[1 + p :].reshape(p, p)) / n.sum(), 1e-3))
    for k in (0, 1):
        m, s = np.zeros(p), pooled
        if n[k]:
            m = got[k, 1 : 1 + p] / n[k]
            s = got[k, 1 + p :].reshape(p, p) / n[k] - np.outer(m, m)
        weight = (shrinkage * n[k] + p) / (n[k] + p)  # few rows: more shrinkage
        factor = np.linalg.cholesky((1 - weight) * s + weight * pooled)
        model.mean.append(m)
        model.inverse.append(np.linalg.inv(factor))
        model.constant.append(float(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum()))
    return model


def score(features: DataFrame, model: QuadraticModel, id_col: str = "id") -> DataFrame:
    """(id, score double) of each feature row."""
    p = len(FEATURES)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x) if len(x) else np.empty(0))], ["id", "score"])

    kind = features.schema[id_col].dataType.simpleString()
    return features.select(F.col(id_col).alias("id"), "x").mapInArrow(tidy(run), f"id {kind}, score double")


def label_rows(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One label for each identifier: that of most rows, ties to 0; rows with null identifier or label are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    votes = known.groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("v"))
    return votes.select("id", (F.col("v") > 0.5).cast("int").alias("label"))


def model_of(statistics_: DataFrame, labels: DataFrame, held_out=None, label_col: str = "quality", shrinkage: float = 0.2) -> QuadraticModel:
    """The model of (id, x) rows, from the labels of those where ``held_out`` (a condition on doc_id) doesn't hold."""
    test = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    train = statistics_.withColumnRenamed("id", "doc_id").where(~test).withColumnRenamed("doc_id", "id")
    return fit(train.join(label_rows(labels, "doc_id", label_col), "id"), shrinkage=shrinkage)


def keep_good(docs: DataFrame, model: QuadraticModel, text_col: str = "text", threshold: float = 0.5, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more: a scan without any shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in chunks(batches, text_col, chunk_bytes):
            good = model.score(statistics(utf8(t[text_col]))) >= threshold
            yield from t.filter(pa.array(good)).to_batches()

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, held_out=None, label_col: str = "quality", shrinkage: float = 0.2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    ``held_out``: a condition on doc_id; labels of rows where it holds are never learned from. Empty and null texts
    are scored like any other. Rows that repeat a doc_id are scored each; a null doc_id is scored and not learned from.
    Only the text gives inputs."""
    test = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    x = materialize(document_statistics(docs), "quality-statistics")
    model = model_of(x, labels, held_out, label_col, shrinkage)
    out = score(x, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
