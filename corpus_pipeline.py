"""A pipeline from raw documents to packed training windows: quality, exact copies, near copies, repeated passages,
packing. Each stage gets what the one before kept, written as Parquet, and all but the last return the columns of
documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import held_out, materialize, public_vocabulary, read, word_encoder
from lectern.llm.exact_dedup import distinct_contents
from lectern.llm.jaccard_join import one_of_each
from lectern.llm.packing import pack
from lectern.llm.quality import document_statistics, keep_good, model_of
from lectern.llm.substring_dedup import remove_repeats

# Every stage works on rows, not on identifiers: repeated and null identifiers, ties and repeated rows lose no text. Null and
# empty texts are scored like any other, are one content, are never near copies, and have nothing to repeat; they are
# packed as the end id alone. Columns of any name pass through. An empty table gives an empty result.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels outside the held-out third; without any labelled
    row every score is one half, and all stay."""
    x = materialize(document_statistics(docs), "quality-statistics")
    return keep_good(docs, model_of(x, read(spark, sf_dir, "labels"), held_out(3)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for A-Z or a-z) that with the largest doc_id stays, exactly one row."""
    return distinct_contents(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their 5-word shingles that with the smallest doc_id stays."""
    return one_of_each(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that repeat a window of 13 words from a document with a smaller doc_id (a null one is larger than any other);
    the rest of a text stays, and so does a row that has no words left."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_repeats(docs, with_text=True, carry=others)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything that is left, in windows of 4096 token ids."""
    return pack(docs, word_encoder(public_vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The classifier and the packing have no SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
