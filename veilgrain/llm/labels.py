"""A bounded sample of labelled documents to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5  # fold 0 is held out everywhere


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return (F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS).cast("int")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label int): all texts of at most `most` labelled ids outside fold 0, chosen by a hash
    of their id, so by neither their order nor their content.  Rows without an id or a label of 0 or
    1 are left out, and of several labels of an id the least counts.  The choice is made on the labels
    alone and has at most `most` rows, which is the bound of the broadcast."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.where("label in (0, 1) and doc_id is not null").where(fold() != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label int, fold): the rows of `labelled_texts`, but of several texts of an id the one
    with the smallest hash, so each id is one row."""
    one = labelled_texts(docs, labels, label, most).groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("doc_id", "text", "label", fold().alias("fold"))
