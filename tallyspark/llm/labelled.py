"""Bounded, deterministic samples of labelled documents, and the held-out fold of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(rows: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """About per_label distinct (id, label) rows of each label, all if it has no more; columns id and label.

    A row is taken if the hash of its id is below its label's share, so no task gathers a label's rows.
    """
    known = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().distinct()
    share = known.groupBy("label").agg((F.lit(float(per_label)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / float(1 << 31)
    return known.join(share, "label").where(place < F.col("share")).select("id", "label")


def with_text(chosen: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole texts of a sample: columns id, label, text. The sample is broadcast; its size is its caller's parameter."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id")
