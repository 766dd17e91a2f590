"""From raw documents to packed training sequences: five stages, each of one operator.

Every stage takes null and empty texts (they have no words: the classifier judges them as such, the others leave them be),
texts of any length, repeated rows, further columns of any name and empty tables, which give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, labelled, linededup, neardup, packing, quality, shared, token_files


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = shared.table(spark, sf_dir, "labels").where(labelled.fold("doc_id", 5) != 0)
    return quality.filter_quality(docs, quality.fit(docs, labels))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier, exactly or within a few edits; those that keep no line go."""
    found = linededup.dedup_lines(docs)
    left = found.where((F.col("__n_gone") == 0) | (F.col("__n_gone") < F.col("__n_lines")))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__n_gone") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, decontaminate.fit(docs, shared.table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins, and where their token ids are in files under the shared folder."""
    import public_tokenizers

    folder = shared.shared_path(spark, "pipeline-tokens")
    return packing.pack_files(token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder))


STAGES = [
    ("quality", good_documents),
    ("lines", new_lines),
    ("near_duplicates", one_of_each),
    ("decontamination", untested),
    ("packing", packed),
]

#: SQL can't express the classifier, so the query is held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is written to the shared folder and read again by the next."""
    docs = shared.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs, f"pipeline-{name}")
    return docs
