"""The training-data pipeline: documents in, token digests of what is kept out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and is written as
Parquet; all but the last return the columns of documents. A null in any column, an empty table and
further columns are what the operators say of them. The order in which the sources are mixed is that
of the files written; the last stage takes it from them and returns it as ``position``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headcount.llm import bpe, minhash, mixing, pii, quality
from headcount.llm.shared import by_size, cut, shared_folder, table
from headcount.sources import remove


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text and site together look good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; five words, a similarity of 0.8."""
    return minhash.keep_one(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it generalised."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves their sources."""
    return mixing.in_order(docs)


def positions(docs: DataFrame) -> DataFrame:
    """docs with ``position``, the number of rows written before a row; null if docs are not read from files.

    Spark reads files by size, but names them by the range of the order that they hold, and the reader
    numbers the rows of each. The table of files, one row each, gives the rows before a file.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c != "position"]
    try:
        rows = docs.select(*names, F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs.select(*names, F.lit(None).cast("long").alias("position"))
    files = docs.select(F.col("_metadata.file_name").alias("__file")).groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    part = F.regexp_extract("__file", r"^part-(\d+)", 1)
    before = Window.orderBy(F.when(part != "", part.cast("long")), "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = cut(files.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    return rows.join(by_size(files), "__file").select(*names, (F.col("__before") + F.col("__row")).alias("position"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its number of tokens, the digests of its ids and of what they decode to, its position."""
    return bpe.digests(positions(docs), *bpe.public_vocabulary(), keep=("position",))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("source_mixing", source_mixing),
    ("byte_level_bpe", tokens),
]

#: Scheduling, token merges and similarity joins are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to a folder of its own in the shared one and read again.

    A stage's folder goes when the next one is written; the last one holds the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    done = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            remove(spark, done)
        done = path
    return docs
