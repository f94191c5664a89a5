"""Derived columns that concern a whole table rather than one expression."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headcount.functions.columns import is_in, level_ord, n_answered, name, null_codes, row_total, with_exprs
from headcount.functions.codes import SENTINELS


def null_sentinels(df: DataFrame, cols: Sequence[str], codes: Iterable[int] = SENTINELS) -> DataFrame:
    """Map missing codes to NULL in several columns, in one projection."""
    codes = list(codes)
    return with_exprs(df, {c: null_codes(name(c), codes) for c in cols})


def add_row_total(df: DataFrame, total: str, cols: Sequence[str], min_answered: int = 0) -> DataFrame:
    """Row total that skips NULL. Below ``min_answered`` answers the total is NULL; the default
    of 0 lets an unanswered row count as a zero."""
    quoted = [name(c) for c in cols]
    text = row_total(*quoted)
    if min_answered > 0:
        text = f"CASE WHEN {n_answered(*quoted)} >= {min_answered} THEN {text} END"
    return with_exprs(df, {total: text})


def add_levels(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Restrict a label column to a level list (others become NULL) and add its order as ``<col>_ord``."""
    c = name(col)
    known = f"CASE WHEN {is_in(c, levels)} THEN {c} END"
    return with_exprs(df, {col: known, f"{col}_ord": level_ord(c, levels)})


def add_codebook_levels(df: DataFrame, col: str, codebook: DataFrame, question: str | None = None) -> DataFrame:
    """``add_levels`` with the labels of a codebook table in its order (``ord``), so that no list stands in the plan.

    ``question`` names the codebook's column if it is not ``col``. Labels of missing codes are unknown.
    The join is left to Spark; NULL labels match nothing.
    """
    known = codebook.filter((F.col("column") == (question or col)) & F.col("label").isNotNull() & ~F.coalesce("is_missing", F.lit(False)))
    # Places are counted over the labels of one question.
    labels = known.groupBy(F.col("label").alias("_label")).agg(F.min("ord").alias("_ord"))
    place = F.row_number().over(Window.orderBy(F.col("_ord").asc_nulls_last(), "_label"))
    labels = labels.select("_label", place.alias("_place"))
    joined = df.join(labels, F.col(name(col)) == F.col("_label"), "left")
    return joined.withColumns({col: F.col("_label"), f"{col}_ord": F.col("_place")}).drop("_label", "_place")


def add_week_index(df: DataFrame, date: str, index: str) -> DataFrame:
    """1-based number of the Monday-start week, counted from the week of the earliest date.

    The earliest date is a scalar subquery: one small aggregate of the same table, no window over
    all rows and no join.
    """
    first = df.agg(F.date_trunc("week", F.min(date)).cast("date").alias("first")).scalar()
    return df.withColumn(index, (F.floor(F.datediff(F.col(date), first) / 7) + 1).cast("int"))


def recode_from_codebook(df: DataFrame, col: str, codebook: DataFrame, label: str) -> DataFrame:
    """Label a coded column from a codebook table with (column, code, label).

    For a short mapping known in advance use ``functions.recode``, which needs no join.
    """
    labels = (
        codebook.filter((F.col("column") == col) & F.col("code").isNotNull())
        .groupBy(F.col("code").alias("_code"))
        .agg(F.min("label").alias(label))
    )
    return df.join(labels, F.col(col) == F.col("_code"), "left").drop("_code")
