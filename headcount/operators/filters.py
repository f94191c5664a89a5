"""Case selection and one-pass counts of conditions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.functions.columns import is_in, literal, name


def exclude_ids(df: DataFrame, col: str, ids: Iterable[int | None] | DataFrame) -> DataFrame:
    """Drop named cases; a NULL id is dropped too, and a NULL among ``ids`` names no case.

    ``ids`` is a list, or a one-column DataFrame when there are many. The join takes no broadcast
    hint: Spark broadcasts the id table only when its size is below the broadcast threshold.
    """
    known = df.filter(F.col(col).isNotNull())
    if isinstance(ids, DataFrame):
        ids = ids.toDF("_excluded_id")
        return known.join(ids, F.col(col) == F.col("_excluded_id"), "left_anti")
    return known.filter(~F.col(col).isin([i for i in ids if i is not None]))


def keep_sentinel(df: DataFrame, col: str, code: int) -> DataFrame:
    """Set aside the cases whose answer is hidden behind one code."""
    return df.filter(F.col(col) == code)


def keep_positive(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col) > 0)


def keep_label(df: DataFrame, col: str, value, negate: bool = False) -> DataFrame:
    """Rows with (or, negated, with another than) a label. NULL is dropped both ways."""
    return df.filter(F.col(col) != value) if negate else df.filter(F.col(col) == value)


def keep_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """Rows with lo <= value <= hi; a bound of None is open. NULL is dropped."""
    df = df.filter(F.col(col).isNotNull())
    df = df if lo is None else df.filter(F.col(col) >= lo)
    return df if hi is None else df.filter(F.col(col) <= hi)


def _profile(df: DataFrame, cols: Sequence[str], tests: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """One row per question with a count for each test of its ``value``. All columns are counted side
    by side in one aggregate; only its result is turned long, so no input row is multiplied."""
    rows = []
    for c in cols:
        value = f"CAST({name(c)} AS BIGINT)"
        counts = [f"{test.replace('value', value)} AS {n}" for n, test in tests.items()]
        rows.append(F.expr(f"struct({literal(c)} AS question, {', '.join(counts)})").alias(f"_{len(rows)}"))
    counted = df.groupBy(*by).agg(*rows)
    return counted.selectExpr(*[name(k) for k in by], f"inline(array({', '.join(f'_{i}' for i in range(len(rows)))}))")


def response_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Zero, positive, negative and non-negative answers of several columns, in one pass."""
    counts = {"n_zero": "= 0", "n_positive": "> 0", "n_negative": "< 0", "n_non_negative": ">= 0"}
    return _profile(df, cols, {n: f"count_if(value {test})" for n, test in counts.items()}, by)


def cross_classify(df: DataFrame, cells: Mapping[str, str]) -> DataFrame:
    """Number of rows meeting each named SQL condition, all in one pass over the table."""
    return df.agg(*[F.expr(f"count_if({cond}) AS {name(n)}") for n, cond in cells.items()])


def missing_profile(
    df: DataFrame, cols: Sequence[str], codes: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Per question: answered, zero, non-zero, NULL, and one count for each missing code.

    Runs on the answers as coded, before missing codes are mapped to NULL.
    """
    tests = {
        "n_answered": "value >= 0",
        "n_zero": "value = 0",
        "n_non_zero": "value > 0",
        "n_null": "value IS NULL",
        "n_other_negative": f"value < 0 AND NOT {is_in('value', codes)}",
        **{f"n_code_{abs(code)}": f"value = {code}" for code in codes},
    }
    return _profile(df, cols, {"n": "count(*)", **{n: f"count_if({test})" for n, test in tests.items()}}, by)
