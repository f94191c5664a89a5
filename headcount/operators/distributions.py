"""Observed and predicted distributions side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headcount.operators.filters import keep_range


def align_distributions(*tables: DataFrame, on: str = "x") -> DataFrame:
    """Full outer join of any number of (x, probability, ...) tables with a row for each x at most.

    The tables are put under each other and one aggregate lays them side by side, so that there is one
    shuffle whatever their number. Rows without x, the tails of predictions, are one row. A column of
    two tables raises.
    """
    columns = [c for t in tables for c in t.columns if c != on]
    if twice := sorted({c for c in columns if columns.count(c) > 1}):
        raise ValueError(f"more than one table has the columns {twice}")
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    return rows.groupBy(on).agg(*[F.max(c).alias(c) for c in columns])


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Probability 0 where one side of an alignment had no row."""
    return df.fillna(0.0, subset=list(cols))


def unpivot_models(df: DataFrame, on: str, models: Sequence[str]) -> DataFrame:
    """Wide distributions to (x, Model, prob)."""
    return df.unpivot([on], list(models), "Model", "prob")


def scale_share(df: DataFrame, total: Column | int, prob: str = "prob", people: str = "n") -> DataFrame:
    """Probability to expected number of people."""
    return df.withColumn(people, F.col(prob) * total)


def compare_distributions(
    observed: DataFrame,
    predictions: Sequence[DataFrame],
    total: Column | int,
    on: str = "x",
    lo: int | None = None,
    hi: int | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Align, fill with 0, go long and scale to people. Nothing is cut unless asked: ``lo`` and
    ``hi`` keep a range, ``drop`` leaves models out. The tails of predictions, rows without x, meet."""
    wide = align_distributions(observed, *predictions, on=on)
    models = [c for c in wide.columns if c != on]
    wide = zero_fill(wide, models)
    if lo is not None or hi is not None:
        wide = keep_range(wide, on, lo, hi)
    return scale_share(unpivot_models(wide, on, [m for m in models if m not in drop]), total)
