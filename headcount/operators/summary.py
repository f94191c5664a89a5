"""Grouped summaries of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headcount.functions.columns import name
from headcount.operators.cells import N, VALUE, question_cells, require_integer, statistics, summarise, value_cells

FULL = ("mean", "median", "sd", "min", "max", "q25", "q75", "n")
BRIEF = ("mean", "sd", "n")
RANGE = ("mean", "sd", "min", "max")
MEAN = ("mean", "n")


def describe(
    df: DataFrame, cols: str | Sequence[str], by: str | Sequence[str] = (), stats: Sequence[str] = FULL
) -> DataFrame:
    """Summary statistics of one or more columns of numbers, overall or by group.

    Several columns come back as one long table with a ``variable`` column, from one scan; they are
    integers. One column may be measured as well. ``n`` counts all rows of the group, the other
    statistics skip NULL.
    """
    keys = [by] if isinstance(by, str) else list(by)
    if isinstance(cols, str):
        return summarise(value_cells(df, keys, cols), keys, stats)
    require_integer(df, cols)
    return summarise(question_cells(df, keys, cols), [*keys, "variable"], stats)


def describe_by_each(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], stats: Sequence[str] = BRIEF
) -> DataFrame:
    """The same summaries under several groupings, one grouping at a time: (key, level, variable, ...).

    All groupings share one scan and one shuffle of the raw rows; the cells of the combined keys
    are then counted again under each key.
    """
    require_integer(df, cols)
    cells = question_cells(df, keys, cols)
    levels = [f"CAST({name(k)} AS STRING) AS {name(k)}" for k in keys]
    long = cells.selectExpr("variable", VALUE, N, *levels).unpivot(["variable", VALUE, N], list(keys), "key", "level")
    again = long.groupBy("key", "level", "variable", VALUE).agg(F.sum(N).alias(N))
    return summarise(again, ["key", "level", "variable"], stats)


def share(
    df: DataFrame,
    keys: Sequence[str],
    within: Sequence[str] = (),
    value: str | Sequence[str] | None = None,
    stats: Sequence[str] = (),
) -> DataFrame:
    """Rows per key and their share of the ``within`` group (of everything when empty).

    With ``value``, summary statistics of it stand beside the share; several outcomes come back as
    one long table with a ``variable`` column, from one scan. The window runs over the grouped rows
    only.
    """
    names = [*(s for s in stats if s != "n"), "n"]
    outcome = []
    if value is None:
        grouped = df.groupBy(*keys).agg(F.count("*").alias("n"))
    elif isinstance(value, str):
        grouped = summarise(value_cells(df, keys, value), keys, names)
    else:
        require_integer(df, value)
        outcome = ["variable"]
        grouped = summarise(question_cells(df, keys, value), [*keys, *outcome], names)
    total = [*within, *outcome]
    whole = F.sum("n").over(Window.partitionBy(*total)) if total else grouped.agg(F.sum("n")).scalar()
    return grouped.withColumn("freq", F.col("n") / whole)


def date_summary(df: DataFrame, col: str) -> DataFrame:
    """Minimum, quartiles, median, mean and maximum of a date column, as dates."""
    points = ("min", "q25", "median", "mean", "q75", "max")
    days = df.selectExpr(f"CAST(unix_date({name(col)}) AS BIGINT) AS day")
    return (
        summarise(value_cells(days, [], "day"), [], [*points, "n"])
        .selectExpr(*[f"date_from_unix_date(CAST(floor({s}) AS INT)) AS {s}_date" for s in points], "n")
    )


def mean_by_value(df: DataFrame, value: str, by: Sequence[str], mean: str = "mean") -> DataFrame:
    """Mean of a column and row count per exact value of the grouping columns."""
    return df.groupBy(*by).agg(F.avg(value).alias(mean), F.count("*").alias("n"))


def dispersion(df: DataFrame, col: str) -> DataFrame:
    """Mean, variance, share of zeros and the zero-inflation index 1 + ln(share of zeros) / mean."""
    require_integer(df, [col])
    return (
        value_cells(df.filter(F.col(col).isNotNull()), [], col)
        .agg(*statistics(["n", "mean", "variance"]), F.expr("coalesce(sum(CASE WHEN value = 0 THEN n END), 0) AS n_zero"))
        .selectExpr("*", "try_divide(n_zero, n) AS share_zero")
        .selectExpr("*", "CASE WHEN share_zero > 0 AND mean > 0 THEN 1 + ln(share_zero) / mean END AS zero_inflation")
    )


def top_categories(df: DataFrame, group: str, category: str, k: int, weight: str | None = None) -> DataFrame:
    """The ``k`` most frequent categories of each group, ties in category order. ``weight`` names
    the row count of a table that is already counted."""
    count = F.count("*") if weight is None else F.sum(weight)
    order = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(category).asc_nulls_last())
    return (
        df.groupBy(group, category)
        .agg(count.alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def attach_lookup(df: DataFrame, lookup: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Left-join lookup columns by key, keeping unmatched rows.

    A key listed twice in the lookup would multiply rows, so the lookup is reduced to one row per
    key first. No broadcast hint: Spark broadcasts a lookup below the size threshold and otherwise
    sort-merges, where adaptive execution splits a skewed key.
    """
    one = (
        lookup.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(F.struct(*cols)).alias("_row"))
        .select("_key", *[F.col(f"_row.{c}").alias(c) for c in cols])
    )
    return df.join(one, F.col(key) == F.col("_key"), "left").drop("_key")
