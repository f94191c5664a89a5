"""One-factor linear model in closed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.functions.columns import level_ord, literal, round_half_even
from headcount.models.table import INTERCEPT, model_table


def _levels(df: DataFrame, y: str, factor: str, levels: Sequence[str], weight: str | None) -> DataFrame:
    sums = ("sum(n) AS n", "sum(y * n) AS s1", "sum(CAST(y AS DOUBLE) * y * n) AS s2")
    return (
        model_table(df, y, [factor], weight=weight)
        .groupBy(F.col(factor).alias("level"))
        .agg(*[F.expr(s) for s in sums])
        .selectExpr("*", "s1 / n AS mean", f"{level_ord('level', levels)} AS ord")
    )


def ols_oneway(
    df: DataFrame, y: str, factor: str, levels: Sequence[str], weight: str | None = None
) -> DataFrame:
    """(level, estimate, se, sigma): level means against the first observed level. The windows run
    over one row per level."""
    return (
        _levels(df, y, factor, levels, weight)
        .selectExpr(
            "*",
            "sum(s2 - s1 * mean) OVER () / (sum(n) OVER () - count(*) OVER ()) AS sigma2",
            "min(struct(ord, mean, n)) OVER () AS ref",
        )
        .selectExpr(
            f"CASE WHEN ord = ref.ord THEN {literal(INTERCEPT)} ELSE level END AS level",
            "CASE WHEN ord = ref.ord THEN mean ELSE mean - ref.mean END AS estimate",
            "sqrt(sigma2 * (1D / n + CASE WHEN ord = ref.ord THEN 0D ELSE 1D / ref.n END)) AS se",
            "sqrt(sigma2) AS sigma",
        )
    )


def ols_oneway_distribution(
    df: DataFrame, y: str, factor: str, levels: Sequence[str], weight: str | None = None
) -> DataFrame:
    """(x, OLS): predictions rounded to whole numbers, as shares of rows."""
    return (
        _levels(df, y, factor, levels, weight)
        .selectExpr(f"CAST({round_half_even('mean')} AS INT) AS x", "n")
        .groupBy("x")
        .agg(F.sum("n").alias("n"))
        .selectExpr("x", "n / sum(n) OVER () AS OLS")
    )
