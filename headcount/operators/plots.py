"""The tables behind the figures: histograms, boxes and overlap counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from headcount.functions.columns import literal, log_scale, name
from headcount.models.table import keep
from headcount.operators.cells import N, VALUE, is_measured, quartiles, same, value_cells


def histogram(
    df: DataFrame,
    col: str,
    width: float = 1,
    origin: float = 0,
    by: Sequence[str] = (),
    bins: int | None = None,
    shared: bool = True,
) -> DataFrame:
    """Rows per bin [lo, lo + width) with the bin's density within its ``by`` group.

    A date column is binned in days since 1970 and its bins come back as dates.

    With ``bins``, the range of the data is cut into that many equal bins: of all rows, or with
    ``shared`` off of each group. The result has ``bin`` (from 1), ``lo`` and ``hi`` then. The
    largest value belongs to the last bin. Where all values are equal there is one bin without width
    and without a density. NaN and infinite values are in no bin. Empty bins are not listed.
    """
    if bins is not None:
        return _equal_bins(df, col, list(by), bins, shared)
    is_date = isinstance(df.schema[col].dataType, T.DateType)
    v = f"unix_date({name(col)})" if is_date else name(col)
    # A width in whole numbers keeps whole bins whole.
    number = str if float(width).is_integer() and float(origin).is_integer() else literal
    width, origin = (int(x) if number is str else float(x) for x in (width, origin))
    lo = f"{number(origin)} + floor(({v} - {number(origin)}) / {number(width)}) * {number(width)}"
    lo = f"date_from_unix_date(CAST({lo} AS INT))" if is_date else lo
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.expr(lo).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else counts.agg(F.sum("n")).scalar()
    return counts.withColumn("density", F.col("n") / (total * width))


def _equal_bins(df: DataFrame, col: str, by: list[str], bins: int, shared: bool) -> DataFrame:
    if bins < 1:
        raise ValueError("a histogram has at least one bin")
    v = f"unix_date({name(col)})" if isinstance(df.schema[col].dataType, T.DateType) else name(col)
    own = [name(k) for k in by]
    rows = df.selectExpr(*own, f"CAST({v} AS DOUBLE) AS _v").filter("abs(_v) <= 1.7976931348623157E308D")
    if shared or not by:
        ends = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        rows = rows.withColumns({"_lo": ends.select("lo").scalar(), "_hi": ends.select("hi").scalar()})
    else:
        ends = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        rows = same(rows, ends, by)
    place = f"CASE WHEN _hi > _lo THEN least(floor((_v - _lo) / ((_hi - _lo) / {bins}D)), {bins - 1}) ELSE 0 END"
    rows = rows.selectExpr(*own, f"CAST({place} AS INT) AS _bin", "_lo", "_hi")
    counts = rows.groupBy(*by, "_bin", "_lo", "_hi").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else counts.agg(F.sum("n")).scalar()
    step = f"((_hi - _lo) / {bins}D)"
    return counts.withColumn("_all", total).selectExpr(
        *own, "_bin + 1 AS bin", f"_lo + _bin * {step} AS lo", f"_lo + (_bin + 1) * {step} AS hi", "n",
        f"CASE WHEN _hi > _lo THEN n / (_all * {step}) END AS density",
    )


def box_stats(
    df: DataFrame, value: str, by: Sequence[str], log: bool = False, plus_one: bool = False
) -> DataFrame:
    """Five-number boxes per group: quartiles, whiskers at the furthest values within 1.5 IQR of
    the box, number of points beyond them, mean and n.

    With ``log`` the values go to log10 first, as a log axis does: zeros drop out, and ``mean`` is
    the mean of the logs. ``plus_one`` shifts by one before the log.

    The cells of counts are kept, so the raw table is read once; quartiles of counts and of measured
    columns come from ranges of values.
    """

    def drawn(v: str) -> str:
        return log_scale(v, plus_one) if log else f"CAST({v} + {int(plus_one)} AS DOUBLE)"

    cells = value_cells(df.filter(F.col(value).isNotNull()), by, value)
    cells = cells.filter(f"{drawn(VALUE)} IS NOT NULL").selectExpr("*", "0 AS _one")
    cells = cells if is_measured(df, value) else keep(cells)
    keys = [*by, "_one"]
    fenced = (
        same(cells, quartiles(cells, keys, drawn), keys)
        .selectExpr(*[name(k) for k in by], f"{drawn(VALUE)} AS v", N, "_q0", "_q1", "_q2")
        .selectExpr("*", "v BETWEEN _q0 - 1.5D * (_q2 - _q0) AND _q2 + 1.5D * (_q2 - _q0) AS inside")
    )
    stats = {
        "whisker_low": "min(CASE WHEN inside THEN v END)",
        "q25": "first(_q0)",
        "median": "first(_q1)",
        "q75": "first(_q2)",
        "whisker_high": "max(CASE WHEN inside THEN v END)",
        "n_outliers": "coalesce(sum(CASE WHEN NOT inside THEN n END), 0)",
        "mean": "sum(v * n) / sum(n)",
        "n": "sum(n)",
    }
    return fenced.groupBy(*by).agg(*[F.expr(f"{text} AS {s}") for s, text in stats.items()])


def overlap_count(df: DataFrame, x: str, y: str, group: str, log_axes: bool = False) -> DataFrame:
    """Rows at each (x, y, group) point; log axes cannot show a point with a zero."""
    if log_axes:
        df = df.filter((F.col(x) > 0) & (F.col(y) > 0))
    return df.groupBy(x, y, group).agg(F.count("*").alias("n"))
