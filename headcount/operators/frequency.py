"""Counts and frequency tables of coded answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcount.functions.columns import level_ord, name
from headcount.models.table import keep
from headcount.operators.cells import same


def tally(df: DataFrame, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Row count by zero or more keys; NULL is a group of its own. ``weight`` names the row count
    of a table that is counted already."""
    count = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(*keys).agg(count.alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return tally(df, [col])


def prop_table(df: DataFrame, col: str, share: str = "share", weight: str | None = None) -> DataFrame:
    """Share of rows per value, NULL left out. The total is a scalar subquery over the counts, so the
    values never meet in one task."""
    counts = tally(df.filter(F.col(col).isNotNull()), [col], weight)
    return counts.withColumn(share, F.col("n") / counts.agg(F.sum("n")).scalar())


#: Counted values that one window may put in order.
ORDERED = 65_536


def running(counts: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, out: str, ordered: int | None = None) -> DataFrame:
    """A kept table with ``out``, the sum of ``weight`` over the rows of the same keys up to each row.

    ``order`` are expressions of any type that has an order, NULL last; with the keys they have to
    tell the rows apart. A prefix sum over sampled ranges: rows are dealt to partitions in order, each
    partition is summed by itself, and the sums of those before are joined back. So no task holds more
    than one range, whatever the keys and the type of the order. A table of few rows is one range.
    """
    ordered = ordered or ORDERED
    n = counts.count()
    own = [name(k) for k in keys]
    # Floating sums of zeros and their negatives aside, the order within a range is that of the ranges.
    by = ", ".join(f"{x} ASC NULLS LAST" for x in order)
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND {}"
    if n <= ordered:
        group = f"PARTITION BY {', '.join(own)} " if own else ""
        return counts.selectExpr("*", f"sum({weight}) OVER ({group}ORDER BY {by} {frame.format('CURRENT ROW')}) AS {out}")
    columns = [F.expr(k).asc_nulls_last() for k in own] + [F.expr(x).asc_nulls_last() for x in order]
    dealt = counts.repartitionByRange(-(-n // (ordered // 4)), *columns)
    dealt = keep(dealt.selectExpr("*", "spark_partition_id() AS _part"))
    parts = dealt.groupBy(*keys, "_part").agg(F.expr(f"sum({weight}) AS _sum"))
    group = f"PARTITION BY {', '.join(own)} " if own else ""
    before = f"sum(_sum) OVER ({group}ORDER BY _part {frame.format('1 PRECEDING')})"
    parts = parts.selectExpr(*own, "_part", f"{before} AS _before")
    inside = f"sum({weight}) OVER (PARTITION BY {', '.join([*own, '_part'])} ORDER BY {by} {frame.format('CURRENT ROW')})"
    rows = same(dealt, parts, [*keys, "_part"])
    kept = [name(c) for c in counts.columns]
    # A sum over no known weight is unknown; what lies before may be known all the same.
    total = f"CASE WHEN _before IS NULL THEN {inside} ELSE _before + coalesce({inside}, 0) END"
    return rows.selectExpr(*kept, f"{total} AS {out}")


def _percentages(counts: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Percent columns over an already counted table, whose values may be of any type that has an order."""
    kept = [name(c) for c in counts.columns]
    counts = keep(counts.selectExpr("*", f"CASE WHEN {value} IS NOT NULL THEN n END AS _valid"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"), F.sum("_valid").alias("_known"))
    rows = same(running(counts, keys, [order, value], "_valid", "_upto"), totals, keys)
    return rows.selectExpr(
        *kept,
        "100 * n / _all AS raw_pct",
        "100 * _valid / _known AS valid_pct",
        f"CASE WHEN {value} IS NOT NULL THEN 100 * _upto / _known END AS cum_pct",
    )


def _value_type(df: DataFrame, cols: Sequence[str]) -> T.DataType:
    types = {df.schema[c].dataType.simpleString() for c in cols}
    if types <= {"tinyint", "smallint", "int", "bigint"}:
        return T.LongType()
    return df.schema[cols[0]].dataType if len(types) == 1 else T.StringType()


def freq_table(
    df: DataFrame,
    cols: str | Sequence[str],
    by: Sequence[str] = (),
    levels: Sequence[str] | None = None,
    codebook: DataFrame | None = None,
    codebook_order: bool = False,
) -> DataFrame:
    """Value, n, raw %, valid % and cumulative % of valid, per question and per ``by`` group.

    Several columns are turned long before the count, so any number of questions costs one scan
    and one shuffle. ``levels`` gives the order in which labels accumulate; codes accumulate in
    numeric order. With a codebook table each code gets its label, and with ``codebook_order`` codes
    accumulate in the codebook's order (``ord``), those it does not list behind.
    """
    single = isinstance(cols, str)
    cols = [cols] if single else list(cols)
    value_type = _value_type(df, cols)
    answers = [f"CAST({name(c)} AS {value_type.simpleString()}) AS {name(c)}" for c in cols]
    wide = df.selectExpr(*[name(k) for k in by], *answers)
    long = wide.unpivot(list(by), cols, "question", "value")
    keys = [*by, "question"]
    counts = tally(long, [*keys, "value"])
    counts = counts.selectExpr("*", f"{level_ord('value', levels) if levels else 'value'} AS _ord")
    if codebook is not None:
        labels = (
            codebook.filter(F.col("code").isNotNull())
            .groupBy(F.col("column").alias("_q"), F.col("code").cast(value_type).alias("_v"))
            .agg(F.min("label").alias("label"), F.min("ord").alias("_place"))
        )
        match = (F.col("question") == F.col("_q")) & (F.col("value") == F.col("_v"))
        counts = counts.join(labels, match, "left").drop("_q", "_v")
        counts = (counts.withColumn("_ord", F.col("_place")) if codebook_order else counts).drop("_place")
    elif codebook_order:
        raise ValueError("there is no codebook to order by")
    out = _percentages(counts, keys, "value", "_ord").drop("_ord")
    return out.drop("question") if single else out
