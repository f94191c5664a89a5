"""Counting cells: (keys, value, n), the form every distribution summary starts from.

Answers are integers from a small domain, so grouping on the value itself shrinks any number of
rows to at most (groups x distinct values) cells, with the work done by map-side combining in
generated code. Means, deviations, exact quantiles, boxes and tables all follow from the cells. A
group that holds a third of all rows is then no larger than any other.

Measured columns (doubles, decimals) have about as many values as rows, so counting them first would
shuffle the table. Their rows are cells of one row each: moments are combined on the map side, and
quantiles are selected digit by digit of an order-keeping 64-bit form of the value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcount.functions.columns import name
from headcount.models.table import keep

N = "n"
VALUE = "value"

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def require_integer(df: DataFrame, cols: Sequence[str]) -> None:
    for c in cols:
        if not isinstance(df.schema[c].dataType, _INTEGER):
            raise TypeError(
                f"column {c!r} is {df.schema[c].dataType.simpleString()}; these summaries are for "
                "integer counts and codes, so bin or round a measured column first"
            )


def is_measured(df: DataFrame, col: str) -> bool:
    """Whether a column holds measurements and not counts or codes; a column without an order as a number raises."""
    kind = df.schema[col].dataType
    if isinstance(kind, _INTEGER):
        return False
    if isinstance(kind, T.FractionalType) and not (isinstance(kind, T.DecimalType) and kind.precision > 18):
        return True
    raise TypeError(f"column {col!r} is {kind.simpleString()}; summaries are for numbers of 18 digits at most")


def value_cells(df: DataFrame, keys: Sequence, value: str) -> DataFrame:
    """One row per (keys, value) with its row count ``n``; of a measured column, one row per row of df."""
    if is_measured(df, value):
        return df.select(*keys, F.col(value).alias(VALUE), F.lit(1).cast("long").alias(N))
    return df.groupBy(*keys, F.col(value).alias(VALUE)).agg(F.count("*").alias(N))


def long_answers(df: DataFrame, keys: Sequence[str], cols: Sequence[str], question: str = "question") -> DataFrame:
    """(keys, question, value): several integer columns under each other."""
    answers = [f"CAST({name(c)} AS BIGINT) AS {name(c)}" for c in cols]
    wide = df.selectExpr(*[name(k) for k in keys], *answers)
    return wide.unpivot(list(keys), list(cols), question, VALUE)


def question_cells(df: DataFrame, keys: Sequence[str], cols: Sequence[str], question: str = "variable") -> DataFrame:
    """Cells of several value columns at once, told apart by ``question``: one scan, one shuffle."""
    return value_cells(long_answers(df, keys, cols, question), [*keys, question], VALUE)


# Sums are exact (decimal for squares), so the variance loses nothing to cancellation. Quantiles
# interpolate linearly between order statistics.
_KNOWN = "sum(CASE WHEN value IS NOT NULL THEN n END)"
_S1 = "sum(CAST(value * n AS DECIMAL(38, 0)))"
_S2 = "sum(CAST(value AS DECIMAL(19, 0)) * CAST(value * n AS DECIMAL(19, 0)))"
_VARIANCE = (
    f"CASE WHEN {_KNOWN} > 1 THEN CAST({_KNOWN} * CAST({_S2} AS DECIMAL(38, 0)) - {_S1} * {_S1} AS DOUBLE)"
    f" / (CAST({_KNOWN} AS DOUBLE) * CAST({_KNOWN} - 1 AS DOUBLE)) END"
)

STATISTICS = {
    "mean": f"try_divide(CAST({_S1} AS DOUBLE), CAST({_KNOWN} AS DOUBLE))",
    "sd": f"sqrt({_VARIANCE})",
    "variance": _VARIANCE,
    "min": "min(value)",
    "max": "max(value)",
    "total": "sum(value * n)",
    "n": "sum(n)",
}
QUANTILES = {"q25": "_q0", "median": "_q1", "q75": "_q2", "iqr": "_q2 - _q0"}

#: Cells that one window may put in order, and values that share all but the last 16 bits.
ORDERED = 65_536
_POINTS = (0.25, 0.5, 0.75)


def statistics(names: Iterable[str]) -> list[Column]:
    """Aggregates over cells, named after the statistic."""
    return [F.expr(f"{STATISTICS[s]} AS {s}") for s in names]


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL, which is then a key like any other. The keys stay once."""
    named = right.selectExpr(*[f"{name(k)} AS {name(f'_{i}_')}" for i, k in enumerate(keys)], *_rest(right, keys))
    match = [F.col(name(k)).eqNullSafe(F.col(f"_{i}_")) for i, k in enumerate(keys)]
    return left.join(named, match, how).drop(*[f"_{i}_" for i in range(len(keys))])


def _rest(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [name(c) for c in df.columns if c not in keys]


def order_key(kind: T.DataType, v: str = VALUE) -> str:
    """SQL for a BIGINT that keeps the order of a number and tells its values apart.

    Integers are their own key and decimals their unscaled number. Of a double it is what its 64 bits
    say of the magnitude: with e its binary exponent, 2^52 (e + 1022) + |v| 2^(52 - e), with the sign.
    The powers of two are exact, so is the key. Infinities and NaN come last, as Spark orders them.
    """
    if isinstance(kind, T.DecimalType):
        return f"CAST({v} * {10 ** kind.scale}BD AS BIGINT)"
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"CAST({v} AS BIGINT)"
    size = f"abs(CAST({v} AS DOUBLE))"
    # log2 may be off by one next to a power of two, which the size of the fraction tells.
    e = f"CAST(greatest(-1022D, floor(log2({size}))) AS INT)"
    # Two factors, as one power could overflow.
    fraction = "({size} * pow(2D, CAST(26 - floor({e} / 2D) AS DOUBLE)) * pow(2D, CAST(26 - ({e} - floor({e} / 2D)) AS DOUBLE)))"
    scaled = fraction.format(size=size, e="_e")
    exact = f"CASE WHEN {scaled} >= 9007199254740992D THEN _e + 1 WHEN {scaled} < 4503599627370496D AND _e > -1022 THEN _e - 1 ELSE _e END"
    key = f"4503599627370496L * (_f + 1022) + CAST({fraction.format(size=size, e='_f')} AS BIGINT)"
    # Names for the steps: each is a one-element array that the next one maps.
    finite = f"transform(transform(array({e}), _e -> {exact}), _f -> {key})[0]"
    return (
        f"CASE WHEN isnan({v}) THEN 9221120237041090560L WHEN {size} = 0D THEN 0L"
        f" WHEN {size} > 1.7976931348623157E308D THEN CAST(sign({v}) AS BIGINT) * 9218868437227405312L"
        f" ELSE CAST(sign({v}) AS BIGINT) * ({finite}) END"
    )


def _interpolated(rows: DataFrame, keys: Sequence[str], drawn: Callable[[str], str]) -> DataFrame:
    """(keys, _q0, _q1, _q2) from rows in order: ``_to`` rows lie up to the end of a cell, ``_at`` are wanted."""
    at = range(2 * len(_POINTS))
    picked = [f"max(CASE WHEN _at[{i}] < _to AND _at[{i}] >= _to - {N} THEN {drawn(VALUE)} END) AS _o{i}" for i in at]
    stats = rows.groupBy(*keys).agg(F.first("_total").alias("_total"), *[F.expr(x) for x in picked])
    between = [
        f"CASE WHEN _o{2 * i} = _o{2 * i + 1} THEN _o{2 * i} ELSE (ceil((_total - 1) * {p}D) - (_total - 1) * {p}D) * _o{2 * i}"
        f" + ((_total - 1) * {p}D - floor((_total - 1) * {p}D)) * _o{2 * i + 1} END AS _q{i}"
        for i, p in enumerate(_POINTS)
    ]
    return stats.selectExpr(*[name(k) for k in keys], *between)


def quartiles(
    cells: DataFrame, keys: Sequence[str], drawn: Callable[[str], str] = "CAST({} AS DOUBLE)".format, ordered: int | None = None
) -> DataFrame:
    """(keys, _q0, _q1, _q2): exact quartiles of cells of any number, interpolated between order statistics.

    ``drawn`` is the scale on which they are interpolated; it has to keep the order. ``keys`` are at
    least one. Selection by digits: the values' 64-bit keys are counted by their leading 16 bits, then,
    in the ranges that hold an order statistic, by the next 16, and so on; digits that all values share
    are skipped. What is put in order is the cells of one last range at a time, and counts of at most
    65,536 ranges within the range before. A table of few cells, or of small numbers, is one range.
    Cells that are not counted yet are read once for the first digits and once for the ranges they leave.
    """
    ordered = ordered or ORDERED
    own = [name(k) for k in keys]
    known = cells.filter("value IS NOT NULL").selectExpr(*own, VALUE, N, f"{order_key(cells.schema[VALUE].dataType)} AS _key")
    n, least, most = known.agg(F.count("*"), F.min("_key"), F.max("_key")).first()
    at = ", ".join(f"{f}((_total - 1) * {p}D)" for p in _POINTS for f in ("floor", "ceil"))
    group, frame = f"PARTITION BY {', '.join(own)}", "ROWS BETWEEN UNBOUNDED PRECEDING AND"
    shifts = [] if n <= ordered else [b for b in (48, 32, 16) if least >> b != most >> b]
    if not shifts:
        rows = known.selectExpr("*", f"sum({N}) OVER ({group} ORDER BY {VALUE} {frame} CURRENT ROW) AS _to", f"sum({N}) OVER ({group}) AS _total")
        return _interpolated(rows.selectExpr("*", f"array({at}) AS _at"), keys, drawn)
    left, before, total, parent = known, "0L", f"sum(_n) OVER ({group})", []
    for i, bits in enumerate(shifts):
        left = left.selectExpr(*[c for c in left.columns if c != "_range"], f"shiftright(_key, {bits}) AS _range")
        counted = left.groupBy(*keys, *parent, "_range").agg(F.expr(f"sum({N}) AS _n"), *[F.first(c).alias(c) for c in ("_base", "_total") if i])
        inside = f"PARTITION BY {', '.join([*own, *parent])} ORDER BY _range {frame} 1 PRECEDING"
        counted = counted.selectExpr(
            *own, "_range", "_n", f"{before} + coalesce(sum(_n) OVER ({inside}), 0L) AS _base", f"{total} AS _total"
        )
        hit = counted.selectExpr("*", f"array({at}) AS _at").filter("exists(_at, t -> t >= _base AND t < _base + _n)")
        left = same(left.drop("_base", "_total", "_parent"), hit.drop("_n", "_at"), [*keys, "_range"])
        left = left.withColumnRenamed("_range", "_parent")
        if i == 0:
            # From here on few rows are left, one for each value however often it occurs.
            shared = [*keys, VALUE, "_key", "_parent", "_base", "_total"]
            left = keep(left.groupBy(*shared).agg(F.sum(N).alias(N)))
        before, total, parent = "_base", "_total", ["_parent"]
    group = f"PARTITION BY {', '.join(own)}, _parent ORDER BY {VALUE} {frame} CURRENT ROW"
    return _interpolated(left.selectExpr("*", f"_base + sum({N}) OVER ({group}) AS _to", f"array({at}) AS _at"), keys, drawn)


def _moments(cells: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Statistics but quantiles; those of a measured column from its rows, combined on the map side."""
    if isinstance(cells.schema[VALUE].dataType, _INTEGER):
        return cells.groupBy(*keys).agg(F.sum(N).alias("_rows"), *statistics(names))
    measured = {"mean": "avg(_v)", "sd": "stddev_samp(_v)", "variance": "var_samp(_v)", "min": "min(value)", "max": "max(value)", "total": "sum(value)", "n": "count(*)"}
    rows = cells.selectExpr("*", "CAST(value AS DOUBLE) AS _v")
    return rows.groupBy(*keys).agg(F.sum(N).alias("_rows"), *[F.expr(f"{measured[s]} AS {s}") for s in names])


def summarise(cells: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, statistics) of a table of cells.

    With quantiles, cells that are counted are kept first, so that the raw rows are read once for both parts.
    """
    plain = [s for s in names if s not in QUANTILES]
    if len(plain) == len(names):
        return _moments(cells, keys, names).drop("_rows")
    own = [*keys, "_one"]
    cells = cells.selectExpr("*", "0 AS _one")
    if isinstance(cells.schema[VALUE].dataType, _INTEGER):
        cells = keep(cells)
    out = same(_moments(cells, own, plain), quartiles(cells, own), own, "left")
    return out.selectExpr(*[name(k) for k in keys], *[f"{QUANTILES.get(s, s)} AS {s}" for s in names])
