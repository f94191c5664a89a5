"""Recodes, totals, bands and dates over coded answers.

Arguments called ``x`` are column names or SQL expressions. A NULL condition is never "false"
here: an unknown answer has to stay unknown, so no recode has an ELSE branch.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from headcount.functions.codes import SENTINELS, Bands


def literal(value) -> str:
    """A Python value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"({value!r}D)" if value < 0 else f"{value!r}D"
    if isinstance(value, int):
        return f"({value})" if value < 0 else str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: Iterable) -> str:
    return ", ".join(literal(v) for v in values)


def name(column: str) -> str:
    """A column name quoted for SQL text."""
    return "`" + column.replace("`", "``") + "`"


def with_exprs(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Add or replace columns from SQL text, in one projection."""
    replaced = [f"{exprs[c]} AS {name(c)}" if c in exprs else name(c) for c in df.columns]
    added = [f"{text} AS {name(c)}" for c, text in exprs.items() if c not in df.columns]
    return df.selectExpr(*replaced, *added)


def is_in(x: str, values: Iterable) -> str:
    return f"({x} IN ({_list(values)}))"


def null_codes(x: str, codes: Iterable[int] = SENTINELS) -> str:
    """NULL where the value is exactly one of ``codes``; other negatives are kept."""
    return f"CASE WHEN {x} NOT IN ({_list(codes)}) THEN {x} END"


def row_total(*xs: str) -> str:
    """Sum over columns that skips NULL; a row with no answer at all totals 0."""
    return "(" + " + ".join(f"coalesce(CAST({x} AS BIGINT), 0L)" for x in xs) + ")"


def n_answered(*xs: str) -> str:
    """How many of the columns hold an answer, to tell a true 0 total from an empty row."""
    return "(" + " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in xs) + ")"


def row_max(*xs: str, skip_null: bool = False) -> str:
    """Largest of the columns; NULL if any of them is NULL unless ``skip_null``."""
    largest = f"greatest({', '.join(xs)})"
    if skip_null:
        return largest
    known = " AND ".join(f"{x} IS NOT NULL" for x in xs)
    return f"CASE WHEN {known} THEN {largest} END"


def date_from_parts(year: str, month: str, day: str) -> str:
    """Date from three integer parts; parts that make no date, or any NULL part, give NULL."""
    return f"try_to_date(concat({year}, '-', {month}, '-', {day}), 'yyyy-M-d')"


def weekday(x: str) -> str:
    """Short English day name."""
    return f"date_format({x}, 'E')"


def if_else(cond: str, yes, no) -> str:
    """Two-way recode that keeps NULL for an unknown condition."""
    return f"CASE WHEN {cond} THEN {literal(yes)} WHEN NOT ({cond}) THEN {literal(no)} END"


def classify(branches: Sequence[tuple[str, object]]) -> str:
    """First true branch wins; a NULL condition is not true; no branch gives NULL."""
    return "CASE " + " ".join(f"WHEN {cond} THEN {literal(label)}" for cond, label in branches) + " END"


def _per_band(x: str, bands: Bands, values: Iterable) -> str:
    branches = [(f"{x} <= {bands.edges[0]}", None)]
    for upper, value in zip(bands.edges[1:], values):
        branches.append((f"{x} IS NOT NULL" if upper is None else f"{x} <= {upper}", value))
    return classify(branches)


def band(x: str, bands: Bands) -> str:
    """Label of the band (lo, hi] the value falls in; outside all bands gives NULL."""
    return _per_band(x, bands, bands.labels)


def band_ord(x: str, bands: Bands) -> str:
    """1-based position of the band, for ordering output."""
    return _per_band(x, bands, range(1, len(bands.labels) + 1))


def recode(x: str, mapping: Mapping) -> str:
    """Value to label by a short fixed mapping; anything unlisted, and NULL, gives NULL."""
    by_label: dict = {}
    for code, label in mapping.items():
        by_label.setdefault(label, []).append(code)
    return classify([(is_in(x, codes), label) for label, codes in by_label.items()])


def level_ord(x: str, levels: Sequence[str]) -> str:
    """1-based position in an ordered level list; a value outside the list gives NULL."""
    return classify([(f"{x} = {literal(level)}", i) for i, level in enumerate(levels, start=1)])


def code_prefix(x: str, length: int) -> str:
    """Leading characters of a numeric code."""
    return f"substring(CAST({x} AS STRING), 1, {length})"


def log_scale(x: str, plus_one: bool = False) -> str:
    """log10 as a log axis draws it: zero and below cannot be drawn and give NULL."""
    x = f"({x} + 1)" if plus_one else x
    return f"CASE WHEN {x} > 0 THEN log10({x}) END"


def round_half_even(x: str, digits: int = 0) -> str:
    """Round with ties to the even neighbour."""
    return f"bround({x}, {digits})"
