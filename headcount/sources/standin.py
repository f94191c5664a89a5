"""A survey table derived from the order tables, for tests and benchmarks.

One respondent per order. Contacts come from the order's line items, every other answer from
integer arithmetic on the order key, with each kind of missing value planted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcount.sources.files import read_table

_SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag STRING",
    "part": "p_partkey BIGINT, p_type STRING",
}
_LINES = {"0_4": "(1)", "5_17": "(2, 3)", "18_69": "(4, 5, 6)", "70": "(7)"}
_KINDS = {"f2f": ("R", 10), "phys": ("A", 25)}
_HOUSEHOLD = {"0_4": 2, "5_17": 3, "18_69": 4, "70": 2}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = T.StructType.fromDDL(_SCHEMAS[name])
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", schema, fmt="parquet")


def _line_item_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts per order. Only two return flags count, so the filter goes to the scan; the
    grouping combines on the map side, so an order with very many lines is no hot spot."""
    sums = [
        f"sum(CASE WHEN l_returnflag = '{flag}' AND l_linenumber IN {lines} "
        f"THEN floor(l_quantity / {size}) END) AS r_{kind}_{age}"
        for kind, (flag, size) in _KINDS.items()
        for age, lines in _LINES.items()
    ]
    lines = _table(spark, sf_dir, "lineitem").where("l_returnflag IN ('R', 'A')")
    return lines.groupBy("l_orderkey").agg(*[F.expr(s) for s in sums])


def _with_missing(value: str, position: int) -> str:
    """Plant the four missing codes at a spacing that differs by question: the array is indexed
    from 0 and gives NULL beyond its end."""
    slot = f"CAST((k + {position * 104729}) % 97 AS INT)"
    return f"coalesce(CAST(get(array(-9, -1, -10, -11), {slot}) AS BIGINT), {value})"


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in survey. ``orders`` holds one row per order key.

    The line items are grouped before the join, so the join's right side is unique on its key and
    Catalyst drops it, scan and shuffle included, from any query that reads no contact column.
    """
    orders = _table(spark, sf_dir, "orders")
    lines = _line_item_contacts(spark, sf_dir)
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").selectExpr(
        "*", "o_orderkey * 7919 AS k"
    )
    columns = [
        "o_orderkey AS respondent_id",
        "CAST(1 + k % 2 AS INT) AS generation",
        "2020 AS survey_year",
        "CASE WHEN k % 211 = 0 THEN -1 WHEN k % 39 < 22 THEN 4 ELSE 5 END AS survey_month",
        "CAST(CASE WHEN k % 39 < 22 THEN 9 + k % 39 ELSE k % 39 - 21 END AS INT) AS survey_day",
        "CAST(CASE WHEN k % 101 = 0 THEN -11 ELSE 18 + (o_custkey * 37) % 72 END AS INT) AS age_years",
        "CAST(CASE WHEN k % 389 <> 0 THEN 1 + (k % 5) % 2 END AS INT) AS sex",
    ]
    position = 0
    for kind in _KINDS:
        for age in _LINES:
            position += 1
            contacts = f"CAST(coalesce(r_{kind}_{age}, 0) AS BIGINT)"
            columns.append(f"{_with_missing(contacts, position)} AS {kind}_{age}")
    for age, modulus in _HOUSEHOLD.items():
        position += 1
        columns.append(f"{_with_missing(f'(k + {position}) % {modulus}', position)} AS hh_{age}")
    columns += [
        "CASE k % 29 WHEN 0 THEN -9 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS had_covid",
        "CASE k % 43 WHEN 0 THEN -9999 WHEN 1 THEN -11 WHEN 2 THEN -10 WHEN 3 THEN -9 WHEN 4 THEN -1 "
        "WHEN 5 THEN 9 WHEN 6 THEN 2 WHEN 7 THEN 2 WHEN 8 THEN 3 WHEN 9 THEN NULL WHEN 10 THEN 4 "
        "ELSE 1 END AS isolation",
        "CASE k % 11 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 8 WHEN 3 THEN 9 WHEN 4 THEN NULL "
        "ELSE 1 END AS hcw",
        "CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN NULL ELSE 2 END AS keyworker",
        "CAST(1111 + k % 397 * 20 AS INT) AS soc_code",
    ]
    return joined.selectExpr(*columns)


def soc_groups(spark: SparkSession, sf_dir: str, digits: int) -> DataFrame:
    """Stand-in index of the groups that the first digits of a code name: (group, title)."""
    lookup = soc_lookup(spark, sf_dir).selectExpr(f"substring(soc_code, 1, {digits}) AS group_code", "soc_title")
    return lookup.groupBy("group_code").agg(F.min("soc_title").alias("group_title"))


def soc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in occupation index with gaps, so that unmatched codes occur."""
    coded = (
        _table(spark, sf_dir, "part")
        .where("p_partkey % 397 % 5 <> 0")
        .selectExpr("CAST(1111 + p_partkey % 397 * 20 AS STRING) AS soc_code", "p_type")
    )
    # Distinct pairs first: that hashes, while the minimum of a text column has to sort its input.
    return coded.distinct().groupBy("soc_code").agg(F.min("p_type").alias("soc_title"))
