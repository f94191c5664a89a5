import math

import pytest

from headcount.functions import codes as K
from headcount.functions import special
from headcount.functions.columns import (
    band,
    band_ord,
    code_prefix,
    date_from_parts,
    if_else,
    level_ord,
    literal,
    log_scale,
    n_answered,
    null_codes,
    recode,
    round_half_even,
    row_max,
    row_total,
    weekday,
)
from headcount.operators import derive
from headcount.plans.clean import occupation


def one(spark, rows, schema, **exprs):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {schema}")
    out = df.selectExpr("id", *[f"{text} AS {n}" for n, text in exprs.items()]).orderBy("id").collect()
    return [tuple(r)[1:] for r in out]


def test_bands_are_closed_on_the_right(spark):
    ages = [-11, 0, 1, 4, 5, 17, 18, 29, 30, 39, 49, 50, 69, 70, 120, None]
    got = one(spark, [(a,) for a in ages], "a int", b=band("a", K.AGE3), o=band_ord("a", K.AGE3))
    assert got == [
        (None, None),
        (None, None),
        ("0 - 4", 1),
        ("0 - 4", 1),
        ("5 - 17", 2),
        ("5 - 17", 2),
        ("23 - 29", 3),
        ("23 - 29", 3),
        ("30 - 39", 4),
        ("30 - 39", 4),
        ("40 - 49", 5),
        ("50 - 59", 6),
        ("60 - 69", 7),
        ("70+", 8),
        ("70+", 8),
        (None, None),
    ]


def test_bands_need_matching_labels():
    with pytest.raises(ValueError):
        K.Bands((0, 1), ("a", "b"))


def test_missing_codes_and_totals(spark):
    rows = [(None, None), (-11, -9), (-5, 2), (0, 0), (3, -1), (2, 4)]
    got = one(
        spark,
        rows,
        "a int, b int",
        x=null_codes("a"),
        t=row_total(null_codes("a"), null_codes("b")),
        k=n_answered(null_codes("a"), null_codes("b")),
        m=row_max("a", "b"),
        s=row_max("a", "b", skip_null=True),
    )
    assert got == [
        (None, 0, 0, None, None),
        (None, 0, 0, -9, -9),
        (-5, -3, 2, 2, 2),
        (0, 0, 2, 0, 0),
        (3, 3, 1, 3, 3),
        (2, 6, 2, 4, 4),
    ]


def test_row_max_keeps_null_unless_told(spark):
    got = one(spark, [(None, 3)], "a int, b int", m=row_max("a", "b"), s=row_max("a", "b", skip_null=True))
    assert got == [(None, 3)]


def test_row_total_can_require_answers(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, 2)], "a int, b int")
    got = derive.add_row_total(df, "t", ["a", "b"], min_answered=1).select("t").collect()
    assert [r.t for r in got] == [None, 1, 3]


def test_dates(spark):
    rows = [(2020, 4, 9), (2020, 4, 12), (2020, 4, 13), (2020, -1, 5), (2020, 2, 30), (2020, None, 1)]
    date = date_from_parts("y", "m", "d")
    got = one(
        spark,
        rows,
        "y int, m int, d int",
        text=f"CAST({date} AS STRING)",
        day=weekday(date),
        kind=if_else(f"{weekday(date)} IN ('Sat', 'Sun')", "Weekend", "Weekday"),
    )
    assert got == [
        ("2020-04-09", "Thu", "Weekday"),
        ("2020-04-12", "Sun", "Weekend"),
        ("2020-04-13", "Mon", "Weekday"),
        (None, None, None),
        (None, None, None),
        (None, None, None),
    ]


def test_week_index_starts_on_the_monday_before_the_first_date(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (DATE'2020-04-09'), (DATE'2020-04-12'), (DATE'2020-04-13'), (DATE'2020-05-17'), (NULL) AS t(d)"
    )
    got = derive.add_week_index(df, "d", "w").collect()
    assert [r.w for r in got] == [1, 1, 2, 6, None]


def test_isolation_recode_and_levels(spark):
    codes = [1, 2, 3, 9, -1, -9, -10, -11, -9999, 4, None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id int, c int")
    df = df.selectExpr("id", f"{recode('c', K.ISOLATION_LABELS)} AS s")
    got = derive.add_levels(df, "s", K.ISOLATION_LEVELS).orderBy("id").collect()
    assert [r.s for r in got] == ["No", "Yes, am now", "Yes, but have stopped", "Prefer not to say"] + ["UNK"] * 5 + [
        None,
        None,
    ]
    assert [r.s_ord for r in got] == [1, 2, 3, 4, 5, 5, 5, 5, 5, None, None]


def test_values_outside_the_level_list_become_null(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    got = derive.add_levels(df, "s", ["a", "b"]).collect()
    assert [(r.s, r.s_ord) for r in got] == [("a", 1), (None, None), (None, None)]


def test_occupation(spark):
    rows = [(2, 1), (2, None), (None, 1), (None, 2), (1, 2), (9, 9), (None, None)]
    got = one(spark, rows, "hcw int, keyworker int", o=occupation())
    assert [r[0] for r in got] == ["HCW", "HCW", "Keyworker", None, "Other", "Other", None]


def test_small_expressions(spark):
    got = one(
        spark,
        [(0, 2.5), (99, 3.5), (-1, -0.5)],
        "a int, b double",
        p=code_prefix("a", 1),
        g=log_scale("a"),
        h=log_scale("a", plus_one=True),
        r=round_half_even("b"),
    )
    assert got == [("0", None, 0.0, 2.0), ("9", math.log10(99), 2.0, 4.0), ("-", None, None, 0.0)]


def test_literals_are_safe_text(spark):
    for value in ["it's", "back\\slash", -3, 2.5, -1e-9, None, True]:
        got = spark.sql(f"SELECT {literal(value)} AS v").first().v
        assert got == value


def test_level_order_text(spark):
    assert one(spark, [("b",)], "s string", o=level_ord("s", ["a", "b"])) == [(2,)]


@pytest.mark.parametrize("x", [1e-3, 0.2, 0.5, 1.0, 1.605, 2.0, 7.5, 30.0, 1e3, 1e6])
def test_gamma_family(spark, x):
    row = spark.createDataFrame([(x,)], "x double").selectExpr(
        f"{special.lgamma('x')} AS l", f"{special.digamma('x + 5D')} - {special.digamma('x')} AS d",
        f"{special.trigamma('x')} - {special.trigamma('x + 5D')} AS t",
    ).first()
    assert row.l == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)
    assert row.d == pytest.approx(sum(1 / (x + j) for j in range(5)), rel=1e-10, abs=1e-12)
    assert row.t == pytest.approx(sum(1 / (x + j) ** 2 for j in range(5)), rel=1e-10, abs=1e-12)


def test_nb_pmf_sums_to_one_and_allows_a_zero_mean(spark):
    df = spark.range(400).selectExpr("CAST(id AS DOUBLE) AS y", "2.5D AS mu", "0.7D AS t", "0D AS none")
    row = df.selectExpr(
        f"sum(exp({special.nb_log_pmf('y', 'mu', 't')})) AS s",
        f"sum(CASE WHEN y = 0 THEN exp({special.nb_log_pmf('y', 'none', 't')}) END) AS z",
    ).first()
    assert row.s == pytest.approx(1, abs=1e-10)
    assert row.z == pytest.approx(1, abs=1e-12)
