import statistics
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from headcount.functions import codes as K
from headcount.operators import distributions, filters, frequency, mixing, plots, summary
from headcount.plans.clean import CONTACTS, clean
from headcount.sources import survey

GROUPS = [("one", 7), (None, 4), (None, 6), ("same", 5), ("same", 5), ("mix", 1), ("mix", 2), ("mix", 3), ("mix", 10)]


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(GROUPS, "g string, v int")


@pytest.fixture(scope="module")
def people(spark, sf_dir):
    df = clean(survey(spark, sf_dir)).cache()
    yield df
    df.unpersist()


def by_key(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_describe_by_group(groups):
    got = by_key(summary.describe(groups, "v", by="g"), "g")
    assert (got["one"].mean, got["one"].sd, got["one"].n) == (7, None, 1)
    assert (got["same"].sd, got["same"].median) == (0, 5)
    mix = got["mix"]
    assert (mix.q25, mix.median, mix.q75) == (1.75, 2.5, 4.75)
    assert mix.sd == pytest.approx(statistics.stdev([1, 2, 3, 10]), rel=1e-14)
    assert got[None].mean == 5


def test_describe_skips_null_but_counts_the_row(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    r = summary.describe(df, "v").first()
    assert (r.mean, r.n, r.min, r.max) == (2, 3, 1, 3)


def test_several_columns_at_once_are_integers(spark):
    df = spark.createDataFrame([(1.5,)], "v double")
    with pytest.raises(TypeError):
        summary.describe(df, ["v"])
    assert summary.describe(df, "v").first().mean == 1.5


def test_variance_does_not_cancel(spark):
    big = 10**9
    r = summary.describe(spark.createDataFrame([(big,), (big + 1,), (big + 2,)], "v bigint"), "v").first()
    assert r.sd == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=2, max_size=60))
def test_describe_against_numpy(spark, values):
    r = summary.describe(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    assert r.mean == pytest.approx(np.mean(values))
    assert r.sd == pytest.approx(np.std(values, ddof=1))
    assert [r.q25, r.median, r.q75] == pytest.approx(list(np.percentile(values, [25, 50, 75])))


def test_several_groupings_equal_single_ones(people):
    each = summary.describe_by_each(people, ["total_contacts", "total_physical"], ["age3", "sex"])
    got = by_key(each.filter("variable = 'total_contacts' AND key = 'sex'"), "level")
    for r in summary.describe(people, "total_contacts", by="sex", stats=summary.BRIEF).collect():
        mine = got[None if r.sex is None else str(r.sex)]
        assert (mine.mean, mine.sd, mine.n) == (r.mean, r.sd, r.n)


def test_frequency_table(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string")
    got = by_key(frequency.freq_table(df, "s", levels=["b", "a"]), "value")
    assert (got["b"].n, got["b"].raw_pct, got["b"].valid_pct) == (2, 50, pytest.approx(200 / 3))
    assert got["b"].cum_pct == pytest.approx(200 / 3) and got["a"].cum_pct == pytest.approx(100)
    assert (got[None].raw_pct, got[None].valid_pct, got[None].cum_pct) == (25, None, None)


def test_frequency_table_with_codebook_labels(spark):
    df = spark.createDataFrame([(1, 2), (2, -9), (1, None)], "p int, q int")
    book = spark.createDataFrame(
        [("p", 1, "no", False, 1), ("p", 2, "yes", False, 2), ("q", -9, "missed", True, 1)],
        "column string, code bigint, label string, is_missing boolean, ord int",
    )
    got = by_key(frequency.freq_table(df, ["p", "q"], codebook=book), "question", "value")
    assert got["p", 1].label == "no" and got["q", -9].label == "missed" and got["q", 2].label is None
    assert sum(r.n for k, r in got.items() if k[0] == "q") == 3


def test_frequencies_sum_to_the_table(people):
    total = people.count()
    table = frequency.freq_table(people, ["total_contacts", "total_physical"]).groupBy("question").sum("n").collect()
    assert {r[1] for r in table} == {total}


def test_shares_sum_to_one(people):
    within = summary.share(people, ["age3", "N_0to17yo"], within=["age3"]).groupBy("age3").sum("freq").collect()
    assert all(r[1] == pytest.approx(1) for r in within)
    assert sum(r.freq for r in summary.share(people, ["children_in_house"]).collect()) == pytest.approx(1)


def test_mixing_totals_equal_row_totals(people):
    for contacts, total in (
        (K.FACE_TO_FACE, "total_face_to_face"),
        (K.PHYSICAL, "total_physical"),
        (K.TOTAL_BY_CONTACT, "total_contacts"),
    ):
        matrix = mixing.mixing_matrix(people, "age3", contacts)
        by_band = {r[0]: r[1] for r in matrix.groupBy("age_respondent").sum("total").collect()}
        rows = {r[0]: r[1] for r in people.groupBy("age3").sum(total).collect()}
        assert by_band == rows


def test_response_profile_adds_up(people):
    total = people.count()
    for r in filters.response_profile(people, ["total_contacts"]).collect():
        assert r.n_zero + r.n_positive == r.n_non_negative == total
        assert r.n_negative == 0


def test_missing_profile_before_mapping(spark):
    df = spark.createDataFrame([(-11,), (-9,), (-5,), (0,), (2,), (None,)], "v int")
    r = filters.missing_profile(df, ["v"], K.SENTINELS).first()
    assert (r.n, r.n_answered, r.n_zero, r.n_non_zero, r.n_null, r.n_other_negative) == (6, 2, 1, 1, 1, 1)
    assert (r.n_code_11, r.n_code_10, r.n_code_9, r.n_code_1) == (1, 0, 1, 0)


def test_missing_profile_matches_raw_counts(spark, sf_dir):
    raw = survey(spark, sf_dir)
    got = by_key(filters.missing_profile(raw, CONTACTS, K.SENTINELS), "question")
    for c in CONTACTS:
        assert got[c].n_code_9 == raw.filter(f"{c} = -9").count()


def test_excluded_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,)], "i bigint")
    tables = [spark.createDataFrame([(i,) for i in ids], "x bigint") for ids in ([2], [2, None])]
    for ids in ([2], [2, None], [None, 2, *range(100, 2100)], *tables):
        assert sorted(r.i for r in filters.exclude_ids(df, "i", ids).collect()) == [1, 3]
    assert filters.exclude_ids(df, "i", []).count() == filters.exclude_ids(df, "i", [None]).count() == 3


def test_cross_classify(spark):
    rows = [(2, 1), (2, None), (None, 1), (None, 2), (1, 2), (9, 9), (None, None)]
    df = spark.createDataFrame(rows, "hcw int, keyworker int")
    r = filters.cross_classify(df, {"both": "hcw = 2 AND keyworker = 1", "key": "keyworker = 1"}).first()
    assert (r.both, r.key) == (1, 2)


def test_top_categories_break_ties_by_name(spark):
    rows = [("g", "c")] * 3 + [("g", "b")] * 2 + [("g", "a")] * 2 + [("g", "d")] + [("h", "z")]
    df = spark.createDataFrame(rows, "g string, c string")
    got = [(r.g, r.c, r.n, r["rank"]) for r in summary.top_categories(df, "g", "c", 2).orderBy("g", "rank").collect()]
    assert got == [("g", "c", 3, 1), ("g", "a", 2, 2), ("h", "z", 1, 1)]


def test_lookup_keeps_unmatched_rows_and_never_multiplies(spark):
    df = spark.createDataFrame([("11",), ("99",), (None,)], "code string")
    lookup = spark.createDataFrame([("11", "b"), ("11", "a"), (None, "x")], "code string, title string")
    got = summary.attach_lookup(df, lookup, "code", ["title"]).collect()
    assert Counter((r.code, r.title) for r in got) == Counter([("11", "a"), ("99", None), (None, None)])


def brute_box(values):
    q25, q50, q75 = np.percentile(values, [25, 50, 75])
    reach = 1.5 * (q75 - q25)
    inside = [v for v in values if q25 - reach <= v <= q75 + reach]
    return min(inside), q25, q50, q75, max(inside), len(values) - len(inside)


def test_box_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(v)) for g in ("a", "b") for v in rng.negative_binomial(1, 0.2, 300)]
    df = spark.createDataFrame(rows, "g string, v int")
    for log in (False, True):
        for r in plots.box_stats(df, "v", ["g"], log=log).collect():
            values = [v for g, v in rows if g == r.g]
            drawn = [float(np.log10(v)) for v in values if v > 0] if log else values
            expected = brute_box(drawn)
            got = (r.whisker_low, r.q25, r.median, r.q75, r.whisker_high, r.n_outliers)
            assert got == pytest.approx(expected, rel=1e-12)
            assert r["mean"] == pytest.approx(np.mean(drawn)) and r.n == len(drawn)


def test_histogram(spark):
    df = spark.createDataFrame([(0,), (4,), (5,), (9,), (10,), (None,)], "v int")
    got = {r.bin: (r.n, r.density) for r in plots.histogram(df, "v", width=5).collect()}
    assert got == {0: (2, 0.08), 5: (2, 0.08), 10: (1, 0.04)}


def test_overlap_on_log_axes_loses_zeros(spark):
    df = spark.createDataFrame([(0, 1, "a"), (2, 2, "a"), (2, 2, "a")], "x int, y int, g string")
    assert plots.overlap_count(df, "x", "y", "g").count() == 2
    assert [r.n for r in plots.overlap_count(df, "x", "y", "g", log_axes=True).collect()] == [2]


def test_date_summary(spark):
    df = spark.sql("SELECT * FROM VALUES (DATE'2020-04-09'), (DATE'2020-04-10'), (DATE'2020-04-20'), (NULL) AS t(d)")
    r = summary.date_summary(df, "d").first()
    assert str(r.min_date) == "2020-04-09" and str(r.median_date) == "2020-04-10" and str(r.max_date) == "2020-04-20"


def test_dispersion(spark):
    df = spark.createDataFrame([(v,) for v in [0, 0, 1, 5]], "v int")
    r = summary.dispersion(df, "v").first()
    assert (r["mean"], r.n_zero, r.share_zero) == (1.5, 2, 0.5)
    assert r.zero_inflation == pytest.approx(1 + np.log(0.5) / 1.5)
    assert summary.dispersion(spark.createDataFrame([(3,)], "v int"), "v").first().zero_inflation is None


def test_compare_distributions(spark):
    a = spark.createDataFrame([(0, 0.5), (1, 0.5)], "x int, Observed double")
    ols = spark.createDataFrame([(-1, 0.2), (1, 0.8)], "x int, OLS double")
    nb = spark.createDataFrame([(0, 0.6), (2, 0.4)], "x int, NegBin double")
    whole = distributions.compare_distributions(a, [ols, nb], 10)
    assert {(r.x, r.Model): r.prob for r in whole.collect()}[-1, "OLS"] == 0.2 and whole.count() == 12
    got = distributions.compare_distributions(a, [ols, nb], 10, lo=0, hi=50, drop=("OLS",))
    table = {(r.x, r.Model): r.n for r in got.collect()}
    assert table == {
        (0, "Observed"): 5,
        (1, "Observed"): 5,
        (2, "Observed"): 0,
        (0, "NegBin"): 6,
        (1, "NegBin"): 0,
        (2, "NegBin"): 4,
    }
