"""What the physical plans must and must not contain."""

import re

import pytest

from headcount.models.table import keep, model_table
from headcount.functions import codes as K
from headcount.operators import cells, frequency, mixing, plots, summary
from headcount.plans.clean import clean, select_cases
from headcount.plans.registry import queries
from headcount.sources import survey

# These fit a model before they return a DataFrame.
FITTED = ("mdl_", "dist_nb", "dist_zinb", "dist_ols_multi", "dist_compare", "dist_zero")


def plan(df):
    return df._jdf.queryExecution().toString()


def shuffles(df):
    physical = plan(df).split("== Physical Plan ==")[1]
    return len(re.findall(r"Exchange hashpartitioning|Exchange SinglePartition|Exchange rangepartitioning", physical))


@pytest.fixture(scope="module")
def people(spark, sf_dir):
    return clean(survey(spark, sf_dir), K.EXCLUDED_IDS)


@pytest.mark.parametrize("key", [k for k in queries() if not k.startswith(FITTED)])
def test_no_cross_join_and_no_python(spark, sf_dir, key):
    text = plan(queries()[key](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInArrow", "BatchEvalPython"):
        assert word not in text


def test_line_items_are_not_read_when_no_contact_column_is(spark, people):
    text = plan(people.groupBy("age3", "selfisolation_un").count())
    assert "orders.parquet" in text and "lineitem.parquet" not in text


def test_scan_reads_only_needed_columns_and_filters_early(spark, sf_dir):
    text = plan(select_cases(survey(spark, sf_dir), K.EXCLUDED_IDS).select("respondent_id", "f2f_0_4"))
    assert "In(l_returnflag, [A,R])" in text.replace("In(l_returnflag, [R,A])", "In(l_returnflag, [A,R])")
    assert "Not(EqualTo(o_orderkey,9142))" in text
    assert "l_extendedprice" not in text and "o_totalprice" not in text


def test_a_summary_adds_two_shuffles_of_counted_rows(people):
    base = shuffles(people.select("total_contacts"))
    for cols in ("total_contacts", ["total_contacts", "total_physical"]):
        assert shuffles(summary.describe(people, cols, by="age3", stats=summary.BRIEF)) == base + 2


@pytest.mark.parametrize(
    "module, query",
    [
        (cells, lambda people: summary.describe(people, "total_contacts", by="age3")),
        (cells, lambda people: mixing.mixing_matrix(people, "age3", K.FACE_TO_FACE)),
        (plots, lambda people: plots.box_stats(people, "total_contacts", ["age3"])),
        (frequency, lambda people: frequency.freq_table(people, "total_contacts")),
    ],
)
def test_quantiles_and_percentages_read_the_table_once(people, monkeypatch, module, query):
    kept = []
    monkeypatch.setattr(module, "keep", lambda df: (kept.append(plan(df).split("== Physical Plan ==")[1]), keep(df))[1])
    text = plan(query(people))
    assert "lineitem.parquet" not in text and [t.count("lineitem.parquet") for t in kept] == [1]


def test_a_million_values_are_not_put_in_one_task(spark):
    df = spark.range(1_000_000).selectExpr("id * 7 AS v", "CAST(NULL AS STRING) AS nothing")
    whole = summary.describe(df, "v")
    boxes = plots.box_stats(df, "v", [])
    table = frequency.freq_table(df, "v")
    shares = frequency.prop_table(df, "v")
    bins = plots.histogram(df, "v")
    for wide in (whole, boxes, table, shares, bins):
        assert not re.search(r"Window[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan(wide))
    assert whole.select("q25", "median", "q75").first() == (1749998.25, 3499996.5, 5249994.75)
    r = boxes.first()
    assert (r.q25, r.median, r.q75, r.n_outliers, r.n) == (1749998.25, 3499996.5, 5249994.75, 0, 1_000_000)
    some = {r.value: r.cum_pct for r in table.where("value IN (0, 458752, 458759, 6999993)").collect()}
    assert some == pytest.approx({0: 1e-4, 458752: 6.5537, 458759: 6.5538, 6999993: 100})
    assert shares.where("share <> 1e-6").count() == 0 and bins.count() == 1_000_000


def test_top_categories_rank_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(queries()["agg_topk"](spark, sf_dir))


def test_model_table_combines_before_the_shuffle(people):
    text = plan(model_table(people, "total_contacts", ["age3"])).split("== Physical Plan ==")[1]
    assert re.search(r"partial_(count|sum)\(", text)


def test_kept_table_has_no_lineage(spark):
    df = keep(spark.range(10).selectExpr("id % 3 AS k").groupBy("k").count())
    assert "Scan ExistingRDD" in plan(df) and df.count() == 3
