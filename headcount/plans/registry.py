"""Every operator as a query over the stand-in survey."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.functions import codes as K
from headcount.functions.columns import is_in, log_scale, n_answered, name, row_max
from headcount.models import large, linear, oneway, report
from headcount.models.fit import Fit, fit_nb, fit_ols, fit_zinb
from headcount.models.table import build_design, keep, model_table
from headcount.operators import derive, distributions, filters, frequency, mixing, plots, summary
from headcount.plans.clean import CONTACT_TOTALS, CONTACTS, DATES, HOUSEHOLD, clean, derive_columns, select_cases
from headcount.sources import (
    CODEBOOK_SCHEMA,
    SURVEY_SCHEMA,
    null_missing,
    read_with_rejects,
    reject_counts,
    remove,
    soc_groups,
    soc_lookup,
    survey,
)

Query = Callable[[SparkSession, str], DataFrame]

OUTCOME = "total_contacts"
TOTALS = ("total_face_to_face", "total_physical", "total_contacts")
QUESTIONS = ("had_covid", "isolation", "hcw", "keyworker")
DIGITS = 6

_queries: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _queries[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_queries)


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles at a fixed number of digits, so that two engines agree on the value."""
    return df.selectExpr(
        *[f"round({name(c)}, {digits}) AS {name(c)}" if t == "double" else name(c) for c, t in df.dtypes]
    )


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(survey(spark, sf_dir), K.EXCLUDED_IDS)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_cases(survey(spark, sf_dir), K.EXCLUDED_IDS)


def _counted(spark: SparkSession, sf_dir: str, factors: list[str]) -> DataFrame:
    """Outcome counts by some factors, kept: results that share them read the survey once."""
    return keep(model_table(_people(spark, sf_dir), OUTCOME, factors, complete=False))


# -- sources ---------------------------------------------------------------------


@query
def src_survey(spark, sf_dir):
    return survey(spark, sf_dir)


@query
def src_lookup(spark, sf_dir):
    return soc_lookup(spark, sf_dir)


@query
def src_rejects(spark, sf_dir):
    """Rows by the column that does not parse, and the good ones, of a file with two kinds of bad cells."""
    rows = survey(spark, sf_dir)
    cells = [F.col(f.name).cast("string") if f.name in rows.columns else F.lit(None).cast("string") for f in SURVEY_SCHEMA]
    text = rows.select(*[c.alias(n) for c, n in zip(cells, SURVEY_SCHEMA.names)])
    text = text.withColumn("age_years", F.expr("CASE WHEN respondent_id % 50 = 7 THEN 'unknown' ELSE age_years END"))
    text = text.withColumn("sex", F.expr("CASE WHEN respondent_id % 90 = 17 THEN '1.5' ELSE sex END"))
    # Kept first: without a shared folder that stops with a message, and rows are written as they are read.
    text = keep(text)
    path = f"{spark.sparkContext.getCheckpointDir()}/rejects-{uuid.uuid4().hex}.csv"
    text.write.option("header", True).csv(path)
    try:
        good, rejects = read_with_rejects(spark, path, limit=0.05)
        return keep(reject_counts(rejects).unionByName(good.agg(F.lit("(good)").alias("column"), F.count("age_years").alias("n"))))
    finally:
        remove(spark, path)


# -- filters ---------------------------------------------------------------------


@query
def flt_exclude_ids(spark, sf_dir):
    return filters.exclude_ids(survey(spark, sf_dir), "respondent_id", K.EXCLUDED_IDS).select(
        "respondent_id", "generation", "age_years"
    )


@query
def flt_exclude_null(spark, sf_dir):
    return filters.exclude_ids(survey(spark, sf_dir), "respondent_id", [*K.EXCLUDED_IDS, None]).select("respondent_id")


@query
def flt_exclude_many(spark, sf_dir):
    ids = [None, *range(0, 8000, 4)]
    return filters.exclude_ids(survey(spark, sf_dir), "respondent_id", ids).select("respondent_id")


@query
def flt_sentinel(spark, sf_dir):
    return filters.keep_sentinel(survey(spark, sf_dir), "age_years", K.HIDDEN_AGE).select(
        "respondent_id", "generation", "age_years"
    )


@query
def flt_positive(spark, sf_dir):
    return filters.keep_positive(survey(spark, sf_dir), "age_years").select("respondent_id", "age_years", "sex")


@query
def flt_response_profile(spark, sf_dir):
    return filters.response_profile(_people(spark, sf_dir), [*TOTALS, *CONTACTS])


@query
def flt_cross_classify(spark, sf_dir):
    yes, not_hcw = f"hcw = {K.HCW_YES}", is_in("hcw", K.HCW_NO)
    keyworker = f"keyworker = {K.KEYWORKER_YES}"
    return filters.cross_classify(
        _cases(spark, sf_dir),
        {
            "hcw_and_keyworker": f"{yes} AND {keyworker}",
            "hcw_not_keyworker": f"{yes} AND keyworker = 2",
            "keyworker": keyworker,
            "hcw": yes,
            "keyworker_not_hcw": f"{not_hcw} AND {keyworker}",
            "neither": f"{not_hcw} AND {is_in('keyworker', K.KEYWORKER_NO)}",
        },
    )


@query
def flt_label(spark, sf_dir):
    people = _people(spark, sf_dir)
    workers = filters.keep_label(people, "occupation", "Keyworker")
    return filters.keep_label(workers, "age3", "40 - 49", negate=True).select("respondent_id", "occupation", "age3")


@query
def flt_range(spark, sf_dir):
    counts = frequency.value_counts(_people(spark, sf_dir), OUTCOME)
    return filters.keep_range(counts, OUTCOME, 0, 50)


# -- derived columns -------------------------------------------------------------


@query
def prj_null_sentinels(spark, sf_dir):
    return derive.null_sentinels(survey(spark, sf_dir), CONTACTS).select("respondent_id", *CONTACTS)


@query
def prj_row_total(spark, sf_dir):
    people = derive_columns(_cases(spark, sf_dir), CONTACT_TOTALS)
    return people.selectExpr(
        "respondent_id", *TOTALS, *K.TOTAL_BY_CONTACT, f"{n_answered(*CONTACTS)} AS n_answered"
    )


@query
def prj_row_max(spark, sf_dir):
    people = derive.null_sentinels(survey(spark, sf_dir), CONTACTS)
    return people.selectExpr(
        "respondent_id",
        f"{row_max('f2f_0_4', 'phys_0_4')} AS largest",
        f"{row_max('f2f_0_4', 'phys_0_4', skip_null=True)} AS largest_known",
    )


@query
def prj_household(spark, sf_dir):
    return derive_columns(_cases(spark, sf_dir), HOUSEHOLD).select(
        "respondent_id",
        "household_size",
        "household_size2",
        "alone",
        "N_0to17yo",
        "children_in_house",
        "Children",
    )


@query
def prj_date_parts(spark, sf_dir):
    return derive_columns(survey(spark, sf_dir), DATES).select("respondent_id", "date_ymd")


@query
def prj_weekday(spark, sf_dir):
    return derive_columns(survey(spark, sf_dir), DATES).select(
        "respondent_id", "weekday", "yesterday", F.dayofweek("date_ymd").alias("weekday_ord")
    )


@query
def prj_weekend(spark, sf_dir):
    return derive_columns(survey(spark, sf_dir), DATES).select("respondent_id", "weekday2", "yesterday2")


@query
def prj_occupation(spark, sf_dir):
    return _people(spark, sf_dir).select("respondent_id", "hcw", "keyworker", "occupation")


@query
def prj_bands(spark, sf_dir):
    return _people(spark, sf_dir).select("respondent_id", "age_years", "age", "age2", "age3", "age4")


@query
def prj_week_index(spark, sf_dir):
    people = derive_columns(_cases(spark, sf_dir), DATES).select("respondent_id", "date_ymd")
    return derive.add_week_index(people, "date_ymd", "Q1week")


@query
def prj_recode(spark, sf_dir):
    return _people(spark, sf_dir).select("respondent_id", "sex", "sex2", "isolation", "selfisolation_un")


@query
def prj_levels(spark, sf_dir):
    people = _people(spark, sf_dir).select("respondent_id", "occupation2", "selfisolation_un")
    people = derive.add_levels(people, "occupation2", K.OCCUPATION_LEVELS)
    return derive.add_levels(people, "selfisolation_un", K.ISOLATION_LEVELS)


@query
def prj_code_prefix(spark, sf_dir):
    return _people(spark, sf_dir).select(
        "respondent_id", "soc_code", "SOC2010Major", "SOC2010SubMajor", "SOC2010Minor"
    )


@query
def prj_log_scale(spark, sf_dir):
    people = _people(spark, sf_dir).selectExpr(
        "respondent_id",
        f"{log_scale(OUTCOME)} AS log_contacts",
        f"{log_scale(OUTCOME, plus_one=True)} AS log_contacts_1",
    )
    return _rounded(people)


# -- joins -----------------------------------------------------------------------


@query
def join_lookup(spark, sf_dir):
    people = survey(spark, sf_dir).select("respondent_id", F.col("soc_code").cast("string").alias("soc_code"))
    return summary.attach_lookup(people, soc_lookup(spark, sf_dir), "soc_code", ["soc_title"])


@query
def join_full(spark, sf_dir):
    cells = _counted(spark, sf_dir, ["household_size"])
    observed = frequency.prop_table(cells, "y", "Observed", "n").select(F.col("y").alias("x"), "Observed")
    size = frequency.prop_table(cells, "household_size", "Household", "n")
    size = size.select(F.col("household_size").alias("x"), "Household")
    return _rounded(distributions.align_distributions(observed, size))


@query
def join_groups(spark, sf_dir):
    """Titles of the major, sub-major and minor group of each respondent's code."""
    people = _people(spark, sf_dir).select("respondent_id", "SOC2010Major", "SOC2010SubMajor", "SOC2010Minor")
    for digits, group in enumerate(("SOC2010Major", "SOC2010SubMajor", "SOC2010Minor"), start=1):
        titles = soc_groups(spark, sf_dir, digits).toDF(group, f"{group}_title")
        people = summary.attach_lookup(people, titles, group, [f"{group}_title"])
    return people


# -- tables ----------------------------------------------------------------------


@query
def agg_tally(spark, sf_dir):
    return frequency.tally(_people(spark, sf_dir), ["SOC2010Major"])


@query
def agg_tally2(spark, sf_dir):
    return frequency.tally(_people(spark, sf_dir), ["age3", "children_in_house"])


@query
def agg_freq(spark, sf_dir):
    return _rounded(
        frequency.freq_table(_people(spark, sf_dir), "selfisolation_un", levels=K.ISOLATION_LEVELS)
    )


@query
def agg_freq_by(spark, sf_dir):
    return _rounded(frequency.freq_table(_people(spark, sf_dir), "had_covid", by=["generation"]))


@query
def agg_freq_multi(spark, sf_dir):
    return _rounded(frequency.freq_table(_cases(spark, sf_dir), QUESTIONS))


@query
def agg_freq_total(spark, sf_dir):
    return _rounded(frequency.freq_table(_people(spark, sf_dir), TOTALS))


@query
def agg_freq_week(spark, sf_dir):
    people = derive_columns(_cases(spark, sf_dir), DATES).select("date_ymd")
    return _rounded(frequency.freq_table(derive.add_week_index(people, "date_ymd", "Q1week"), "Q1week"))


@query
def agg_describe(spark, sf_dir):
    return _rounded(summary.describe(_people(spark, sf_dir), TOTALS))


@query
def agg_describe_by(spark, sf_dir):
    return _rounded(summary.describe(_people(spark, sf_dir), OUTCOME, by="age3"))


def _table(spark, sf_dir, table) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Whole numbers far apart, as hashes are.
SPARSE = "(l_orderkey * 8 + l_linenumber) * 2654435761 % 1000003 * 1000003"


@query
def agg_describe_price(spark, sf_dir):
    """A measured column, by group."""
    return _rounded(summary.describe(_table(spark, sf_dir, "lineitem"), "l_extendedprice", by="l_returnflag"), 4)


@query
def agg_describe_sparse(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_linestatus", f"{SPARSE} AS spread")
    return _rounded(summary.describe(rows, "spread", by="l_linestatus", stats=("median", "q25", "q75", "min", "max", "n")), 1)


@query
def agg_freq_dates(spark, sf_dir):
    """Running percentages over dates, one question, by group."""
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderpriority", "CAST(o_orderdate AS DATE) AS day")
    return _rounded(frequency.freq_table(rows, "day", by=["o_orderpriority"]))


@query
def agg_freq_names(spark, sf_dir):
    """Running percentages over names that all begin alike, each weighing its orders."""
    names = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"), "left")
    return _rounded(frequency.freq_table(names, "c_name"))


@query
def agg_freq_prices(spark, sf_dir):
    """Running percentages over a measured column."""
    return _rounded(frequency.freq_table(_table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query
def agg_describe_household(spark, sf_dir):
    return _rounded(summary.describe(_people(spark, sf_dir), TOTALS, by="household_size2"))


@query
def agg_brief_by(spark, sf_dir):
    return _rounded(
        summary.describe_by_each(_people(spark, sf_dir), TOTALS, ["age3", "sex", "occupation", "generation"])
    )


@query
def agg_mean_by(spark, sf_dir):
    return _rounded(summary.describe(_people(spark, sf_dir), OUTCOME, by="age2", stats=summary.MEAN))


@query
def agg_share_within(spark, sf_dir):
    return _rounded(summary.share(_people(spark, sf_dir), ["age3", "N_0to17yo"], within=["age3"]))


@query
def agg_share_total(spark, sf_dir):
    return _rounded(
        summary.share(
            _people(spark, sf_dir),
            ["children_in_house"],
            value=OUTCOME,
            stats=("mean", "sd", "median", "q25", "q75"),
        )
    )


@query
def agg_share_outcomes(spark, sf_dir):
    return _rounded(summary.share(_people(spark, sf_dir), ["children_in_house"], value=TOTALS, stats=("mean", "sd", "median")))


@query
def agg_profile_isolation(spark, sf_dir):
    return _rounded(summary.describe(_people(spark, sf_dir), TOTALS, by="selfisolation_un"))


@query
def agg_profile_hcw(spark, sf_dir):
    return _rounded(summary.describe(_people(spark, sf_dir), TOTALS, by="hcw"))


@query
def agg_profile_keyworker(spark, sf_dir):
    return _rounded(summary.describe(_people(spark, sf_dir), TOTALS, by="keyworker"))


@query
def agg_freq_filtered(spark, sf_dir):
    answered = filters.keep_label(_people(spark, sf_dir), "selfisolation_un", "UNK", negate=True)
    return _rounded(frequency.freq_table(answered, "selfisolation_un", levels=K.ISOLATION_LEVELS))


def _codebook(spark) -> DataFrame:
    """Labels and missing codes of two questions as a codebook table."""
    labels = {"sex": K.SEX_LABELS, "isolation": K.ISOLATION_LABELS}
    missing = {"sex": (), "isolation": K.ISOLATION_MISSING}
    rows = [
        (column, code, label, code in missing[column], place)
        for column, known in labels.items()
        for place, (code, label) in enumerate(known.items(), start=1)
    ]
    return spark.createDataFrame(rows, CODEBOOK_SCHEMA)


@query
def agg_freq_codebook(spark, sf_dir):
    codebook = _codebook(spark)
    cases = null_missing(_cases(spark, sf_dir), codebook)
    return _rounded(frequency.freq_table(cases, ["sex", "isolation"], codebook=codebook))


def _ordered_codebook(spark) -> DataFrame:
    """The same codebook with another order of the answers, which the stored codes do not have."""
    return _codebook(spark).withColumn("ord", F.expr("CASE code WHEN 3 THEN 1 WHEN 9 THEN 2 WHEN 1 THEN 3 ELSE 4 + code END").cast("int"))


@query
def agg_freq_codebook_order(spark, sf_dir):
    cases = null_missing(_cases(spark, sf_dir), _codebook(spark))
    table = frequency.freq_table(cases, ["sex", "isolation"], codebook=_ordered_codebook(spark), codebook_order=True)
    return _rounded(table)


@query
def prj_levels_codebook(spark, sf_dir):
    people = _people(spark, sf_dir).select("respondent_id", "selfisolation_un")
    return derive.add_codebook_levels(people, "selfisolation_un", _ordered_codebook(spark), "isolation")


@query
def prj_recode_codebook(spark, sf_dir):
    codebook = _codebook(spark)
    cases = null_missing(_cases(spark, sf_dir).select("respondent_id", "sex", "isolation"), codebook)
    cases = derive.recode_from_codebook(cases, "sex", codebook, "sex_label")
    return derive.recode_from_codebook(cases, "isolation", codebook, "isolation_label")


@query
def agg_date_summary(spark, sf_dir):
    return summary.date_summary(_people(spark, sf_dir), "date_ymd")


@query
def agg_topk(spark, sf_dir):
    people = _people(spark, sf_dir).select("occupation", F.col("soc_code").cast("string").alias("soc_code"))
    # Count by code first: the lookup then joins a few hundred rows, and a title may span codes.
    counted = people.groupBy("occupation", "soc_code").agg(F.count("*").alias("n"))
    titled = summary.attach_lookup(counted, soc_lookup(spark, sf_dir), "soc_code", ["soc_title"])
    return summary.top_categories(titled, "occupation", "soc_title", 5, weight="n")


@query
def agg_value_counts(spark, sf_dir):
    return frequency.value_counts(_people(spark, sf_dir), OUTCOME)


@query
def agg_dispersion(spark, sf_dir):
    return _rounded(summary.dispersion(_people(spark, sf_dir), OUTCOME))


@query
def agg_missing(spark, sf_dir):
    return filters.missing_profile(_cases(spark, sf_dir), CONTACTS, K.SENTINELS)


# -- mixing matrices -------------------------------------------------------------


@query
def mix_f2f(spark, sf_dir):
    return _rounded(
        mixing.mixing_matrix(_people(spark, sf_dir), "age3", K.FACE_TO_FACE, mixing.WITH_QUARTILES)
    )


@query
def mix_phys(spark, sf_dir):
    return _rounded(mixing.mixing_matrix(_people(spark, sf_dir), "age3", K.PHYSICAL))


@query
def mix_total(spark, sf_dir):
    return _rounded(mixing.mixing_matrix(_people(spark, sf_dir), "age3", K.TOTAL_BY_CONTACT))


# -- tables behind figures -------------------------------------------------------


@query
def plot_bubble(spark, sf_dir):
    return _rounded(
        summary.mean_by_value(_people(spark, sf_dir), "household_size", ["age_years"], "mean_household_size")
    )


@query
def plot_bubble2(spark, sf_dir):
    return _rounded(
        summary.mean_by_value(
            _people(spark, sf_dir), "household_size", ["age_years", "children_in_house"], "mean_household_size"
        )
    )


@query
def plot_hh_mean(spark, sf_dir):
    return _rounded(
        summary.mean_by_value(_people(spark, sf_dir), OUTCOME, ["household_size"], "mean_contacts")
    )


@query
def plot_hist_date(spark, sf_dir):
    return _rounded(plots.histogram(_people(spark, sf_dir), "date_ymd"))


@query
def plot_hist_by(spark, sf_dir):
    return _rounded(plots.histogram(_people(spark, sf_dir), "age_years", width=5, by=["sex2"]))


@query
def plot_hist_density(spark, sf_dir):
    return _rounded(plots.histogram(_people(spark, sf_dir), OUTCOME, width=2))


@query
def plot_hist_bins(spark, sf_dir):
    """A count in 30 bins over the range of all."""
    return _rounded(plots.histogram(_people(spark, sf_dir), "age_years", by=["sex2"], bins=30))


@query
def plot_hist_price(spark, sf_dir):
    """A measured column in 30 bins over the range of each group."""
    return _rounded(plots.histogram(_table(spark, sf_dir, "orders"), "o_totalprice", by=["o_orderpriority"], bins=30, shared=False))


@query
def plot_box_price(spark, sf_dir):
    return _rounded(plots.box_stats(_table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]), 4)


@query
def plot_box(spark, sf_dir):
    return _rounded(plots.box_stats(_people(spark, sf_dir), OUTCOME, ["age3", "children_in_house"]))


@query
def plot_box_log(spark, sf_dir):
    return _rounded(plots.box_stats(_people(spark, sf_dir), OUTCOME, ["household_size"], log=True, plus_one=True))


@query
def plot_overlap(spark, sf_dir):
    return plots.overlap_count(
        _people(spark, sf_dir), "total_face_to_face", "total_physical", "occupation", log_axes=True
    )


# -- closed-form models ----------------------------------------------------------


def _null(spark, sf_dir) -> oneway.OneWay:
    return oneway.fit_oneway(_people(spark, sf_dir), OUTCOME)


def _one_factor(spark, sf_dir, factor) -> oneway.OneWay:
    return oneway.fit_oneway(_people(spark, sf_dir), OUTCOME, {factor: K.MODEL_FACTORS[factor]})


@query
def mdl_table(spark, sf_dir):
    return model_table(_people(spark, sf_dir), OUTCOME, list(K.MODEL_FACTORS))


@query
def mdl_nb_null(spark, sf_dir):
    fit = _null(spark, sf_dir)
    summary_row = oneway.fit_summary(fit).select("term", "theta", "n", "loglik", "deviance", "aic")
    return _rounded(oneway.coefficients(fit).select("term", "estimate", "se").join(summary_row, "term").drop("term"))


@query
def mdl_theta_ci(spark, sf_dir):
    return _rounded(oneway.theta_interval(_null(spark, sf_dir)).drop("term"))


@query
def mdl_nb_prob(spark, sf_dir):
    return _rounded(oneway.size_and_probability(_null(spark, sf_dir)).select("size", "mu", "prob"))


def _register_factor(factor: str) -> None:
    def coefficients(spark, sf_dir):
        return _rounded(oneway.coefficients(_one_factor(spark, sf_dir, factor)).drop("term"))

    def ratios(spark, sf_dir):
        return _rounded(oneway.rate_ratios(_one_factor(spark, sf_dir, factor)).drop("term"))

    def test(spark, sf_dir):
        return _rounded(oneway.likelihood_ratio(_one_factor(spark, sf_dir, factor)))

    _queries[f"mdl_nb_uni_{factor}"] = coefficients
    _queries[f"mdl_irr_{factor}"] = ratios
    _queries[f"mdl_lrt_{factor}"] = test


for _factor in K.MODEL_FACTORS:
    _register_factor(_factor)


@query
def mdl_nb_uni(spark, sf_dir):
    """All one-factor models from one scan."""
    return _rounded(oneway.coefficients(oneway.fit_oneway(_people(spark, sf_dir), OUTCOME, K.MODEL_FACTORS)))


@query
def mdl_ols_uni(spark, sf_dir):
    return _rounded(linear.ols_oneway(_people(spark, sf_dir), OUTCOME, "age3", K.AGE3.labels))


# -- distributions ---------------------------------------------------------------


def _observed(cells: DataFrame) -> DataFrame:
    return frequency.prop_table(cells, "y", "Observed", "n").select(F.col("y").cast("int").alias("x"), "Observed")


@query
def dist_observed(spark, sf_dir):
    return _rounded(frequency.prop_table(_people(spark, sf_dir), OUTCOME))


@query
def dist_nb_null(spark, sf_dir):
    fit = _null(spark, sf_dir)
    return _rounded(oneway.distribution(fit, oneway.largest_outcome(fit)).select("x", "prob"))


@query
def dist_ols(spark, sf_dir):
    return _rounded(
        linear.ols_oneway_distribution(_people(spark, sf_dir), OUTCOME, "age3", K.AGE3.labels)
    )


@query
def dist_unpivot(spark, sf_dir):
    cells = _counted(spark, sf_dir, ["age3"])
    ols = linear.ols_oneway_distribution(cells, "y", "age3", K.AGE3.labels, "n")
    wide = distributions.zero_fill(distributions.align_distributions(_observed(cells), ols), ["Observed", "OLS"])
    return _rounded(distributions.unpivot_models(wide, "x", ["Observed", "OLS"]))


def _figure(observed: DataFrame, predictions: list[DataFrame], total) -> DataFrame:
    """The range and the models that the published figure shows."""
    return distributions.compare_distributions(observed, predictions, total, lo=0, hi=50, drop=("OLS",))


@query
def dist_compare(spark, sf_dir):
    cells = _counted(spark, sf_dir, ["age3"])
    ols = linear.ols_oneway_distribution(cells, "y", "age3", K.AGE3.labels, "n")
    fit = oneway.fit_oneway(cells, "y", weight="n")
    nb = oneway.distribution(fit, oneway.largest_outcome(fit), tail=False).select("x", F.col("prob").alias("NegBin"))
    total = F.lit(cells.agg(F.sum("n")).first()[0])
    return _rounded(_figure(_observed(cells), [ols, nb], total), 5)


@query
def dist_align_tail(spark, sf_dir):
    """Observed and predicted side by side, the tails of two predictions in one row."""
    cells = _counted(spark, sf_dir, ["age3"])
    fit = oneway.fit_oneway(cells, "y", weight="n")
    nb = [oneway.distribution(fit, top).select("x", F.col("prob").alias(label)) for top, label in ((9, "Short"), (14, "Long"))]
    return _rounded(distributions.align_distributions(_observed(cells), *nb))


@query
def dist_zero_null(spark, sf_dir):
    return _rounded(oneway.zero_counts(_null(spark, sf_dir)).drop("term"), 5)


# -- models on all factors -------------------------------------------------------


def _design(spark, sf_dir, set_aside_zero: bool = True):
    table = model_table(_people(spark, sf_dir), OUTCOME, list(K.MODEL_FACTORS))
    return build_design(table, K.MODEL_FACTORS, set_aside_zero)


def _nb(spark, sf_dir) -> Fit:
    return fit_nb(_design(spark, sf_dir))


def _zinb(spark, sf_dir) -> Fit:
    return fit_zinb(_design(spark, sf_dir))


def _coefficients(spark, fit: Fit) -> DataFrame:
    table = report.coef_table(spark, [fit]).select("term", "level", "estimate", "se", "z")
    return table.selectExpr("term", "level", "round(estimate, 6) AS estimate", "round(se, 6) AS se", "round(z, 5) AS z")


@query
def mdl_nb_coef(spark, sf_dir):
    return _coefficients(spark, _nb(spark, sf_dir))


@query
def mdl_nb_fit(spark, sf_dir):
    return _rounded(report.fit_table(spark, [_nb(spark, sf_dir)]).drop("model", "iterations"))


@query
def mdl_ols_coef(spark, sf_dir):
    return _coefficients(spark, fit_ols(_design(spark, sf_dir, False)))


@query
def mdl_zinb_coef(spark, sf_dir):
    fit = _zinb(spark, sf_dir)
    table = report.coef_table(spark, [fit]).withColumn("converged", F.lit(fit.converged))
    return table.selectExpr(
        "part", "term", "level", "round(estimate, 6) AS estimate", "round(se, 6) AS se", "round(z, 4) AS z", "converged"
    )


@query
def mdl_aic(spark, sf_dir):
    design = _design(spark, sf_dir)
    nb = fit_nb(design)
    ols = fit_ols(design if not design.all_zero else _design(spark, sf_dir, False))
    return _rounded(report.fit_table(spark, [ols, nb, fit_zinb(design, nb)]).drop("iterations"))


@query
def mdl_irr(spark, sf_dir):
    return _rounded(report.rate_ratio_table(spark, [_nb(spark, sf_dir)]).drop("model", "part", "p_value"))


@query
def mdl_irr_zinb(spark, sf_dir):
    table = report.rate_ratio_table(spark, [_zinb(spark, sf_dir)]).drop("model", "p_value", "deviance")
    bounds = {c: F.round(c, 5) for c in ("conf_low", "conf_high")}
    return _rounded(table.withColumns(bounds))


@query
def mdl_lrt(spark, sf_dir):
    return _rounded(report.drop_one_lrt(spark, _nb(spark, sf_dir)).drop("p_value"), 5)


@query
def mdl_lrt_poisson(spark, sf_dir):
    """The test where the outcome, any contact or none, is not over-dispersed."""
    people = _people(spark, sf_dir).withColumn(OUTCOME, F.expr(f"least({OUTCOME}, 1)"))
    factors = {"age3": K.MODEL_FACTORS["age3"]}
    fit = fit_nb(build_design(model_table(people, OUTCOME, list(factors)), factors))
    return _rounded(report.drop_one_lrt(spark, fit).drop("p_value").withColumn("model", F.lit(fit.model)), 5)


@query
def mdl_lrt_pvalue(spark, sf_dir):
    return _rounded(report.drop_one_lrt(spark, _nb(spark, sf_dir)).select("term", "df", "p_value"), 7)


# An outcome that is 0 for everyone of one occupation: the limit that such a level is reported at.


def _all_zero(spark, sf_dir) -> Fit:
    people = _people(spark, sf_dir).withColumn(OUTCOME, F.expr(f"CASE WHEN occupation2 = 'HCW' THEN 0 ELSE {OUTCOME} END"))
    return fit_nb(build_design(model_table(people, OUTCOME, list(K.MODEL_FACTORS)), K.MODEL_FACTORS))


@query
def mdl_lrt_allzero(spark, sf_dir):
    # Four digits: the other engine reaches the level's limit in steps and stops just short of it.
    return _rounded(report.drop_one_lrt(spark, _all_zero(spark, sf_dir)).drop("p_value"), 4)


@query
def dist_nb_allzero(spark, sf_dir):
    return _distribution(_all_zero(spark, sf_dir))


@query
def dist_zero_allzero(spark, sf_dir):
    return _rounded(report.zero_count_table([_all_zero(spark, sf_dir)]), 5)


# Zeros of one occupation so rare that the count part explains them: a zero part at its limit.


def _rare_zeros(spark, sf_dir) -> Fit:
    rare = f"CASE WHEN occupation2 = 'HCW' AND {OUTCOME} = 0 AND respondent_id % 16 <> 0 THEN 1 ELSE {OUTCOME} END"
    people = _people(spark, sf_dir).withColumn(OUTCOME, F.expr(rare))
    return fit_zinb(build_design(model_table(people, OUTCOME, list(K.MODEL_FACTORS)), K.MODEL_FACTORS))


@query
def mdl_zinb_limit(spark, sf_dir):
    # Five digits: the other engine reaches the limit in steps.
    table = report.coef_table(spark, [_rare_zeros(spark, sf_dir)])
    return table.selectExpr("part", "term", "level", "round(estimate, 5) AS estimate", "round(se, 5) AS se")


@query
def dist_zero_limit(spark, sf_dir):
    return _rounded(report.zero_count_table([_rare_zeros(spark, sf_dir)]), 4)


# One factor of some 400 levels beside another: levels in a table, not on the driver.


def _large(spark, sf_dir, set_aside_zero: bool):
    return large.large_design(_people(spark, sf_dir), OUTCOME, {"sex2": K.MODEL_FACTORS["sex2"]}, "soc_code", set_aside_zero)


def _large_figures(spark, fit) -> DataFrame:
    levels = large.with_zero_levels(fit).selectExpr("'soc_code' AS term", "CAST(level AS STRING) AS level", "estimate", "se")
    return _rounded(fit.coefficients(spark).unionByName(levels))


@query
def mdl_large_nb(spark, sf_dir):
    return _large_figures(spark, large.fit_nb_large(_large(spark, sf_dir, True)))


@query
def mdl_large_ols(spark, sf_dir):
    return _large_figures(spark, large.fit_ols_large(_large(spark, sf_dir, False)))


@query
def mdl_theta_ci_multi(spark, sf_dir):
    return _rounded(report.theta_interval_table(spark, [_nb(spark, sf_dir)]).drop("model"))


def _distribution(fit: Fit) -> DataFrame:
    return _rounded(report.predicted_distribution(fit, report.largest_outcome(fit)))


@query
def dist_nb(spark, sf_dir):
    return _distribution(_nb(spark, sf_dir))


@query
def dist_zinb(spark, sf_dir):
    return _distribution(_zinb(spark, sf_dir))


@query
def dist_ols_multi(spark, sf_dir):
    return _rounded(report.ols_distribution(fit_ols(_design(spark, sf_dir, False))))


@query
def dist_zero(spark, sf_dir):
    nb = _nb(spark, sf_dir)
    return _rounded(report.zero_count_table([nb, fit_zinb(nb.design, nb)]), 5)


@query
def dist_compare_multi(spark, sf_dir):
    factors = list(K.MODEL_FACTORS)
    cells = _counted(spark, sf_dir, factors)
    design = build_design(model_table(cells, "y", factors, weight="n"), K.MODEL_FACTORS)
    linear_design = design
    if design.all_zero:
        linear_design = build_design(model_table(cells, "y", factors, weight="n"), K.MODEL_FACTORS, False)
    nb = fit_nb(design)
    top = report.largest_outcome(nb)
    predictions = [
        report.ols_distribution(fit_ols(linear_design)),
        report.predicted_distribution(nb, top, "NegBin", tail=False),
        report.predicted_distribution(fit_zinb(design, nb), top, "Zinb", tail=False),
    ]
    total = F.lit(cells.agg(F.sum("n")).first()[0])
    compared = _figure(_observed(cells), predictions, total)
    return compared.selectExpr("x", "Model", "round(prob, 5) AS prob", "round(n, 4) AS n")
