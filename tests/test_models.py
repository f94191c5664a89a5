import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headcount.functions import codes as K
from headcount.models import linear, oneway, report
from headcount.models.fit import NotConverged, fit_nb, fit_ols, fit_poisson, fit_zinb, pair_sums
from headcount.models.table import INTERCEPT, build_design, model_table
from headcount.plans.clean import clean
from headcount.sources import survey

FACTORS = {"a": ("x", "y", "z"), "b": ("no", "yes")}


def draw(seed=3, n=4000, theta=1.5, zero=0.0, effect=0.5):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 3, n), rng.integers(0, 2, n)
    mu = np.exp(0.8 + 0.3 * (a == 1) - 0.4 * (a == 2) + effect * b)
    y = rng.negative_binomial(theta, theta / (theta + mu)) if theta else rng.poisson(mu)
    y = np.where(rng.random(n) < zero, 0, y)
    return a, b, y


def frame(spark, a, b, y):
    rows = [(FACTORS["a"][i], FACTORS["b"][j], int(v)) for i, j, v in zip(a, b, y)]
    return spark.createDataFrame(rows, "a string, b string, y int")


def matrix(a, b):
    return np.column_stack([np.ones(len(a)), a == 1, a == 2, b == 1]).astype(float)


def nb_loglik(x, y, beta, theta):
    mu = np.exp(x @ beta)
    lg = np.vectorize(math.lgamma)
    return np.sum(
        lg(y + theta) - math.lgamma(theta) - lg(y + 1.0) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu))
    )


def zinb_loglik(x, y, params):
    p = x.shape[1]
    mu, theta = np.exp(x @ params[:p]), math.exp(params[-1])
    pi = 1 / (1 + np.exp(-x @ params[p : 2 * p]))
    lg = np.vectorize(math.lgamma)
    log_f = (
        lg(y + theta) - math.lgamma(theta) - lg(y + 1.0) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu))
    )
    return np.sum(np.where(y == 0, np.log(pi + (1 - pi) * np.exp(log_f)), np.log(1 - pi) + log_f))


def slope(f, x, h=1e-5):
    out = np.zeros(len(x))
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = h
        out[i] = (f(x + e) - f(x - e)) / (2 * h)
    return out


@pytest.fixture(scope="module")
def sample():
    return draw()


@pytest.fixture(scope="module")
def design(spark, sample):
    return build_design(model_table(frame(spark, *sample), "y", list(FACTORS)), FACTORS)


@pytest.fixture(scope="module")
def nb(design):
    return fit_nb(design)


def test_design_terms_and_reference(design):
    assert design.terms == [(INTERCEPT, ""), ("a", "y"), ("a", "z"), ("b", "yes")]
    assert design.reference == {"a": "x", "b": "no"}


def test_pair_sums_equal_the_dense_cross_product(design, sample):
    a, b, y = sample
    x = matrix(a, b)
    sums = pair_sums(
        design, design.fitted, {"xx": "n"}, {"xy": "s"}, {"n0": "n0"}, {"yy": "n * y * y"}, theta=1.0
    )
    assert np.array_equal(sums["xx"], x.T @ x)
    assert np.allclose(sums["xy"], x.T @ y, rtol=1e-13) and sums["yy"] == pytest.approx(np.sum(y * y))


def test_nb_is_a_stationary_maximum(nb, sample):
    a, b, y = sample
    x = matrix(a, b)
    assert nb.converged
    assert nb.loglik == pytest.approx(nb_loglik(x, y, nb.beta, nb.theta), rel=1e-10)
    gradient = slope(lambda v: nb_loglik(x, y, v[:-1], math.exp(v[-1])), np.append(nb.beta, math.log(nb.theta)))
    assert np.max(np.abs(gradient)) < 1e-3


def test_nb_standard_errors_use_expected_information(nb, sample):
    a, b, _ = sample
    x = matrix(a, b)
    mu = np.exp(x @ nb.beta)
    info = x.T @ (x * (mu / (1 + mu / nb.theta))[:, None])
    assert np.allclose(nb.vcov, np.linalg.inv(info), rtol=1e-8)


def test_nb_recovers_planted_effects(nb):
    truth = np.array([0.8, 0.3, -0.4, 0.5])
    assert np.all(np.abs(nb.beta - truth) < 4 * np.sqrt(np.diag(nb.vcov)))
    assert abs(nb.theta - 1.5) < 4 * nb.se_theta


def test_result_does_not_depend_on_partitioning(spark, sample, nb):
    df = frame(spark, *sample).repartition(13, "y")
    again = fit_nb(build_design(model_table(df, "y", list(FACTORS)), FACTORS))
    assert np.allclose(again.beta, nb.beta, atol=1e-9) and again.theta == pytest.approx(nb.theta, rel=1e-9)


def test_raw_rows_and_cells_give_the_same_fit(spark, sample, nb):
    rows = frame(spark, *sample).selectExpr("a", "b", "CAST(y AS BIGINT) AS y", "1L AS n")
    again = fit_nb(build_design(rows, FACTORS))
    assert np.allclose(again.beta, nb.beta, atol=1e-9)


def test_rows_with_unknown_values_are_dropped(spark, sample, nb):
    extra = spark.createDataFrame([(None, "yes", 900), ("x", None, 900), ("x", "no", None)], "a string, b string, y int")
    table = model_table(frame(spark, *sample).union(extra), "y", list(FACTORS))
    assert np.allclose(fit_nb(build_design(table, FACTORS)).beta, nb.beta, atol=1e-9)


def test_one_factor_closed_form_equals_the_general_fit(spark, sample):
    df = frame(spark, *sample)
    closed = oneway.fit_oneway(df, "y", {"a": FACTORS["a"]})
    general = fit_nb(build_design(model_table(df, "y", ["a"]), {"a": FACTORS["a"]}))
    rows = {r.level: r for r in oneway.coefficients(closed).collect()}
    expected = [rows[INTERCEPT], rows["y"], rows["z"]]
    assert [r.estimate for r in expected] == pytest.approx(list(general.beta), abs=1e-9)
    assert [r.se for r in expected] == pytest.approx(list(np.sqrt(np.diag(general.vcov))), abs=1e-9)
    assert closed.theta["a"] == pytest.approx(general.theta, rel=1e-9)
    assert closed.se_theta["a"] == pytest.approx(general.se_theta, rel=1e-7)
    s = oneway.fit_summary(closed).first()
    assert (s.loglik, s.deviance, s.aic) == pytest.approx((general.loglik, general.deviance, general.aic), rel=1e-11)


def test_one_factor_test_equals_the_refit(spark, sample):
    df = frame(spark, *sample)
    closed = oneway.likelihood_ratio(oneway.fit_oneway(df, "y", {"a": FACTORS["a"]})).first()
    general = fit_nb(build_design(model_table(df, "y", ["a"]), {"a": FACTORS["a"]}))
    refit = report.drop_one_lrt(spark, general).filter("term = 'a'").first()
    assert (closed.df, closed.statistic) == (refit.df, pytest.approx(refit.statistic, abs=1e-6))


def test_fitting_several_factors_together_changes_nothing(spark, sample):
    df = frame(spark, *sample)
    together = oneway.fit_oneway(df, "y", FACTORS)
    for f, levels in FACTORS.items():
        assert together.theta[f] == pytest.approx(oneway.fit_oneway(df, "y", {f: levels}).theta[f], rel=1e-11)


def test_counts_without_over_dispersion_are_a_poisson_model(spark):
    a, b, _ = draw()
    y = np.arange(len(a)) % 2
    df = frame(spark, a, b, y)
    d = build_design(model_table(df, "y", list(FACTORS)), FACTORS)
    fit = fit_nb(d)
    assert fit.model == "Poisson" and fit.converged and fit.theta is None and fit.n_parameters == d.p
    mu = np.exp(matrix(a, b) @ fit.beta)
    assert fit.loglik == pytest.approx(np.sum(y * np.log(mu) - mu), rel=1e-10)
    assert fit.deviance == pytest.approx(2 * np.sum(np.where(y > 0, -np.log(mu), 0) - (y - mu)), rel=1e-9)
    probs = {r.x: r.prob for r in report.predicted_distribution(fit, 3).collect()}
    assert probs[1] == pytest.approx(np.mean(mu * np.exp(-mu))) and sum(probs.values()) == pytest.approx(1)
    assert {r.term: r.df for r in report.drop_one_lrt(spark, fit).collect()} == {"<none>": None, "a": 2, "b": 1}
    null = oneway.fit_oneway(df, "y")
    row = oneway.fit_summary(null).first()
    assert row.model == "Poisson" and row.theta is None
    assert row.aic == pytest.approx(2 - 2 * np.sum(y * np.log(y.mean()) - y.mean()))
    assert sum(r.prob for r in oneway.distribution(null, 4).collect()) == pytest.approx(1)


def test_large_theta_equals_poisson_regression(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    a, b, y = draw(theta=None)
    df = frame(spark, a, b, y)
    fit = fit_poisson(build_design(model_table(df, "y", list(FACTORS)), FACTORS))
    dummies = df.selectExpr("y", "double(a = 'y') AS ay", "double(a = 'z') AS az", "double(b = 'yes') AS byes")
    data = VectorAssembler(inputCols=["ay", "az", "byes"], outputCol="features").transform(dummies)
    glm = GeneralizedLinearRegression(family="poisson", labelCol="y", tol=1e-12, maxIter=100).fit(data)
    assert [glm.intercept, *glm.coefficients] == pytest.approx(list(fit.beta), abs=1e-6)


def test_level_that_is_always_zero(spark):
    a, b, y = draw()
    y = np.where(a == 2, 0, y)
    df = frame(spark, a, b, y)
    d = build_design(model_table(df, "y", list(FACTORS)), FACTORS)
    assert d.all_zero == [("a", "z")]
    fit = fit_nb(d)
    kept = a != 2
    alone = fit_nb(build_design(model_table(frame(spark, a[kept], b[kept], y[kept]), "y", list(FACTORS)), FACTORS))
    assert np.allclose(fit.beta, alone.beta, atol=1e-9)
    table = {(r.term, r.level): r.estimate for r in report.coef_table(spark, [fit]).collect()}
    assert table["a", "z"] is None
    # Without the factor its rows count again.
    lrt = {r.term: r for r in report.drop_one_lrt(spark, fit).collect()}
    assert lrt["a"].statistic > 100 and lrt["a"].df == 2
    one_factor = oneway.likelihood_ratio(oneway.fit_oneway(df, "y", {"a": FACTORS["a"]})).first()
    assert one_factor.df == lrt["a"].df
    # And they are people of whom nobody is expected to have any.
    zeros = {r.model: r.zeros for r in report.zero_count_table([fit]).collect()}
    assert zeros["Observed"] == np.sum(y == 0) and zeros["NB"] > np.sum(a == 2)
    probs = {r.x: r.prob for r in report.predicted_distribution(fit, 20).collect()}
    assert probs[0] > np.mean(a == 2) and sum(probs.values()) == pytest.approx(1) and probs[None] < 0.05
    one = {r.level: r for r in oneway.coefficients(oneway.fit_oneway(df, "y", {"a": FACTORS["a"]})).collect()}
    assert one["z"].estimate is None and one["z"].se is None


def test_collinear_factors_are_named(spark, sample):
    a, b, y = sample
    df = frame(spark, a, b, y).withColumn("c", F.expr("CASE WHEN b = 'no' THEN 'p' ELSE 'q' END"))
    factors = {**FACTORS, "c": ("p", "q")}
    d = build_design(model_table(df, "y", list(factors)), factors)
    assert d.aliased == [("c", "q")]
    fit = fit_nb(d)
    assert fit.loglik == pytest.approx(fit_nb(build_design(model_table(df, "y", list(FACTORS)), FACTORS)).loglik)
    assert {(r.term, r.level): r.estimate for r in report.coef_table(spark, [fit]).collect()}["c", "q"] is None
    with pytest.raises(ValueError):
        report.drop_one_lrt(spark, fit)


def test_a_fit_that_does_not_settle_raises(design):
    with pytest.raises(NotConverged):
        fit_nb(design, max_iter=2)
    assert not fit_nb(design, max_iter=2, allow_unconverged=True).converged
    with pytest.raises(NotConverged):
        fit_zinb(design, max_iter=1)


def test_a_step_that_lowers_the_likelihood_is_not_taken(design, nb, monkeypatch):
    from headcount.models import fit as module

    solve = np.linalg.solve
    monkeypatch.setattr(module.np.linalg, "solve", lambda m, v: -solve(m, v))
    got = fit_nb(design, theta=nb.theta, start=nb.beta + 0.1, allow_unconverged=True)
    assert not got.converged and np.array_equal(got.beta, nb.beta + 0.1)


def test_levels_without_zeros_have_no_structural_zeros(spark):
    a, b, y = draw(seed=5, n=3000, zero=0.3)
    y = np.where((a == 1) & (y == 0), 1, y)
    d = build_design(model_table(frame(spark, a, b, y), "y", list(FACTORS)), FACTORS)
    assert d.no_zeros == [("a", "y")]
    fit = fit_zinb(d)
    assert fit.converged and fit.iterations < 20
    table = {(r.part, r.term, r.level): r.estimate for r in report.coef_table(spark, [fit]).collect()}
    assert table["zero", "a", "y"] is None and table["count", "a", "y"] is not None


def test_each_pass_is_one_shuffle(design, nb):
    from headcount.models.fit import OBSERVED, _with_mean

    seen = []
    rows = _with_mean(design.fitted, design.linear(nb.beta), nb.theta)
    collect = type(rows).collect
    type(rows).collect = lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), collect(df))[1]
    try:
        pair_sums(design, rows, pair={"observed": OBSERVED})
    finally:
        type(rows).collect = collect
    assert seen[0].count("Exchange hashpartitioning") == 1
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInArrow"):
        assert word not in seen[0]


def test_all_zero_outcome_is_refused(spark):
    df = spark.createDataFrame([("x", "no", 0), ("y", "yes", 0)], "a string, b string, y int")
    with pytest.raises(ValueError):
        build_design(model_table(df, "y", list(FACTORS)), FACTORS)


def test_unlisted_level_is_refused(spark):
    df = spark.createDataFrame([("x", "no", 1), ("w", "yes", 2)], "a string, b string, y int")
    with pytest.raises(ValueError):
        build_design(model_table(df, "y", list(FACTORS)), FACTORS)


def test_ols_against_least_squares(spark, sample):
    a, b, y = sample
    x = matrix(a, b)
    fit = fit_ols(build_design(model_table(frame(spark, a, b, y), "y", list(FACTORS)), FACTORS, False))
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    n, p = x.shape
    assert np.allclose(fit.beta, beta, atol=1e-10)
    assert fit.deviance == pytest.approx(rss[0], rel=1e-10)
    assert np.allclose(fit.vcov, rss[0] / (n - p) * np.linalg.inv(x.T @ x), rtol=1e-8)
    sigma2 = rss[0] / n
    assert fit.aic == pytest.approx(n * (math.log(2 * math.pi * sigma2) + 1) + 2 * (p + 1), rel=1e-12)


def test_ols_one_factor_equals_the_general_fit(spark, sample):
    df = frame(spark, *sample)
    rows = {r.level: r for r in linear.ols_oneway(df, "y", "a", FACTORS["a"]).collect()}
    fit = fit_ols(build_design(model_table(df, "y", ["a"]), {"a": FACTORS["a"]}, False))
    assert [rows[k].estimate for k in (INTERCEPT, "y", "z")] == pytest.approx(list(fit.beta), abs=1e-10)
    assert [rows[k].se for k in (INTERCEPT, "y", "z")] == pytest.approx(list(np.sqrt(np.diag(fit.vcov))), rel=1e-8)


def test_ols_totals_match_in_every_level(spark, sample, design):
    fit = fit_ols(design)
    d = design.patterns.selectExpr("*", f"{design.linear(fit.beta)} AS f")
    for c in design.index.values():
        for r in d.groupBy(c).agg(F.expr("sum(s) AS a"), F.expr("sum(n * f) AS b")).collect():
            assert r.a == pytest.approx(r.b, rel=1e-9)


def test_zinb_is_a_stationary_maximum(spark):
    a, b, y = draw(seed=11, n=6000, theta=2.0, zero=0.25)
    x = matrix(a, b)
    d = build_design(model_table(frame(spark, a, b, y), "y", list(FACTORS)), FACTORS)
    nb = fit_nb(d)
    fit = fit_zinb(d, nb)
    params = np.concatenate([fit.beta, fit.zero, [math.log(fit.theta)]])
    assert fit.converged and fit.loglik > nb.loglik
    assert fit.loglik == pytest.approx(zinb_loglik(x, y, params), rel=1e-10)
    f = lambda v: zinb_loglik(x, y, v)
    assert np.max(np.abs(slope(f, params))) < 0.02
    curvature = np.array([slope(lambda v, i=i: slope(f, v, 1e-4)[i], params, 1e-3) for i in range(len(params))])
    se = np.sqrt(np.diag(np.linalg.inv(-curvature)))
    p = len(fit.beta)
    assert np.sqrt(np.diag(fit.vcov)) == pytest.approx(se[:p], rel=0.01)
    assert np.sqrt(np.diag(fit.zero_vcov)) == pytest.approx(se[p : 2 * p], rel=0.01)
    assert fit.se_theta == pytest.approx(fit.theta * se[-1], rel=0.01)
    zeros = {r.model: r.zeros for r in report.zero_count_table([nb, fit]).collect()}
    assert zeros["Observed"] == np.sum(y == 0)
    assert abs(zeros["ZINB"] - zeros["Observed"]) < abs(zeros["NB"] - zeros["Observed"])
    probs = report.predicted_distribution(fit, 400, tail=False).agg(F.sum("prob")).first()[0]
    assert probs == pytest.approx(1, abs=1e-9)


def best_with_closed(x, y, shut, start):
    """Highest likelihood with no structural zeros where ``shut``, by a plain quasi-Newton climb."""
    p = x.shape[1]

    def f(v):
        mu, theta = np.exp(x @ v[:p]), math.exp(v[-1])
        pi = np.where(shut, 0.0, 1 / (1 + np.exp(-(x @ v[p : 2 * p]))))
        zero = theta * np.log(theta / (theta + mu))
        pmf = np.array([math.lgamma(k + theta) - math.lgamma(theta) - math.lgamma(k + 1) for k in y]) + zero + y * np.log(mu / (theta + mu))
        return np.sum(np.where(y == 0, np.log(pi + (1 - pi) * np.exp(zero)), np.log1p(-pi) + pmf))

    v, h = start.copy(), np.eye(len(start)) * 1e-3
    value, g = f(v), slope(f, start, 1e-5)
    for _ in range(200):
        move, scale = h @ g, 1.0
        while f(v + scale * move) < value and scale > 1e-9:
            scale /= 2
        if scale <= 1e-9:
            break
        new = v + scale * move
        g2 = slope(f, new, 1e-5)
        s, d = new - v, g - g2
        if s @ d > 1e-14:
            rho, eye = 1 / (s @ d), np.eye(len(v))
            h = (eye - rho * np.outer(s, d)) @ h @ (eye - rho * np.outer(d, s)) + rho * np.outer(s, s)
        gain, v, value, g = f(new) - value, new, f(new), g2
        if gain < 1e-9:
            break
    return value


@pytest.mark.parametrize("level, code", [("z", 2), ("x", 0)])
def test_zinb_names_a_level_whose_zeros_the_count_part_explains(spark, level, code):
    """A level with fewer zeros than the count part expects, among others with many; a reference too."""
    a, b, y = draw(seed=21, n=3000, theta=2.0, zero=0.3)
    few = (a == code) & (y == 0)
    y = np.where(few & (np.arange(len(y)) % 10 != 0), 1, y)
    df = frame(spark, a, b, y)
    d = build_design(model_table(df, "y", list(FACTORS)), FACTORS)
    fit = fit_zinb(d)
    assert fit.converged and fit.closed == [("a", level)] and d.no_zeros == []
    x = matrix(a, b)
    p = x.shape[1]
    start = np.concatenate([fit.beta, fit.zero, [math.log(fit.theta)]])
    shut = a == code
    assert fit.loglik == pytest.approx(best_with_closed(x, y, shut, start), abs=1e-5)
    assert fit.loglik > fit_nb(d).loglik
    # No likelihood with structural zeros in that level is higher.
    for low in (-4.0, -8.0):
        open_ = start.copy()
        if code:
            open_[p + code] = low
        else:
            open_[p] += low
            open_[p + 1 : p + 3] -= low
        assert zinb_loglik(x, y, open_) < fit.loglik
    table = {(r.part, r.term, r.level): r for r in report.coef_table(spark, [fit]).collect()}
    assert table["zero", "a", level].estimate is None
    ratios = {(r.term, r.level): r for r in report.rate_ratio_table(spark, [fit]).collect() if r.part == "zero"}
    assert ratios["a", level].ratio == 0.0 and sum(r.reference for r in ratios.values()) == 2
    assert ratios["a", "x" if code else "y"].reference
    assert report.patterns(fit).filter("pi = 0").count() == 2
    zeros = {r.model: r.zeros for r in report.zero_count_table([fit]).collect()}
    assert zeros["Observed"] == np.sum(y == 0) < zeros["ZINB"]


def test_zinb_climbs_by_complete_data_where_newton_does_not(spark, monkeypatch):
    """With Newton's directions turned downhill, only steps of the EM kind are left; none lowers the likelihood."""
    from headcount.models import fit as module

    a, b, y = draw(seed=11, n=3000, theta=2.0, zero=0.25)
    d = build_design(model_table(frame(spark, a, b, y), "y", list(FACTORS)), FACTORS)
    nb = fit_nb(d)
    ascent, calls = module._ascent, []
    monkeypatch.setattr(module, "MAX_HALVINGS", 3)
    monkeypatch.setattr(module, "_ascent", lambda h, g: (calls.append(0), ascent(h, g) * (-1 if len(calls) % 2 else 1))[1])
    first = fit_zinb(d, nb, max_iter=1, tol=-1e300, allow_unconverged=True)
    second = fit_zinb(d, nb, max_iter=3, tol=-1e300, allow_unconverged=True)
    assert nb.loglik < second.loglik and first.loglik < second.loglik


def test_zinb_of_the_small_survey_settles(spark, sf_dir):
    from headcount.plans import registry

    d = registry._design(spark, sf_dir)
    nb = fit_nb(d)
    fit = fit_zinb(d, nb)
    assert fit.converged and fit.loglik > nb.loglik
    assert set(fit.closed) == {("household_size2", "2"), ("selfisolation_un", "Yes, but have stopped")}


def test_zinb_without_any_inflation_is_the_negative_binomial(spark):
    a, b, y = draw(seed=4, n=4000, theta=1.5, zero=0.0)
    y = np.where((y == 0) & (np.arange(len(y)) % 5 != 0), 1, y)  # far fewer zeros than the model expects
    d = build_design(model_table(frame(spark, a, b, y), "y", list(FACTORS)), FACTORS)
    nb = fit_nb(d)
    fit = fit_zinb(d, nb)
    assert fit.converged and len(fit.closed) == 5 and fit.loglik == pytest.approx(nb.loglik, abs=1e-7)
    assert np.allclose(fit.beta, nb.beta, atol=1e-6) and fit.theta == pytest.approx(nb.theta, rel=1e-6)
    assert {r.estimate for r in report.coef_table(spark, [fit]).collect() if r.part == "zero"} == {None}
    assert report.patterns(fit).agg(F.max("pi")).first()[0] == 0
    assert np.allclose(np.sqrt(np.diag(fit.vcov)), np.sqrt(np.diag(nb.vcov)), rtol=0.2)


def test_lrt_of_a_poisson_fit(spark):
    """Each factor left out, against Poisson regressions by Newton's method in numpy."""
    a, b, _ = draw(seed=9, n=1500)
    x = matrix(a, b)
    pick = np.random.default_rng(9)
    y = pick.binomial(3, np.array([0.3, 0.45, 0.6])[a] * (0.8 + 0.2 * b))
    fit = fit_nb(build_design(model_table(frame(spark, a, b, y), "y", list(FACTORS)), FACTORS))
    assert fit.model == "Poisson"

    def deviance(x):
        beta = np.zeros(x.shape[1])
        beta[0] = np.log(y.mean())
        for _ in range(50):
            mu = np.exp(x @ beta)
            beta = beta + np.linalg.solve(x.T @ (mu[:, None] * x), x.T @ (y - mu))
        mu = np.exp(x @ beta)
        return 2 * np.sum(np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0) - (y - mu))

    rows = {r.term: r for r in report.drop_one_lrt(spark, fit).collect()}
    whole = deviance(x)
    assert rows["<none>"].deviance == pytest.approx(whole, rel=1e-8)
    for term, columns in (("a", [0, 3]), ("b", [0, 1, 2])):
        assert rows[term].deviance == pytest.approx(deviance(x[:, columns]), rel=1e-8)
        assert rows[term].statistic == pytest.approx(deviance(x[:, columns]) - whole, rel=1e-6)


def test_zinb_is_never_below_nb(nb, design):
    fit = fit_zinb(design, nb)
    assert fit.loglik >= nb.loglik - 1e-6


def test_more_terms_never_lower_the_likelihood(spark, sample, nb):
    df = frame(spark, *sample)
    small = fit_nb(build_design(model_table(df, "y", ["a"]), {"a": FACTORS["a"]}))
    assert nb.loglik >= small.loglik


def test_predicted_distribution_against_brute_force(spark, nb, sample):
    a, b, _ = sample
    mu, theta = np.exp(matrix(a, b) @ nb.beta), nb.theta
    got = {r.x: r.prob for r in report.predicted_distribution(nb, 5).collect()}
    for k in range(6):
        log_p = (
            math.lgamma(k + theta) - math.lgamma(theta) - math.lgamma(k + 1)
            + theta * np.log(theta / (theta + mu)) + k * np.log(mu / (theta + mu))
        )
        assert got[k] == pytest.approx(np.mean(np.exp(log_p)), rel=1e-9)


def test_no_row_is_made_for_a_pattern_and_an_outcome(nb):
    out = report.predicted_distribution(nb, 40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_a_million_outcomes_cost_what_the_likely_ones_do(spark, nb):
    out = report.predicted_distribution(nb, 1_000_000)
    count, total, last = out.agg(F.count("*"), F.sum("prob"), F.max("x")).first()
    assert (count, last) == (1_000_002, 1_000_000) and total == pytest.approx(1, abs=1e-12)
    few = {r.x: r.prob for r in report.predicted_distribution(nb, 60).collect()}
    many = {r.x: r.prob for r in out.filter("x <= 60").collect()}
    assert all(many[x] == pytest.approx(p, rel=1e-12) for x, p in few.items() if x is not None)


@pytest.mark.parametrize("mu, theta", [(0.5, None), (40.0, None), (3.0, 1.5), (200.0, 0.2), (5.0, 80.0), (0.0, 1.0)])
def test_the_tail_beyond_the_last_outcome_is_lost_in_rounding(mu, theta):
    last = report.last_outcome(mu, theta, 10**7)
    assert report.last_outcome(mu, theta, 3) <= 3
    if not mu:
        assert last == 0
        return

    def log_pmf(k):
        if theta is None:
            return -mu + k * math.log(mu) - math.lgamma(k + 1)
        return math.lgamma(k + theta) - math.lgamma(theta) - math.lgamma(k + 1) + theta * math.log(theta / (theta + mu)) + k * math.log(mu / (theta + mu))

    rest = sum(math.exp(log_pmf(k)) for k in range(last + 1, last + 4000))
    assert rest < 1e-17 and sum(math.exp(log_pmf(k)) for k in range(last + 1)) == pytest.approx(1, abs=1e-9)


def test_null_distribution_sums_to_one(spark, sample):
    fit = oneway.fit_oneway(frame(spark, *sample), "y")
    assert oneway.distribution(fit, 500, tail=False).agg(F.sum("prob")).first()[0] == pytest.approx(1, abs=1e-9)


def test_planted_effect_in_the_survey(spark, sf_dir):
    people = clean(survey(spark, sf_dir)).selectExpr(
        "occupation2", "sex2", "total_contacts + CASE WHEN occupation2 = 'HCW' THEN 2 ELSE 0 END AS y"
    )
    factors = {f: K.MODEL_FACTORS[f] for f in ("occupation2", "sex2")}
    fit = fit_nb(build_design(model_table(people, "y", list(factors)), factors))
    rows = {(r.term, r.level): r for r in report.coef_table(spark, [fit]).collect()}
    assert rows["occupation2", "HCW"].p_value < 1e-4
    assert rows["occupation2", "HCW"].estimate > 0.2
    assert rows["occupation2", "Keyworker"].p_value > 0.01
    lrt = {r.term: r for r in report.drop_one_lrt(spark, fit).collect()}
    assert lrt["occupation2"].p_value < 1e-4 < lrt["sex2"].p_value


@pytest.mark.parametrize(
    "x, df, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (15.08627246938899, 5, 0.01), (0, 3, 1.0)]
)
def test_chi_square_tail(x, df, p):
    assert report.chi_square_tail(x, df) == pytest.approx(p, rel=1e-9)


def test_rate_ratio_table_lists_the_reference(spark, nb):
    rows = report.rate_ratio_table(spark, [nb]).collect()
    assert {(r.term, r.level) for r in rows if r.reference} == {("a", "x"), ("b", "no")}
    r = next(r for r in rows if r.level == "yes")
    assert r.conf_low < r.ratio < r.conf_high and r.ratio == pytest.approx(math.exp(nb.beta[3]))
