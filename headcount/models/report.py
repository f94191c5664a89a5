"""Result tables of fitted models, tests between them and their predicted distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.functions.columns import literal, round_half_even
from headcount.functions.special import lgamma
from headcount.models.fit import Fit, drop_one_deviances
from headcount.models.table import parameter

_NORMAL = NormalDist()
Z95 = _NORMAL.inv_cdf(0.975)

COEF_SCHEMA = "model string, part string, term string, level string, estimate double, se double, z double, p_value double"
FIT_SCHEMA = (
    "model string, n bigint, p int, theta double, se_theta double, loglik double, deviance double, "
    "aic double, iterations int, converged boolean"
)
IRR_SCHEMA = (
    "model string, part string, term string, level string, reference boolean, ratio double, "
    "conf_low double, conf_high double, se_log double, p_value double, n bigint, aic double, "
    "deviance double, loglik double"
)


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        total, term, k = math.erfc(math.sqrt(half)), 0.0, 1
        if df > 1:
            term = math.sqrt(half) * math.exp(-half) * 2 / math.sqrt(math.pi)
        while k < df:
            total += term
            k += 2
            term *= x / k
        return total
    total, term = 0.0, math.exp(-half)
    for k in range(1, df // 2 + 1):
        total += term
        term *= half / k
    return total


def _parts(fit: Fit) -> list[tuple[str, np.ndarray, np.ndarray]]:
    parts = [("count", fit.beta, fit.vcov)]
    if fit.zero is not None:
        parts.append(("zero", fit.zero, fit.zero_vcov))
    return parts


def _at_limit(fit: Fit, part: str, i: int) -> bool:
    """Whether a coefficient of the zero part is at its limit, minus infinity, or relative to such a one."""
    return part == "zero" and i not in fit.zero_live


def _base(fit: Fit, part: str) -> dict[str, str]:
    """The level that a factor's coefficients are relative to: in the zero part the first with a finite one."""
    return fit.zero_reference if part == "zero" else fit.design.reference


def _se(vcov: np.ndarray, i: int) -> float | None:
    return math.sqrt(vcov[i, i]) if vcov[i, i] > 0 else None


def coef_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """One row per coefficient. A level without a finite one is listed with NULL figures: its outcome
    is always 0, or the count part explains its zeros (zero part), or the terms before it span its
    indicator. Where that is a reference of the zero part, the factor's first other level takes its place."""
    rows = []
    for fit in fits:
        for part, values, vcov in _parts(fit):
            base = _base(fit, part)
            moved = [(t, level) for t, level in fit.design.reference.items() if base[t] != level]
            rows += [(fit.model, part, term, level, None, None, None, None) for term, level in moved]
            for i, (term, level) in enumerate(fit.design.terms):
                if base.get(term) == level:
                    continue
                if _at_limit(fit, part, i):
                    rows.append((fit.model, part, term, level, None, None, None, None))
                    continue
                se = _se(vcov, i)
                z = float(values[i]) / se if se else None
                p = 2 * _NORMAL.cdf(-abs(z)) if z is not None else None
                rows.append((fit.model, part, term, level, float(values[i]), se, z, p))
            without = [*fit.design.all_zero, *fit.design.aliased]
            rows += [(fit.model, part, term, level, None, None, None, None) for term, level in without]
    return spark.createDataFrame(rows, COEF_SCHEMA)


def fit_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """One row per model; the AIC counts theta (NB), sigma (OLS), or both parts and theta (ZINB)."""
    rows = [
        (
            f.model,
            f.design.n,
            f.n_parameters,
            f.theta,
            f.se_theta,
            float(f.loglik),
            None if f.deviance is None else float(f.deviance),
            float(f.aic),
            f.iterations,
            f.converged,
        )
        for f in fits
    ]
    return spark.createDataFrame(rows, FIT_SCHEMA)


def rate_ratio_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """Ratios (rate ratios, odds ratios for the zero part) with Wald limits. ``se_log`` is on the
    log scale. Each factor starts with its reference level, at a ratio of 1."""
    rows = []
    for fit in fits:
        tail = (
            fit.design.n,
            float(fit.aic),
            None if fit.deviance is None else float(fit.deviance),
            float(fit.loglik),
        )
        for part, values, vcov in _parts(fit):
            base = _base(fit, part)
            for term, level in fit.design.reference.items():
                rows.append((fit.model, part, term, base[term], True, 1.0, None, None, None, None, *tail))
                if base[term] != level:
                    rows.append((fit.model, part, term, level, False, 0.0, None, None, None, None, *tail))
            for i, (term, level) in enumerate(fit.design.terms):
                if base.get(term) == level:
                    continue
                if _at_limit(fit, part, i):
                    ratio = 0.0 if i == 0 or (term, level) in fit.closed else None
                    rows.append((fit.model, part, term, level, False, ratio, None, None, None, None, *tail))
                    continue
                b, se = float(values[i]), _se(vcov, i)
                low = high = p = None
                if se:
                    low, high = _exp(b - Z95 * se), _exp(b + Z95 * se)
                    p = 2 * _NORMAL.cdf(-abs(b / se))
                rows.append((fit.model, part, term, level, False, _exp(b), low, high, se, p, *tail))
    return spark.createDataFrame(rows, IRR_SCHEMA)


def _exp(x: float) -> float:
    try:
        return math.exp(x)
    except OverflowError:
        return math.inf


def theta_interval_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    rows = [
        (f.model, f.theta, f.se_theta, f.theta - Z95 * f.se_theta, f.theta + Z95 * f.se_theta)
        for f in fits
        if f.se_theta is not None
    ]
    return spark.createDataFrame(
        rows, "model string, theta double, se_theta double, conf_low double, conf_high double"
    )


def drop_one_lrt(spark: SparkSession, fit: Fit) -> DataFrame:
    """Likelihood ratio test of each factor: refit without it at the full model's theta.

    Every observed level but one costs a degree of freedom, a level whose outcome is always 0 too:
    the statistic holds what its rows gain.
    """
    design = fit.design
    freedom = {f: len(levels) - 1 - sum(t == f for t, _ in design.aliased) for f, levels in design.seen.items()}
    if empty := [f for f, df in freedom.items() if df < 1]:
        raise ValueError(f"there is nothing to test in {empty}: one level, or no coefficient of its own")
    rows = [("<none>", None, float(fit.deviance), None, None, fit.converged)]
    for factor, deviance in drop_one_deviances(fit, list(design.index)).items():
        df = freedom[factor]
        statistic = max(deviance - float(fit.deviance), 0.0)
        rows.append((factor, df, deviance, statistic, chi_square_tail(statistic, df), fit.converged))
    return spark.createDataFrame(
        rows, "term string, df int, deviance double, statistic double, p_value double, converged boolean"
    )


def patterns(fit: Fit) -> DataFrame:
    """One row per combination of factor levels: (mu, pi, t, n). Never one per respondent.

    Levels whose outcome is always 0 are among them, with a mean of 0.
    """
    theta = "CAST(NULL AS DOUBLE)" if fit.theta is None else parameter(fit.theta)
    return fit.design.patterns.selectExpr(f"{fit.mean()} AS mu", f"{fit.structural_zero()} AS pi", f"{theta} AS t", "n")


def largest_outcome(fit: Fit) -> int:
    return int(fit.design.values.agg(F.max("y")).first()[0] or 0)


#: Log of the probability below which a tail is lost in the rounding of what comes before it.
LOST = math.log(1e-18)


def last_outcome(mu: float, theta: float | None, kmax: int) -> int:
    """An x up to ``kmax`` beyond which P(Y > x) is lost in rounding, for this mean and all smaller ones."""

    def log_tail(k: int) -> float:
        if theta is None:
            ratio = mu / (k + 1)
            log_pmf = -mu + k * math.log(mu) - math.lgamma(k + 1)
        else:
            ratio = mu / (theta + mu) * (k + theta) / (k + 1)
            log_pmf = math.lgamma(k + theta) - math.lgamma(theta) - math.lgamma(k + 1)
            log_pmf += theta * math.log(theta / (theta + mu)) + k * math.log(mu / (theta + mu))
        # From here on probabilities fall at least as fast as this ratio, if it is below 1.
        return log_pmf - math.log1p(-ratio) if ratio < 1 else 0.0

    if mu <= 0:
        return 0
    low, high = 0, 1
    while high < kmax and log_tail(high) > LOST:
        low, high = high, 2 * high
    high = min(high, kmax)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if log_tail(middle) > LOST else (low, middle)
    return high


def predicted_distribution(fit: Fit, kmax: int, prob: str = "prob", tail: bool = True) -> DataFrame:
    """(x, probability): mean over respondents of P(Y = x), for x = 0..kmax.

    The mass beyond is in a last row without x, unless ``tail`` is off. There is a row for each x from
    the start, and each adds up the patterns: of log P(Y = x) = c(x) + a + x b, only a and b depend
    on the pattern, so a pattern costs an exponential, and nothing is multiplied out. Where the
    largest mean's tail is lost in rounding the rest is 0. The patterns are one array, which
    the combinations of levels bound.
    """
    # The array is read twice: for the sums here and within each row.
    rows = patterns(fit)
    theta = fit.theta
    slope, level = ("ln(mu)", "-mu") if theta is None else ("ln(mu / (t + mu))", "t * ln(t / (t + mu))")
    at_zero = "n * CASE WHEN mu > 0 THEN pi ELSE 1D END"
    total, none, most = rows.agg(F.sum("n"), F.expr(f"sum({at_zero})"), F.max("mu")).first()
    packed = rows.filter("mu > 0").selectExpr(f"named_struct('w', n * (1D - pi), 'a', {level}, 'b', {slope}) AS p")
    packed = packed.agg(F.collect_list("p").alias("p"))
    last = last_outcome(most or 0.0, theta, kmax)
    xs = fit.design.patterns.sparkSession.range(kmax + 1)
    xs = xs.selectExpr("CAST(id AS INT) AS x", "CAST(id AS DOUBLE) AS k", f"{'1D' if theta is None else repr(float(theta)) + 'D'} AS t")
    xs = xs.selectExpr("*", "k + 1D AS k1", "k + t AS kt")
    c = f"-{lgamma('k1')}" if theta is None else f"{lgamma('kt')} - {lgamma('t')} - {lgamma('k1')}"
    xs = xs.selectExpr("x", "k", f"{c} AS c").withColumn("p", packed.scalar())
    mass = "aggregate(p, 0D, (s, q) -> s + q.w * exp(c + q.a + k * q.b))"
    zero = f"CASE WHEN x = 0 THEN {float(none or 0.0)!r}D ELSE 0D END"
    out = xs.selectExpr("x", f"(CASE WHEN x <= {last} THEN {mass} ELSE 0D END + {zero}) / {float(total)!r}D AS {prob}")
    return with_tail(out, prob) if tail else out


def with_tail(distribution: DataFrame, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """A row without x for the probability that the listed values leave."""
    left = distribution.groupBy(*by).agg(F.expr(f"greatest(0D, 1D - sum({prob})) AS {prob}"))
    return distribution.unionByName(left.selectExpr(*by, "CAST(NULL AS INT) AS x", prob))


def ols_distribution(fit: Fit, share: str = "OLS") -> DataFrame:
    """(x, share): linear predictions rounded to whole numbers."""
    return (
        fit.design.patterns.selectExpr(f"CAST({round_half_even(fit.design.linear(fit.beta))} AS INT) AS x", "n")
        .groupBy("x")
        .agg(F.expr(f"sum(n) / {fit.design.n} AS {share}"))
    )


def zero_count_table(fits: Sequence[Fit]) -> DataFrame:
    """(model, zeros): observed zeros, then the zeros each model expects."""
    out = fits[0].design.patterns.selectExpr("'Observed' AS model", "coalesce(sum(n0), 0D) AS zeros")
    for fit in fits:
        expected = f"sum(n * (pi + (1D - pi) * {fit.count_zero()}))"
        out = out.unionByName(patterns(fit).selectExpr(f"{literal(fit.model)} AS model", f"{expected} AS zeros"))
    return out
