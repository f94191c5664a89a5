"""Null and one-factor negative binomial models.

With one factor the fitted mean of a level is that level's mean, so only theta needs iterating. Any
number of one-factor models are fitted together: they share one scan of the raw rows, and each
theta pass is one aggregation grouped by model.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.functions.columns import classify, is_in, level_ord, literal
from headcount.functions.special import (
    nb_log_pmf,
    nb_theta_curvature,
    nb_theta_score,
    nb_unit_deviance,
    nb_zero,
    poisson_log_pmf,
)
from headcount.models.fit import POISSON_THETA, _theta_step, moment_theta
from headcount.models.report import with_tail
from headcount.models.table import INTERCEPT, ZERO, keep, model_table, parameters

NULL_MODEL = "(null)"
Z95 = NormalDist().inv_cdf(0.975)


@dataclass
class OneWay:
    """Fitted one-factor models: ``cells`` is (term, level, ord, y, n, mu), theta is per term.

    A term whose outcome is not over-dispersed is a Poisson model and has no theta.
    """

    cells: DataFrame
    theta: dict[str, float | None]
    se_theta: dict[str, float | None]
    iterations: dict[str, int]

    def theta_text(self) -> str:
        return _by_term(self.theta)

    def se_theta_text(self) -> str:
        return _by_term(self.se_theta)


def _by_term(values: Mapping[str, float | None]) -> str:
    return f"CAST({classify([(f'term = {literal(t)}', v) for t, v in values.items()])} AS DOUBLE)"


def _null_cells(df: DataFrame, y: str, weight: str | None) -> DataFrame:
    return model_table(df, y, [], weight=weight).selectExpr(f"{literal(NULL_MODEL)} AS term", "'' AS level", "1 AS ord", "y", "n")


def _factor_cells(df: DataFrame, y: str, factors: Mapping[str, Sequence[str]], weight: str | None) -> DataFrame:
    """Each model drops only the rows whose own factor is unknown."""
    names = list(factors)
    long = (
        model_table(df, y, names, complete=False, weight=weight)
        .unpivot(["y", "n"], names, "term", "level")
        .filter("level IS NOT NULL")
        .groupBy("term", "level", "y")
        .agg(F.sum("n").alias("n"))
    )
    places = " ".join(f"WHEN {literal(f)} THEN {level_ord('level', levels)}" for f, levels in factors.items())
    return long.selectExpr("term", "level", f"CASE term {places} END AS ord", "y", "n")


def fit_oneway(
    df: DataFrame,
    y: str,
    factors: Mapping[str, Sequence[str]] | None = None,
    weight: str | None = None,
    max_iter: int = 60,
    tol: float = 1e-8,
) -> OneWay:
    """Fit the null model (no factors) or one model per factor. ``weight`` as in ``model_table``.

    A theta that grows without end leaves a Poisson model; a fit that does not settle raises.
    """
    cells = _factor_cells(df, y, factors, weight) if factors else _null_cells(df, y, weight)
    level = "PARTITION BY term, level"
    cells = keep(
        cells.selectExpr("term", "level", "ord", "CAST(y AS DOUBLE) AS y", "n").selectExpr(
            "*", f"0 AS {ZERO}", f"sum(y * n) OVER ({level}) / sum(n) OVER ({level}) AS mu"
        )
    )
    start = (
        cells.groupBy("term")
        .agg(
            F.expr("sum(n * mu) / sum(n) AS mean"),
            F.expr("sum(n * (y - mu) * (y - mu)) / sum(n) AS variance"),
        )
        .collect()
    )
    theta = {r["term"]: min(moment_theta(r["mean"], r["variance"]), POISSON_THETA) for r in start}
    open_terms = set(theta)
    iterations = dict.fromkeys(theta, 0)
    poisson = set()
    curvature: dict[str, float] = {}

    for _ in range(max_iter):
        order = sorted(theta)
        place = classify([(f"term = {literal(k)}", i) for i, k in enumerate(order)])
        rows = (
            cells.filter(is_in("term", sorted(open_terms)))
            .selectExpr("term", "y", "n", "mu", f"get({parameters([theta[k] for k in order])}, {place}) AS t")
            .groupBy("term")
            .agg(
                F.expr(f"sum(n * {nb_theta_score('y', 'mu', 't')}) AS score"),
                F.expr(f"sum(n * {nb_theta_curvature('y', 'mu', 't')}) AS curvature"),
            )
            .collect()
        )
        for r in rows:
            term = r["term"]
            curvature[term] = r["curvature"]
            step = _theta_step(theta[term], r["score"], r["curvature"])
            iterations[term] += 1
            moved = theta[term] * math.exp(step)
            if moved > POISSON_THETA:
                poisson.add(term)
                open_terms.discard(term)
            else:
                # Newton squares the error, so after a step this small there is none left to see.
                theta[term] = moved
                if abs(step) < tol:
                    open_terms.discard(term)
        if not open_terms:
            break
    if open_terms:
        raise RuntimeError(f"theta of {sorted(open_terms)} did not settle in {max_iter} passes")
    se = {k: math.sqrt(-1 / c) if (c := curvature[k]) < 0 and k not in poisson else None for k in theta}
    return OneWay(cells, {k: None if k in poisson else t for k, t in theta.items()}, se, iterations)


def level_means(fit: OneWay) -> DataFrame:
    """(term, level, ord, n, mean, theta, w): one row per level; w is the information on its log mean."""
    return (
        fit.cells.groupBy("term", "level", "ord")
        .agg(F.sum("n").alias("n"), F.first("mu").alias("mean"))
        .selectExpr("*", f"{fit.theta_text()} AS theta")
        .selectExpr("*", "n * mean / (1D + coalesce(mean / theta, 0D)) AS w")
    )


def _log_ratios(fit: OneWay) -> DataFrame:
    """Levels beside their model's reference, the first level with a positive mean.

    A level with a mean of 0 has no finite log ratio; its ``log_ratio`` and ``se`` are NULL.
    """
    usable = "CASE WHEN mean > 0 THEN struct(ord, mean, w) END"
    return (
        level_means(fit)
        .selectExpr("*", f"min({usable}) OVER (PARTITION BY term) AS ref")
        .selectExpr(
            "*",
            "ord = ref.ord AS is_ref",
            "CASE WHEN mean > 0 THEN ln(mean) - ln(ref.mean) END AS log_ratio",
            "CASE WHEN mean > 0 THEN sqrt(try_divide(1D, w) + 1D / ref.w) END AS se",
        )
    )


def coefficients(fit: OneWay) -> DataFrame:
    """(term, level, estimate, se, theta): log mean of the reference, log ratios of the others."""
    return _log_ratios(fit).selectExpr(
        "term",
        f"CASE WHEN is_ref THEN {literal(INTERCEPT)} ELSE level END AS level",
        "CASE WHEN is_ref THEN ln(ref.mean) ELSE log_ratio END AS estimate",
        "CASE WHEN is_ref THEN sqrt(1D / ref.w) ELSE se END AS se",
        "theta",
    )


def _log_pmf(y: str, mu: str, theta: str) -> str:
    return f"CASE WHEN {theta} IS NULL THEN {poisson_log_pmf(y, mu)} ELSE {nb_log_pmf(y, mu, theta)} END"


def fit_summary(fit: OneWay) -> DataFrame:
    """(term, model, n, p, theta, se_theta, loglik, deviance, aic): one row per model; theta counts in the AIC."""
    poisson_deviance = "2D * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0D END - y + mu)"
    aggregates = {
        "n": "sum(n)",
        "p": "count(DISTINCT CASE WHEN mu > 0 THEN level END)",
        "theta": "first(t)",
        "loglik": f"sum(n * {_log_pmf('y', 'mu', 't')})",
        "deviance": f"sum(n * CASE WHEN t IS NULL THEN {poisson_deviance} ELSE {nb_unit_deviance('y', 'mu', 't')} END)",
    }
    return (
        fit.cells.selectExpr("*", f"{fit.theta_text()} AS t")
        .groupBy("term")
        .agg(*[F.expr(f"{text} AS {s}") for s, text in aggregates.items()])
        .selectExpr(
            "term",
            "CASE WHEN theta IS NULL THEN 'Poisson' ELSE 'NB' END AS model",
            "n",
            "p",
            "theta",
            f"{fit.se_theta_text()} AS se_theta",
            "loglik",
            "deviance",
            "-2D * loglik + 2D * (p + CASE WHEN theta IS NULL THEN 0 ELSE 1 END) AS aic",
        )
    )


def rate_ratios(fit: OneWay) -> DataFrame:
    """Incidence rate ratios with Wald limits, reference level first, and the model's fit figures."""
    ratios = _log_ratios(fit).selectExpr(
        "term",
        "level",
        "ord AS level_ord",
        "is_ref AS reference",
        "exp(log_ratio) AS irr",
        f"CASE WHEN NOT is_ref THEN exp(log_ratio - {Z95}D * se) END AS conf_low",
        f"CASE WHEN NOT is_ref THEN exp(log_ratio + {Z95}D * se) END AS conf_high",
        "CASE WHEN NOT is_ref THEN se END AS se_log",
    )
    return ratios.join(fit_summary(fit).select("term", "n", "loglik", "deviance", "aic"), "term")


def likelihood_ratio(fit: OneWay) -> DataFrame:
    """(term, df, statistic): test of the factor against a common mean, theta held at the fit."""
    term = "PARTITION BY term"
    gain = (
        "CASE WHEN mean > 0 THEN n * mean * ln(mean / common) ELSE 0D END"
        " - CASE WHEN theta IS NULL THEN n * (mean - common)"
        " ELSE n * (mean + theta) * ln((mean + theta) / (common + theta)) END"
    )
    return (
        level_means(fit)
        .selectExpr("*", f"sum(n * mean) OVER ({term}) / sum(n) OVER ({term}) AS common")
        .groupBy("term")
        .agg(F.expr("count(*) - 1 AS df"), F.expr(f"2D * sum({gain}) AS statistic"))
    )


def theta_interval(fit: OneWay) -> DataFrame:
    """(term, theta, se_theta, conf_low, conf_high)."""
    margin = f"{Z95}D * {fit.se_theta_text()}"
    return (
        fit.cells.select("term")
        .distinct()
        .selectExpr(
            "term",
            f"{fit.theta_text()} AS theta",
            f"{fit.se_theta_text()} AS se_theta",
            f"{fit.theta_text()} - {margin} AS conf_low",
            f"{fit.theta_text()} + {margin} AS conf_high",
        )
    )


def size_and_probability(fit: OneWay) -> DataFrame:
    """(term, level, size, mu, prob): the success-probability form of each level's distribution."""
    return level_means(fit).selectExpr(
        "term", "level", "theta AS size", "mean AS mu", "theta / (theta + mean) AS prob"
    )


def zero_counts(fit: OneWay) -> DataFrame:
    """(term, observed, expected): zeros in the data and zeros the model expects."""
    return (
        fit.cells.selectExpr("*", f"{fit.theta_text()} AS t")
        .groupBy("term")
        .agg(
            F.expr("coalesce(sum(CASE WHEN y = 0 THEN n END), 0) AS observed"),
            F.expr(f"sum(n * CASE WHEN t IS NULL THEN exp(-mu) ELSE {nb_zero('mu', 't')} END) AS expected"),
        )
    )


def largest_outcome(fit: OneWay) -> int:
    return int(fit.cells.agg(F.max("y")).first()[0] or 0)


def distribution(fit: OneWay, kmax: int, tail: bool = True) -> DataFrame:
    """(term, x, prob): mean over rows of P(Y = x) for x = 0..kmax, and a row without x for the rest."""
    out = (
        level_means(fit)
        .selectExpr("term", "mean", "theta", "n / sum(n) OVER (PARTITION BY term) AS share")
        .selectExpr("*", f"explode(sequence(0, {kmax})) AS x")
        .selectExpr("term", "x", f"share * coalesce(exp({_log_pmf('x', 'mean', 'theta')}), 0D) AS part")
        .groupBy("term", "x")
        .agg(F.sum("part").alias("prob"))
    )
    return with_tail(out, "prob", ["term"]) if tail else out
