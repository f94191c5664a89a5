"""Models with one factor of very many levels, such as an occupation code.

Next to the other factors' coefficients, the information matrix of the levels is a table of diagonal
entries: a row has one level. Eliminating the levels block by block (the Schur complement) leaves a
system of the other coefficients, which is all that reaches the driver; levels stay in a table, a row
each, with their coefficient, whatever their number. There is no intercept: each level has its own.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.functions.columns import name, recode
from headcount.models.fit import (
    DEVIANCE,
    LOGLIK,
    MAX_HALVINGS,
    OBSERVED,
    POISSON_THETA,
    SCORE,
    VALUE_TERMS,
    _theta_step,
    moment_theta,
    pair_sums,
)
from headcount.models.table import REFERENCE, ZERO, Design, _aliased, build_design, keep, model_table, parameter, parameters

_NONE = "CAST(NULL AS DOUBLE)"


@dataclass(frozen=True)
class LargeDesign:
    """A design of the other factors whose patterns also have ``level``, the large factor's, of the rows that are fitted.

    ``zero_levels`` has the levels whose outcome is always 0: they have no finite coefficient and no
    part in the fit, as in ``Design``. ``kept`` are the other factors' coefficients that the levels
    and those before them do not span; the intercept is not among them.
    """

    small: Design
    large: str
    zero_levels: DataFrame
    kept: np.ndarray


@dataclass
class LargeFit:
    """``beta`` of the kept terms, their covariance, and ``levels``: level, estimate, se (of each level's own intercept)."""

    model: str
    design: LargeDesign
    beta: np.ndarray
    vcov: np.ndarray
    levels: DataFrame
    loglik: float
    deviance: float
    theta: float | None = None
    sigma2: float | None = None
    iterations: int = 0

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``term``, ``level``, ``estimate``, ``se`` of the other factors; NULL for a coefficient that the levels span."""
        small = self.design.small
        at = {int(k): i for i, k in enumerate(self.design.kept)}
        rows = []
        for k, (term, level) in list(enumerate(small.terms))[1:]:
            i = at.get(k)
            rows.append((term, level, None, None) if i is None else (term, level, float(self.beta[i]), math.sqrt(self.vcov[i, i])))
        return spark.createDataFrame(rows, "term string, level string, estimate double, se double")


def large_design(df: DataFrame, y: str, factors: Mapping[str, Sequence[str]], large: str, set_aside_zero: bool = True) -> LargeDesign:
    """Sufficient sums of the rows of df where outcome, factors and ``large`` are known.

    ``factors`` gives the level order of the other factors. The large factor has no list of levels.
    """
    names = list(factors)
    table = keep(model_table(df, y, [*names, large]))
    counted = table.groupBy(*names, "y").agg(F.sum("n").alias("n"))
    small = build_design(counted, factors, set_aside_zero)
    columns = []
    for f in names:
        slots = {level: small.terms.index((f, level)) if (f, level) in small.terms else REFERENCE for level in small.seen[f]}
        gone = [level for level in small.seen[f] if (f, level) in small.all_zero]
        slots = {level: slot for level, slot in slots.items() if level not in gone}
        columns.append(f"{recode(name(f), slots)} AS {name(small.index[f])}")
    coded = table.selectExpr(f"{name(large)} AS level", *columns, f"0 AS {ZERO}", "y", "n")
    index = [name(c) for c in small.index.values()]
    coded = coded.filter(" AND ".join(f"{c} IS NOT NULL" for c in index)) if index else coded
    sums = {"n": "sum(n)", "s": "sum(y * n)", "n0": "coalesce(sum(CASE WHEN y = 0 THEN n END), 0)"}
    rows = keep(coded.groupBy("level", ZERO, *index).agg(*[F.expr(f"CAST({text} AS DOUBLE) AS {c}") for c, text in sums.items()]))
    totals = keep(rows.groupBy("level").agg(F.sum("s").alias("s")).filter("s = 0").select("level"))
    rows = keep(rows.join(totals, "level", "left_anti")) if set_aside_zero and not totals.isEmpty() else rows
    zero = totals if set_aside_zero else totals.limit(0)
    design = LargeDesign(dataclasses.replace(small, patterns=rows), large, zero, np.arange(1, small.p))
    gram = _reduced(design, rows.selectExpr("*", "0D AS alpha"), "n", "0D")["schur"]
    spanned = set(_aliased_below(gram, np.diag(_plain(design, rows))))
    return dataclasses.replace(design, kept=np.array([k for i, k in enumerate(design.kept) if i not in spanned], int))


def _plain(design: LargeDesign, rows: DataFrame) -> np.ndarray:
    k = design.kept
    return pair_sums(design.small, rows, pair={"xx": "n"})["xx"][np.ix_(k, k)]


def _aliased_below(gram: np.ndarray, whole: np.ndarray) -> list[int]:
    """Columns that the levels, or the columns before them, span: what is left of them is rounding."""
    gone = [i for i in range(len(gram)) if gram[i, i] <= 1e-9 * whole[i]]
    kept = [i for i in range(len(gram)) if i not in gone]
    return gone + [kept[i] for i in _aliased(gram[np.ix_(kept, kept)])]


def _blocks(design: LargeDesign, rows: DataFrame, weight: str, score: str) -> DataFrame:
    """``level``, ``d`` (its diagonal entry), ``h`` (its score) and ``b`` (its row of entries with the kept coefficients).

    One aggregation by level; the entries of a row are summed by coefficient, so it is as wide as they are many.
    """
    small, kept = design.small, design.kept.tolist()
    active = {}
    for f, column in small.index.items():
        for k in kept:
            if small.terms[k][0] == f:
                active[k] = f"{name(column)} = {k}"
    sums = [F.expr(f"coalesce(sum(CASE WHEN {active[k]} THEN _w END), 0D) AS b_{k}") for k in kept]
    by = rows.selectExpr("*", f"{weight} AS _w", f"{score} AS _h").groupBy("level")
    by = by.agg(F.sum("_w").alias("d"), F.sum("_h").alias("h"), F.first("alpha").alias("alpha"), *sums)
    entries = f"array({', '.join(f'b_{k}' for k in kept)})" if kept else "CAST(array() AS ARRAY<DOUBLE>)"
    return by.selectExpr("level", "alpha", "d", "h", f"{entries} AS b")


def _eliminated(blocks: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the levels of b b' / d and b h / d: p (p + 1) / 2 and p numbers."""
    one, two = np.zeros((p, p)), np.zeros(p)
    if p:
        rows = blocks.select("d", "h", "b", F.posexplode("b").alias("i", "bi")).filter("bi <> 0")
        last = rows.selectExpr("i", "-1 AS j", "bi * h / d AS v")
        pairs = rows.select("i", "d", "bi", F.posexplode("b").alias("j", "bj")).filter("j >= i AND bj <> 0")
        sums = pairs.selectExpr("i", "j", "bi * bj / d AS v").unionByName(last).groupBy("i", "j").agg(F.sum("v").alias("v"))
        for r in sums.collect():
            if r["j"] < 0:
                two[r["i"]] = r["v"]
            else:
                one[r["i"], r["j"]] = one[r["j"], r["i"]] = r["v"]
    return one, two


def _reduced(design: LargeDesign, rows: DataFrame, weight: str, score: str, **more) -> dict:
    """The system of the kept coefficients with the levels eliminated, the blocks, and further sums of ``pair_sums``."""
    k = design.kept
    at = pair_sums(design.small, rows, pair={"a": weight}, single={"g": score}, **more)
    blocks = keep(_blocks(design, rows, weight, score))
    one, two = _eliminated(blocks, len(k))
    return {**at, "schur": at["a"][np.ix_(k, k)] - one, "right": at["g"][k] - two, "blocks": blocks}


def _solve(at: dict) -> np.ndarray:
    return np.linalg.solve(at["schur"], at["right"]) if len(at["right"]) else np.zeros(0)


def _dot(b: str, values: Sequence[float]) -> str:
    """Product of a row of entries with numbers of the driver."""
    if not len(values):
        return "0D"
    return f"aggregate(zip_with({b}, {parameters(values)}, (x, y) -> x * y), 0D, (a, x) -> a + x)"


def _with_levels(design: LargeDesign, alpha: DataFrame) -> DataFrame:
    return design.small.patterns.join(alpha, "level")


def _linear(design: LargeDesign, beta: np.ndarray) -> str:
    full = np.zeros(design.small.p)
    full[design.kept] = beta
    return f"({design.small.linear(full)} + alpha)"


def _level_errors(blocks: DataFrame, schur: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, DataFrame]:
    """Covariance of the kept coefficients, and ``level``, ``estimate``, ``se`` of the levels."""
    inverse = np.linalg.inv(schur) if len(schur) else schur
    root = np.linalg.cholesky(inverse).T if len(schur) else schur
    # b' S^-1 b / d^2 as the squared length of R b / d.
    parts = [f"pow({_dot('b', row)} / d, 2D)" for row in root]
    spread = " + ".join(["1D / d", *parts])
    return scale * inverse, keep(blocks.selectExpr("level", "alpha AS estimate", f"sqrt({float(scale)!r}D * ({spread})) AS se"))


def with_zero_levels(fit: LargeFit) -> DataFrame:
    """``levels`` with those whose outcome is always 0, without figures."""
    return fit.levels.unionByName(fit.design.zero_levels.selectExpr("level", f"{_NONE} AS estimate", f"{_NONE} AS se"))


def fit_nb_large(design: LargeDesign, theta: float | None = None, max_iter: int = 50, tol: float = 1e-9) -> LargeFit:
    """Negative binomial regression with log link and a coefficient for each level of the large factor.

    The steps of ``fit_nb``: Newton's method in all coefficients and log(theta) together, with the
    levels eliminated. A pass is a join with the levels' table and sums by level and by pair of the other coefficients.
    An outcome that is not over-dispersed, or a fit that does not settle, raises.
    """
    small = design.small
    fixed = theta is not None
    theta = theta if fixed else min(moment_theta(small.mean, small.variance), POISSON_THETA / 10)
    start = small.patterns.groupBy("level").agg(F.expr("ln(sum(s) / sum(n)) AS alpha"))

    def evaluate(alpha: DataFrame, beta: np.ndarray, theta: float) -> dict:
        rows = _with_levels(design, alpha).selectExpr("*", f"exp({_linear(design, beta)}) AS mu", f"{parameter(theta)} AS t")
        at = _reduced(
            design, rows.selectExpr("*", "t + mu AS d"), OBSERVED, SCORE,
            whole={
                "loglik": LOGLIK, "deviance": DEVIANCE, "theta_score": "(n * ln(t / d) + n - (s + n * t) / d)",
                "theta_curvature": "(n / t - 2D * n / d + (s + n * t) / (d * d))",
            },
            values=VALUE_TERMS, theta=theta,
        )
        for whole, own in (("loglik", "v_loglik"), ("deviance", "v_deviance"), ("theta_score", "v_score"), ("theta_curvature", "v_curvature")):
            at[whole] += at[own]
        return at

    beta, alpha = np.zeros(len(design.kept)), keep(start)
    at = evaluate(alpha, beta, theta)
    for iteration in range(1, max_iter + 1):
        move = _solve(at)
        steps = at["blocks"].selectExpr("level", "alpha", f"(h - {_dot('b', move)}) / d AS step")
        shift = 0.0 if fixed else _theta_step(theta, at["theta_score"], at["theta_curvature"])
        largest = steps.agg(F.max(F.abs("step"))).first()[0] or 0.0
        if max(np.max(np.abs(move), initial=0.0), largest, abs(shift)) < tol:
            break
        if not fixed and theta * math.exp(shift) > POISSON_THETA:
            raise ValueError("the outcome is not over-dispersed")
        slack = 1e-9 * abs(at["loglik"]) + 1e-14 * theta * small.n
        scale = 1.0
        for _ in range(MAX_HALVINGS):
            there = steps.selectExpr("level", f"alpha + {parameter(scale).replace(ZERO, '0')} * step AS alpha")
            trial = evaluate(there, beta + scale * move, theta * math.exp(scale * shift))
            if trial["loglik"] >= at["loglik"] - slack:
                break
            scale /= 2
        else:
            raise RuntimeError(f"no step raises the likelihood in pass {iteration}")
        beta, theta, at = beta + scale * move, theta * math.exp(scale * shift), trial
    else:
        raise RuntimeError(f"the model with {design.large} did not settle in {max_iter} passes")
    # Errors come from the expected information.
    alpha = at["blocks"].select("level", "alpha")
    rows = _with_levels(design, alpha).selectExpr("*", f"exp({_linear(design, beta)}) AS mu", f"{parameter(theta)} AS t")
    expected = _reduced(design, rows, "n * mu * t / (t + mu)", "0D")
    vcov, levels = _level_errors(expected["blocks"], expected["schur"])
    return LargeFit("NB", design, beta, vcov, levels, at["loglik"], at["deviance"], theta=theta, iterations=iteration)


def fit_ols_large(design: LargeDesign) -> LargeFit:
    """Gaussian linear model with a mean for each level of the large factor: one pass, and one for the residuals' sum.

    The design is made with ``set_aside_zero`` off.
    """
    small = design.small
    centre = parameter(small.mean)
    rows = small.patterns.selectExpr("*", "0D AS alpha")
    at = _reduced(design, rows, "n", f"s - n * {centre}")
    beta = _solve(at)
    blocks = keep(at["blocks"].selectExpr("level", f"(h - {_dot('b', beta)}) / d + {float(small.mean)!r}D AS alpha", "d", "b"))
    fitted = _with_levels(design, blocks.select("level", "alpha")).selectExpr("*", f"{_linear(design, beta)} AS f")
    # Sums of squares about the mean less what the fit explains, both centred.
    m = f"{float(small.mean)!r}D"
    gained = fitted.agg(F.expr(f"sum(2D * (f - {m}) * (s - n * {m}) - n * (f - {m}) * (f - {m}))")).first()[0]
    rss = float(small.variance * max(small.n - 1, 1) - gained)
    freedom = small.n - len(beta) - blocks.count()
    if freedom < 1:
        raise ValueError("there are no rows beyond the coefficients")
    sigma2 = rss / freedom
    vcov, levels = _level_errors(blocks, at["schur"], sigma2)
    loglik = -0.5 * small.n * (math.log(2 * math.pi) + math.log(rss / small.n) + 1)
    return LargeFit("OLS", design, beta, vcov, levels, loglik, rss, sigma2=sigma2, iterations=1)
