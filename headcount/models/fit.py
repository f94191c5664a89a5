"""Fitting: one aggregation over the patterns per step, a small linear solve on the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.functions.columns import name
from headcount.functions.special import digamma, lgamma, nb_log_pmf, nb_zero, poisson_log_pmf, trigamma
from headcount.models.table import ALL_ZERO, REFERENCE, Design, _aliased, parameter, parameters

# A theta that moves beyond this belongs to an outcome that is not over-dispersed.
POISSON_THETA = 1e6
MAX_HALVINGS = 20


class NotConverged(RuntimeError):
    """A fit that did not settle. ``fit`` is where it stopped."""

    def __init__(self, fit: Fit):
        super().__init__(f"{fit.model} did not settle in {fit.iterations} passes")
        self.fit = fit


@dataclass
class Fit:
    """A fitted model. ``zero`` holds the zero-inflation coefficients of a ZINB model.

    Those of ``zero_live`` are finite and relative to ``zero_reference``; levels in ``closed`` have no
    structural zeros, the limit of their coefficient. All of them count as parameters.
    """

    model: str
    design: Design
    beta: np.ndarray
    vcov: np.ndarray
    loglik: float
    theta: float | None = None
    se_theta: float | None = None
    deviance: float | None = None
    sigma2: float | None = None
    zero: np.ndarray | None = None
    zero_vcov: np.ndarray | None = None
    iterations: int = 0
    converged: bool = True
    fixed_theta: bool = field(default=False)
    closed: list[tuple[str, str]] = field(default_factory=list)
    zero_live: list[int] = field(default_factory=list)
    zero_reference: dict[str, str] = field(default_factory=dict)

    @property
    def n_parameters(self) -> int:
        extra = 0 if self.fixed_theta else 1
        return len(self.beta) + (0 if self.zero is None else len(self.zero)) + extra

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_parameters

    def mean(self) -> str:
        """Mean of the count part of each pattern; 0 at a level whose outcome is always 0."""
        return f"CASE WHEN {self.design.set_aside()} THEN 0D ELSE exp({self.design.linear(self.beta)}) END"

    def structural_zero(self) -> str:
        """Probability of a structural zero of each pattern."""
        if self.zero is None:
            return "0D"
        none = f"{self.design.set_aside()} OR {never_zero(self.design, self.closed)}"
        return f"CASE WHEN {none} THEN 0D ELSE {logistic(self.design.linear(self.zero))} END"

    def log_pmf(self, x: str) -> str:
        """log P(Y = x) of the count part, for columns mu and t."""
        return poisson_log_pmf(x, "mu") if self.theta is None else nb_log_pmf(x, "mu", "t")

    def count_zero(self) -> str:
        """P(Y = 0) of the count part."""
        return "exp(-mu)" if self.theta is None else nb_zero("mu", "t")


def _has_level(design: Design, level: tuple[str, str]) -> str:
    """Whether a pattern has a level, a reference included."""
    own = design.terms.index(level) if level in design.terms else REFERENCE
    return f"{name(design.index[level[0]])} = {own}"


def never_zero(design: Design, closed: Sequence[tuple[str, str]]) -> str:
    """Whether a pattern has a level whose structural zeros are none at the limit."""
    tests = [_has_level(design, t) for t in closed]
    return f"({' OR '.join(tests)})" if tests else "false"


def logistic(x: str) -> str:
    return f"(1D / (1D + exp(-{x})))"


def pair_sums(
    design: Design,
    patterns: DataFrame,
    pair: Mapping[str, str] = {},
    single: Mapping[str, str] = {},
    whole: Mapping[str, str] = {},
    values: Mapping[str, str] = {},
    theta: float | None = None,
    models: int | None = None,
) -> dict | list[dict]:
    """Weighted cross-products of the dummy columns, without ever building them.

    A pattern has one active column per factor, so sum(w x_i x_j) is a sum of w over the patterns
    where i and j are both active. ``pair`` measures come back as p x p matrices, ``single`` ones as
    p-vectors and ``whole`` ones as scalars. ``values`` are scalars too, summed over the table of
    outcomes with ``theta`` as t; they ride in the same shuffle. At most p(p+1)/2 + 1 sums come to
    the driver.

    With ``models``, the patterns carry a model number and each model gets its own sums.
    """
    slots = design.slots()
    pairs = [f"struct({a} AS i, {b} AS j)" for k, a in enumerate(slots) for b in slots[k:]]
    measures = {**pair, **single, **whole}
    scope = {**dict.fromkeys(pair, "{}"), **dict.fromkeys(single, "CASE WHEN i = j THEN {} END")}
    scope.update(dict.fromkeys(whole, "CASE WHEN i = 0 AND j = 0 THEN {} END"))
    number = [] if models is None else ["model"]
    rows = (
        patterns.selectExpr(*number, *slots, *[f"{text} AS {m}" for m, text in measures.items()])
        .selectExpr(*number, f"explode(array({', '.join(pairs)})) AS ij", *measures)
        .filter("ij.i >= 0 AND ij.j >= 0")
        .selectExpr(*number, "ij.i", "ij.j", *[f"{scope[m].format(m)} AS {m}" for m in measures])
    )
    if values:
        alone = design.values.selectExpr("*", f"{parameter(theta)} AS t")
        alone = alone.selectExpr("-1 AS i", "-1 AS j", *[f"{text} AS {m}" for m, text in values.items()])
        rows = rows.unionByName(alone, allowMissingColumns=True)
    rows = rows.groupBy(*number, "i", "j").agg(*[F.expr(f"sum({m}) AS {m}") for m in [*measures, *values]]).collect()
    p = design.p
    out = [
        {
            **{m: np.zeros((p, p)) for m in pair},
            **{m: np.zeros(p) for m in single},
            **dict.fromkeys([*whole, *values], 0.0),
        }
        for _ in range(models or 1)
    ]
    for r in rows:
        a, b, sums = r["i"], r["j"], out[r["model"] if number else 0]
        if a < 0:
            sums.update({m: r[m] or 0.0 for m in values})
            continue
        for m in pair:
            sums[m][a, b] = sums[m][b, a] = r[m]
        if a == b:
            for m in single:
                sums[m][a] = r[m]
        if a == b == 0:
            sums.update({m: r[m] for m in whole})
    return out if number else out[0]


def _theta_step(theta: float, score: float, curvature: float) -> float:
    """Newton step for log(theta), bounded; uphill where the likelihood is not concave."""
    gradient = theta * score
    hessian = theta * theta * curvature + gradient
    step = -gradient / hessian if hessian < 0 else math.copysign(1.0, gradient)
    return max(-2.0, min(2.0, step))


def moment_theta(mean: float, variance: float) -> float:
    return mean * mean / (variance - mean) if variance > mean * (1 + 1e-9) else 100.0


# Terms of the negative binomial log-likelihood and its derivatives in theta that depend on the
# outcome alone, and those that a pattern's rows n, total s and zeros n0 give.
VALUE_TERMS = {
    "v_loglik": f"n * ({lgamma('y + t')} - {lgamma('t')} - {lgamma('y + 1D')})",
    "v_score": f"n * ({digamma('y + t')} - {digamma('t')})",
    "v_curvature": f"n * ({trigamma('y + t')} - {trigamma('t')})",
    "v_deviance": "2D * n * (y * ln(y) - (y + t) * ln(y + t))",
}
LOGLIK = "(n * t * ln(t / d) + CASE WHEN s > 0 THEN s * ln(mu / d) ELSE 0D END)"
DEVIANCE = "2D * ((s + n * t) * ln(d) - n0 * t * ln(t) - CASE WHEN s > 0 THEN s * ln(mu) ELSE 0D END)"
OBSERVED = "t * mu * (s + n * t) / (d * d)"
SCORE = "t * (s - n * mu) / d"


def _with_mean(patterns: DataFrame, eta: str, theta: float) -> DataFrame:
    return patterns.selectExpr("*", f"exp({eta}) AS mu", f"{parameter(theta)} AS t").selectExpr("*", "t + mu AS d")


def _settled(fit: Fit, allow_unconverged: bool) -> Fit:
    if fit.converged or allow_unconverged:
        return fit
    raise NotConverged(fit)


def fit_nb(
    design: Design,
    theta: float | None = None,
    max_iter: int = 50,
    tol: float = 1e-9,
    start: np.ndarray | None = None,
    allow_unconverged: bool = False,
) -> Fit:
    """Negative binomial regression with log link; ``theta`` is estimated unless given.

    Coefficients and log(theta) each take a Newton step per pass, and a pass is one shuffle of sums.
    The log-likelihood is concave in the coefficients for any theta. Standard errors use the expected
    information at the estimate. An outcome that is not over-dispersed has no finite theta: its
    likelihood rises until theta leaves ``POISSON_THETA`` behind, and the fit returned is the Poisson
    regression, under that name. A fit that does not settle raises ``NotConverged``.
    """
    fixed = theta is not None
    if start is None:
        start = np.zeros(design.p)
        start[0] = math.log(design.mean)
    beta = np.array(start, dtype=float)
    theta = theta if fixed else min(moment_theta(design.mean, design.variance), POISSON_THETA)

    def evaluate(beta: np.ndarray, theta: float) -> dict:
        at = pair_sums(
            design,
            _with_mean(design.fitted, design.linear(beta), theta),
            pair={"observed": OBSERVED, "expected": "n * mu * t / d"},
            single={"score": SCORE},
            whole={
                "loglik": LOGLIK,
                "deviance": DEVIANCE,
                "theta_score": "(n * ln(t / d) + n - (s + n * t) / d)",
                "theta_curvature": "(n / t - 2D * n / d + (s + n * t) / (d * d))",
            },
            values=VALUE_TERMS,
            theta=theta,
        )
        at["loglik"] += at["v_loglik"]
        at["deviance"] += at["v_deviance"]
        at["theta_score"] += at["v_score"]
        at["theta_curvature"] += at["v_curvature"]
        return at

    at = evaluate(beta, theta)
    converged, iteration = False, 0
    for iteration in range(1, max_iter + 1):
        move = np.linalg.solve(at["observed"], at["score"])
        shift = 0.0 if fixed else _theta_step(theta, at["theta_score"], at["theta_curvature"])
        if max(np.max(np.abs(move)), abs(shift)) < tol:
            converged = True
            break
        if not fixed and theta * math.exp(shift) > POISSON_THETA:
            return fit_poisson(design, max_iter, tol, beta, allow_unconverged)
        # The log-gamma terms grow with theta and cancel, so this much of the sum is rounding.
        slack = 1e-9 * abs(at["loglik"]) + 1e-14 * theta * design.n
        scale = 1.0
        for _ in range(MAX_HALVINGS):
            trial = evaluate(beta + scale * move, theta * math.exp(scale * shift))
            if trial["loglik"] >= at["loglik"] - slack:
                break
            scale /= 2
        else:
            break  # no step along this direction holds the likelihood; the point stays as it is
        beta, theta, at = beta + scale * move, theta * math.exp(scale * shift), trial
    curvature = at["theta_curvature"]
    fit = Fit(
        model="NB",
        design=design,
        beta=beta,
        vcov=np.linalg.inv(at["expected"]),
        loglik=at["loglik"],
        theta=theta,
        se_theta=math.sqrt(-1 / curvature) if curvature < 0 else None,
        deviance=at["deviance"],
        iterations=iteration,
        converged=converged,
        fixed_theta=fixed,
    )
    return _settled(fit, allow_unconverged)


def fit_poisson(
    design: Design,
    max_iter: int = 50,
    tol: float = 1e-9,
    start: np.ndarray | None = None,
    allow_unconverged: bool = False,
) -> Fit:
    """Poisson regression with log link: the model without over-dispersion, with no theta to count."""
    if start is None:
        start = np.zeros(design.p)
        start[0] = math.log(design.mean)
    beta = np.array(start, dtype=float)

    def evaluate(beta: np.ndarray) -> dict:
        at = pair_sums(
            design,
            design.fitted.selectExpr("*", f"{design.linear(beta)} AS eta").selectExpr("*", "exp(eta) AS mu"),
            pair={"observed": "n * mu"},
            single={"score": "s - n * mu"},
            whole={"loglik": "s * eta - n * mu"},
            values={"v_loglik": f"-n * {lgamma('y + 1D')}", "v_deviance": "2D * n * (y * ln(y) - y)"},
            theta=1.0,
        )
        at["deviance"] = at["v_deviance"] - 2 * at["loglik"]
        at["loglik"] += at["v_loglik"]
        return at

    at = evaluate(beta)
    converged, iteration = False, 0
    for iteration in range(1, max_iter + 1):
        move = np.linalg.solve(at["observed"], at["score"])
        if np.max(np.abs(move)) < tol:
            converged = True
            break
        scale = 1.0
        for _ in range(MAX_HALVINGS):
            trial = evaluate(beta + scale * move)
            if trial["loglik"] >= at["loglik"] - 1e-9 * abs(at["loglik"]):
                break
            scale /= 2
        else:
            break
        beta, at = beta + scale * move, trial
    fit = Fit(
        model="Poisson",
        design=design,
        beta=beta,
        vcov=np.linalg.inv(at["observed"]),
        loglik=at["loglik"],
        deviance=at["deviance"],
        iterations=iteration,
        converged=converged,
        fixed_theta=True,
    )
    return _settled(fit, allow_unconverged)


def drop_one_deviances(fit: Fit, factors: Sequence[str], max_iter: int = 50, tol: float = 1e-7) -> dict[str, float]:
    """Deviance of the model without each factor, theta held at the full fit; of a Poisson fit, that of Poisson models.

    All reduced models are fitted at once: the patterns are repeated per model, each pass is one
    aggregation, and a dropped factor is one whose coefficients stay at 0. Models that do not settle
    raise.
    """
    if fit.model not in ("NB", "Poisson"):
        raise ValueError(f"the test is for count models without a zero part, not for {fit.model}")
    design, p, theta = fit.design, fit.design.p, fit.theta
    poisson = theta is None
    kept = [design.kept_without(f) for f in factors]
    beta = np.zeros((len(factors), p))
    for m, k in enumerate(kept):
        beta[m, k] = fit.beta[k]
    patterns = design.patterns.selectExpr("*", f"explode(sequence(0, {len(factors) - 1})) AS model")
    for term in {t for t, _ in design.all_zero}:
        # Rows at an always-zero level come back in the model that no longer has the factor.
        own = factors.index(term) if term in factors else -1
        patterns = patterns.filter(f"model = {own} OR {name(design.index[term])} <> {ALL_ZERO}")
    # The number of a coefficient in the flat array of all models; none for a reference level.
    places = [f"CASE WHEN {s} >= 0 THEN model * {p} + {s} END" for s in design.slots()]
    alone = design.values.selectExpr("*", f"{parameter(1.0 if poisson else theta)} AS t")
    of_values = "2D * n * (y * ln(y) - y)" if poisson else VALUE_TERMS["v_deviance"]
    constant = alone.agg(F.expr(f"sum({of_values}) AS v")).first()["v"] or 0.0

    def evaluate(beta: np.ndarray) -> list[dict]:
        flat = parameters(beta.ravel())
        eta = " + ".join(f"coalesce(get({flat}, {place}), 0D)" for place in places)
        if poisson:
            rows = patterns.selectExpr("*", f"{eta} AS eta").selectExpr("*", "exp(eta) AS mu")
            terms = ("n * mu", "s - n * mu", "-2D * (s * eta - n * mu)")
        else:
            rows, terms = _with_mean(patterns, eta, theta), (OBSERVED, SCORE, DEVIANCE)
        pair, single, whole = ({key: text} for key, text in zip(("observed", "score", "deviance"), terms))
        out = pair_sums(design, rows, pair=pair, single=single, whole=whole, models=len(factors))
        for sums in out:
            sums["deviance"] += constant
        return out

    at = evaluate(beta)
    scale = np.ones(len(factors))
    for _ in range(max_iter):
        move = np.zeros_like(beta)
        for m, k in enumerate(kept):
            move[m, k] = np.linalg.solve(at[m]["observed"][np.ix_(k, k)], at[m]["score"][k])
        if np.max(np.abs(move)) < tol:
            return {f: float(at[m]["deviance"]) for m, f in enumerate(factors)}
        trial = evaluate(beta + scale[:, None] * move)
        for m in range(len(factors)):
            if trial[m]["deviance"] <= at[m]["deviance"] + 1e-9 * abs(at[m]["deviance"]):
                beta[m] += scale[m] * move[m]
                at[m], scale[m] = trial[m], 1.0
            else:
                scale[m] /= 2
    late = [f for m, f in enumerate(factors) if np.max(np.abs(move[m])) >= tol]
    raise RuntimeError(f"the models without {late} did not settle in {max_iter} passes")


def fit_ols(design: Design) -> Fit:
    """Gaussian linear model from one pass of cross-products."""
    mean = parameter(design.mean)
    sums = pair_sums(design, design.fitted, pair={"xx": "n"}, single={"xy": f"s - n * {mean}"})
    beta = np.linalg.solve(sums["xx"], sums["xy"])
    # Centring keeps the residual sum of squares from cancelling.
    rss = float(design.variance * max(design.n - 1, 1) - beta @ sums["xy"])
    beta[0] += design.mean
    n_rows = design.n
    sigma2 = rss / (n_rows - design.p)
    loglik = -0.5 * n_rows * (math.log(2 * math.pi) + math.log(rss / n_rows) + 1)
    return Fit(
        model="OLS",
        design=design,
        beta=beta,
        vcov=sigma2 * np.linalg.inv(sums["xx"]),
        loglik=loglik,
        deviance=rss,
        sigma2=sigma2,
        iterations=1,
    )


def _ascent(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Newton direction with the curvature made negative definite, so that it always points uphill."""
    if not len(gradient):
        return np.zeros(0)
    values, vectors = np.linalg.eigh(-hessian)
    size = np.maximum(np.abs(values), 1e-8 * max(1.0, np.max(np.abs(values))))
    return vectors @ ((vectors.T @ gradient) / size)


def _zero_part(design: Design, closed: Sequence[tuple[str, str]]) -> tuple[np.ndarray, dict[str, str]]:
    """Coefficients of the zero part that can be told apart while ``closed`` levels have no structural zeros.

    If a factor's reference is closed its first open level takes the place. Coefficients that the open
    patterns do not tell apart are left out, as aliased levels are in the count part.
    """
    if not closed:
        return np.arange(design.p), dict(design.reference)
    reference, dropped = dict(design.reference), set()
    for term in design.index:
        if (term, reference[term]) in closed:
            left = [level for t, level in design.terms if t == term and (t, level) not in closed]
            if not left:
                return np.zeros(0, int), reference
            reference[term] = left[0]
            dropped.add(design.terms.index((term, left[0])))
    open_rows = f"CASE WHEN {never_zero(design, closed)} THEN 0D ELSE n END"
    gram = pair_sums(design, design.fitted, pair={"xx": open_rows})["xx"]
    kept = np.array([i for i in range(design.p) if i not in dropped], int)
    spanned = set(_aliased(gram[np.ix_(kept, kept)]))
    return np.array([i for k, i in enumerate(kept) if k not in spanned], int), reference


#: A level may close when it is expected to have fewer structural zeros than this.
FEW = 1.0
#: How often a level may close again after it was opened.
MAX_OPENINGS = 2


def fit_zinb(
    design: Design, start: Fit | None = None, max_iter: int = 60, tol: float = 1e-12, allow_unconverged: bool = False
) -> Fit:
    """Zero-inflated negative binomial, the same factors in the count and the zero part.

    Newton's method on the likelihood of the data as observed, over all coefficients and
    log(theta) together, from the plain negative binomial fit. Each pass is one aggregation that
    brings the log-likelihood, its gradient and its curvature. Where no Newton step raises the
    likelihood, a step of the EM kind does: the curvature of the complete data, which is always
    definite. No step that lowers the likelihood is taken.

    The zero part of a level has no maximum if the count part explains its zeros: the likelihood rises
    for ever as the probability of a structural zero goes to 0. Such a level, a reference too, is
    *closed* as soon as that raises the likelihood: its probability is 0 from then on. When the rest
    has settled, the slope of the likelihood at that limit is tested, and a level that would gain from
    structural zeros is opened again. Levels without any zero are closed from the start. With all
    closed the model is the negative binomial, so its likelihood is never below that. Closed levels are
    named in ``closed``. A fit that does not settle raises ``NotConverged``.
    """
    nb = start or fit_nb(design)
    if nb.theta is None:
        raise ValueError("the outcome is not over-dispersed, so there is no zero-inflated negative binomial fit")
    p = design.p
    levels = [t for t in design.terms[1:]]
    aliased = {t for t, _ in design.aliased}
    levels += [(t, level) for t, level in design.reference.items() if t not in aliased]
    closed = list(design.no_zeros)
    opened: dict[tuple[str, str], int] = {}

    def evaluate(x: np.ndarray, closed: Sequence[tuple[str, str]], zero: np.ndarray, whole: bool = False) -> dict:
        beta, gamma, theta = x[:p], x[p : 2 * p], math.exp(x[2 * p])
        # A zero is a count zero with probability c = 1 - r; v is the variance of the split. e and g
        # are the derivatives of log f(0) in the linear predictor and in theta.
        tests = [_has_level(design, t) for t in closed]
        shut = " + ".join(f"CAST({t} AS INT)" for t in tests) or "0"
        rows = (
            _with_mean(design.fitted, design.linear(beta), theta)
            .selectExpr("*", f"{design.linear(gamma)} AS ez", f"{shut} AS shut")
            .selectExpr("*", f"CASE WHEN shut > 0 THEN 0D ELSE {logistic('ez')} END AS pi")
            .selectExpr("*", f"{nb_zero('mu', 't')} AS f0", "n - n0 AS m", "-t * mu / d AS e", "ln(t / d) + mu / d AS g")
            .selectExpr("*", "CASE WHEN pi > 0 THEN pi / (pi + (1D - pi) * f0) ELSE 0D END AS r")
            .selectExpr("*", "1D - r AS c", "r * (1D - r) AS v")
        )
        sums = pair_sums(
            design,
            rows,
            pair={
                "cc": "n0 * (v * e * e - c * t * t * mu / (d * d)) - t * mu * (s + m * t) / (d * d)",
                "cz": "-n0 * v * e",
                "zz": "n0 * v - n * pi * (1D - pi)",
                **({"whole_c": "t * mu * (s + (n0 * c + m) * t) / (d * d)", "whole_z": "n * pi * (1D - pi)"} if whole else {}),
            },
            single={
                "sc": "n0 * c * e + t * (s - m * mu) / d",
                "sz": "n0 * r - n * pi",
                "few": "n * pi",
                "ct": "t * (n0 * (v * e * g - c * mu * mu / (d * d)) + (s - m * mu) * mu / (d * d))",
                "zt": "-t * n0 * v * g",
            },
            whole={
                "loglik": "CASE WHEN n0 > 0 THEN n0 * ln(pi + (1D - pi) * f0) ELSE 0D END + m * ln(1D - pi)"
                " + m * t * ln(t / d) + CASE WHEN s > 0 THEN s * ln(mu / d) ELSE 0D END",
                "st": "t * (n0 * c * g + m * ln(t / d) + m - (s + m * t) / d)",
                "tt": "n0 * (t * t * (v * g * g + c * mu * mu / (t * d * d)) + t * c * g)"
                " + t * t * (m / t - 2D * m / d + (s + m * t) / (d * d)) + t * (m * ln(t / d) + m - (s + m * t) / d)",
                # Slope of the likelihood in the odds of a structural zero, where one closed level alone keeps it at 0.
                **{f"slope_{i}": f"CASE WHEN shut = 1 AND {t} THEN exp(ez) * (n0 / f0 - n) ELSE 0D END" for i, t in enumerate(tests)},
                **{f"size_{i}": f"CASE WHEN shut = 1 AND {t} THEN exp(ez) * n ELSE 0D END" for i, t in enumerate(tests)},
            },
            values={k: VALUE_TERMS[k] for k in ("v_loglik", "v_score", "v_curvature")},
            theta=theta,
        )
        q = 2 * p + 1
        h = np.zeros((q, q))
        h[:p, :p], h[p : 2 * p, p : 2 * p] = sums["cc"], sums["zz"]
        h[:p, p : 2 * p], h[p : 2 * p, :p] = sums["cz"], sums["cz"].T
        h[:p, -1] = h[-1, :p] = sums["ct"]
        h[p : 2 * p, -1] = h[-1, p : 2 * p] = sums["zt"]
        h[-1, -1] = sums["tt"] + theta * theta * sums["v_curvature"] + theta * sums["v_score"]
        score = np.concatenate([sums["sc"], sums["sz"], [sums["st"] + theta * sums["v_score"]]])
        live = np.concatenate([np.arange(p), p + zero, [2 * p]])
        if whole:
            # The curvature of the complete data in place of the observed one.
            h = np.zeros((q, q)) - np.diag([0.0] * (q - 1) + [max(abs(h[-1, -1]), abs(score[-1]))])
            h[:p, :p], h[p : 2 * p, p : 2 * p] = -sums["whole_c"], -sums["whole_z"]
        # What a level has: its own coefficient's sums, or for a reference those of no other level.
        has = {}
        for term, level in levels:
            if (term, level) in design.terms:
                k = design.terms.index((term, level))
                has[term, level] = (sums["sz"][k], sums["few"][k])
            else:
                other = [k for k, (t, _) in enumerate(design.terms) if t == term]
                has[term, level] = tuple(sums[m][0] - sums[m][other].sum() for m in ("sz", "few"))
        return {
            "loglik": sums["loglik"] + sums["v_loglik"], "gradient": score[live], "hessian": h[np.ix_(live, live)],
            "live": live, "has": has,
            "gain": {t: sums[f"slope_{i}"] / max(sums[f"size_{i}"], 1e-300) for i, t in enumerate(closed)},
        }

    def spread(move: np.ndarray, live: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * p + 1)
        out[live] = move
        return out

    def uphill(x: np.ndarray, at: dict, move: np.ndarray) -> tuple[np.ndarray, dict] | None:
        move = move * min(1.0, 4.0 / max(np.max(np.abs(move)), 1e-300))
        scale = 1.0
        for _ in range(MAX_HALVINGS):
            to = x + scale * spread(move, at["live"])
            trial = evaluate(to, closed, zero)
            if trial["loglik"] > at["loglik"]:
                return to, trial
            scale /= 2
        return None

    def without(x: np.ndarray, more: Sequence[tuple[str, str]]) -> tuple[list, np.ndarray, dict, np.ndarray]:
        """The point with further levels closed, its coefficients moved to the references then in use."""
        now = [*closed, *more]
        zero, reference = _zero_part(design, now)
        to = x.copy()
        if not len(zero):
            # Nothing is left to inflate: the model is the one without a zero part.
            to[:p], to[p : 2 * p], to[2 * p] = nb.beta, 0.0, math.log(nb.theta)
            return now, zero, reference, to
        for term, level in reference.items():
            if level != design.reference[term] and (base := x[p + design.terms.index((term, level))]):
                own = [k for k, (t, _) in enumerate(design.terms) if t == term]
                to[p] += base
                for k in own:
                    to[p + k] -= base
        gone = np.setdiff1d(np.arange(p), zero)
        to[p + gone] = 0.0
        return now, zero, reference, to

    x = np.zeros(2 * p + 1)
    x[:p], x[2 * p] = nb.beta, math.log(nb.theta)
    x[p] = -3.0
    zero, reference = _zero_part(design, closed)
    at = evaluate(x, closed, zero)
    converged, iteration = False, 0
    refused: set[tuple[str, str]] = set()
    for iteration in range(1, max_iter + 1):
        leaving = [
            t for t, (slope, few) in at["has"].items()
            if t not in closed and t not in refused and opened.get(t, 0) < MAX_OPENINGS and slope < 0 and few < FEW
        ]
        if leaving:
            now, fewer, base, to = without(x, leaving)
            trial = evaluate(to, now, fewer)
            if trial["loglik"] >= at["loglik"] - 1e-12 * abs(at["loglik"]):
                closed, zero, reference, x, at = now, fewer, base, to, trial
                continue
            refused.update(leaving)  # the likelihood would fall here: try again from the next point
        move = _ascent(at["hessian"], at["gradient"])
        # Half the squared Newton decrement is the log-likelihood still to be gained.
        if 0.5 * float(move @ at["gradient"]) < tol:
            back = [t for t, gain in at["gain"].items() if gain > 1e-6 and opened.get(t, 0) < MAX_OPENINGS]
            if not back:
                converged = True
                break
            # A level that would gain opens with odds small enough for the gain to show.
            level = max(back, key=at["gain"].get)
            opened[level] = opened.get(level, 0) + 1
            kept = [t for t in closed if t != level]
            wider, base = _zero_part(design, kept)
            place = design.terms.index(level) if level in design.terms else None
            found = None
            for low in (-2.0, -4.0, -6.0, -8.0, -12.0):
                to = x.copy()
                if len(zero) == 0:
                    to[p] = low
                elif place is not None and base[level[0]] != level[1]:
                    to[p + place] = low
                else:
                    # The level is the reference again: the others move relative to it.
                    own = [k for k, (t, _) in enumerate(design.terms) if t == level[0] and k in wider]
                    to[p] += low
                    to[[p + k for k in own]] -= low
                trial = evaluate(to, kept, wider)
                if trial["loglik"] > at["loglik"]:
                    found = to, trial
                    break
            if found is None:
                converged = True  # the gain is lost in rounding
                break
            closed, zero, reference, (x, at) = kept, wider, base, found
            refused.clear()
            continue
        step = uphill(x, at, move)
        if step is None:
            step = uphill(x, at, _ascent(evaluate(x, closed, zero, True)["hessian"], at["gradient"]))
        if step is None:
            break
        x, at = step
        refused.clear()
    information = -at["hessian"]
    vcov = np.zeros((2 * p + 1, 2 * p + 1))
    vcov[np.ix_(at["live"], at["live"])] = np.linalg.pinv(information, hermitian=True)
    theta = math.exp(x[2 * p])
    variance = vcov[-1, -1]
    fit = Fit(
        model="ZINB",
        design=design,
        beta=x[:p],
        vcov=vcov[:p, :p],
        loglik=at["loglik"],
        theta=theta,
        se_theta=theta * math.sqrt(variance) if variance > 0 else None,
        zero=x[p : 2 * p],
        zero_vcov=vcov[p : 2 * p, p : 2 * p],
        iterations=iteration,
        converged=converged,
        closed=sorted(closed, key=levels.index) if len(zero) else levels,
        zero_live=[int(k) for k in zero],
        zero_reference=reference,
    )
    return _settled(fit, allow_unconverged)
