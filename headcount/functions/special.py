"""Gamma-family functions and negative binomial terms as SQL text.

Spark has no log-gamma or its derivatives. For a positive argument the recurrence moves it up by
eight, where a short asymptotic series is good to about 1e-12. The cost does not depend on the
argument and nothing leaves generated code. Arguments should be plain column names: they occur many
times in a formula.
"""

from __future__ import annotations

import math

_SHIFT = 8

# -- fixed values: series coefficients in 1/z^2, lowest power first --------------
_LGAMMA = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_DIGAMMA = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)
_TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)


def _series(coefficients, r: str) -> str:
    text = f"({coefficients[-1]!r}D)"
    for c in reversed(coefficients[:-1]):
        text = f"(({c!r}D) + {r} * {text})"
    return text


def _steps(x: str) -> list[str]:
    return [f"({x})"] + [f"({x} + {i}D)" for i in range(1, _SHIFT)]


def lgamma(x: str) -> str:
    z = f"({x} + {_SHIFT}D)"
    r = f"(1D / ({z} * {z}))"
    below = " * ".join(_steps(x))
    half_log_2pi = 0.5 * math.log(2 * math.pi)
    return f"(({z} - 0.5D) * ln({z}) - {z} + {half_log_2pi!r}D + {_series(_LGAMMA, r)} / {z} - ln({below}))"


def digamma(x: str) -> str:
    z = f"({x} + {_SHIFT}D)"
    r = f"(1D / ({z} * {z}))"
    below = " - ".join(f"1D / {s}" for s in _steps(x))
    return f"(ln({z}) - 0.5D / {z} - {r} * {_series(_DIGAMMA, r)} - {below})"


def trigamma(x: str) -> str:
    z = f"({x} + {_SHIFT}D)"
    r = f"(1D / ({z} * {z}))"
    below = " + ".join(f"1D / ({s} * {s})" for s in _steps(x))
    return f"(1D / {z} + 0.5D * {r} + {r} * {_series(_TRIGAMMA, r)} / {z} + {below})"


def nb_log_pmf(y: str, mu: str, theta: str) -> str:
    """log P(Y = y) for mean mu and variance mu + mu^2 / theta. A mean of 0 puts all mass on 0."""
    return (
        f"({lgamma(f'{y} + {theta}')} - {lgamma(theta)} - {lgamma(f'{y} + 1D')}"
        f" + {theta} * ln({theta} / ({theta} + {mu}))"
        f" + CASE WHEN {y} > 0 THEN {y} * ln({mu} / ({theta} + {mu})) ELSE 0D END)"
    )


def poisson_log_pmf(y: str, mu: str) -> str:
    """log P(Y = y) for mean mu. A mean of 0 puts all mass on 0."""
    return f"(CASE WHEN {y} > 0 THEN {y} * ln({mu}) ELSE 0D END - {mu} - {lgamma(f'{y} + 1D')})"


def nb_zero(mu: str, theta: str) -> str:
    """P(Y = 0)."""
    return f"exp({theta} * ln({theta} / ({theta} + {mu})))"


def nb_unit_deviance(y: str, mu: str, theta: str) -> str:
    """Twice the log-likelihood lost against a mean equal to the observation."""
    return (
        f"(2D * (CASE WHEN {y} > 0 THEN {y} * ln({y} / {mu}) ELSE 0D END"
        f" - ({y} + {theta}) * ln(({y} + {theta}) / ({mu} + {theta}))))"
    )


def nb_theta_score(y: str, mu: str, theta: str) -> str:
    """Derivative of the log-likelihood in theta."""
    return (
        f"({digamma(f'{y} + {theta}')} - {digamma(theta)} + ln({theta} / ({theta} + {mu}))"
        f" + 1D - ({y} + {theta}) / ({mu} + {theta}))"
    )


def nb_theta_curvature(y: str, mu: str, theta: str) -> str:
    """Second derivative of the log-likelihood in theta."""
    return (
        f"({trigamma(f'{y} + {theta}')} - {trigamma(theta)} + 1D / {theta} - 2D / ({mu} + {theta})"
        f" + ({y} + {theta}) / (({mu} + {theta}) * ({mu} + {theta})))"
    )
