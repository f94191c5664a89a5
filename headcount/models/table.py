"""The model table, and how it is kept between fitting steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headcount.functions.columns import literal, name, recode

INTERCEPT = "(Intercept)"


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table that many jobs will read.

    The checkpoint goes to the shared folder that the session names in ``spark.checkpoint.dir``, so
    a lost executor costs a re-read and nothing else. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` its files go when the table does.
    """
    if not df.sparkSession.sparkContext.getCheckpointDir():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return df.checkpoint()


def model_table(
    df: DataFrame, y: str, factors: Sequence[str], complete: bool = True, weight: str | None = None
) -> DataFrame:
    """Exact weighted form of the regression data: (factors, y, n).

    Rows with an unknown outcome are dropped; rows with an unknown factor too unless ``complete``
    is off. All regressors are factors, so the size is bounded by level combinations times
    distinct outcomes, however many rows there are. ``weight`` names the row count of a table that
    is counted already, so that one counted table can serve several models.
    """
    keys = [*factors, "y"]
    known = " AND ".join(f"{name(c)} IS NOT NULL" for c in (keys if complete else ["y"]))
    # The test for unknowns is an aggregate on purpose. As a filter on the keys it would be pushed
    # below the projection that derives them, and every row would pay for the derivation twice.
    rows = "1L" if weight is None else name(weight)
    return (
        df.selectExpr(*[name(f) for f in factors], f"CAST({name(y)} AS BIGINT) AS y", f"{rows} AS n")
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.expr(f"count_if({known}) AS n_known"))
        .filter("n_known > 0")
        .drop("n_known")
    )


REFERENCE, ALL_ZERO = -1, -2

# A stored column of zeros. Parameters are read as get(array, column): with a column for an index
# Spark cannot fold the array into the expression, so the generated code is the same in every
# fitting step and compiles once.
ZERO = "i_"


def parameters(values: Sequence[float]) -> str:
    """Numbers as an array in SQL text."""
    return "array(" + ", ".join(literal(float(v)) for v in values) + ")"


def parameter(value: float) -> str:
    return f"get({parameters([value])}, {ZERO})"


@dataclass(frozen=True)
class Design:
    """Sufficient sums of a model table.

    ``patterns`` has a row per combination of levels: a coefficient index per factor (-1 for a level
    without one, -2 for a level whose outcome is always 0; index 0 is the intercept), the rows n,
    their total s and their zeros n0. ``values`` has the rows n of each positive outcome y. Every
    likelihood here is linear in the outcome given the pattern but for terms of y alone, so these two
    tables hold all that a fit needs.
    """

    patterns: DataFrame
    values: DataFrame
    index: dict[str, str]
    terms: list[tuple[str, str]]
    reference: dict[str, str]
    all_zero: list[tuple[str, str]]
    n: int
    n0: int
    mean: float
    variance: float
    seen: dict[str, list[str]]
    aliased: list[tuple[str, str]] = field(default_factory=list)
    no_zeros: list[tuple[str, str]] = field(default_factory=list)

    @property
    def fitted(self) -> DataFrame:
        """The patterns that take part in a fit. The others sit at their limit, a mean of 0."""
        df = self.patterns
        for term in {t for t, _ in self.all_zero}:
            df = df.filter(F.col(self.index[term]) != ALL_ZERO)
        return df

    def set_aside(self) -> str:
        """Whether a pattern has a level whose outcome is always 0."""
        tests = [f"{name(self.index[term])} = {ALL_ZERO}" for term in sorted({t for t, _ in self.all_zero})]
        return f"({' OR '.join(tests)})" if tests else "false"

    @property
    def p(self) -> int:
        return len(self.terms)

    def slots(self) -> list[str]:
        """Active coefficient of each factor, after the intercept."""
        return [ZERO, *[name(c) for c in self.index.values()]]

    def linear(self, coefficients: Sequence[float]) -> str:
        """Linear predictor. A reference slot is out of the array's bounds and adds nothing."""
        beta = parameters(coefficients)
        return "(" + " + ".join(f"coalesce(get({beta}, {slot}), 0D)" for slot in self.slots()) + ")"

    def kept_without(self, factor: str) -> list[int]:
        """Coefficients of the nested model that leaves one factor out."""
        return [i for i, (term, _) in enumerate(self.terms) if term != factor]


def _aliased(gram: np.ndarray) -> list[int]:
    """Columns that those before them already span, by elimination in their order."""
    a, out = gram.astype(float).copy(), []
    for k in range(len(a)):
        if a[k, k] <= 1e-9 * gram[k, k]:
            out.append(k)
            continue
        below = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(below, a[k, k + 1 :])
    return out


def build_design(
    table: DataFrame, factors: Mapping[str, Sequence[str]], set_aside_zero: bool = True
) -> Design:
    """Code a model table. ``factors`` gives each factor's level order; the first level that
    occurs with a positive total is the reference, levels that never occur get no coefficient.

    A level whose outcome is always 0 has no finite coefficient. Its limit, a mean of 0, fits its
    rows exactly, so they take no part in the fit and the level is listed in ``all_zero``; results
    count them at that limit. A linear model has no such trouble and turns ``set_aside_zero`` off. A
    level whose indicator the terms before it span is listed in ``aliased`` and gets no coefficient,
    one without any zero in ``no_zeros``.
    """
    names = list(factors)
    cells = keep(table)
    margins = (
        cells.unpivot(["y", "n"], names, "term", "level")
        .groupBy("term", "level")
        .agg(F.expr("sum(y * n) AS total"), F.expr("coalesce(sum(CASE WHEN y = 0 THEN n END), 0) AS zeros"))
        .collect()
        if names
        else []
    )
    totals = {(r["term"], r["level"]): r["total"] for r in margins}
    zeros = {(r["term"], r["level"]): r["zeros"] for r in margins}
    reference, all_zero, seen, usable = {}, [], {}, {}
    for f in names:
        unlisted = [level for term, level in totals if term == f and level not in factors[f]]
        if unlisted:
            raise ValueError(f"factor {f!r} has levels outside its level list: {unlisted}")
        seen[f] = [level for level in factors[f] if (f, level) in totals]
        usable[f] = [level for level in seen[f] if totals[f, level] > 0 or not set_aside_zero]
        if not usable[f]:
            raise ValueError(f"the outcome is 0 in every row, so factor {f!r} cannot be fitted")
        all_zero += [(f, level) for level in seen[f] if level not in usable[f]]
        reference[f] = usable[f][0]

    def coded(aliased: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
        terms, columns = [(INTERCEPT, "")], []
        for f in names:
            slots = {level: ALL_ZERO for level in seen[f] if level not in usable[f]}
            for level in usable[f]:
                if level == reference[f] or (f, level) in aliased:
                    slots[level] = REFERENCE
                else:
                    slots[level] = len(terms)
                    terms.append((f, level))
            columns.append(f"{recode(name(f), slots)} AS {name(f'i_{f}')}")
        index = [name(f"i_{f}") for f in names]
        rows = cells.selectExpr(*columns, f"0 AS {ZERO}", "y", "n").groupBy(ZERO, *index)
        sums = {"n": "sum(n)", "s": "sum(y * n)", "n0": "coalesce(sum(CASE WHEN y = 0 THEN n END), 0)"}
        return keep(rows.agg(*[F.expr(f"CAST({text} AS DOUBLE) AS {c}") for c, text in sums.items()])), terms

    values = cells.filter("y > 0").groupBy("y").agg(F.sum("n").alias("n"))
    values = keep(values.selectExpr(f"0 AS {ZERO}", "CAST(y AS DOUBLE) AS y", "CAST(n AS DOUBLE) AS n"))
    m = cells.selectExpr("sum(n) AS n", "sum(CASE WHEN y = 0 THEN n END) AS n0", "sum(y * n) AS s1").first()
    n, n0, mean = int(m["n"]), int(m["n0"] or 0), m["s1"] / m["n"]
    squares = values.selectExpr(f"sum(n * (y - {literal(float(mean))}) * (y - {literal(float(mean))})) AS v").first()["v"]
    variance = ((squares or 0.0) + n0 * mean * mean) / max(n - 1, 1)

    def design(aliased: list[tuple[str, str]]) -> Design:
        patterns, terms = coded(aliased)
        no_zeros = [t for t in terms[1:] if zeros[t] == 0] + [(f, reference[f]) for f in names if zeros[f, reference[f]] == 0]
        return Design(
            patterns, values, {f: f"i_{f}" for f in names}, terms, reference, all_zero, n, n0, mean, variance, seen, aliased, no_zeros
        )

    from headcount.models.fit import pair_sums

    plain = design([])
    gram = pair_sums(plain, plain.fitted, pair={"xx": "n"})["xx"]
    spanned = [plain.terms[k] for k in _aliased(gram)]
    return design(spanned) if spanned else plain
