"""Regression on all factors in DuckDB SQL, by another route than the Spark fits.

Nothing here inverts a matrix to take a step. One factor's levels are adjusted at a time, each
level on its own, and recursion repeats that until nothing moves; theta takes its turn as one more
block. Every level has a coefficient and there is no intercept: fitted means are unique even though
coefficients are not, and estimates are read off as differences from the reference level. Standard
errors come from Gauss-Jordan elimination, also by recursion.
"""

from __future__ import annotations


class Layout:
    """Numbering of all levels of some factors in one list."""

    def __init__(self, levels: dict[str, list[str]], places):
        self.factors = list(levels)
        self.offset, self.size = {}, 0
        for f in self.factors:
            self.offset[f] = self.size
            self.size += len(levels[f])
        self.ix = "[" + ", ".join(f"{places(f)} + {self.offset[f]}" for f in self.factors) + "]"
        self.levels = " UNION ALL ".join(
            f"SELECT {self.offset[f] + i + 1} AS idx, {j} AS fac, {i + 1} AS ord, '{f}' AS term, '{level}' AS level"
            for j, f in enumerate(self.factors)
            for i, level in enumerate(levels[f])
        )
        self.first = len(levels[self.factors[0]])


def cells(layout: Layout, known: str, tag: str = "") -> list[tuple[str, str]]:
    """Cells, level combinations, levels and the tail counts of the outcome."""
    return [
        (
            f"cell{tag}",
            f"SELECT {layout.ix} AS ix, total_contacts::DOUBLE AS y, COUNT(*)::DOUBLE AS n FROM people WHERE {known} GROUP BY ALL",
        ),
        (
            f"pats{tag}",
            f"SELECT ix, SUM(n) AS n, SUM(n * y) AS s, SUM(CASE WHEN y = 0 THEN n ELSE 0 END) AS n0 FROM cell{tag} GROUP BY ix",
        ),
        (f"lvs{tag}", layout.levels),
        (
            f"tj{tag}",
            f"""SELECT j::DOUBLE AS j, SUM(n) AS t
  FROM (SELECT y, SUM(n) AS n FROM cell{tag} GROUP BY y),
    (SELECT UNNEST(RANGE(0, (SELECT MAX(y) FROM cell{tag})::BIGINT)) AS j)
  WHERE y > j GROUP BY 1""",
        ),
    ]


ETA = "EXP(list_sum(list_transform(ix, lambda q: b[q])))"


def nb_fit(layout: Layout, sweeps: int, tag: str = "", theta: str = "") -> list[tuple[str, str]]:
    """Block-wise fit. ``theta`` is SQL for a fixed value, or empty to estimate it.

    The tables are ``it`` (the steps) and ``fin`` (the last one: coefficient list b and theta).
    """
    k = len(layout.factors)
    period = k + (not theta)
    start = f"LN({theta})" if theta else "0.0::DOUBLE"
    step = f"""SELECT step + 1, list(nb ORDER BY idx), ANY_VALUE(nlt) FROM (
    WITH cur AS (SELECT step, b, lt, EXP(lt) AS th FROM it{tag} WHERE step < {sweeps * period}),
    m AS (SELECT step % {period} AS ph, ix, n, s, th, {ETA} AS mu FROM cur, pats{tag}),
    up AS (SELECT ix[ph + 1] AS idx, SUM(th * (s - n * mu) / (th + mu))
        / SUM(th * mu * (s + n * th) / ((th + mu) * (th + mu))) AS d FROM m WHERE ph < {k} GROUP BY 1),
    sc AS (SELECT (SELECT SUM(t / (th + j)) FROM tj{tag}) + SUM(n * LN(th / (th + mu)) + n - (s + n * th) / (mu + th)) AS g,
        SUM(n / th - 2 * n / (mu + th) + (s + n * th) / ((mu + th) * (mu + th)))
          - (SELECT SUM(t / ((th + j) * (th + j))) FROM tj{tag}) AS h, th FROM m WHERE ph = {k} GROUP BY th)
    SELECT cur.step, idx, cur.b[idx] + COALESCE(up.d, 0) AS nb,
      cur.lt + COALESCE((SELECT -g * th / (th * th * h + th * g) FROM sc), 0) AS nlt
    FROM cur CROSS JOIN lvs{tag} LEFT JOIN up USING (idx)) GROUP BY step"""
    return [
        (
            f"it{tag}",
            f"""SELECT 0 AS step, list_transform(range(1, {layout.size + 1}),
      lambda i: CASE WHEN i <= {layout.first} THEN m0 ELSE 0.0::DOUBLE END) AS b, {start} AS lt
    FROM (SELECT LN(SUM(s) / SUM(n)) AS m0 FROM pats{tag})
  UNION ALL
  {step}""",
        ),
        (f"fin{tag}", f"SELECT b, EXP(lt) AS theta FROM it{tag} WHERE step = {sweeps * period}"),
        (
            f"fig{tag}",
            f"""SELECT ANY_VALUE(theta) AS theta, SUM(n) AS n,
    SUM(n * (LGAMMA(y + theta) - LGAMMA(theta) - LGAMMA(y + 1) + theta * LN(theta / (theta + mu))
      + CASE WHEN y > 0 THEN y * LN(mu / (theta + mu)) ELSE 0 END)) AS loglik,
    SUM(2 * n * (CASE WHEN y > 0 THEN y * LN(y / mu) ELSE 0 END - (y + theta) * LN((y + theta) / (mu + theta)))) AS deviance,
    1 / SQRT((SELECT SUM(t / ((theta + j) * (theta + j))) FROM tj{tag}, fin{tag})
      - SUM(n / theta - 2 * n / (mu + theta) + n * (y + theta) / ((mu + theta) * (mu + theta)))) AS se_theta
  FROM (SELECT y, n, theta, {ETA} AS mu FROM cell{tag}, fin{tag})""",
        ),
    ]


TERMS = [
    ("seen", "SELECT lvs.* FROM lvs WHERE idx IN (SELECT UNNEST(ix) FROM pats)"),
    ("base", "SELECT term, ARG_MIN(idx, ord) AS ref, ARG_MIN(level, ord) AS ref_level FROM seen GROUP BY term"),
    (
        "coefs",
        """SELECT 0 AS pos, '(Intercept)' AS term, '' AS level, 0 AS idx, 0 AS ref UNION ALL
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY idx) AS INTEGER), seen.term, level, idx, ref
    FROM seen JOIN base USING (term) WHERE idx <> ref""",
    ),
]


# Gauss-Jordan elimination of the square table gm (i, j, v) beside rhs (i, r) and the identity.
# ``inv`` has (pos, sol, var): the solution, and the diagonal of the inverse.
ELIMINATE = [
    (
        "gj",
        """SELECT 0 AS step, i, list_concat(list_append(list(v ORDER BY j), ANY_VALUE(r)),
      list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j)) AS line
    FROM gm JOIN rhs USING (i) GROUP BY i
  UNION ALL
  SELECT l.step + 1, l.i, CASE WHEN l.i = l.step
      THEN list_transform(l.line, lambda x: x / p.line[l.step + 1])
      ELSE list_transform(range(1, len(l.line) + 1), lambda q: l.line[q] - l.line[l.step + 1] * p.line[q] / p.line[l.step + 1]) END
    FROM gj l JOIN gj p ON p.i = l.step""",
    ),
    (
        "inv",
        """SELECT i AS pos, line[k + 1] AS sol, line[k + 2 + i] AS var
    FROM gj, (SELECT COUNT(*)::INTEGER AS k FROM rhs) WHERE step = k""",
    ),
]


def gram(weight: str, right: str, source: str) -> list[tuple[str, str]]:
    """Weighted cross-products of the level indicators, eliminated."""
    return [
        (
            "act",
            f"""SELECT c.pos, p.w, p.r, p.id FROM
    (SELECT ix, {weight} AS w, {right} AS r, ROW_NUMBER() OVER () AS id FROM {source}) p, coefs c
    WHERE c.idx = 0 OR list_contains(p.ix, c.idx)""",
        ),
        (
            "gm",
            """SELECT a.pos AS i, b.pos AS j, COALESCE(SUM(x.w), 0) AS v FROM coefs a, coefs b
    LEFT JOIN (SELECT u.pos AS pi, v.pos AS pj, SUM(u.w) AS w FROM act u JOIN act v ON u.id = v.id GROUP BY 1, 2) x
      ON x.pi = a.pos AND x.pj = b.pos GROUP BY 1, 2""",
        ),
        ("rhs", "SELECT pos AS i, SUM(r) AS r FROM act GROUP BY 1"),
        *ELIMINATE,
    ]


ZETA = "1 / (1 + EXP(-list_sum(list_transform(ix, lambda q: c[q]))))"


def zinb_fit(layout: Layout, sweeps: int) -> list[tuple[str, str]]:
    """Block-wise fit of the zero-inflated model: count levels, zero levels and theta in turn.

    A zero is a count zero with probability 1 - r. A step divides by the curvature, or where that
    is small by a fifth of the curvature with r held fixed, which is always positive.
    """
    k = len(layout.factors)
    period = 2 * k + 1
    step = f"""SELECT step + 1, list(nb ORDER BY idx), list(nc ORDER BY idx), ANY_VALUE(nlt) FROM (
    WITH cur AS (SELECT step, step % {period} AS ph, b, c, lt, EXP(lt) AS th FROM zit WHERE step < {sweeps * period}),
    m0 AS (SELECT ph, ix, n, n0, n - n0 AS np, s, th, {ETA} AS mu, {ZETA} AS pi FROM cur, pats),
    m AS (SELECT *, th + mu AS d, pi / (pi + (1 - pi) * POW(th / (th + mu), th)) AS r FROM m0),
    up AS (SELECT ix[ph + 1] AS idx, SUM(th * (s - np * mu) / d - n0 * (1 - r) * th * mu / d) AS g,
        SUM(th * mu * (s + np * th) / (d * d) + n0 * (1 - r) * th * th * mu / (d * d)) AS held,
        SUM(n0 * r * (1 - r) * th * th * mu * mu / (d * d)) AS less FROM m WHERE ph < {k} GROUP BY 1),
    uz AS (SELECT ix[ph - {k} + 1] AS idx, SUM(n0 * r - n * pi) AS g, SUM(n * pi * (1 - pi)) AS held,
        SUM(n0 * r * (1 - r)) AS less FROM m WHERE ph >= {k} AND ph < {2 * k} GROUP BY 1),
    sc AS (SELECT th, (SELECT SUM(t / (th + j)) FROM tj)
          + SUM(np * (LN(th / d) + 1) - (s + np * th) / d + n0 * (1 - r) * (LN(th / d) + mu / d)) AS g,
        SUM(np / th - 2 * np / d + (s + np * th) / (d * d)
          + n0 * ((1 - r) * mu * mu / (th * d * d) + r * (1 - r) * (LN(th / d) + mu / d) * (LN(th / d) + mu / d)))
          - (SELECT SUM(t / ((th + j) * (th + j))) FROM tj) AS h FROM m WHERE ph = {2 * k} GROUP BY th)
    SELECT cur.step, idx, cur.b[idx] + COALESCE(up.g / GREATEST(up.held - up.less, 0.2 * up.held), 0) AS nb,
      cur.c[idx] + COALESCE(uz.g / GREATEST(uz.held - uz.less, 0.2 * uz.held), 0) AS nc,
      cur.lt + COALESCE((SELECT g / GREATEST(-th * h - g, 0.2 * ABS(th * h)) FROM sc), 0) AS nlt
    FROM cur CROSS JOIN lvs LEFT JOIN up USING (idx) LEFT JOIN uz USING (idx)) GROUP BY step"""
    spread = "list_transform(range(1, {0}), lambda i: CASE WHEN i <= {1} THEN {2} ELSE 0.0::DOUBLE END)"
    return [
        (
            "zit",
            f"""SELECT 0 AS step, {spread.format(layout.size + 1, layout.first, "m0")} AS b,
      {spread.format(layout.size + 1, layout.first, "-2.0::DOUBLE")} AS c, 0.5::DOUBLE AS lt
    FROM (SELECT LN(SUM(s) / SUM(n)) AS m0 FROM pats)
  UNION ALL
  {step}""",
        ),
        ("zfin", f"SELECT b, c, EXP(lt) AS theta FROM zit WHERE step = {sweeps * period}"),
        (
            "zfit",
            f"""SELECT *, theta + mu AS d, pi / (pi + (1 - pi) * POW(theta / (theta + mu), theta)) AS r
    FROM (SELECT ix, n, n0, n - n0 AS np, s, theta, {ETA} AS mu, {ZETA} AS pi FROM pats, zfin)""",
        ),
        (
            "zfig",
            f"""SELECT ANY_VALUE(theta) AS theta, SUM(n) AS n, SUM(n * CASE WHEN y = 0
      THEN LN(pi + (1 - pi) * POW(theta / (theta + mu), theta))
      ELSE LN(1 - pi) + LGAMMA(y + theta) - LGAMMA(theta) - LGAMMA(y + 1) + theta * LN(theta / (theta + mu))
        + y * LN(mu / (theta + mu)) END) AS loglik
    FROM (SELECT y, n, theta, {ETA} AS mu, {ZETA} AS pi FROM cell, zfin)""",
        ),
    ]


def zinb_terms() -> list[tuple[str, str]]:
    """``zest`` (part, term, level, estimate, se) and ``zse`` (se_theta): errors from the curvature
    of the likelihood in all coefficients and log(theta) together. p is the position of log(theta)."""
    return [
        *TERMS,
        ("size", "SELECT COUNT(*)::INTEGER AS k FROM coefs"),
        (
            "zcoefs",
            """SELECT 'count' AS part, pos, term, level, idx, ref FROM coefs
    UNION ALL SELECT 'zero', pos + k, term, level, idx, ref FROM coefs, size
    UNION ALL SELECT 'theta', 2 * k, '', '', 0, 0 FROM size""",
        ),
        (
            "zw",
            """SELECT ROW_NUMBER() OVER () AS id, ix,
      n0 * r * (1 - r) * e * e + th_e AS cc, n0 * r * (1 - r) * e * -1 AS cz, n0 * r * (1 - r) - n * pi * (1 - pi) AS zz,
      theta * (n0 * r * (1 - r) * e * g + (s - np * mu) * mu / (d * d) - n0 * (1 - r) * mu * mu / (d * d)) AS ct,
      -theta * n0 * r * (1 - r) * g AS zt,
      theta * theta * (np / theta - 2 * np / d + (s + np * theta) / (d * d)
        + n0 * ((1 - r) * mu * mu / (theta * d * d) + r * (1 - r) * g * g)) AS tt
    FROM (SELECT *, -theta * mu / d AS e, LN(theta / d) + mu / d AS g,
      -theta * mu * (s + np * theta) / (d * d) - n0 * (1 - r) * theta * theta * mu / (d * d) AS th_e FROM zfit)""",
        ),
        (
            "zact",
            "SELECT w.*, c.pos, c.part FROM zw w, zcoefs c WHERE c.idx = 0 OR list_contains(w.ix, c.idx)",
        ),
        (
            "zsum",
            """SELECT u.pos AS pi, v.pos AS pj, SUM(CASE
        WHEN u.part = 'theta' AND v.part = 'theta' THEN u.tt
        WHEN u.part = 'theta' OR v.part = 'theta' THEN CASE WHEN u.part = 'count' OR v.part = 'count' THEN u.ct ELSE u.zt END
        WHEN u.part = 'count' AND v.part = 'count' THEN u.cc
        WHEN u.part = 'zero' AND v.part = 'zero' THEN u.zz ELSE u.cz END) AS w
    FROM zact u JOIN zact v ON u.id = v.id GROUP BY 1, 2""",
        ),
        (
            "gm",
            """SELECT a.pos AS i, b.pos AS j, -COALESCE(x.w, 0) + CASE WHEN a.part = 'theta' AND b.part = 'theta'
        THEN (SELECT SUM(theta * theta * t / ((theta + j) * (theta + j))) FROM tj, zfin) ELSE 0 END AS v
    FROM zcoefs a CROSS JOIN zcoefs b LEFT JOIN zsum x ON x.pi = a.pos AND x.pj = b.pos""",
        ),
        ("rhs", "SELECT pos AS i, 0.0::DOUBLE AS r FROM zcoefs"),
        *ELIMINATE,
        (
            "zest",
            """SELECT part, pos, term, level, SQRT(var) AS se, CASE
        WHEN idx = 0 AND part = 'count' THEN (SELECT SUM(b[ref]) FROM base, zfin)
        WHEN idx = 0 THEN (SELECT SUM(c[ref]) FROM base, zfin)
        WHEN part = 'count' THEN (SELECT b[idx] - b[ref] FROM zfin)
        ELSE (SELECT c[idx] - c[ref] FROM zfin) END AS estimate
    FROM zcoefs JOIN inv USING (pos) WHERE part <> 'theta'""",
        ),
        ("zse", "SELECT theta * SQRT(var) AS se_theta FROM zfin, inv WHERE pos = 2 * (SELECT k FROM size)"),
    ]


def nb_terms() -> list[tuple[str, str]]:
    """(pos, term, level, estimate, se) of the fit in ``fin``."""
    return [
        *TERMS,
        ("fitted", f"SELECT ix, n, s, theta, {ETA} AS mu FROM pats, fin"),
        *gram("n * mu / (1 + mu / theta)", "0.0::DOUBLE", "fitted"),
        (
            "est",
            """SELECT pos, term, level, SQRT(var) AS se, CASE WHEN pos = 0
      THEN (SELECT SUM(b[ref]) FROM base, fin) ELSE (SELECT b[idx] - b[ref] FROM fin) END AS estimate
    FROM coefs JOIN inv USING (pos)""",
        ),
    ]


def ols_terms() -> list[tuple[str, str]]:
    return [
        *TERMS,
        *gram("n", "s", "pats"),
        (
            "rss",
            """SELECT SUM(n) AS n, SUM(n * (y - f) * (y - f)) AS rss FROM (
      SELECT c.n, c.y, (SELECT SUM(sol) FROM inv JOIN coefs USING (pos) WHERE idx = 0 OR list_contains(c.ix, idx)) AS f FROM cell c)""",
        ),
        (
            "est",
            """SELECT pos, term, level, sol AS estimate,
      SQRT(var * (SELECT rss / (n - (SELECT COUNT(*) FROM coefs)) FROM rss)) AS se FROM coefs JOIN inv USING (pos)""",
        ),
    ]
