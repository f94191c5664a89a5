"""The same results in DuckDB SQL, written on their own from the definitions.

``survey`` and ``soc`` are the stand-in tables; ``people`` is the analysis table.
"""

from __future__ import annotations

from headcount.plans import oracle_models as om
from headcount.plans.oracle_tables import PEOPLE, SOC, SURVEY

DIGITS = 6
FACE = ["f2f_0_4", "f2f_5_17", "f2f_18_69", "f2f_70"]
PHYS = ["phys_0_4", "phys_5_17", "phys_18_69", "phys_70"]
TOTALS = ["total_face_to_face", "total_physical", "total_contacts"]
BY_CONTACT = ["total_0to4", "total_5to17", "total_18to69", "total_70over"]
CONTACT_BANDS = ["0 - 4", "5 - 17", "18 - 69", "70+"]
Z95 = "1.959963984540054"

# -- fixed values: level order, as published results use it ---------------------
LEVELS = {
    "age3": ["0 - 4", "5 - 17", "23 - 29", "30 - 39", "40 - 49", "50 - 59", "60 - 69", "70+"],
    "sex2": ["Male", "Female"],
    "household_size2": ["1", "2", "3", "4", "5+"],
    "Children": ["No", "Yes"],
    "yesterday2": ["Weekday", "Weekend"],
    "occupation2": ["Other", "HCW", "Keyworker"],
    "selfisolation_un": ["No", "Yes, am now", "Yes, but have stopped", "Prefer not to say", "UNK"],
}


def _with(*tables: tuple[str, str]) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({sql})" for n, sql in tables)


_SURVEY = ("survey", SURVEY)
_SOC = ("soc", SOC)
_PEOPLE = ("people", PEOPLE)


def on_survey(sql: str, *tables) -> str:
    return f"{_with(_SURVEY, *tables)}\n{sql}"


def on_people(sql: str, *tables) -> str:
    return f"{_with(_SURVEY, _PEOPLE, *tables)}\n{sql}"


# The analysis table with an outcome of 0 for everyone of one occupation.
_ZEROED = "SELECT * REPLACE (CASE WHEN occupation2 = 'HCW' THEN 0 ELSE total_contacts END AS total_contacts) FROM everyone"


def on_zeroed(sql: str, *tables) -> str:
    return f"{_with(_SURVEY, ('everyone', PEOPLE), ('people', _ZEROED), *tables)}\n{sql}"


_RARE = (
    "SELECT * REPLACE (CASE WHEN occupation2 = 'HCW' AND total_contacts = 0 AND respondent_id % 16 <> 0 THEN 1 "
    "ELSE total_contacts END AS total_contacts) FROM everyone"
)


def on_rare(sql: str, *tables) -> str:
    return f"{_with(_SURVEY, ('everyone', PEOPLE), ('people', _RARE), *tables)}\n{sql}"


def r(x: str, digits: int = DIGITS) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), {digits})"


rounded = r


def stats(v: str, names: str) -> str:
    """Select list of summary statistics of column ``v``."""
    known = {
        "mean": r(f"AVG({v})"),
        "median": r(f"MEDIAN({v})"),
        "sd": r(f"STDDEV_SAMP({v})"),
        "min": f"MIN({v})",
        "max": f"MAX({v})",
        "q25": r(f"QUANTILE_CONT({v}, 0.25)"),
        "q75": r(f"QUANTILE_CONT({v}, 0.75)"),
        "iqr": r(f"QUANTILE_CONT({v}, 0.75) - QUANTILE_CONT({v}, 0.25)"),
        "total": f"CAST(SUM({v}) AS BIGINT)",
        "n": "COUNT(*)",
    }
    return ", ".join(f'{known[s]} AS "{s}"' for s in names.split())


FULL = "mean median sd min max q25 q75 n"


def stack(table: str, cols: list[str], keys: str = "", name: str = "variable", value: str = "v", labels=None) -> str:
    labels = labels or cols
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{label}' AS {name}, {c} AS {value} FROM {table}" for c, label in zip(cols, labels)
    )


def price_stats(v: str, digits: int) -> str:
    """All statistics of a measured column."""
    made = {"mean": "AVG({})", "median": "MEDIAN({})", "sd": "STDDEV_SAMP({})", "min": "MIN({})", "max": "MAX({})"}
    made |= {"q25": "QUANTILE_CONT({}, 0.25)", "q75": "QUANTILE_CONT({}, 0.75)"}
    return ", ".join(f"{r(sql.format(v), digits)} AS {s}" for s, sql in made.items()) + ", COUNT(*) AS n"


def equal_bins(value: str, by: str, source: str, shared: bool) -> str:
    """30 bins over the range of all rows or of each group."""
    part = "" if shared else f"PARTITION BY {by}"
    return f"""SELECT {by}, bin, {r("lo + (bin - 1) * step")} AS lo, {r("lo + bin * step")} AS hi, n,
  {r(f"n / (SUM(n) OVER (PARTITION BY {by}) * step)")} AS density FROM (
  SELECT {by}, CAST(LEAST(FLOOR((v - lo) / step), 29) + 1 AS INTEGER) AS bin, lo, step, COUNT(*) AS n FROM (
    SELECT *, (hi - lo) / 30 AS step FROM (
      SELECT {by}, {value}::DOUBLE AS v, MIN({value}::DOUBLE) OVER ({part}) AS lo, MAX({value}::DOUBLE) OVER ({part}) AS hi FROM {source}))
  GROUP BY ALL)"""


def level_place(col: str, factor: str) -> str:
    cases = " ".join(f"WHEN '{level}' THEN {i}" for i, level in enumerate(LEVELS[factor], start=1))
    return f"CAST(CASE {col} {cases} END AS INTEGER)"


def frequency(source: str, keys: str, order: str = "value") -> str:
    """Frequency table of (keys, value) rows."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}value, n,
  {r(f"100.0 * n / SUM(n) OVER ({part})")} AS raw_pct,
  {r(f"CASE WHEN value IS NOT NULL THEN 100.0 * n / SUM(CASE WHEN value IS NOT NULL THEN n END) OVER ({part}) END")} AS valid_pct,
  {r(f"CASE WHEN value IS NOT NULL THEN 100.0 * SUM(n) OVER ({part} ORDER BY {order} NULLS LAST) / SUM(CASE WHEN value IS NOT NULL THEN n END) OVER ({part}) END")} AS cum_pct
FROM (SELECT {lead}value, COUNT(*) AS n FROM ({source}) GROUP BY ALL)"""


def mixing(cols: list[str], names: str) -> str:
    return on_people(
        f"SELECT age_respondent, age_contact, {stats('v', names)} FROM long WHERE v >= 0 GROUP BY 1, 2",
        ("long", stack("people", cols, "age3 AS age_respondent", "age_contact", labels=CONTACT_BANDS)),
    )


# -- negative binomial models ------------------------------------------------------
# The score of theta for fitted level means m: sum over j of (rows with y > j) / (theta + j)
# plus sum over levels of n * ln(theta / (theta + m)). It falls through its root, so bisection
# on log(theta) finds it.


def nb_tables(level: str, where: str, place: str = "1") -> list[tuple[str, str]]:
    return [
        (
            "obs",
            f"SELECT {level} AS lev, {place} AS ord, total_contacts AS y, COUNT(*) AS n FROM people WHERE {where} GROUP BY ALL",
        ),
        (
            "lv",
            "SELECT lev, ord, SUM(n)::DOUBLE AS n, SUM(n * y)::DOUBLE AS s, SUM(n * y)::DOUBLE / SUM(n) AS m FROM obs GROUP BY 1, 2",
        ),
        ("js", "SELECT UNNEST(RANGE(0, (SELECT MAX(y) FROM obs)::BIGINT)) AS j"),
        ("tails", "SELECT j::DOUBLE AS j, SUM(n)::DOUBLE AS t FROM js, obs WHERE y > j GROUP BY 1"),
        (
            "bis",
            """SELECT 0 AS i, LN(1e-4::DOUBLE) AS lo, LN(1e7::DOUBLE) AS hi
    UNION ALL
    SELECT i + 1,
      CASE WHEN score > 0 THEN (lo + hi) / 2 ELSE lo END,
      CASE WHEN score > 0 THEN hi ELSE (lo + hi) / 2 END
    FROM (SELECT i, lo, hi,
        (SELECT SUM(t / (EXP((lo + hi) / 2) + j)) FROM tails)
        + (SELECT SUM(n * LN(EXP((lo + hi) / 2) / (EXP((lo + hi) / 2) + m))) FROM lv) AS score
      FROM bis WHERE i < 80)""",
        ),
        ("th", "SELECT EXP((lo + hi) / 2) AS theta FROM bis WHERE i = 80"),
        (
            "info",
            """SELECT theta, 1 / SQRT((SELECT SUM(t / ((theta + j) * (theta + j))) FROM tails)
        - (SELECT SUM(n / theta - 2 * n / (m + theta) + (s + n * theta) / ((m + theta) * (m + theta))) FROM lv)) AS se_theta
      FROM th""",
        ),
        (
            "ll",
            """SELECT SUM(n) AS n,
        SUM(n * (LGAMMA(y + theta) - LGAMMA(theta) - LGAMMA(y + 1) + theta * LN(theta / (theta + m))
          + CASE WHEN y > 0 THEN y * LN(m / (theta + m)) ELSE 0 END)) AS loglik,
        SUM(2 * n * (CASE WHEN y > 0 THEN y * LN(y / m) ELSE 0 END - (y + theta) * LN((y + theta) / (m + theta)))) AS deviance
      FROM (SELECT o.y::DOUBLE AS y, o.n::DOUBLE AS n, l.m FROM obs o JOIN lv l USING (lev)), th""",
        ),
        ("w", "SELECT lev, ord, n, m, n * m / (1 + m / theta) AS w, theta FROM lv, th"),
        ("ref", "SELECT m AS m0, w AS w0, lev AS lev0 FROM w ORDER BY ord LIMIT 1"),
    ]


NULL_TABLES = nb_tables("''", "total_contacts IS NOT NULL")


def factor_tables(f: str) -> list[tuple[str, str]]:
    return nb_tables(f, f"{f} IS NOT NULL", level_place(f, f))


def nb_coef(f: str) -> str:
    return on_people(
        f"""SELECT CASE WHEN lev = lev0 THEN '(Intercept)' ELSE lev END AS level,
  {r("CASE WHEN lev = lev0 THEN LN(m) ELSE LN(m / m0) END")} AS estimate,
  {r("CASE WHEN lev = lev0 THEN SQRT(1 / w) ELSE SQRT(1 / w + 1 / w0) END")} AS se,
  {r("theta")} AS theta
FROM w, ref""",
        *factor_tables(f),
    )


def nb_irr(f: str) -> str:
    se = "SQRT(1 / w + 1 / w0)"
    other = "CASE WHEN lev <> lev0 THEN {} END"
    return on_people(
        f"""SELECT lev AS level, ord AS level_ord, lev = lev0 AS reference, {r("m / m0")} AS irr,
  {r(other.format(f"EXP(LN(m / m0) - {Z95} * {se})"))} AS conf_low,
  {r(other.format(f"EXP(LN(m / m0) + {Z95} * {se})"))} AS conf_high,
  {r(other.format(se))} AS se_log,
  CAST(ll.n AS BIGINT) AS n, {r("loglik")} AS loglik, {r("deviance")} AS deviance,
  {r("-2 * loglik + 2 * ((SELECT COUNT(*) FROM lv) + 1)")} AS aic
FROM w, ref, ll""",
        *factor_tables(f),
    )


def nb_lrt(f: str) -> str:
    return on_people(
        f"""SELECT '{f}' AS term, COUNT(*) - 1 AS df,
  {r("2 * SUM(n * m * LN(m / c) - n * (m + theta) * LN((m + theta) / (c + theta)))")} AS statistic
FROM w, (SELECT SUM(s) / SUM(n) AS c FROM lv)""",
        *factor_tables(f),
    )


PMF0 = """EXP(LGAMMA(k + theta) - LGAMMA(theta) - LGAMMA(k + 1) + theta * LN(theta / (theta + m))
  + k * LN(m / (theta + m)))"""
NB_NULL = (
    "nb",
    f"SELECT k::INTEGER AS x, {PMF0} AS prob FROM (SELECT UNNEST(RANGE(0, (SELECT MAX(y) + 1 FROM obs)::BIGINT)) AS k), lv, th",
)
OBSERVED = (
    "observed",
    "SELECT total_contacts::INTEGER AS x, COUNT(*) / (SUM(COUNT(*)) OVER ())::DOUBLE AS p FROM people GROUP BY 1",
)
OLS = (
    "ols",
    """SELECT x, SUM(n) / (SUM(SUM(n)) OVER ())::DOUBLE AS p FROM
    (SELECT ROUND_EVEN(AVG(total_contacts), 0)::INTEGER AS x, COUNT(*) AS n FROM people
     WHERE age3 IS NOT NULL GROUP BY age3) GROUP BY 1""",
)


ALL_KNOWN = " AND ".join(f"{f} IS NOT NULL" for f in LEVELS)


def _layout(*left_out: str) -> om.Layout:
    return om.Layout({f: v for f, v in LEVELS.items() if f not in left_out}, lambda f: level_place(f, f))


def multi_nb() -> list[tuple[str, str]]:
    layout = _layout()
    return [*om.cells(layout, ALL_KNOWN), *om.nb_fit(layout, 60)]


def lrt_tables() -> list[tuple[str, str]]:
    """``lrt``: the test of each factor against the model that leaves it out, theta held."""
    reduced, rows = [], ["SELECT '<none>' AS term, NULL::INTEGER AS df, deviance, NULL::DOUBLE AS statistic FROM fig"]
    for i, f in enumerate(LEVELS):
        layout, tag = _layout(f), f"_{i}"
        reduced += om.cells(layout, ALL_KNOWN, tag) + om.nb_fit(layout, 30, tag, "(SELECT theta FROM fin)")
        df = f"(SELECT COUNT(*) - 1 FROM seen WHERE term = '{f}')"
        rows.append(
            f"SELECT '{f}', CAST({df} AS INTEGER), x.deviance, x.deviance - fig.deviance FROM fig{tag} x, fig"
        )
    return [*multi_nb(), *om.TERMS, *reduced, ("lrt", " UNION ALL ".join(rows))]


def lrt(digits: int) -> str:
    return f"SELECT term, df, {r('deviance', digits)} AS deviance, {r('statistic', digits)} AS statistic, TRUE AS converged FROM lrt"


def with_tail(table: str) -> str:
    """A distribution and, without x, what its listed values leave."""
    return f"""SELECT x, {r("prob")} AS prob FROM {table}
UNION ALL SELECT NULL, {r("GREATEST(0, 1 - SUM(prob))")} FROM {table}"""


def multi_models() -> dict[str, str]:
    """Fits on all factors."""
    q = {}
    coef = f"""SELECT term, level, {r("estimate")} AS estimate, {r("se")} AS se, {r("estimate / se", 5)} AS z FROM est"""
    q["mdl_nb_coef"] = on_people(coef, *multi_nb(), *om.nb_terms())
    q["mdl_ols_coef"] = on_people(coef, *om.cells(_layout(), ALL_KNOWN), *om.ols_terms())
    p = "(SELECT COUNT(*) FROM coefs)"
    q["mdl_nb_fit"] = on_people(
        f"""SELECT CAST(n AS BIGINT) AS n, CAST({p} + 1 AS INTEGER) AS p, {r("theta")} AS theta, {r("se_theta")} AS se_theta,
  {r("loglik")} AS loglik, {r("deviance")} AS deviance, {r(f"-2 * loglik + 2 * ({p} + 1)")} AS aic, TRUE AS converged FROM fig""",
        *multi_nb(),
        *om.TERMS,
    )
    q["mdl_theta_ci_multi"] = on_people(
        f"""SELECT {r("theta")} AS theta, {r("se_theta")} AS se_theta, {r(f"theta - {Z95} * se_theta")} AS conf_low,
  {r(f"theta + {Z95} * se_theta")} AS conf_high FROM fig""",
        *multi_nb(),
    )
    q["mdl_irr"] = on_people(
        f"""SELECT term, level, reference, {r("EXP(estimate)")} AS ratio, {r(f"EXP(estimate - {Z95} * se)")} AS conf_low,
  {r(f"EXP(estimate + {Z95} * se)")} AS conf_high, {r("se")} AS se_log, CAST(n AS BIGINT) AS n,
  {r(f"-2 * loglik + 2 * ({p} + 1)")} AS aic, {r("deviance")} AS deviance, {r("loglik")} AS loglik
FROM (SELECT term, level, FALSE AS reference, estimate, se FROM est UNION ALL
  SELECT term, ref_level, TRUE, 0.0, NULL FROM base), fig""",
        *multi_nb(),
        *om.nb_terms(),
    )
    tested = lrt_tables()
    q["mdl_lrt"] = on_people(lrt(5), *tested)
    # With one factor the means are those of its levels. Outcomes are 0 or 1, so y ln y is 0.
    q["mdl_lrt_poisson"] = on_people(
        f"""SELECT '<none>' AS term, NULL::INTEGER AS df, {r("-2 * SUM(s * LN(s / n))", 5)} AS deviance, NULL::DOUBLE AS statistic, TRUE AS converged,
  'Poisson' AS model FROM lv
UNION ALL SELECT 'age3', CAST(COUNT(*) - 1 AS INTEGER), {r("-2 * SUM(s) * LN(SUM(s) / SUM(n))", 5)},
  {r("2 * SUM(s * LN(s / n)) - 2 * SUM(s) * LN(SUM(s) / SUM(n))", 5)}, TRUE, 'Poisson' FROM lv""",
        (
            "lv",
            "SELECT age3, COUNT(*)::DOUBLE AS n, SUM(LEAST(total_contacts, 1))::DOUBLE AS s FROM people "
            "WHERE age3 IS NOT NULL AND total_contacts IS NOT NULL GROUP BY 1",
        ),
    )
    q["mdl_lrt_allzero"] = on_zeroed(lrt(4), *tested)
    # The upper tail of chi-square by the series of the lower incomplete gamma function.
    q["mdl_lrt_pvalue"] = on_people(
        f"""SELECT term, df, {r("CASE WHEN df IS NULL THEN NULL WHEN statistic <= 0 THEN 1 ELSE GREATEST(0, 1 - below) END", 7)} AS p_value
FROM lrt LEFT JOIN (
  SELECT term, SUM(EXP((df / 2.0 + k) * LN(statistic / 2) - statistic / 2 - LGAMMA(df / 2.0 + k + 1))) AS below
  FROM (SELECT *, UNNEST(RANGE(0, CAST(statistic / 2 + 50 * SQRT(statistic / 2) + 100 AS BIGINT))) AS k FROM lrt WHERE statistic > 0)
  GROUP BY term) USING (term)""",
        *tested,
    )
    pmf = PMF0.replace("* LN(m /", "* LN(mu /").replace("+ m)", "+ mu)")
    ks = "(SELECT UNNEST(RANGE(0, (SELECT MAX(y) + 1 FROM cell)::BIGINT)) AS k)"
    nbfit = ("nbfit", f"SELECT n, n0, theta, {om.ETA} AS mu FROM pats, fin")
    ndist = ("ndist", f"SELECT CAST(k AS INTEGER) AS x, SUM(n * {pmf}) / SUM(n) AS prob FROM nbfit, {ks} GROUP BY k")
    q["dist_nb"] = on_people(with_tail("ndist"), *multi_nb(), nbfit, ndist)
    q["dist_nb_allzero"] = on_zeroed(with_tail("ndist"), *multi_nb(), nbfit, ndist)
    q["dist_zero_allzero"] = on_zeroed(
        f"""SELECT 'Observed' AS model, {r("SUM(n0)", 5)} AS zeros FROM pats
UNION ALL SELECT 'NB', {r("SUM(n * POW(theta / (theta + mu), theta))", 5)} FROM nbfit""",
        *multi_nb(),
        nbfit,
    )
    q["dist_ols_multi"] = on_people(
        f"""SELECT x, {r("SUM(n) / (SELECT SUM(n) FROM pats)")} AS "OLS" FROM (
  SELECT n, CAST(ROUND_EVEN((SELECT SUM(sol) FROM inv JOIN coefs USING (pos) WHERE idx = 0 OR list_contains(p.ix, idx)), 0) AS INTEGER) AS x
  FROM pats p) GROUP BY x""",
        *om.cells(_layout(), ALL_KNOWN),
        *om.TERMS,
        *om.gram("n", "s", "pats"),
    )
    # Occupation codes, numbered as the survey's arithmetic makes them, and sex. With one other
    # coefficient the level's errors are closed forms of sums by level.
    codes = om.Layout(
        {"soc_code": [str(1111 + 20 * i) for i in range(397)], "sex2": LEVELS["sex2"]},
        lambda f: "(soc_code - 1111) // 20 + 1" if f == "soc_code" else level_place(f, f),
    )
    both = "soc_code IS NOT NULL AND sex2 IS NOT NULL"
    male, female = codes.offset["sex2"] + 1, codes.offset["sex2"] + 2
    large = f"""SELECT 'sex2' AS term, 'Female' AS level, {r("gap")} AS estimate, {r("SQRT({scale} / schur)")} AS se FROM one
UNION ALL SELECT 'soc_code', CAST(1111 + 20 * (idx - 1) AS VARCHAR), {{}}, {{}} FROM sums, one"""
    by_level = "SELECT idx, SUM(n) AS n, SUM(s) AS s, SUM(w) AS d, COALESCE(SUM(w) FILTER (x), 0) AS b FROM weighed GROUP BY idx"
    shown = "CASE WHEN s > 0 THEN {} END"
    q["mdl_large_nb"] = on_people(
        large.replace("{scale}", "1").format(
            shown.format(r(f"(SELECT b[sums.idx] + b[{male}] FROM fin)")), shown.format(r("SQRT(1 / d + POW(sums.b / d, 2) / schur)"))
        ),
        *om.cells(codes, both),
        *om.nb_fit(codes, 60),
        ("weighed", f"SELECT ix[1] AS idx, ix[2] = {female} AS x, n, s, n * mu * theta / (mu + theta) AS w FROM (SELECT *, {om.ETA} AS mu FROM pats, fin)"),
        ("sums", by_level),
        ("one", f"SELECT SUM(CASE WHEN s > 0 THEN b - b * b / d END) AS schur, (SELECT b[{female}] - b[{male}] FROM fin) AS gap FROM sums"),
    )
    q["mdl_large_ols"] = on_people(
        large.replace("{scale}", "sigma2").format(r("my - gap * b / d"), r("SQRT(sigma2 * (1 / d + POW(sums.b / d, 2) / schur))")),
        ("pts", f"SELECT (soc_code - 1111) // 20 + 1 AS idx, (sex2 = 'Female')::INT AS x, total_contacts::DOUBLE AS y FROM people WHERE {both}"),
        ("sums", "SELECT idx, COUNT(*)::DOUBLE AS d, SUM(x)::DOUBLE AS b, AVG(x) AS mx, AVG(y) AS my FROM pts GROUP BY idx"),
        ("slope", "SELECT SUM((x - mx) * (y - my)) / SUM((x - mx) * (x - mx)) AS gap, SUM((x - mx) * (x - mx)) AS schur FROM pts JOIN sums USING (idx)"),
        (
            "one",
            """SELECT ANY_VALUE(gap) AS gap, ANY_VALUE(schur) AS schur,
    SUM(POW(y - my - gap * (x - mx), 2)) / (COUNT(*) - 1 - (SELECT COUNT(*) FROM sums)) AS sigma2 FROM pts JOIN sums USING (idx), slope""",
        ),
    )
    zinb = [*om.cells(_layout(), ALL_KNOWN), *om.zinb_fit(_layout(), 80)]
    q["mdl_zinb_coef"] = on_people(
        f"SELECT part, term, level, {r('estimate')} AS estimate, {r('se')} AS se, {r('estimate / se', 4)} AS z, TRUE AS converged FROM zest",
        *zinb,
        *om.zinb_terms(),
    )
    limit = "CASE WHEN part = 'count' OR estimate > -10 THEN {} END"
    q["mdl_zinb_limit"] = on_rare(
        f"SELECT part, term, level, {r(limit.format('estimate'), 5)} AS estimate, {r(limit.format('se'), 5)} AS se FROM zest",
        *zinb,
        *om.zinb_terms(),
    )
    q["dist_zero_limit"] = on_rare(
        f"""SELECT 'Observed' AS model, {r("SUM(n0)", 4)} AS zeros FROM pats
UNION ALL SELECT 'ZINB', {r("SUM(n * (pi + (1 - pi) * POW(theta / (theta + mu), theta)))", 4)} FROM zfit""",
        *zinb,
    )
    q["mdl_irr_zinb"] = on_people(
        f"""SELECT part, term, level, reference, {r("EXP(estimate)")} AS ratio, {r(f"EXP(estimate - {Z95} * se)", 5)} AS conf_low,
  {r(f"EXP(estimate + {Z95} * se)", 5)} AS conf_high, {r("se")} AS se_log, CAST(n AS BIGINT) AS n,
  {r(f"-2 * loglik + 2 * (2 * {p} + 1)")} AS aic, {r("loglik")} AS loglik
FROM (SELECT part, term, level, FALSE AS reference, estimate, se FROM zest
  UNION ALL SELECT part, term, ref_level, TRUE, 0.0, NULL FROM base, (VALUES ('count'), ('zero')) AS v(part)), zfig""",
        *zinb,
        *om.zinb_terms(),
    )
    ols = [t for t in om.ols_terms() if t[0] not in [n for n, _ in om.TERMS]]
    ols_row = f"""SELECT 'OLS' AS model, n, {p} + 1 AS p, NULL::DOUBLE AS theta, NULL::DOUBLE AS se_theta,
    -0.5 * n * (LN(2 * PI() * rss / n) + 1) AS loglik, rss AS deviance FROM rss"""
    nb_row = f"SELECT 'NB', n, {p} + 1, theta, se_theta, loglik, deviance FROM fig"
    zinb_row = f"SELECT 'ZINB', n, 2 * {p} + 1, theta, (SELECT se_theta FROM zse), loglik, NULL FROM zfig"
    # The two eliminations use the same table names, so the zero-inflated one is set apart.
    row = "SELECT model, CAST(n AS BIGINT) AS n, CAST(p AS INTEGER) AS p, {0} AS theta, {1} AS se_theta, {2} AS loglik, {3} AS deviance, {4} AS aic, TRUE AS converged FROM ({5})"
    shape = [r("theta"), r("se_theta"), r("loglik"), r("deviance"), r("-2 * loglik + 2 * p")]
    named = "SELECT 'x' AS model, 0.0 AS n, 0 AS p, 0.0 AS theta, 0.0 AS se_theta, 0.0 AS loglik, 0.0 AS deviance WHERE FALSE"
    plain = on_people(row.format(*shape, f"{ols_row} UNION ALL {nb_row}"), *multi_nb(), *om.TERMS, *ols)
    inflated = on_people(row.format(*shape, f"{named} UNION ALL {zinb_row}"), *zinb, *om.zinb_terms())
    q["mdl_aic"] = f"SELECT * FROM ({plain}) UNION ALL SELECT * FROM ({inflated})"
    zpmf = f"(1 - pi) * {pmf} + CASE WHEN k = 0 THEN pi ELSE 0 END"
    zdist = f"SELECT CAST(k AS INTEGER) AS x, SUM(n * ({zpmf})) / SUM(n) AS prob FROM zfit, {ks} GROUP BY k"
    q["dist_zinb"] = on_people(with_tail("zdist"), *zinb, ("zdist", zdist))
    q["dist_zero"] = on_people(
        f"""SELECT 'Observed' AS model, {r("SUM(n0)", 5)} AS zeros FROM pats
UNION ALL SELECT 'NB', {r("SUM(n * POW(theta / (theta + mu), theta))", 5)} FROM nbfit
UNION ALL SELECT 'ZINB', {r("SUM(n * (pi + (1 - pi) * POW(theta / (theta + mu), theta)))", 5)} FROM zfit""",
        *multi_nb(),
        nbfit,
        *om.zinb_fit(_layout(), 80),
    )
    everyone = "(SELECT COUNT(*) FROM people)"
    q["dist_compare_multi"] = on_people(
        f"""SELECT x, "Model", {r("prob", 5)} AS prob, {r(f"prob * {everyone}", 4)} AS n FROM (
  SELECT x, 'Observed' AS "Model", COALESCE(p, 0) AS prob FROM xs LEFT JOIN observed USING (x)
  UNION ALL SELECT x, 'NegBin', COALESCE(prob, 0) FROM xs LEFT JOIN ndist USING (x)
  UNION ALL SELECT x, 'Zinb', COALESCE(prob, 0) FROM xs LEFT JOIN zdist USING (x)) WHERE x BETWEEN 0 AND 50""",
        *multi_nb(),
        nbfit,
        *om.zinb_fit(_layout(), 80),
        OBSERVED,
        ndist,
        ("zdist", zdist),
        ("xs", "SELECT x FROM observed UNION SELECT x FROM ndist"),
    )
    return q


def box(value: str, keys: str, source: str = "", digits: int = DIGITS) -> str:
    def r(x):
        return rounded(x, digits)

    return (on_people if not source else lambda sql, *tables: f"{_with(('people', source), *tables)}\n{sql}")(
        f"""SELECT {keys},
  {r("MIN(v) FILTER (v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))")} AS whisker_low,
  {r("ANY_VALUE(q25)")} AS q25, {r("ANY_VALUE(q50)")} AS median, {r("ANY_VALUE(q75)")} AS q75,
  {r("MAX(v) FILTER (v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))")} AS whisker_high,
  COUNT(*) FILTER (NOT (v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))) AS n_outliers,
  {r("AVG(v)")} AS mean, COUNT(*) AS n
FROM pts JOIN quart USING ({keys}) GROUP BY {keys}""",
        ("pts", f"SELECT {keys}, {value} AS v FROM people"),
        (
            "quart",
            f"SELECT {keys}, QUANTILE_CONT(v, 0.25) AS q25, QUANTILE_CONT(v, 0.5) AS q50, "
            f"QUANTILE_CONT(v, 0.75) AS q75 FROM pts GROUP BY ALL",
        ),
    )


def histogram(value: str, width: int, by: str = "") -> str:
    lead, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return on_people(
        f"""SELECT {lead}bin, n, {r(f"n / (SUM(n) OVER ({part}) * {width}.0)")} AS density
FROM (SELECT {lead}{value} AS bin, COUNT(*) AS n FROM people GROUP BY ALL) WHERE bin IS NOT NULL"""
    )


def _oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    contacts = FACE + PHYS

    # sources
    q["src_survey"] = on_survey("SELECT * FROM survey")
    q["src_lookup"] = f"{_with(_SOC)} SELECT * FROM soc"

    q["src_rejects"] = on_survey(
        """SELECT 'age_years' AS column, COUNT(*) AS n FROM survey WHERE respondent_id % 50 = 7 UNION ALL
SELECT 'sex', COUNT(*) FROM survey WHERE respondent_id % 90 = 17 UNION ALL
SELECT '(good)', COUNT(*) FROM survey WHERE respondent_id % 50 <> 7 AND respondent_id % 90 <> 17"""
    )

    # filters
    case = "respondent_id, generation, age_years"
    q["flt_exclude_null"] = on_survey("SELECT respondent_id FROM survey WHERE respondent_id <> 9142")
    q["flt_exclude_many"] = on_survey(
        "SELECT respondent_id FROM survey WHERE respondent_id NOT IN (SELECT UNNEST(RANGE(0, 8000, 4)))"
    )
    q["flt_exclude_ids"] = on_survey(f"SELECT {case} FROM survey WHERE respondent_id NOT IN (9142)")
    q["flt_sentinel"] = on_survey(f"SELECT {case} FROM survey WHERE age_years = -11")
    q["flt_positive"] = on_survey("SELECT respondent_id, age_years, sex FROM survey WHERE age_years > 0")
    q["flt_response_profile"] = on_people(
        """SELECT question, COUNT(*) FILTER (v = 0) AS n_zero, COUNT(*) FILTER (v > 0) AS n_positive,
  COUNT(*) FILTER (v < 0) AS n_negative, COUNT(*) FILTER (v >= 0) AS n_non_negative FROM long GROUP BY 1""",
        ("long", stack("people", TOTALS + contacts, name="question")),
    )
    q["flt_cross_classify"] = on_survey(
        """SELECT COUNT(*) FILTER (hcw = 2 AND keyworker = 1) AS hcw_and_keyworker,
  COUNT(*) FILTER (hcw = 2 AND keyworker = 2) AS hcw_not_keyworker,
  COUNT(*) FILTER (keyworker = 1) AS keyworker, COUNT(*) FILTER (hcw = 2) AS hcw,
  COUNT(*) FILTER ((hcw = 1 OR hcw = 3 OR hcw = 8 OR hcw = 9) AND keyworker = 1) AS keyworker_not_hcw,
  COUNT(*) FILTER ((hcw = 1 OR hcw = 3 OR hcw = 8 OR hcw = 9) AND (keyworker = 2 OR keyworker = 9)) AS neither
FROM survey WHERE age_years > 0 AND respondent_id <> 9142"""
    )
    q["flt_label"] = on_people(
        "SELECT respondent_id, occupation, age3 FROM people WHERE occupation = 'Keyworker' AND age3 <> '40 - 49'"
    )
    q["flt_range"] = on_people(
        "SELECT total_contacts, COUNT(*) AS n FROM people GROUP BY 1 HAVING total_contacts >= 0 AND total_contacts <= 50"
    )

    # derived columns
    q["prj_null_sentinels"] = on_survey(
        "SELECT respondent_id, "
        + ", ".join(f"CASE WHEN {c} = -11 OR {c} = -10 OR {c} = -9 OR {c} = -1 THEN NULL ELSE {c} END AS {c}" for c in contacts)
        + " FROM survey"
    )
    answered = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in contacts)
    q["prj_row_total"] = on_people(
        f"SELECT respondent_id, {', '.join(TOTALS + BY_CONTACT)}, CAST({answered} AS INTEGER) AS n_answered FROM people"
    )
    q["prj_row_max"] = on_survey(
        """SELECT respondent_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a > b THEN a ELSE b END AS largest,
  COALESCE(CASE WHEN a > b THEN a ELSE b END, a, b) AS largest_known
FROM (SELECT respondent_id, CASE WHEN f2f_0_4 >= 0 THEN f2f_0_4 END AS a, CASE WHEN phys_0_4 >= 0 THEN phys_0_4 END AS b FROM survey)"""
    )
    q["prj_household"] = on_people(
        "SELECT respondent_id, household_size, household_size2, alone, N_0to17yo, children_in_house, Children FROM people"
    )
    dates = (
        "dated",
        "SELECT respondent_id, CASE WHEN survey_month BETWEEN 1 AND 12 THEN "
        "MAKE_DATE(survey_year, survey_month, survey_day) END AS d FROM survey",
    )
    day = "CASE DAYOFWEEK({0}) WHEN 0 THEN 'Sun' WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' END"
    q["prj_date_parts"] = on_survey("SELECT respondent_id, d AS date_ymd FROM dated", dates)
    q["prj_weekday"] = on_survey(
        f"SELECT respondent_id, {day.format('d')} AS weekday, {day.format('(d - 1)')} AS yesterday, "
        "CAST(DAYOFWEEK(d) + 1 AS INTEGER) AS weekday_ord FROM dated",
        dates,
    )
    kind = "CASE WHEN DAYOFWEEK({0}) IN (0, 6) THEN 'Weekend' WHEN {0} IS NOT NULL THEN 'Weekday' END"
    q["prj_weekend"] = on_survey(
        f"SELECT respondent_id, {kind.format('d')} AS weekday2, {kind.format('(d - 1)')} AS yesterday2 FROM dated", dates
    )
    q["prj_occupation"] = on_people("SELECT respondent_id, hcw, keyworker, occupation FROM people")
    q["prj_bands"] = on_people("SELECT respondent_id, age_years, age, age2, age3, age4 FROM people")
    week = (
        "weeks",
        "SELECT respondent_id, date_ymd, CAST((DATE_TRUNC('week', date_ymd)::DATE - DATE_TRUNC('week', (SELECT MIN(date_ymd) FROM people))::DATE) // 7 + 1 AS INTEGER) AS Q1week FROM people",
    )
    q["prj_week_index"] = on_people("SELECT * FROM weeks", week)
    q["prj_recode"] = on_people("SELECT respondent_id, sex, sex2, isolation, selfisolation_un FROM people")
    q["prj_levels"] = on_people(
        f"SELECT respondent_id, occupation2, selfisolation_un, {level_place('occupation2', 'occupation2')} AS occupation2_ord, "
        f"{level_place('selfisolation_un', 'selfisolation_un')} AS selfisolation_un_ord FROM people"
    )
    q["prj_code_prefix"] = on_people(
        """SELECT respondent_id, soc_code, LEFT(soc_code::VARCHAR, 1) AS "SOC2010Major",
  LEFT(soc_code::VARCHAR, 2) AS "SOC2010SubMajor", LEFT(soc_code::VARCHAR, 3) AS "SOC2010Minor" FROM people"""
    )
    q["prj_log_scale"] = on_people(
        f"SELECT respondent_id, CASE WHEN total_contacts > 0 THEN {r('LOG10(total_contacts)')} END AS log_contacts, "
        f"{r('LOG10(total_contacts + 1)')} AS log_contacts_1 FROM people"
    )

    # joins
    q["join_lookup"] = on_survey(
        "SELECT s.respondent_id, s.soc_code::VARCHAR AS soc_code, t.soc_title FROM survey s LEFT JOIN soc t ON s.soc_code::VARCHAR = t.soc_code",
        _SOC,
    )
    groups = {"SOC2010Major": 1, "SOC2010SubMajor": 2, "SOC2010Minor": 3}
    q["join_groups"] = on_people(
        "SELECT respondent_id, "
        + ", ".join(f"(people.soc_code::VARCHAR)[:{k}] AS {g}, t{k}.title AS {g}_title" for g, k in groups.items())
        + " FROM people "
        + " ".join(
            f"LEFT JOIN (SELECT soc_code[:{k}] AS code, MIN(soc_title) AS title FROM soc GROUP BY 1) t{k} ON t{k}.code = (people.soc_code::VARCHAR)[:{k}]"
            for k in groups.values()
        ),
        _SOC,
    )
    q["join_full"] = on_people(
        f"""SELECT x, {r("a.p")} AS "Observed", {r("b.p")} AS "Household" FROM
  (SELECT total_contacts AS x, COUNT(*) / (SELECT COUNT(*) FROM people) AS p FROM people GROUP BY 1) a
  FULL JOIN (SELECT household_size AS x, COUNT(*) / (SELECT COUNT(*) FROM people) AS p FROM people GROUP BY 1) b USING (x)"""
    )

    # tables
    q["agg_tally"] = on_people(
        'SELECT LEFT(soc_code::VARCHAR, 1) AS "SOC2010Major", COUNT(*) AS n FROM people GROUP BY 1'
    )
    q["agg_tally2"] = on_people("SELECT age3, children_in_house, COUNT(*) AS n FROM people GROUP BY 1, 2")
    q["agg_freq"] = on_people(
        frequency("SELECT selfisolation_un AS value FROM people", "", level_place("value", "selfisolation_un"))
    )
    q["agg_freq_by"] = on_people(frequency("SELECT generation, had_covid::BIGINT AS value FROM people", "generation"))
    questions = ["had_covid", "isolation", "hcw", "keyworker"]
    q["agg_freq_multi"] = on_people(
        frequency(stack("people", [f"{c}::BIGINT" for c in questions], name="question", value="value", labels=questions), "question")
    )
    q["agg_freq_total"] = on_people(frequency(stack("people", TOTALS, name="question", value="value"), "question"))
    q["agg_freq_week"] = on_people(frequency("SELECT Q1week::BIGINT AS value FROM weeks", ""), week)
    long = ("long", stack("people", TOTALS, "age3, sex, occupation, generation, household_size2"))
    q["agg_describe"] = on_people(f"SELECT variable, {stats('v', FULL)} FROM long GROUP BY 1", long)
    q["agg_describe_by"] = on_people(f"SELECT age3, {stats('total_contacts', FULL)} FROM people GROUP BY 1")
    q["agg_describe_household"] = on_people(
        f"SELECT household_size2, variable, {stats('v', FULL)} FROM long GROUP BY 1, 2", long
    )
    for k, col in (("isolation", "selfisolation_un"), ("hcw", "hcw"), ("keyworker", "keyworker")):
        profile = ("long", stack("people", TOTALS, col))
        q[f"agg_profile_{k}"] = on_people(f"SELECT {col}, variable, {stats('v', FULL)} FROM long GROUP BY 1, 2", profile)
    q["agg_share_outcomes"] = on_people(
        f"""SELECT *, {r("n / (SELECT COUNT(*) FROM people)")} AS freq
FROM (SELECT children_in_house, variable, {stats("v", "mean sd median n")} FROM long GROUP BY 1, 2)""",
        ("long", stack("people", TOTALS, "children_in_house")),
    )
    q["agg_freq_filtered"] = on_people(
        frequency(
            "SELECT selfisolation_un AS value FROM people WHERE selfisolation_un <> 'UNK'", "", level_place("value", "selfisolation_un")
        )
    )
    sex_label = "CASE sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END"
    isolation = "CASE WHEN isolation NOT IN (-9999, -11, -10, -9, -1) THEN isolation END"
    isolation_label = "CASE isolation WHEN 1 THEN 'No' WHEN 2 THEN 'Yes, am now' WHEN 3 THEN 'Yes, but have stopped' WHEN 9 THEN 'Prefer not to say' END"
    q["prj_recode_codebook"] = on_people(
        f"SELECT respondent_id, sex, {isolation} AS isolation, {sex_label} AS sex_label, {isolation_label} AS isolation_label FROM people"
    )
    both = f"SELECT 'sex' AS question, sex::BIGINT AS value FROM people UNION ALL SELECT 'isolation', ({isolation})::BIGINT FROM people"
    q["agg_freq_codebook"] = on_people(
        f"""SELECT *, CASE question WHEN 'sex' THEN {sex_label.replace("sex", "value")}
  ELSE {isolation_label.replace("isolation", "value")} END AS label FROM ({frequency(both, "question")})"""
    )
    place = "CASE value WHEN 3 THEN 1 WHEN 9 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 6 END"
    q["agg_freq_codebook_order"] = on_people(
        f"""SELECT *, CASE question WHEN 'sex' THEN {sex_label.replace("sex", "value")}
  ELSE {isolation_label.replace("isolation", "value")} END AS label
FROM ({frequency(both, "question", f"CASE WHEN question = 'isolation' OR value < 3 THEN {place} END NULLS LAST, value")})"""
    )
    shown = "CASE WHEN selfisolation_un <> 'UNK' THEN selfisolation_un END"
    q["prj_levels_codebook"] = on_people(
        f"""SELECT respondent_id, {shown} AS selfisolation_un, CAST(CASE selfisolation_un WHEN 'Yes, but have stopped' THEN 1
  WHEN 'Prefer not to say' THEN 2 WHEN 'No' THEN 3 WHEN 'Yes, am now' THEN 4 END AS INTEGER) AS selfisolation_un_ord FROM people"""
    )
    brief = ["age3", "sex", "occupation", "generation"]
    q["agg_brief_by"] = on_people(
        " UNION ALL ".join(
            f"SELECT '{k}' AS key, {k}::VARCHAR AS level, variable, {stats('v', 'mean sd n')} FROM long GROUP BY ALL" for k in brief
        ),
        long,
    )
    q["agg_describe_price"] = f"""SELECT l_returnflag, {price_stats("l_extendedprice", 4)} FROM lineitem GROUP BY 1"""
    q["agg_describe_sparse"] = f"""SELECT l_linestatus, {r("MEDIAN(v::DOUBLE)", 1)} AS median, {r("QUANTILE_CONT(v::DOUBLE, 0.25)", 1)} AS q25,
  {r("QUANTILE_CONT(v::DOUBLE, 0.75)", 1)} AS q75, MIN(v) AS min, MAX(v) AS max, COUNT(*) AS n FROM (
  SELECT l_linestatus, (l_orderkey * 8 + l_linenumber) * 2654435761 % 1000003 * 1000003 AS v FROM lineitem) GROUP BY 1"""
    q["agg_freq_dates"] = frequency("SELECT o_orderpriority, o_orderdate::DATE AS value FROM orders", "o_orderpriority")
    q["agg_freq_names"] = frequency("SELECT c_name AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "")
    q["agg_freq_prices"] = frequency("SELECT l_extendedprice AS value FROM lineitem", "")
    q["agg_mean_by"] = on_people(f"SELECT age2, {stats('total_contacts', 'mean n')} FROM people GROUP BY 1")
    q["agg_share_within"] = on_people(
        f"""SELECT age3, N_0to17yo, n, {r("n / SUM(n) OVER (PARTITION BY age3)")} AS freq
FROM (SELECT age3, N_0to17yo, COUNT(*) AS n FROM people GROUP BY 1, 2)"""
    )
    q["agg_share_total"] = on_people(
        f"""SELECT *, {r("n / (SELECT COUNT(*) FROM people)")} AS freq
FROM (SELECT children_in_house, {stats("total_contacts", "mean sd median q25 q75 n")} FROM people GROUP BY 1)"""
    )
    as_date = "DATE '1970-01-01' + CAST(FLOOR({}) AS INTEGER)"
    points = {
        "min": "MIN(d)",
        "q25": "QUANTILE_CONT(d, 0.25)",
        "median": "QUANTILE_CONT(d, 0.5)",
        "mean": "AVG(d)",
        "q75": "QUANTILE_CONT(d, 0.75)",
        "max": "MAX(d)",
    }
    q["agg_date_summary"] = on_people(
        "SELECT "
        + ", ".join(f"{as_date.format(sql)} AS {s}_date" for s, sql in points.items())
        + ", COUNT(*) AS n FROM (SELECT date_ymd - DATE '1970-01-01' AS d FROM people)"
    )
    q["agg_topk"] = on_people(
        """SELECT occupation, soc_title, n, CAST(place AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY occupation ORDER BY n DESC, soc_title NULLS LAST) AS place FROM (
    SELECT p.occupation, t.soc_title, COUNT(*) AS n FROM people p LEFT JOIN soc t ON p.soc_code::VARCHAR = t.soc_code GROUP BY 1, 2))
WHERE place <= 5""",
        _SOC,
    )
    q["agg_value_counts"] = on_people("SELECT total_contacts, COUNT(*) AS n FROM people GROUP BY 1")
    zero = "AVG(CASE WHEN total_contacts = 0 THEN 1.0 ELSE 0.0 END)"
    q["agg_dispersion"] = on_people(
        f"""SELECT COUNT(*) AS n, {r("AVG(total_contacts)")} AS mean, {r("VAR_SAMP(total_contacts)")} AS variance,
  COUNT(*) FILTER (total_contacts = 0) AS n_zero, {r(zero)} AS share_zero,
  {r(f"1 + LN({zero}) / AVG(total_contacts)")} AS zero_inflation FROM people"""
    )
    codes = ", ".join(f"COUNT(*) FILTER (v = -{c}) AS n_code_{c}" for c in (11, 10, 9, 1))
    q["agg_missing"] = on_survey(
        f"""SELECT question, COUNT(*) AS n, COUNT(*) FILTER (v >= 0) AS n_answered, COUNT(*) FILTER (v = 0) AS n_zero,
  COUNT(*) FILTER (v > 0) AS n_non_zero, COUNT(*) FILTER (v IS NULL) AS n_null,
  COUNT(*) FILTER (v < 0 AND v NOT IN (-11, -10, -9, -1)) AS n_other_negative, {codes}
FROM ({stack("survey WHERE age_years > 0 AND respondent_id <> 9142", contacts, name="question")}) GROUP BY 1"""
    )

    # mixing matrices
    q["mix_f2f"] = mixing(FACE, "mean median sd total q25 q75 n")
    q["mix_phys"] = mixing(PHYS, "mean median sd iqr total n")
    q["mix_total"] = mixing(BY_CONTACT, "mean median sd iqr total n")

    # tables behind figures
    hh = f"{r('AVG(household_size)')} AS mean_household_size, COUNT(*) AS n"
    q["plot_bubble"] = on_people(f"SELECT age_years, {hh} FROM people GROUP BY 1")
    q["plot_bubble2"] = on_people(f"SELECT age_years, children_in_house, {hh} FROM people GROUP BY 1, 2")
    q["plot_hh_mean"] = on_people(
        f"SELECT household_size, {r('AVG(total_contacts)')} AS mean_contacts, COUNT(*) AS n FROM people GROUP BY 1"
    )
    q["plot_hist_date"] = histogram("date_ymd", 1)
    q["plot_hist_by"] = histogram("CAST(FLOOR(age_years / 5) * 5 AS BIGINT)", 5, "sex2")
    q["plot_hist_density"] = histogram("CAST(FLOOR(total_contacts / 2) * 2 AS BIGINT)", 2)
    q["plot_hist_bins"] = on_people(equal_bins("age_years", "sex2", "people", True))
    q["plot_hist_price"] = equal_bins("o_totalprice", "o_orderpriority", "orders", False)
    q["plot_box_price"] = box("o_totalprice", "o_orderpriority", "SELECT * FROM orders", 4)
    q["plot_box"] = box("total_contacts", "age3, children_in_house")
    q["plot_box_log"] = box("LOG10(total_contacts + 1)", "household_size")
    q["plot_overlap"] = on_people(
        "SELECT total_face_to_face, total_physical, occupation, COUNT(*) AS n FROM people "
        "WHERE total_face_to_face > 0 AND total_physical > 0 GROUP BY ALL"
    )

    # models
    factors = ", ".join(LEVELS)
    known = " AND ".join(f"{f} IS NOT NULL" for f in LEVELS)
    q["mdl_table"] = on_people(
        f"SELECT {factors}, total_contacts AS y, COUNT(*) AS n FROM people WHERE {known} GROUP BY ALL"
    )
    q["mdl_nb_null"] = on_people(
        f"""SELECT {r("LN(m)")} AS estimate, {r("SQRT(1 / w.w)")} AS se, {r("theta")} AS theta, CAST(ll.n AS BIGINT) AS n,
  {r("loglik")} AS loglik, {r("deviance")} AS deviance, {r("-2 * loglik + 4")} AS aic FROM w, ll""",
        *NULL_TABLES,
    )
    q["mdl_theta_ci"] = on_people(
        f"""SELECT {r("theta")} AS theta, {r("se_theta")} AS se_theta, {r(f"theta - {Z95} * se_theta")} AS conf_low,
  {r(f"theta + {Z95} * se_theta")} AS conf_high FROM info""",
        *NULL_TABLES,
    )
    q["mdl_nb_prob"] = on_people(
        f"SELECT {r('theta')} AS size, {r('m')} AS mu, {r('theta / (theta + m)')} AS prob FROM lv, th", *NULL_TABLES
    )
    for f in LEVELS:
        q[f"mdl_nb_uni_{f}"] = nb_coef(f)
        q[f"mdl_irr_{f}"] = nb_irr(f)
        q[f"mdl_lrt_{f}"] = nb_lrt(f)
    q["mdl_nb_uni"] = " UNION ALL ".join(f"SELECT '{f}' AS term, * FROM ({nb_coef(f)})" for f in LEVELS)
    q["mdl_ols_uni"] = on_people(
        f"""SELECT CASE WHEN age3 = base THEN '(Intercept)' ELSE age3 END AS level,
  {r("CASE WHEN age3 = base THEN m ELSE m - m0 END")} AS estimate,
  {r("SQRT(rss / (total - levels)) * SQRT(CASE WHEN age3 = base THEN 1.0 / n ELSE 1.0 / n + 1.0 / n0 END)")} AS se,
  {r("SQRT(rss / (total - levels))")} AS sigma
FROM g, (SELECT age3 AS base, m AS m0, n AS n0 FROM g ORDER BY {level_place("age3", "age3")} LIMIT 1),
  (SELECT SUM(ss) AS rss, SUM(n) AS total, COUNT(*) AS levels FROM g)""",
        (
            "g",
            "SELECT age3, COUNT(*) AS n, AVG(total_contacts) AS m, VAR_POP(total_contacts) * COUNT(*) AS ss "
            "FROM people WHERE age3 IS NOT NULL GROUP BY 1",
        ),
    )

    # distributions
    q["dist_observed"] = on_people(
        f"SELECT total_contacts, COUNT(*) AS n, {r('COUNT(*) / (SELECT COUNT(*) FROM people)')} AS share FROM people GROUP BY 1"
    )
    q["dist_nb_null"] = on_people(with_tail("nb"), *NULL_TABLES, NB_NULL)
    q["dist_ols"] = on_people(f'SELECT x, {r("p")} AS "OLS" FROM ols', OLS)
    q["dist_unpivot"] = on_people(
        f"""SELECT x, 'Observed' AS "Model", {r("COALESCE(o.p, 0)")} AS prob FROM observed o FULL JOIN ols l USING (x)
UNION ALL SELECT x, 'OLS', {r("COALESCE(l.p, 0)")} FROM observed o FULL JOIN ols l USING (x)""",
        OBSERVED,
        OLS,
    )
    total = "(SELECT COUNT(*) FROM people)"
    q["dist_compare"] = on_people(
        f"""SELECT x, "Model", {r("prob", 5)} AS prob, {r(f"prob * {total}", 5)} AS n FROM (
  SELECT x, 'Observed' AS "Model", COALESCE(p, 0) AS prob FROM xs LEFT JOIN observed USING (x)
  UNION ALL SELECT x, 'NegBin', COALESCE(prob, 0) FROM xs LEFT JOIN nb USING (x)) WHERE x BETWEEN 0 AND 50""",
        *NULL_TABLES,
        NB_NULL,
        OBSERVED,
        OLS,
        ("xs", "SELECT x FROM observed UNION SELECT x FROM nb UNION SELECT x FROM ols"),
    )
    tail = "SELECT x, prob FROM nb WHERE x <= {0} UNION ALL SELECT NULL, GREATEST(0, 1 - SUM(prob)) FROM nb WHERE x <= {0}"
    q["dist_align_tail"] = on_people(
        f"""SELECT x, {r("MAX(p)")} AS "Observed", {r("MAX(s)")} AS "Short", {r("MAX(l)")} AS "Long" FROM (
  SELECT x, p, NULL::DOUBLE AS s, NULL::DOUBLE AS l FROM observed UNION ALL
  SELECT x, NULL, prob, NULL FROM ({tail.format(9)}) UNION ALL SELECT x, NULL, NULL, prob FROM ({tail.format(14)})) GROUP BY x""",
        *NULL_TABLES,
        NB_NULL,
        OBSERVED,
    )
    q["dist_zero_null"] = on_people(
        f"""SELECT CAST((SELECT SUM(n) FROM obs WHERE y = 0) AS BIGINT) AS observed,
  {r("SUM(n * POW(theta / (theta + m), theta))", 5)} AS expected FROM lv, th""",
        *NULL_TABLES,
    )
    q.update(multi_models())
    return q


def oracle_sql() -> dict[str, str]:
    return _oracle()
