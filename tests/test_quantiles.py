"""Quantiles of any number, running sums in any order: against numpy, and with bounded tasks."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcount.operators import cells, frequency, plots, summary


def test_order_key_is_what_the_bits_of_a_double_say(spark):
    pick = random.Random(1)
    v = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 1 / 3]
    v += [2.0**k for k in range(-1074, 1024, 13)] + [float(np.nextafter(2.0**k, 0)) for k in range(-1060, 1024, 7)]
    v += [struct.unpack("d", struct.pack("Q", pick.getrandbits(64)))[0] for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in v], "value double").selectExpr("value", f"{cells.order_key(T.DoubleType())} AS k")
    for x, k in df.collect():
        bits = struct.unpack("q", struct.pack("d", x))[0]
        assert k == (9221120237041090560 if math.isnan(x) else bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF))


def values(kind):
    pick = np.random.default_rng(7)
    if kind == "hash":
        v = pick.integers(-(2**63), 2**63 - 1, 5000)
        return [int(x) for x in v], "bigint"
    if kind == "mixed":
        return [float(x) for x in pick.normal(0, 1, 3000) * 10.0 ** pick.integers(-300, 300, 3000)], "double"
    if kind == "one":
        return [2.5] * 2000 + [float(x) for x in pick.normal(2.5, 1e-9, 1500)], "double"
    if kind == "decimal":
        return [f"{x:.4f}" for x in pick.normal(0, 1e6, 3000)], "decimal(18,4)"
    if kind == "float":
        return [float(np.float32(x)) for x in pick.normal(0, 1, 3000)], "float"
    return [int(x) for x in pick.integers(-3, 200_000, 4000)], "int"


@pytest.mark.parametrize("kind", ["hash", "mixed", "one", "decimal", "float", "int"])
@pytest.mark.parametrize("ordered", [None, 50])
def test_quartiles_of_any_number(spark, kind, ordered, monkeypatch):
    """A limit of 50 cells a window takes the way of large tables."""
    v, sql = values(kind)
    rows = [(i % 3 if i % 7 else None, str(x)) for i, x in enumerate(v)] + [(1, None), (5, None)]
    df = spark.createDataFrame(rows, "g int, x string").selectExpr("g", f"CAST(x AS {sql}) AS x")
    monkeypatch.setattr(cells, "ORDERED", ordered or 65_536)
    got = {r["g"]: r for r in summary.describe(df, "x", "g", ("median", "q25", "q75", "n", "min", "max")).collect()}
    assert set(got) == {None, 0, 1, 2, 5} and got[5]["median"] is None and got[5]["n"] == 1
    for g in (None, 0, 1, 2):
        own = np.array([float(x) for i, x in enumerate(v) if (i % 3 if i % 7 else None) == g])
        want = [np.percentile(own, q) for q in (25, 50, 75)]
        assert [got[g][s] for s in ("q25", "median", "q75")] == pytest.approx(want, rel=1e-12)
        assert got[g]["n"] == len(own) + (g == 1) and float(got[g]["min"]) == own.min()


def test_moments_and_boxes_of_a_measured_column(spark):
    pick = np.random.default_rng(3)
    v = [*pick.lognormal(0, 1, 400).tolist(), 500.0]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(v)] + [(0, None)], "g int, x double")
    got = {r["g"]: r for r in summary.describe(df, "x", "g").collect()}
    box = {r["g"]: r for r in plots.box_stats(df, "x", ["g"]).collect()}
    for g in (0, 1):
        own = np.array(v[g::2])
        assert got[g]["mean"] == pytest.approx(own.mean()) and got[g]["sd"] == pytest.approx(own.std(ddof=1))
        assert got[g]["n"] == len(own) + (g == 0)
        q = np.percentile(own, (25, 50, 75))
        inside = own[(own >= q[0] - 1.5 * (q[2] - q[0])) & (own <= q[2] + 1.5 * (q[2] - q[0]))]
        assert [box[g][s] for s in ("q25", "median", "q75")] == pytest.approx(list(q))
        assert (box[g]["whisker_low"], box[g]["whisker_high"]) == (inside.min(), inside.max())
        assert box[g]["n_outliers"] == len(own) - len(inside) and box[g]["mean"] == pytest.approx(own.mean())
    logs = plots.box_stats(df, "x", ["g"], log=True).filter("g = 0").first()
    assert logs["median"] == pytest.approx(np.median(np.log10(v[0::2])))
    with pytest.raises(TypeError):
        summary.describe(df.withColumn("x", F.lit("a")), "x")
    with pytest.raises(TypeError):
        summary.describe(df.withColumn("x", F.lit(1).cast("decimal(30,2)")), "x")


def test_a_million_doubles_and_hashes(spark):
    df = spark.range(1_000_000).selectExpr("xxhash64(id) AS h", "pmod(xxhash64(id, 1), 1000003) / 7D AS d")
    for c in ("h", "d"):
        got = summary.describe(df, c, stats=("median", "q25", "q75")).first()
        want = df.selectExpr(*[f"percentile(CAST({c} AS DOUBLE), {p}) AS p" + s for p, s in ((0.25, "1"), (0.5, "2"), (0.75, "3"))]).first()
        assert [got["q25"], got["median"], got["q75"]] == pytest.approx(list(want), rel=1e-12)


def brute_running(rows):
    out, total = {}, {}
    for g, v, n in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1])):
        if v is not None:
            total[g] = total.get(g, 0) + n
        out[g, v] = total.get(g) if v is not None else None
    return out


@pytest.mark.parametrize("kind", ["string", "date", "double", "bigint"])
@pytest.mark.parametrize("ordered", [40, 65_536])
def test_running_percentages_in_any_order(spark, kind, ordered, monkeypatch):
    monkeypatch.setattr(frequency, "ORDERED", ordered)
    base = spark.range(3000).selectExpr("id % 3 AS g", "pmod(xxhash64(id), 300) AS k")
    made = {
        "string": "concat('common-prefix-', lpad(CAST(k AS STRING), 6, '0'))", "date": "date_add(DATE '2020-01-01', CAST(k AS INT))",
        "double": "k / 7D - 20", "bigint": "k * 1000000007L",
    }[kind]
    df = base.selectExpr("CASE WHEN g = 2 THEN NULL ELSE g END AS g", f"CASE WHEN k % 50 = 7 THEN NULL ELSE {made} END AS v")
    got = frequency.freq_table(df, "v", by=["g"]).collect()
    counts = [(r["g"], r["value"], r["n"]) for r in got]
    want = brute_running(counts)
    known = {g: sum(n for h, v, n in counts if h == g and v is not None) for g in (None, 0, 1)}
    assert sum(r["n"] for r in got) == 3000
    for r in got:
        w = want[r["g"], r["value"]]
        assert r["cum_pct"] == (None if w is None else pytest.approx(100 * w / known[r["g"]]))


def test_ranges_of_a_million_strings_are_spread(spark):
    df = spark.range(1_000_000).selectExpr("concat('the-same-beginning-of-all-', sha1(CAST(id AS STRING))) AS v")
    counts = frequency.keep(frequency.tally(df, ["v"]).selectExpr("v AS value", "n", "'q' AS question"))
    out = frequency.running(counts, ["question"], ["value"], "n", "upto")
    top = out.agg(F.max("upto"), F.count_distinct("upto")).first()
    assert tuple(top) == (1_000_000, 1_000_000)
    assert out.filter("upto = 1").first()["value"] == df.agg(F.min("v")).first()[0]
    windows = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "Window" in x]
    # One runs over the rows of a range, the other over the ranges' sums.
    assert len(windows) == 2 and "_part" in windows[0] and "_sum" in windows[1]


def test_equal_bins(spark):
    df = spark.createDataFrame(
        [("a", 0.0), ("a", 1.0), ("a", 2.5), ("a", 10.0), ("b", 5.0), ("b", None), ("b", math.nan), ("b", math.inf), (None, 7.0)], "g string, x double"
    )
    shared = {(r["g"], r["bin"]): r for r in plots.histogram(df, "x", by=["g"], bins=4).collect()}
    assert {k: r["n"] for k, r in shared.items()} == {("a", 1): 2, ("a", 2): 1, ("a", 4): 1, ("b", 3): 1, (None, 3): 1}
    assert (shared["a", 4]["lo"], shared["a", 4]["hi"]) == (7.5, 10.0)
    assert shared["a", 1]["density"] == pytest.approx(2 / (4 * 2.5))
    own = {(r["g"], r["bin"]): r for r in plots.histogram(df, "x", by=["g"], bins=4, shared=False).collect()}
    assert own["b", 1]["lo"] == own["b", 1]["hi"] == 5.0 and own["b", 1]["density"] is None
    assert plots.histogram(df.limit(0), "x", bins=3).count() == 0
    with pytest.raises(ValueError):
        plots.histogram(df, "x", bins=0)
    widths = plots.histogram(df.filter("g = 'a'"), "x", width=0.5).orderBy("bin").collect()
    assert [r["bin"] for r in widths] == [0.0, 1.0, 2.5, 10.0] and widths[0]["density"] == pytest.approx(1 / (4 * 0.5))


def test_alignment_is_one_shuffle_and_tails_meet(spark):
    from headcount.operators import distributions

    tables = [spark.createDataFrame([(i, 0.1 * i), (None, 0.5)], f"x int, m{i} double") for i in range(5)]
    out = distributions.align_distributions(*tables)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = {r["x"]: r.asDict() for r in out.collect()}
    assert len(rows) == 6 and all(rows[None][f"m{i}"] == 0.5 for i in range(5)) and rows[2]["m3"] is None
    with pytest.raises(ValueError):
        distributions.align_distributions(tables[0], tables[0])
