"""Whitening, against numpy's eigenvectors and exact whole-number sums."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from headcount.llm import whitening


def frame(spark, vectors, ids=None):
    rows = [(i, v, "clash") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")


def usable(vectors):
    good = {}
    for i, v in enumerate(vectors):
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            good[i] = [math.floor(64 * c) + 1_000_000 for c in v]
    return good


def check(rows, vectors, most=16):
    """The contract, from exact covariances of the distinct vectors."""
    good = usable(vectors)
    distinct = sorted(set(map(tuple, good.values())))
    n, d = len(distinct), len(distinct[0])
    sums = [sum(c) for c in zip(*distinct)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in distinct) / n) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    rank = int((values > 1e-10 * values[0]).sum())
    got = {}
    for r in rows:
        got.setdefault(r["id"], {})[r["component"]] = r
    assert set(got) == set(good) and all(sorted(c) == list(range(1, min(most, rank) + 1)) for c in got.values())
    for k in range(1, min(most, rank) + 1):
        want = {i: float((np.array(x) - np.array(mean, float)) @ vectors_[:, k - 1]) / math.sqrt(values[k - 1]) for i, x in good.items()}
        some = max(want, key=lambda i: abs(want[i]))
        sign = math.copysign(1, want[some] * got[some][k]["whitened"])
        for i in good:
            assert got[i][k]["whitened"] == pytest.approx(sign * want[i], abs=1e-7)
            assert got[i][k]["n"] == n and got[i][k]["deviation"] == sum((n * c - s) ** 2 for c, s in zip(good[i], sums))
            assert got[i][k]["explained"] == pytest.approx(values[k - 1] / np.trace(v), rel=1e-9)


def random_vectors(seed, n, d):
    pick = np.random.default_rng(seed)
    return (pick.normal(size=(n, d)) * pick.uniform(0.1, 3, d)).tolist()


def fitted(df, most=16):
    rows = whitening.grid(df)
    distinct = rows.select("x").distinct()
    model = whitening.fit(distinct)
    return whitening.whiten(rows, model, most).collect(), model, whitening.identity_error(distinct, model, most)


def test_bad_vectors_and_repeats(spark):
    vectors = random_vectors(1, 60, 5)
    vectors += [vectors[0]] * 30 + [None, [1.0, None, 0.0, 0.0, 0.0], [math.nan, 0.0, 0.0, 0.0, 0.0], [0.0, math.inf, 0.0, 0.0, 0.0], [0.0] * 5]
    rows, model, error = fitted(frame(spark, vectors).repartition(7))
    check(rows, vectors)
    assert model.n == 61 and error < 1e-9


def test_few_components_and_low_rank(spark):
    vectors = random_vectors(2, 40, 4)
    vectors = [[*v, v[0] * 64 // 1 / 64, 7.0] for v in vectors]  # a repeated and a constant dimension
    rows, model, error = fitted(frame(spark, vectors))
    check(rows, vectors)
    assert len(model.values) == 4 and error < 1e-9
    assert {r["component"] for r in fitted(frame(spark, vectors), 2)[0]} == {1, 2}


def test_single_vector_empty_table_and_null_ids(spark):
    for vectors in ([[1.0, 2.0]] * 3, [], [[], []]):
        rows, model, error = fitted(frame(spark, vectors))
        assert rows == [] and error is None
    vectors = random_vectors(3, 9, 2)
    rows, _, _ = fitted(frame(spark, vectors, [None, None, *range(7)]))
    assert sum(r["id"] is None for r in rows) == 4
    with pytest.raises(Exception, match="differ in length"):
        fitted(frame(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(Exception, match="too large"):
        whitening.grid(frame(spark, [[1e300]])).collect()
    with pytest.raises(TypeError):
        whitening.grid(spark.createDataFrame([(1, "x")], "vec_id long, embedding string"))


def test_large_entries_stay_exact(spark):
    vectors = [[1e12 + i, 3e4 * (i % 7) - i] for i in range(50)]
    model = whitening.fit(whitening.grid(frame(spark, vectors)).select("x").distinct())
    good = list(usable(vectors).values())
    mean = [Fraction(sum(c), 50) for c in zip(*good)]
    v = [[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in good) / 50) for j in range(2)] for i in range(2)]
    assert model.values == pytest.approx(np.linalg.eigvalsh(v)[::-1], rel=1e-9)
    assert (whitening._gram(np.array([[1 << 40, 3]], np.int64)) == [[1 << 80, 3 << 40], [3 << 40, 9]]).all()
    assert whitening._deviation(np.array([[1 << 30, 5]], np.int64), 2, [1, 2]) == [((1 << 31) - 1) ** 2 + 8**2]
    assert whitening._deviation(np.array([[70, 5]], np.int64), 2, [101, 12]) == [39**2 + 2**2]


def test_factor_and_rotations():
    pick = np.random.default_rng(4)
    for n, d in ((500, 33), (40, 7), (5, 8), (30, 1), (3, 2)):
        x = pick.normal(size=(n, d)) * 10.0 ** pick.uniform(-2, 3, d)
        v = np.cov(x.T, bias=True).reshape(d, d)
        factor = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v, atol=1e-12 * np.abs(v).max())
        values, vectors = whitening.jacobi(factor)
        k = len(values)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], atol=1e-12 * values[0])
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert (np.diff(values) <= 0).all()


def test_query_equals_numpy(spark, sf_dir):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    out = whitening.op13_whitening(spark, sf_dir)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.withColumnRenamed("vec_id", "id")
    first = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.min("vec_id")).first()[0]
    check(rows.withColumn("id", F.col("id") - first).collect(), vectors)
    assert rows.agg(F.max("identity_error")).first()[0] < 1e-4
