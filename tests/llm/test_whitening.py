"""Whitening against numpy's eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from statledger.llm import bidiagonal, whitening
from statledger.llm.queries import QUERIES


def checked(rows, vectors, most=8):
    """The rows against a covariance in whole numbers; vectors: id -> list."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors.values()], object)
    n, total = len(x), x.sum(axis=0)
    exact = n * x - total
    covariance = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in exact.T @ exact])
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    found = {}
    for r in rows:
        found.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(found) == list(range(1, min(most, sum(values > 1e-9 * values[0])) + 1))
    for k, own in found.items():
        assert sorted(own) == sorted(vectors)
        want = (exact.astype(float) / n) @ directions[:, k - 1] / np.sqrt(values[k - 1])
        got = np.array([own[i]["whitened"] for i in vectors])
        sign = np.sign(want @ got)
        assert np.abs(got - sign * want).max() < 1e-6
        for i, row in zip(vectors, exact, strict=True):
            assert own[i]["n"] == n and int(own[i]["deviation"]) == sum(int(v)**2 for v in row)
            assert own[i]["explained"] == pytest.approx(values[k - 1] / covariance.trace(), rel=1e-9)
            assert own[i]["identity_error"] < 1e-9


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    checked(QUERIES["op12_whitening"](spark, sf_dir).collect(), vectors)
    many = whitening.whiten(table.repartition(70)).collect()
    checked(many, vectors)


NAN, INF = float("nan"), float("inf")


def test_edges(spark):
    rng = np.random.default_rng(3)
    good = {k: v.tolist() for k, v in enumerate(rng.normal(size=(40, 5)) * [1, 2, 3, 100, 5])}
    bad = [None, [], [None] * 5, [1.0, NAN, 0.0, 0.0, 0.0], [INF, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [-1e13, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0, None]]
    rows = list(good.items()) + [(100 + k, v) for k, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "embedding as vector", "1 as n", "2 as component")
    checked(whitening.whiten(table).collect(), good)
    assert whitening.whiten(table.where("vec_id >= 100 or vec_id = 1")).collect() == []
    assert whitening.whiten(table.where("vec_id < 0")).collect() == []
    same = whitening.whiten(table.where("vec_id = 1").union(table.where("vec_id = 1")))
    assert same.collect() == [] and [f.name for f in same.schema] == ["vec_id", *[f.name for f in whitening._FIELDS]]


def test_fewer_vectors_than_dimensions_repeats_and_null_keys(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 30)).tolist()
    rows = [(k, base[k % 4]) for k in range(300)] + [(None, base[0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted({r["component"] for r in got}) == [1, 2, 3] and len(got) == 903
    alike = [r["whitened"] for r in got if r["component"] == 1 and (r["vec_id"] is None or r["vec_id"] % 4 == 0)]
    assert len(set(alike)) == 1


@pytest.mark.parametrize("values", [
    [5.0] * 20, [5.0] * 4 + [4.0] * 4 + [1.0] * 12, (5 + 1e-9 * np.arange(20)).tolist(), (5 + 1e-6 * np.arange(20)).tolist(),
    (10.0 ** -np.arange(20)).tolist(), [3.0, 3.0] + [0.0] * 18, [1e8] + [1.0] * 19,
])
def test_solver_on_close_and_small_singular_values(values):
    rng = np.random.default_rng(5)
    left, right = (np.linalg.qr(rng.normal(size=(20, 20)))[0] for _ in range(2))
    r = np.linalg.qr((left * values) @ right, mode="r")
    squares, vectors = bidiagonal.right_singular(r, 8)
    want = np.linalg.svd(r)[1]
    assert np.abs(np.sqrt(squares) - want).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-9
    assert np.abs(r.T @ (r @ vectors) - vectors * squares[:vectors.shape[1]]).max() < 1e-12 * want[0]**2


def test_graded_bidiagonal_has_relative_accuracy():
    diagonal, above = 10.0 ** -np.arange(0, 26, 2), 10.0 ** -np.arange(1, 25, 2)
    product = np.prod([Fraction(float(d))**2 for d in diagonal])
    found = bidiagonal.squares(diagonal, above)
    assert float(np.prod([Fraction(float(v)) for v in found]) / product) == pytest.approx(1, rel=1e-12)


def test_sums_and_deviations_that_64_bits_do_not_hold(spark):
    big = [[float(k) * 2**30, 2.0**41 - k] for k in range(-500, 500)]
    table = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    rows = whitening.whiten(table).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in big]
    totals = [sum(v[k] for v in x) for k in range(2)]
    for r in rows:
        assert int(r["deviation"]) == sum((1000 * c - s)**2 for c, s in zip(x[r["vec_id"]], totals, strict=True))
