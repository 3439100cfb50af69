"""Whitening against plain linear algebra, and its parts against brute force."""

from decimal import Decimal
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from tabml.llm import queries, whitening


def plain_rows(vectors, scale=256, components=4):
    """{(id, component): (n, deviation, whitened up to sign, explained)} by numpy, and the spectrum's gaps."""
    good = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for k in range(min(components, len(v))):
            out[i, k + 1] = (n, deviation, float((np.array(v) - x.mean(axis=0)) @ axes[:, k] / np.sqrt(values[k])), values[k] / values.sum())
    return out


def check(got, want):
    assert {(r["id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, whitened, explained = want[r["id"], r["component"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-6) and r["identity_error"] < 1e-9
        if abs(whitened) > 1e-3:
            assert sign.setdefault(r["component"], r["whitened"] * whitened > 0) == (r["whitened"] * whitened > 0)
        assert abs(r["whitened"]) == pytest.approx(abs(whitened), abs=1e-6)


def test_query_equals_numpy(spark, folder):
    vectors = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = [r.asDict() | {"id": r.vec_id} for r in queries.op11_whitening(spark, folder).collect()]
    check(got, plain_rows(vectors))


def test_small_tables_with_every_kind_of_row(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=5)], "x", 1) for i in range(40)]
    rows += [rows[3], rows[3], (90, rows[4][1], None, 2), (91, None, None, 3), (92, [1.0, None, 0.0, 0.0, 0.0], "", 4), (93, [float("nan")] * 5, "", 5),
             (94, [float("inf")] * 5, "", 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `v` string, `a.b` int")
    got = [r.asDict() for r in whitening.whiten(df).collect()]
    repeated = [r for r in got if r["id"] == 3]
    assert len(repeated) == 12 and len({(r["component"], r["whitened"]) for r in repeated}) == 4
    check([r for r in got if r["id"] != 3], {k: v for k, v in plain_rows([r[:2] for r in rows]).items() if k[0] != 3})
    assert {r["id"] for r in got} == {*range(40), 90}


def test_ids_and_lengths(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [2.0]), (2, []), (3, [0.5, 3.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    want = plain_rows([(None, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [0.5, 3.0])])
    check([r.asDict() for r in got], want)


def test_nothing_and_nothing_that_varies(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    [row] = whitening.whiten(spark.createDataFrame([(7, [0.5])], schema)).collect()
    assert (row.n, row.deviation, row.whitened, row.explained, row.identity_error) == (1, 0, None, None, None)
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)).collect()
    assert {(r.id, r.component, r.whitened if r.component == 1 else None, r.explained) for r in flat} == {
        (1, 1, -1.0, 1.0), (2, 1, 1.0, 1.0), (1, 2, None, 0.0), (2, 2, None, 0.0)}


def test_equal_eigenvalues(spark):
    rows = [(2 * k + s, [float((1 - 2 * s) * (i == k)) for i in range(5)]) for k in range(5) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 40 and all(r.explained == 0.2 and r.identity_error < 1e-12 for r in got)


def test_huge_entries_are_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [2.0 ** 50, 2.0])]
    got = {r.id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.component == 1}
    x = [[(1 << 63) - 1, 0], [1 - (1 << 63), 256], [1 << 58, 512]]
    sums = [sum(c) for c in zip(*x)]
    for i, v in enumerate(x, 1):
        exact = sum((3 * c - s) ** 2 for c, s in zip(v, sums))
        assert got[i].deviation == (exact if exact < 10 ** 38 else None)


def test_wide_vectors_are_refused(spark):
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * 1025)], "vec_id long, embedding array<float>"))


def determinant(m):
    total = 0
    for order in permutations(range(len(m))):
        sign = (-1) ** sum(order[i] > order[j] for i in range(len(m)) for j in range(i + 1, len(m)))
        product = sign
        for i, j in enumerate(order):
            product *= m[i][j]
        total += product
    return total


def test_polynomial_equals_determinants(spark):
    rng = np.random.default_rng(2)
    for d, most in ((1, 5), (2, 10 ** 6), (4, 10 ** 20), (5, 3), (5, 1)):
        half = [[int(rng.integers(-9, 10)) * most // 9 for _ in range(d)] for _ in range(d)]
        m = [[sum(a * b for a, b in zip(r, s)) for s in half] for r in half]
        c = whitening.characteristic_polynomial(spark, m)
        for x in (-2, 0, 1, 7):
            assert sum(v * x ** k for k, v in enumerate(c)) == determinant([[(i == j) * x - m[i][j] for j in range(d)] for i in range(d)])


def test_roots_of_known_polynomials():
    def times(roots):
        c = [1]
        for r in roots:
            c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
        return c
    for roots in ([5, 3, 3, 0], [9, 9, 9, 1], [2, 1, 0, 0, 0], [1000, 999]):
        top = sorted(roots, reverse=True)[:4]
        assert [Fraction(x, 1 << whitening.PLACES) for x in whitening.largest_roots(times(roots), 4, sum(roots))] == top
    [root] = whitening.largest_roots([-2, 0, 1], 1, 2)
    assert (root - 1) ** 2 < 2 << 2 * whitening.PLACES <= root ** 2


def test_eigenvectors_of_a_known_matrix():
    [v] = whitening.eigenvectors([[2, 1], [1, 2]], [Decimal(3)])
    assert v == pytest.approx([0.5 ** 0.5, 0.5 ** 0.5], abs=1e-15)
