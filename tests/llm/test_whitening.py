"""Whitening against plain arithmetic, and its numbers against matrices whose roots are known."""

from decimal import Decimal
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from veilframe.llm import charpoly
from veilframe.llm.queries import QUERIES
from veilframe.llm.whitening import characteristic_polynomial, scatter, whitened_components

SMALL = "/root/testdata/sf0.001"


def minors(matrix):
    """The characteristic polynomial by the Faddeev-LeVerrier recurrence."""
    n = len(matrix)
    a, m, out = np.array(matrix, dtype=object), np.zeros((n, n), dtype=object), [1]
    for k in range(1, n + 1):
        m = a.dot(m) + out[-1] * np.eye(n, dtype=int).astype(object)
        out.append(-int(np.trace(a.dot(m))) // k)
    return out


def test_polynomial(spark):
    rng = np.random.default_rng(2)
    for rows, size in ((3, 1), (9, 4), (2, 6), (40, 13)):
        y = rng.integers(-(10**7), 10**7, (rows, size)).astype(object)
        a = y.T.dot(y).tolist()
        assert characteristic_polynomial(spark, a) == minors(a)


def test_roots_and_null_spaces():
    a = [[5, 0, 0, 0], [0, 2, 0, 0], [0, 0, 5, 0], [0, 0, 0, 0]]
    p = minors(a)
    assert charpoly.roots_above(p, 0) == 3 and charpoly.roots_above(p, 5) == 0 and charpoly.roots_above(p, 9, 1) == 2
    for k, (root, start, count) in {1: (5, 1, 2), 2: (5, 1, 2), 3: (2, 3, 1)}.items():
        found = charpoly.isolate(p, k, 12)
        assert abs(found[0] - root) < Decimal("1e-35") and found[1:] == (start, count)
        vectors = charpoly.null_space(a, found[0], count)
        for i, v in enumerate(vectors):
            assert all(abs(sum(a[r][c] * v[c] for c in range(4)) - root * v[r]) < Decimal("1e-30") for r in range(4))
            assert all(abs(sum(x * y for x, y in zip(v, w)) - (i == j)) < Decimal("1e-30") for j, w in enumerate(vectors))
    assert charpoly.isolate(p, 4, 12) is None


def test_nearly_equal_roots():
    a = [[10**30, 1], [1, 10**30]]
    found = [charpoly.isolate(minors(a), k, 2 * 10**30) for k in (1, 2)]
    assert [f[1:] for f in found] == [(1, 1), (2, 1)] and abs(found[0][0] - found[1][0] - 2) < Decimal("1e-6")


def plain(rows):
    """{(id, component): (n, deviation, |whitened|, explained)} by double eigenvectors."""
    x = np.array([[floor(Fraction(float(v)) * 1024) + 100000 for v in vec] for _, vec in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    v = (x * n - s).astype(float) / n
    e, u = np.linalg.eigh(v.T @ v / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (i, _), row, away in zip(rows, x, v):
        for k in range(min(8, len(e))):
            if e[k] > 1e-6:
                out[i, k + 1] = (n, int(sum((n * a - b) ** 2 for a, b in zip(row, s))), abs(away @ u[:, k] / np.sqrt(e[k])), e[k] / e.sum())
    return out


def check(got, want):
    assert {(r[0], r.component) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, white, explained = want[r[0], r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(white, rel=1e-6, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    out = QUERIES["op13_exact_whitening"].run(spark, SMALL)
    assert dict(out.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    check(out.collect(), plain(rows))


def test_odd_rows(spark):
    good = [(1, [0.5, 0.25, -1.0]), (2, [1.5, 0.0, 2.0]), (2, [1.5, 0.0, 2.0]), (None, [0.1, 0.2, 0.3]), (5, [-3.0, 7.0, 1e-9])]
    bad = [(6, None), (7, []), (8, [None, 1.0, 2.0]), (9, [float("nan"), 1.0, 2.0]), (10, [1.0, float("inf"), 2.0]), (11, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in good + bad], "vec_id long, embedding array<double>, at string, deviation double")
    got = whitened_components(df).collect()
    want = plain([(k, v) for k, (_, v) in enumerate(good)])
    assert len(got) == len(want) and got[0].n == 5
    assert sorted((r.component, r.deviation) for r in got) == sorted((k, d) for (_, k), (_, d, _, _) in want.items())
    assert sorted(abs(r.whitened) for r in got) == pytest.approx(sorted(w for _, _, w, _ in want.values()))


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]], [None]])
def test_no_spread(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert whitened_components(df).collect() == []


def test_huge_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, 1e18]), (4, [1e16, -1e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([[floor(Fraction(v) * 1024) for v in r] for _, r in rows], dtype=object)
    both = np.concatenate([np.full((4, 1), 1, dtype=object), x], axis=1)
    assert scatter(df, "embedding", 2) == both.T.dot(both).tolist()
    got = whitened_components(df).collect()
    assert len(got) == 8 and all(r.deviation is None for r in got)
    away = sorted(abs(r.whitened) for r in got if r.component == 1)
    assert away == pytest.approx([0, 0, 2**0.5, 2**0.5], abs=1e-9)  # two vectors at +-1e300, two near the mean
