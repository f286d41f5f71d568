import math

import numpy as np
import pytest

from annalist.llm.whitening import MOST_DIMS, Centre, jacobi, whitened

SCHEMA = "vec_id long, component string, embedding array<float>, n int"


def plain(rows, k=8):
    """vec_id -> (deviation, whitened) by whole numbers and numpy's own eigenvectors."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float((n * a - b) / n) for a, b in zip(v, s, strict=True)] for v in x])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    y = centred @ q[:, :k] / np.sqrt(e[:k])
    return n, [(i, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), y[j]) for j, ((i, _), v) in enumerate(zip(rows, x, strict=True))], e / e.sum()


def test_equals_plain_numbers_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(12, 12)) * np.linspace(0.01, 3, 12)
    rows = [(i, [float(c) for c in (rng.normal(size=12) @ mix + 7).astype(np.float32)]) for i in range(300)]
    rows += [(5, rows[9][1]), (None, rows[9][1]), (400, None), (401, [1.0] * 11 + [None]), (402, [1.0] * 11 + [math.nan]), (403, [math.inf] + [0.0] * 11), (404, [])]
    odd = [(500, [1.0, 2.0])]
    df = spark.createDataFrame([(i, "x", v, 3) for i, v in rows + odd], SCHEMA).repartition(5)
    got = whitened(df).collect()
    n, want, explained = plain(rows)
    assert n == 302 and len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    signs = {}
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - explained[r.component - 1]) < 1e-10 and r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1
    for i, deviation, y in want:
        for c in range(1, 9):
            v = by_id[(i, deviation)][c][0]
            sign = signs.setdefault(c, 1 if v * y[c - 1] > 0 else -1)
            assert abs(v - sign * y[c - 1]) < 1e-8
    assert len(by_id[(9, next(d for i, d, _ in want if i == 9))][1]) == 1 and any(k[0] is None for k in by_id)


def test_small_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitened(frame([])).collect() == [] and whitened(frame([(1, "", None, 1), (2, "", [], 1)])).collect() == []
    assert whitened(frame([(1, "", [1.0, 2.0], 1)])).collect() == []
    two = whitened(frame([(1, "", [0.0, 1.0], 1), (2, "", [2.0, 1.0], 1)])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in two] == [(1, 1, 2, 2048**2, 1.0, 1.0), (2, 1, 2, 2048**2, 1.0, 1.0)]
    assert two[0].whitened == -two[1].whitened
    with pytest.raises(ValueError, match="dimensions"):
        whitened(frame([(1, "", [1.0] * (MOST_DIMS + 1), 1)]))


def test_large_entries_and_counts():
    assert Centre(3, [10, 2**61]).deviations(np.array([[4, 7]])) == [None]
    n, s, x = 10**5, [5, 10**11], [30_000, 2]
    assert Centre(n, s).deviations(np.array([x])) == [(n * x[0] - s[0]) ** 2 + (n * x[1] - s[1]) ** 2 if n * x[1] - s[1] > -(2**31) else None]
    assert Centre(4, [10, 10]).deviations(np.array([[3, 1], [2, 2]])) == [4 + 36, 8]
    n, s, x = 10**4, [5, 10**9], [200_000, 2]
    assert Centre(n, s).deviations(np.array([x])) == [(n * x[0] - s[0]) ** 2 + (n * x[1] - s[1]) ** 2]


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    scale = 10.0 ** -np.arange(0, 12, 1.5)
    core = rng.normal(size=(8, 8))
    core = core @ core.T + 8 * np.eye(8)
    values, vectors = jacobi(core * scale[:, None] * scale[None, :])
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-13) and (np.diff(values) <= 0).all() and (values > 0).all()
    from fractions import Fraction

    def determinant(m):
        m, d = [[Fraction(float(x)) for x in r] for r in m], Fraction(1)
        for i in range(len(m)):
            d *= m[i][i]
            for j in range(i + 1, len(m)):
                f = m[j][i] / m[i][i]
                m[j] = [a - f * b for a, b in zip(m[j], m[i], strict=True)]
        return d

    assert abs(np.log(values).sum() / math.log(determinant(core * scale[:, None] * scale[None, :])) - 1) < 1e-12
