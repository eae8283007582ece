"""Whitening against exact sums, a plain eigendecomposition and the definition; the refinement on hard spectra."""

import numpy as np
import pytest

from cautela.llm.common import table
from cautela.llm.queries import QUERIES
from cautela.llm.whitening import Centre, Moments, clusters, components, refined, whiten


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(values)) - 0.5 * (q.T @ q))
    a = (q * np.array(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 64, 64),
        [1 + 1e-9 * i for i in range(32)] + list(range(2, 34)),
        [1] * 10 + [2] * 10 + list(range(3, 47)),
        10.0 ** -np.arange(0, 12, 0.25),
        [5] * 8,
        [1 + 1e-13 * i for i in range(8)] + [3 + 1e-7 * i for i in range(20)],
        [0] * 20 + list(range(1, 45)),
        [7.0],
    ],
)
def test_refinement_reaches_double_precision(values):
    a, _ = symmetric(values)
    found, x = refined(a, np.linalg.eigh(a.astype(np.float32))[1])
    top = max(np.abs(values))
    assert np.abs(np.sort(found) - np.sort(values)).max() < 1e-16 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16 and np.abs(a @ x - x * found).max() < 1e-16 * top
    assert (np.diff(found) <= 0).all()


def test_close_values_get_their_own_vectors():
    """Float32 cannot tell these apart, so their start is any basis of the plane."""
    a, q = symmetric([1, 1 + 1e-9, 1 + 2e-9, 5, 9])
    _, x = refined(a, np.linalg.eigh(a.astype(np.float32))[1])
    assert np.abs(np.abs(x.T @ q[:, ::-1]) - np.eye(5)).max() < 1e-9
    assert [g.tolist() for g in clusters(np.array([3.0, 1.0, 1.1, 9.0, 3.05]), 0.2)] == [[1, 2], [0, 4]]


def test_moments_merge():
    rows, whole = np.random.default_rng(1).normal(1e6, 1, (500, 4)), Moments(4)
    for part in np.array_split(rows, [1, 7, 300, 300]):
        one = Moments(4)
        if len(part):
            one.add(part)
        whole.merge(one.n, one.mean, one.products)
    assert whole.n == 500 and np.allclose(whole.covariance().astype(float), np.cov(rows.T, bias=True), rtol=1e-12)


def test_deviations_are_exact():
    whole = np.array([[3, -(1 << 40)], [0, 1 << 40], [5, 7]], np.int64)
    sums = [int(x) for x in whole.sum(axis=0)]
    centre = Centre(3, [s // 3 for s in sums], [s % 3 for s in sums])
    exact = [sum((3 * int(x) - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in whole]
    assert centre.deviations(whole) == [x if x < 1 << 63 else None for x in exact] and None in centre.deviations(whole)


def expected(rows, k=32):
    """(id, component) -> n, deviation, |whitened| and share, from whole numbers and a plain eigendecomposition."""
    out = []
    for dim in {len(v) for _, v in rows}:
        ids = [i for i, v in rows if len(v) == dim]
        x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows if len(v) == dim]
        n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
        exact = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
        centred = np.array(exact, np.float64) / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        kept = [j for j in range(min(k, dim)) if values[j] > 1e-13 * values[0]] if values[0] > 0 else []
        scores = centred @ vectors
        for i, row, deviations in zip(ids, scores, exact, strict=True):
            out += [(i, j + 1, n, sum(d * d for d in deviations), abs(row[j]) / np.sqrt(values[j]), values[j] / values.sum()) for j in kept]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def check(frame, rows):
    got = sorted(
        ((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in frame.collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]),
    )
    wanted = expected(rows)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in wanted], rtol=1e-7, atol=1e-9)
    assert all(0 <= r.identity_error < 1e-9 for r in frame.collect())


def test_query(spark, sf):
    frame = QUERIES["op12_embedding_whitening"](spark, sf)
    check(frame, [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()])
    signs = {}
    for r in frame.collect():
        signs.setdefault(r.component, []).append(r.whitened)
    # The whitened components themselves, not only their sizes, are uncorrelated.
    assert np.abs(np.cov(np.array([signs[c] for c in sorted(signs)]), bias=True) - np.eye(len(signs))).max() < 0.5


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(i % 3, 0.5, 5)] + [2.0]) for i in range(60)] + [(None, [0.5] * 6), (7, [0.1] * 6)]
    good += [good[3], good[3]] + [(200 + i, [float(i), 1.0]) for i in range(4)] + [(300, [1.0, 2.0, 3.0])]
    bad = [(100, None), (101, []), (102, [1.0] * 5 + [None]), (103, [1.0] * 5 + [float("nan")]), (104, [float("-inf")] * 6), (105, [1e300] * 6)]
    schema = "vec_id long, embedding array<double>, id string, vec int, dim int, n int"
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in good + bad], schema).repartition(5)
    check(whiten(frame), good)  # one vector alone, and a component that never changes, have no variance
    assert whiten(frame.filter("vec_id = 300")).count() == whiten(frame.filter("vec_id < 0")).count() == 0


def test_many_parts_merge_by_tree(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(0, [3, 2, 1], 3)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(40)
    check(whiten(frame), [(r.vec_id, r.embedding) for r in frame.collect()])
    model = components(np.diag([4.0, 9.0, 0.0]), 2)
    assert model.variances.tolist() == [9.0, 4.0] and np.array_equal(model.vectors, [[0, 1], [1, 0], [0, 0]])
