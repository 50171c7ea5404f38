"""Whitening: rank-one updates against plain eigendecompositions, the contract's columns in exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import whitening
from tallyfold.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def integers(vectors):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)


def covariance(x):
    """Exact sums, then floats."""
    n, sums = len(x), x.sum(axis=0)
    centred = n * x - sums
    return np.array([[float(Fraction(int(v), n**3)) for v in row] for row in centred.T @ centred])


def vectors(rng, n, d, kind="full"):
    c = rng.normal(size=(n, d)) * rng.uniform(0.02, 0.3, size=d)
    if kind == "low rank":
        c = rng.normal(size=(n, 3)) @ rng.normal(size=(3, d))
    if kind == "repeated":
        c = np.repeat(c[:max(2, n // 9)], 9, axis=0)[:n]
    if kind == "equal columns":
        c[:, -1], c[:, 0] = c[:, -2], 0.5
    return c.astype(np.float32)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1e3), st.floats(1e-3, 1e3)), min_size=1, max_size=8, unique_by=lambda p: round(p[0], 2)))
def test_secular_roots(pairs):
    poles, weights = (np.array(a) for a in zip(*sorted(pairs)))
    roots, apart = whitening.secular_roots(poles, weights)
    z = np.sqrt(weights)
    plain = np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z))
    assert np.abs(roots - plain).max() <= 1e-12 * plain[-1]
    assert np.allclose(apart, poles - roots[:, None], atol=1e-12 * plain[-1])
    assert all(np.sum(apart[j] < 0) == j + 1 for j in range(len(poles)))  # one root above each pole


@pytest.mark.parametrize("kind", ["full", "low rank", "repeated", "equal columns"])
@pytest.mark.parametrize("d, n", [(1, 20), (5, 3), (12, 200), (64, 300)])
def test_spectrum_of_updates_and_merges(kind, d, n):
    if kind == "equal columns" and d < 2:
        return
    x = integers(vectors(np.random.default_rng(d + n), n, d, kind)).astype(np.int64)
    n = len(x)
    plain = covariance(x.astype(object)) * n
    top = max(np.linalg.eigvalsh(plain)[-1], 1e-9)
    parts = [whitening.Moments(0, np.zeros(d, np.int64), whitening.Spectrum.zero(d)) for _ in range(4)]
    for i, row in enumerate(x):
        parts[0].add(row)
        parts[1 + i % 3].add(row)
    merged = whitening.Moments.from_bytes(parts[1].to_bytes(), d)
    for other in parts[2:]:
        if other.n:
            merged.merge(other)
    for m in (parts[0], merged):
        assert m.n == n and (m.sums == x.sum(axis=0)).all()
        u, values = m.spectrum.vectors, m.spectrum.values
        assert (np.diff(values) >= 0).all() and np.abs(u.T @ u - np.eye(d)).max() < 1e-12
        assert np.abs((u * values) @ u.T - plain).max() < 1e-11 * top


def check(found, rows, components=32):
    """The contract in exact sums and a plain eigendecomposition."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = integers([v for _, v in usable])
    n, d = x.shape
    sums = x.sum(axis=0)
    v = covariance(x)
    values, basis = np.linalg.eigh(v)
    falling = np.argsort(-values)
    values, basis = values[falling], basis[:, falling]
    k = min(components, int(np.sum(values > 1e-12 * values[0])))
    assert len(found) == n * k
    by_component, by_id = {}, {}
    for r in found:
        by_component.setdefault(r.component, []).append(r)
        by_id.setdefault(r.vec_id, set()).add(r.deviation)
        assert r.n == n
    deviations = {}
    for (i, _), row in zip(usable, x):
        deviations.setdefault(i, set()).add(int(sum((n * row - sums) ** 2)))
    assert by_id == deviations
    centred = np.array([[float(Fraction(int(c), n)) for c in row] for row in n * x - sums])
    got = np.empty((n, k))
    for component, rows_of in by_component.items():
        j = component - 1
        rows_of.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0, r.whitened))
        assert all(abs(r.explained - values[j] / np.trace(v)) <= 1e-9 for r in rows_of)
        got[:, j] = [r.whitened for r in rows_of]
        plain = centred @ basis[:, j] / math.sqrt(values[j])
        alone = min([abs(values[j] - o) for i, o in enumerate(values) if i != j], default=1) > 1e-6 * values[0]
        if alone:  # else the direction is not determined
            # columns are in order of id and size, so a plain column of either sign is too
            errors = []
            for sign in (1, -1):
                order = sorted(range(n), key=lambda a: (usable[a][0] is None, usable[a][0] or 0, sign * plain[a]))
                errors.append(np.abs(got[:, j] - sign * plain[order]).max())
            assert min(errors) < 1e-7
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert all(abs(np.mean(got[:, j] ** 2) - 1) < 1e-9 for j in range(k))


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["full", "low rank", "repeated"])
def test_whiten(spark, kind):
    rng = np.random.default_rng(11)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(rng, 300, 40, kind))]
    bad = [(900, None), (901, []), (902, [None] * 40), (903, [float("nan")] + [0.0] * 39), (904, [float("inf")] * 40), (905, [1.0, 2.0])]
    more = [(7, rows[8][1]), (7, rows[8][1]), (None, rows[9][1])]
    df = table(spark, rows + bad + more).selectExpr("*", "'x' AS n", "'y' AS component", "'z' AS whitened").repartition(7)
    check(whitening.whiten(df).collect(), rows + more)


def test_trees_of_small_groups_give_the_same(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(np.random.default_rng(4), 200, 6))]
    df, d = whitening.usable(table(spark, rows).repartition(23, "vec_id"), "vec_id", "embedding")
    x = integers([v for _, v in rows])
    models = [whitening.fit(df, d, fan_in) for fan_in in (2, 5, 64)]
    for m in models:
        assert m.n == 200 and (m.sums == x.sum(axis=0)).all()
        assert np.allclose((m.vectors * m.values) @ m.vectors.T, covariance(x), atol=1e-12)
        assert m.trace == pytest.approx(np.trace(covariance(x)), rel=1e-13)


def test_degenerate_tables(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)]):
        found = whitening.whiten(table(spark, rows))
        assert found.columns == columns and found.count() == 0
    check(whitening.whiten(table(spark, two := [(1, [0.5, 0.25]), (2, [0.0, 0.25])])).collect(), two)
    with pytest.raises(Exception, match="beyond 2\\^40"):
        whitening.whiten(table(spark, [(1, [3e38]), (2, [0.0])])).collect()


def test_deviations_beyond_64_bits_raise():
    model = whitening.Model(10**9, np.array([10**15, 10**15]), np.ones(2), np.eye(2), 2.0)
    assert whitening._deviations(np.array([[10**6 + 3, 10**6]]), model)[0] == 9 * 10**18
    with pytest.raises(OverflowError):
        import pyarrow as pa

        pa.array(whitening._deviations(np.array([[10**6 + 4, 10**6]]), model), pa.int64())


def test_query_over_its_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op12_whitening"](spark, sf_dir).collect(), rows)
