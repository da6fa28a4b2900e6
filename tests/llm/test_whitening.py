"""Whitening against plain integers and numpy's own decompositions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from beaconlake.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, component string, n string"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(k, v, "x", "y") for k, v in rows], SCHEMA).repartition(parts)


def plain(rows, keep=32):
    """n, deviation by key, explained, absolute whitened by key: integers for the sums, numpy's SVD of the centred rows."""
    good = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(good), len(good[0][1])
    total = [sum(x[i] for _, x in good) for i in range(dim)]
    deviation = [(k, sum((n * c - s) ** 2 for c, s in zip(x, total))) for k, x in good]
    centred = np.array([[float(n * c - s) for c, s in zip(x, total)] for _, x in good]) / n
    _, sigma, axes = np.linalg.svd(centred, full_matrices=False)
    real = sigma > 1e-12 * sigma[0]
    sigma, axes, share = sigma[real][:keep], axes[real][:keep], (sigma**2 / (sigma**2).sum())[real][:keep]
    return n, deviation, share, np.abs(centred @ axes.T / (sigma / math.sqrt(n)))


def check(made, rows, keep=32):
    n, deviation, share, white = plain(rows, keep)
    got = made.collect()
    k = len(share)
    assert len(got) == len(deviation) * k
    want = sorted(((key, c + 1), dev, round(abs(float(white[i, c])), 5)) for i, (key, dev) in enumerate(deviation) for c in range(k))
    found = sorted(((r.vec_id, r.component), int(r.deviation_exact), round(abs(r.whitened), 5)) for r in got)
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[2] for f in found], [w[2] for w in want], atol=2e-5)
    assert all(r.n == n and r.identity_error < 1e-9 and abs(r.explained / share[r.component - 1] - 1) < 1e-9 for r in got)
    assert len({r.identity_error for r in got}) == 1
    assert all(r.deviation == r.deviation_exact or (r.deviation is None and r.deviation_exact >= 1 << 63) for r in got)


def test_against_plain(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 40)) @ np.diag(np.geomspace(30, 0.5, 40)) @ np.linalg.qr(rng.standard_normal((40, 40)))[0] + 17
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += rows[:7] + [(rows[3][0] + 5000, rows[3][1])]  # repeated rows and vectors
    odd = [(900, None), (901, []), (902, [None] * 40), (903, [math.nan] * 40), (904, [math.inf] + [0.0] * 39), (905, [1.0] * 39 + [None])]
    check(whitening.op12_whitening(frame(spark, rows + odd)), rows)


def test_tree_of_many_parts(spark, monkeypatch):
    """More tasks than one fold takes, some of them empty."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((90, 6)) * [50, 20, 9, 4, 2, 1])]
    check(whitening.whiten(frame(spark, rows, 120), keep=4), rows, 4)


def test_lengths_null_keys_and_wide_values(spark):
    rng = np.random.default_rng(7)
    rows = [(None if i % 9 == 0 else i, (v * 1e9).tolist()) for i, v in enumerate(rng.standard_normal((60, 3)))]
    other = [(500 + i, [1.0, 2.0]) for i in range(20)] + [(600, [1e300, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows + other)).collect()
    _, deviation, _, _ = plain(rows)
    assert sorted(int(r.deviation_exact) for r in got if r.component == 1) == sorted(d for _, d in deviation)
    assert sum(r.vec_id is None for r in got) == 3 * sum(k is None for k, _ in rows)
    assert all(r.identity_error < 1e-9 for r in got) and any(r.deviation is None for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]])
def test_nothing_to_whiten(spark, rows):
    made = whitening.op12_whitening(frame(spark, rows))
    assert made.collect() == [] and made.columns[0] == "vec_id"


def test_a_dependent_dimension(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((80, 3)) * 300) / 64
    rows = [(i, [*v.tolist(), float(v[0]), 5.0]) for i, v in enumerate(x)]
    got = whitening.op12_whitening(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in got)


def test_jacobi_keeps_small_singular_values():
    """Graded columns: singular values far below the rounding of the Gram matrix keep their digits."""
    rng = np.random.default_rng(9)
    for d in (1, 2, 7, 30):
        scale = np.geomspace(1, 1e-12, d)
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        sigma, axes = whitening.jacobi(q * scale)
        assert np.allclose(sigma, scale, rtol=1e-12)
        assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-13
        r = rng.standard_normal((d, d))
        sigma, axes = whitening.jacobi(r)
        assert np.allclose(sigma, np.linalg.svd(r)[1], rtol=1e-10)
        assert np.abs((r @ axes).T @ (r @ axes) - np.diag(sigma**2)).max() < 1e-10
