"""Bias fields against a known field and a version over the whole array."""

import numpy as np
import pytest

from tests.test_kernels import array, volume
from volspark.operators import bias, fronts

SHAPE = (24, 26, 28)


def scene(seed=0, shape=SHAPE):
    """Three tissues with noise under a smooth field: observed values, the field's logarithm, and the mask of what is not air."""
    rng = np.random.default_rng(seed)
    z, y, x = np.meshgrid(*[np.linspace(-1, 1, n) for n in shape], indexing="ij")
    r = np.sqrt(z**2 + y**2 + x**2)
    tissue = np.where(np.sin(5 * z) * np.cos(4 * x + y) > 0.2, 300.0, np.where(np.cos(6 * y + 2 * z) > 0, 200.0, 120.0))
    field = 0.35 * np.sin(1.6 * x + 0.5) * np.cos(1.2 * y) - 0.25 * z**3 + 0.15 * x * y * z
    seen = np.where(r < 1.3, tissue * np.exp(rng.normal(0, 0.02, shape)) * np.exp(field), 0.0)
    return seen, field, r < 1.3


def whole_array(v, mask, iterations, shrink, threshold):
    """The same fit with one box and points one by one instead of matrix products."""
    lo, hi = [0] * 3, [n - 1 for n in v.shape]
    keep = mask & (v > 0)
    at = [c.ravel() for c in np.indices(v.shape)]
    own = keep.ravel()
    for c, n in zip(at, v.shape, strict=True):
        own = own & ((c % shrink == shrink // 2) if n >= shrink else True)
    at, u = [c[own] for c in at], np.log(v.ravel()[own])
    f, out = np.zeros(len(u)), np.zeros(v.shape)
    for level, most in enumerate(iterations):
        mesh = 1 << level
        for _ in range(most):
            w = u - f
            a, b = w.min(), w.max()
            r = bias.residual(w, bias.sharpened(bias.histogram(w, a, b), a, b), a, b)
            basis = [bias.spline(c, p, q, mesh) for c, p, q in zip(at, lo, hi, strict=True)]
            omega = np.einsum("ni,nj,nk->nijk", *basis)
            total = (omega**2).sum(axis=(1, 2, 3))
            top, under = (omega**3 * (r / total)[:, None, None, None]).sum(axis=0), (omega**2).sum(axis=0)
            delta = np.where(under > 0, top / np.where(under > 0, under, 1), 0)
            d = np.einsum("nijk,ijk->n", omega, delta)
            f = f + d
            full = [bias.spline(np.arange(n), 0, n - 1, mesh) for n in v.shape]
            out = out + np.einsum("zi,yj,xk,ijk->zyx", *full, delta)
            e = np.exp(d)
            if e.std(ddof=1) / e.mean() < threshold:
                break
    return out


@pytest.mark.parametrize("few", [10**9, 0])
def test_equals_whole_array(spark, few):
    seen, _, mask = scene(1, (13, 14, 9))
    rounds = (3, 2)
    got = bias.n4_log_bias(volume(spark, seen), None, rounds, 2, 1e-4, few)
    assert np.allclose(array(got, seen.shape), whole_array(seen, mask, rounds, 2, 1e-4), atol=1e-9)


def test_finds_a_known_field_better_than_a_quadratic_surface(spark):
    seen, field, mask = scene()
    v = volume(spark, seen)
    off = lambda b: np.std((b - field)[mask])  # noqa: E731  a constant factor is free
    n4, quadratic = array(bias.n4_log_bias(v, shrink=2), SHAPE), array(fronts.polynomial_log_bias(v, 2), SHAPE)
    assert off(n4) < 0.7 * off(quadratic) and off(n4) < 0.5 * np.std(field[mask])
    flat = array(bias.n4_log_bias(v, shrink=2, corrected=True), SHAPE)
    assert np.allclose(flat, seen / np.exp(n4))


def test_volumes_apart_masks_and_thin_axes(spark):
    seen, _, mask = scene(2, (3, 12, 12))
    both = volume(spark, seen).unionByName(volume(spark, np.full((3, 12, 12), 7.0), "flat")).unionByName(volume(spark, np.zeros((3, 12, 12)), "empty"))
    half = mask & (np.indices(seen.shape)[2] < 7)
    m = volume(spark, half.astype(float)).where("v > 0")
    got = bias.n4_log_bias(both, m, (4,), 4, 1e-4)
    assert np.allclose(array(got.where("vol_id = 'a'"), seen.shape), whole_array(seen, half, (4,), 4, 1e-4), atol=1e-9)
    assert not array(got.where("vol_id = 'flat'"), seen.shape).any() and not array(got.where("vol_id = 'empty'"), seen.shape).any()
    flat = bias.n4_log_bias(both.where("vol_id = 'flat'"), None, (2, 2), 2)
    assert np.abs(array(flat, seen.shape)).max() < 1e-12
    assert bias.n4_log_bias(both.where("false")).count() == 0


def test_splines_sum_to_one():
    for mesh in (1, 2, 8):
        w = bias.spline(np.arange(-2, 13), 0, 10, mesh)
        assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
    assert np.array_equal(bias.spline(np.zeros(1), 4, 4, 2), bias.spline(np.zeros(1), 0, 5, 2))
