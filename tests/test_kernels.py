"""Numpy kernels against analytic results."""

import numpy as np
import pytest

from gridskein.operators import kernels as k
from gridskein.operators import tracking as tk


def test_labels_wrap_and_touch():
    mask = np.zeros((4, 6), bool)
    mask[1, 0] = mask[1, 5] = mask[2, 1] = True
    flat = k.label(mask, True)
    assert flat[1, 0] == flat[1, 5] == 1 and flat[2, 1] == 2
    assert k.label(mask, False).max() == 3
    assert k.label(mask, True, True).max() == 1
    assert k.label(np.zeros((3, 3), bool), True).max() == 0


def test_labels_3d_meet_across_levels():
    mask = np.zeros((2, 3, 4), bool)
    mask[0, 0, 0] = mask[1, 1, 1] = True
    assert k.label(mask, True, True).max() == 1
    assert k.label(mask, True, False).max() == 2


def test_flood_and_low_seed():
    v = np.array([[3.0, 3, 0, 3]])
    assert k.flood_from(v, [(0, 0)], 2, False).tolist() == [[True, True, False, False]]
    assert k.flood_from(v, [(0, 0)], 2, True).tolist() == [[True, True, False, True]]
    with pytest.raises(ValueError):
        k.flood_from(v, [(0, 2)], 2, False)


def test_fill_missing_is_harmonic():
    v = np.tile(np.arange(10.0)[:, None], (1, 8))
    gone = v.copy()
    gone[3:6, 2:5] = np.nan
    assert np.allclose(k.fill_missing(gone), v, atol=1e-6)


def test_contour_of_a_cone_is_closed_and_round():
    y, x = np.mgrid[:21, :21] - 10.0
    (line,) = k.contour_lines(-np.hypot(x, y), -5.5)
    assert (line[0] == line[-1]).all()
    assert np.abs(np.hypot(line[:, 0] - 10, line[:, 1] - 10) - 5.5).max() < 0.1


def test_contour_across_is_open():
    (line,) = k.contour_lines(np.tile(np.arange(5.0)[:, None], (1, 7)), 2.5)
    assert len(line) == 7 and np.allclose(line[:, 0], 2.5)


def test_saddle_keeps_high_corners_apart():
    assert len(k.contour_lines(np.array([[1.0, 0], [0, 1]]), 0.5)) == 2


def test_line_is_the_longest_way():
    x, y = np.array([0.0, 1, 2, 3, 2]), np.array([2.0, 2, 2, 2, 3])
    d = np.full((5, 8), 2.0e6)
    (line,) = k.join_line(x, y, d, d, 8, False, 1.2, 1e6)
    assert line.tolist() == [0, 1, 2, 3]
    assert k.join_line(x, y, d, d, 8, False, 1.2, 1e9) == []
    assert k.join_line(x[:0], y[:0], d, d, 8, True, 1.5, 1) == []


def test_line_across_the_wrap():
    (line,) = k.join_line(np.array([7.0, 0.0]), np.array([1.0, 1.0]), np.full((3, 8), 2.0e6), np.ones((3, 8)), 8, True, 1.5, 1e6)
    assert len(line) == 2


def test_single_low():
    y, x = np.mgrid[:21, :21]
    msl = 101000 - 1500 * np.exp(-((x - 10) ** 2 + (y - 10) ** 2) / 20)
    lat, lon, ones = 40.0 + y, x * 1.0, np.full((21, 21), 1.0e4)
    labels, table = k.cyclones_by_contour(msl, 0 * ones, lat, lon, ones, 800, 4.5e6, 1500, 750, 200)
    assert len(table) == 1 and table[0][1:3] == (50.0, 10.0) and labels[10, 10] == 1
    assert k.cyclones_by_contour(msl, 0 * ones + 2000, lat, lon, ones, 800, 4.5e6, 1500, 750, 200)[1] == []


def test_blobs_join_near_peaks():
    rain = np.array([[0.0, 3, 1, 2, 0, 0, 0, 5]])
    lat, lon, ones = np.zeros((1, 8)), np.arange(8.0)[None], np.ones((1, 8))
    assert len(k.blobs(rain, lat, lon, ones, 50)[1]) == 3
    assert len(k.blobs(rain, lat, lon, ones, 250)[1]) == 2


def test_solvers():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 12))
    b = rng.normal(size=12)
    spd = a @ a.T + 12 * np.eye(12)
    x, rest = k.conjugate_gradient(lambda v: spd @ v, b)
    assert rest < 1e-10 and np.allclose(spd @ x, b, atol=1e-5)
    general = a + 12 * np.eye(12)
    x, rest = k.bicgstab(lambda v: general @ v, b)
    assert rest < 1e-10 and np.allclose(general @ x, b, atol=1e-5)


def test_harmonics_round_trip():
    lats = np.linspace(-87, 87, 40)
    c = np.zeros((6, 6), complex)
    c[0, 2], c[1, 3], c[3, 5] = 1.0, 0.5 - 0.2j, 0.3j
    field = k.synthesis(c, lats, 64)
    assert np.allclose(k.harmonics(field, lats, 5), c, atol=1e-10)
    assert np.allclose(k.truncated(c, 2)[0, 2], 1.0) and k.truncated(c, 2)[3, 5] == 0
    n = 2
    assert np.isclose(k.inverse_laplacian(c)[0, 2], -(6.37e6**2) / (n * (n + 1)))


def test_varimax_keeps_sums_of_squares():
    a = np.random.default_rng(1).normal(size=(10, 3))
    assert np.allclose((k.varimax(a) ** 2).sum(axis=1), (a**2).sum(axis=1))


def test_kalman_follows_constant_speed():
    x, p = np.array([0.0, 0.0]), np.diag(tk.TRACKING.first_variance)
    for n in range(1, 30):
        x, p = tk.kalman_step(x, p, 1e5 * n)
    assert abs(x[0] - 29e5) < 2e4 and abs(x[1] * tk.TRACKING.step_seconds - 1e5) < 2e4


def test_polar_round_trip():
    for hemis, lat in (("N", 63.0), ("S", -41.0)):
        la, lo = tk.polar_latlon(*tk.polar_xy(lat, 222.0, hemis), hemis)
        assert np.allclose((la, lo), (lat, 222.0))
