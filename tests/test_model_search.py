"""The search by quadratic models: exact on quadratics, bounded, never below its start, better than the simplex far from a maximum."""

import numpy as np
import pytest

from braggflow.functions.crystal import NICKEL, NICKEL_DETECTOR
from braggflow.operators import refine


@pytest.mark.parametrize("n", [1, 3, 6])
def test_maxima_of_smooth_functions(n):
    rng = np.random.default_rng(n)
    for _ in range(10):
        top, root = rng.uniform(-0.8, 0.8, n), rng.normal(size=(n, n))
        bend, calls = root @ root.T + np.eye(n), []
        value = lambda v: calls.append(v) or -(v - top) @ bend @ (v - top)  # noqa: B023, E731
        found, best = refine.model_search(value, np.zeros(n), np.ones(n), evaluations=40 * n)
        assert np.allclose(found, top, atol=1e-2) and best == value(found) and len(calls) <= 40 * n + 1
        assert all((np.abs(v) <= 1 + 1e-12).all() for v in calls)


def test_bounds_hold_and_the_start_is_a_candidate():
    width, start = np.array([0.1, 2.0]), np.array([5.0, -1.0])
    for search in (refine.model_search, refine.search):
        calls = []
        found, best = search(lambda v: calls.append(v) or v.sum(), start, width)  # noqa: B023
        assert np.allclose(found, start + width) and np.isclose(best, 6.1)
        assert all((np.abs(v - start) <= width * (1 + 1e-9)).all() for v in calls)
        found, best = search(lambda v: float((v == start).all()), start, width)
        assert (found == start).all() and best == 1.0
        assert search(lambda v: 3.0, start, width)[1] == 3.0


def blurred(om, hkl, detector, sigma):
    """A frame of the orientation's spots with a Gaussian around each."""
    q = om @ NICKEL.reciprocal() @ hkl
    q = q[:, q[2] < 0]
    length = np.sqrt((q * q).sum(axis=0))
    unit = q / length
    energy = refine.HC_KEV_NM * length / (4 * np.pi * -unit[2])
    x, y, z = detector.rotation().T @ (np.array([[0.0], [0.0], [1.0]]) - 2 * unit[2] * unit)
    p = detector.p_array
    px = (x * p[2] / z - p[0]) / detector.px_x + 0.5 * (detector.nr_px_x - 1)
    py = (y * p[2] / z - p[1]) / detector.px_y + 0.5 * (detector.nr_px_y - 1)
    ok = (z > 0) & (energy >= detector.e_lo) & (energy <= detector.e_hi) & (px >= 0) & (px < detector.nr_px_x - 1) & (py >= 0) & (py < detector.nr_px_y - 1)
    image, reach = np.zeros((detector.nr_px_y, detector.nr_px_x), "f4"), 3 * sigma
    for a, b in zip(px[ok], py[ok], strict=True):
        rows = np.arange(max(0, int(b) - reach), min(detector.nr_px_y, int(b) + reach + 1))
        cols = np.arange(max(0, int(a) - reach), min(detector.nr_px_x, int(a) + reach + 1))
        image[np.ix_(rows, cols)] += 1000 * np.exp(-((rows[:, None] - b) ** 2 + (cols[None] - a) ** 2) / (2 * sigma**2))
    return image


def test_a_degree_off_the_orientation():
    """Thirty frames: the sum of objectives is higher than the simplex's, at no more evaluations; no fit is below its start."""
    rng = np.random.default_rng(0)
    axis = np.arange(-6, 7)
    hkl = np.stack([x.reshape(-1) for x in np.meshgrid(axis, axis, axis)]).astype("f8")
    hkl = hkl[:, (hkl != 0).any(axis=0) & ((hkl[0] + hkl[1]) % 2 == 0) & ((hkl[1] + hkl[2]) % 2 == 0)]
    direction, width = refine.directions(hkl), np.full(3, np.radians(3.0))
    total = dict.fromkeys(refine.METHODS, 0.0)
    calls = dict.fromkeys(refine.METHODS, 0)
    for _ in range(30):
        euler = rng.uniform(0.3, 2.5, 3)
        image = blurred(refine.matrix_of(euler), hkl, NICKEL_DETECTOR, 16)
        start = euler + np.radians(rng.uniform(-1.0, 1.0, 3))
        for name, method in refine.METHODS.items():

            def value(v):
                calls[name] += 1  # noqa: B023
                return refine.overlap(refine.matrix_of(v), NICKEL.reciprocal(), hkl, direction, image, NICKEL_DETECTOR, 90)  # noqa: B023

            best = method(value, start, width)[1]
            assert best >= value(start)
            total[name] += best
    assert total["model"] > 1.05 * total["simplex"] and calls["model"] <= 1.1 * calls["simplex"], (total, calls)
