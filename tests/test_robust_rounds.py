"""The twin-aware choice in rounds, against a walk over each frame in order of quality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggflow.functions.crystal import CSL, CSL_AXIS_TOLERANCE, symmetry_quaternions
from braggflow.operators import cells, claims
from tests.test_geometry import rotation

SYMMETRY = np.array(symmetry_quaternions(225))
COLUMNS = "image_nr int, grain_nr int, quality double, source_row int, n_matches double, om array<double>"


def quaternion(m):
    w, v = np.linalg.eigh(np.array([
        [m[0, 0] + m[1, 1] + m[2, 2], m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]],
        [m[2, 1] - m[1, 2], m[0, 0] - m[1, 1] - m[2, 2], m[0, 1] + m[1, 0], m[0, 2] + m[2, 0]],
        [m[0, 2] - m[2, 0], m[0, 1] + m[1, 0], m[1, 1] - m[0, 0] - m[2, 2], m[1, 2] + m[2, 1]],
        [m[1, 0] - m[0, 1], m[0, 2] + m[2, 0], m[1, 2] + m[2, 1], m[2, 2] - m[0, 0] - m[1, 1]],
    ]))
    return v[:, -1]


def apart(p, q):
    """(angle, sorted absolute axis) of the cubic disorientation: the smallest of all equivalents, by trying them."""
    between = cells.equivalents((p * [1, -1, -1, -1])[None], q[None])[0][:1]
    images = cells.equivalents(between, SYMMETRY)[0]
    best = images[images[:, 0].argmax()]
    size = np.linalg.norm(best[1:])
    axis = np.sort(np.abs(best[1:] / size)) if size > 1e-9 else np.full(3, np.nan)
    return np.degrees(2 * np.arccos(min(1.0, best[0]))), axis


def walk(rows, found, min_unique, max_angle, min_total, sigmas, tolerance, cubic):
    kept = set()
    for frame in {r[0] for r in rows}:
        held, any_kept = [], False
        for r in sorted((r for r in rows if r[0] == frame), key=lambda r: (-r[2], -r[3])):
            n, labels = found.get((frame, r[1]), (0, 0))
            total, q, twin = n or round(r[4]), None, False
            if cubic and r[5] is not None:
                q = quaternion(np.array(r[5]).reshape(3, 3))
                away = [apart(k, q) for k in held]
                if any(a < max_angle for a, _ in away):
                    continue
                twin = any(abs(a - CSL[s][0]) < tolerance and np.linalg.norm(axis - np.array(CSL[s][1])) < CSL_AXIS_TOLERANCE for a, axis in away for s in sigmas)
            if total >= min_total and (twin or labels >= min_unique or not any_kept):
                kept.add((frame, r[1]))
                any_kept = True
                if q is not None:
                    held.append(q)
    return kept


def frames(seed):
    """Grains with near copies, twins of several kinds and twins of twins."""
    rng = np.random.default_rng(seed)
    rows, found = [], {}
    for frame, n in enumerate((1, 30, 70)):
        oms = [np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(max(1, n // 6))]
        oms = [m * np.linalg.det(m) for m in oms]
        while len(oms) < n:
            base = oms[rng.integers(len(oms))]
            kind = rng.integers(5)
            axis, angle = [((1, 1, 1), 60.0), ((1, -1, 1), 60.0), ((1, 1, 0), 38.94), ((0, 1, -1), 50.48), (rng.normal(size=3), rng.uniform(0, 7))][kind]
            oms.append(base @ rotation(axis, angle) @ rotation(rng.normal(size=3), rng.uniform(0, 2.5)))
        for i, m in enumerate(oms):
            rows.append((frame, i, float(rng.integers(1, 40)), i, float(rng.integers(0, 9)) + 0.5, None if rng.random() < 0.05 else m.reshape(-1).tolist()))
            if rng.random() < 0.7:
                found[frame, i] = (int(rng.integers(0, 12)), int(rng.integers(0, 4)))
    return rows, found


@pytest.mark.parametrize(("seed", "sigmas", "cubic", "walk_rows"), [(1, (3,), True, 12), (2, (3, 9, 11), True, 25), (2, (3, 9, 11), True, None), (3, (), True, None), (4, (3,), False, None)])
def test_rounds_equal_a_walk(spark, seed, sigmas, cubic, walk_rows):
    rows, found = frames(seed)
    solutions = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("at", "strong", "q", "cell")})
    counted = spark.createDataFrame([(*k, *v) for k, v in found.items()], "image_nr int, grain_nr int, n_unique long, n_unique_labels long")
    expect = walk(rows, found, 2, 5.0, 5, sigmas, 3.0, cubic)
    got = claims.keep_robust(solutions, counted, sigmas=sigmas, cubic=cubic, walk_rows=walk_rows)
    assert got.columns == [*solutions.columns, "n_unique", "n_unique_labels"]
    assert sorted((r.image_nr, r.grain_nr) for r in got.collect()) == sorted(expect) and len(expect) < len(rows)
    assert claims.keep_robust(solutions.where("false"), counted, sigmas=sigmas, cubic=cubic).count() == 0


def test_boundaries_are_distinct():
    assert [len(claims._boundaries((s,))) for s in (3, 9, 11)] == [4, 12, 12]
