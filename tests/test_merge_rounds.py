"""Clusters of coarse matches by cells and rounds, against a walk over each frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggflow.functions.crystal import symmetry_quaternions
from braggflow.operators import cells, merge


def rotations(rng, n, near):
    q = rng.normal(size=(n, 4))
    k = max(1, n // 3)
    q[k:] = q[rng.integers(0, k, n - k)] + rng.normal(scale=near, size=(n - k, 4))
    return q / np.linalg.norm(q, axis=1)[:, None]


@pytest.mark.parametrize(("space_group", "angle", "walk_rows"), [(225, 5.0, 0), (194, 20.0, 20), (1, 30.0, 20), (225, 5.0, None)])
def test_leaders_in_rounds_equal_a_walk(spark, space_group, angle, walk_rows):
    rng = np.random.default_rng(space_group)
    symmetry = np.array(symmetry_quaternions(space_group))
    rows, expect = [], {}
    for frame, n in enumerate((1, 60, 110)):
        q = rotations(rng, n, np.radians(angle) / 4)
        if n > 1:
            q[n // 2] = q[3]  # repeated orientations
            q[n // 2 + 1] = -q[4]
        at = np.sort(rng.choice(10 * n, n, replace=False))
        rows += [(frame, int(a), v.tolist()) for a, v in zip(at, q, strict=True)]
        expect |= {(frame, int(a)): int(at[o]) for a, o in zip(at, merge.leaders(q, symmetry, angle), strict=True)}
    df = spark.createDataFrame(rows, "image_nr int, at long, q array<double>")
    got = merge.leading(df, space_group=space_group, max_angle_deg=angle, walk_rows=walk_rows)
    assert {(r.image_nr, r["at"]): r.leader for r in got.collect()} == expect
    assert merge.leading(df.where("false")).count() == 0


def test_index_finds_all_that_is_near(spark):
    rng = np.random.default_rng(4)
    symmetry = symmetry_quaternions(225)
    q = rotations(rng, 300, 0.05)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(q)], "image_nr int, at int, q array<double>")
    placed = cells.index(df, symmetry, cells.chord(7.0)).cache()
    assert placed.where("home").count() == 300 and placed.count() < 1200
    got = {(r.near, r["at"]) for r in cells.meetings(placed.where("home"), placed, 7.0).collect()}
    images = cells.equivalents(q, np.array(symmetry))
    dots = np.einsum("id,jkd->ijk", q, images).max(axis=2)
    assert got == {tuple(map(int, x)) for x in np.argwhere(dots >= np.cos(np.radians(3.5)))}


def test_best_of_a_cluster_and_the_cap(spark):
    turn = lambda deg: [float(x) for x in (np.cos(np.radians(deg)), -np.sin(np.radians(deg)), 0, np.sin(np.radians(deg)), np.cos(np.radians(deg)), 0, 0, 0, 1)]
    orientations = spark.createDataFrame([(i, turn(d)) for i, d in ((10, 0.0), (11, 3.0), (12, 93.0), (13, 20.0), (14, 7.0))], "row_nr long, om array<double>")
    scores = {10: 5.0, 11: 7.0, 12: 7.0, 13: 1.0, 14: 9.0}
    scored = spark.createDataFrame([(3, i, 4, s, s) for i, s in scores.items()], "image_nr int, row_nr long, n_spots long, total double, score double")
    told = lambda df: {(r.grain_nr, r.n_solutions, r.row_nr) for r in df.collect()}
    # 11 and 12 are the same orientation of a cubic crystal; the earlier of equal scores is taken
    assert told(merge.merge(scored, orientations)) == {(1, 3, 11), (2, 1, 13), (3, 1, 14)}
    # in order of score: 14 claims 11 and 12, and 13 and 10 are beyond the best three
    assert told(merge.merge(scored, orientations, most=3)) == {(1, 3, 14)}
    assert merge.merge(scored.withColumn("row_nr", F.col("row_nr") + 100), orientations).count() == 0
