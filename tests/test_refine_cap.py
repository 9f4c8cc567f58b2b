"""The cap on spots in the fit's objective, and frames that go packed to the parts of their candidates."""

import numpy as np
from pyspark.sql import functions as F

from braggflow.functions.crystal import NICKEL, NICKEL_DETECTOR
from braggflow.operators import refine
from braggflow.plans import derive as D


def test_only_the_first_spots_count():
    rng = np.random.default_rng(2)
    axis = np.arange(-6, 7)
    hkl = np.stack([x.reshape(-1) for x in np.meshgrid(axis, axis, axis)]).astype("f8")
    hkl = hkl[:, (hkl != 0).any(axis=0)]
    direction, om, ones = refine.directions(hkl), refine.matrix_of(rng.uniform(0.3, 2.5, 3)), np.ones((2048, 2048), "f4")
    value = lambda image, most: refine.overlap(om, NICKEL.reciprocal(), hkl, direction, image, NICKEL_DETECTOR, most)
    n = round(value(ones, None) ** (2 / 3))  # n lit spots of one: n * sqrt(n)
    assert n > 8
    for most in (1, 5, n - 1, n, n + 5):
        assert np.isclose(value(ones, most), min(most, n) ** 1.5)
    # what counts is decided before the image: dark places use up the cap as well
    assert value(np.zeros((2048, 2048), "f4"), 5) == 0


def test_frames_without_light_and_parts_without_candidates(spark):
    candidates = D.grid(spark, "/root/testdata/sf0.001").orderBy("row_nr").limit(3)
    candidates = candidates.select(F.expr("row_nr % 2").alias("image_nr"), F.col("row_nr").alias("grain_nr"), F.lit(1).cast("long").alias("n_solutions"), "row_nr", F.lit(1.0).alias("score"), "om")
    hkls = D.hkls(spark)
    from braggflow.operators import reflections

    pixels = spark.range(D.SIZE * D.SIZE).select(F.lit(1).cast("long").alias("image_nr"), F.col("id").alias("pix"), F.lit(4.0).alias("v"))
    found, spots = refine.refine(candidates, pixels, reflections.primitive(hkls), NICKEL, D.DETECTOR, min_spots=1, max_spots=7)
    rows = found.collect()
    assert {r.image_nr for r in rows} == {1} and all(r.n_matches <= 7 and np.isclose(r.quality, r.n_matches * np.sqrt(4.0 * r.n_matches)) for r in rows)
    assert spots.count() == sum(r.n_matches for r in rows)
