"""The fit of candidates: which reflections it takes, and that it takes every candidate."""

import numpy as np

from braggflow.functions.crystal import HC_KEV_NM, NICKEL, Detector
from braggflow.operators import refine


def test_higher_orders_stand_in_for_a_first_order_out_of_the_window():
    detector = Detector((0.0, 0.0, 0.5), (0.0, 0.0, 0.0), 0.01, 0.01, 201, 201)
    hkl = np.array([[0.0, 0, -1], [0.0, 0, -2], [0.0, 0, -3]]).T
    tilt = np.radians(60.0)  # (0, 0, -1) at 30 degrees from the detector's plane: reflected forwards
    om = np.array([[1.0, 0, 0], [0, np.cos(tilt), -np.sin(tilt)], [0, np.sin(tilt), np.cos(tilt)]])
    first = HC_KEV_NM * NICKEL.reciprocal()[2, 2] / (4 * np.pi * np.cos(tilt))
    image = np.full((201, 201), 4.0, "f4")
    for e_lo, expect in ((first * 0.5, 2.0), (first * 1.5, 2.0), (first * 2.5, 2.0), (first * 3.5, 0.0)):
        at = Detector(detector.p_array, detector.r_array, 0.01, 0.01, 201, 201, e_lo=e_lo, e_hi=first * 9)
        assert refine.overlap(om, NICKEL.reciprocal(), hkl, refine.directions(hkl), image, at) == expect


def test_every_coarse_match_reaches_the_fit(spark, monkeypatch):
    from pyspark.sql import functions as F

    from braggflow.plans import derive as D
    from braggflow.plans import registry

    data, seen = "/root/testdata/sf0.001", []
    rows = D.orientations(spark, data).orderBy("row_nr").limit(60)
    scored = rows.select(F.lit(0).cast("long").alias("image_nr"), "row_nr", F.lit(5).cast("long").alias("n_spots"), F.lit(1.0).alias("total"), F.col("row_nr").cast("double").alias("score"))
    monkeypatch.setattr(registry, "_coarse", lambda *_: scored)
    none = spark.createDataFrame([], "image_nr long, grain_nr long, row_nr long, n_matches long, n_spots_calc long, quality double")
    monkeypatch.setattr(refine, "refine", lambda candidates, *_, **__: (seen.append(candidates), none)[1:] * 2)
    registry.QUERIES["refine_candidates"](spark, data)
    assert seen[0].agg(F.sum("n_solutions")).first()[0] == 60


def test_what_cannot_be_reached_does_not_count():
    from braggflow.functions.crystal import NICKEL_DETECTOR

    rng = np.random.default_rng(5)
    axis = np.arange(-8, 9)
    hkl = np.stack([x.reshape(-1) for x in np.meshgrid(axis, axis, axis)]).astype("f8")
    hkl = hkl[:, (hkl != 0).any(axis=0)]
    image = rng.random((2048, 2048)).astype("f4")
    for _ in range(10):
        start = rng.uniform(0.2, 2.5, 3)
        width = np.radians(3.0)
        kept = refine.reachable(refine.matrix_of(start), NICKEL.reciprocal(), hkl, NICKEL_DETECTOR, 3 * width)
        assert 0 < kept.sum() < 0.6 * hkl.shape[1]
        for _ in range(5):
            om = refine.matrix_of(start + rng.uniform(-width, width, 3))
            whole, part = ((refine.overlap(om, NICKEL.reciprocal(), h, refine.directions(h), image, NICKEL_DETECTOR)) for h in (hkl, hkl[:, kept]))
            assert whole == part
