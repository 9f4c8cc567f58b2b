"""Fits that run side by side are the fits one by one, whatever shares a batch; frames and parts of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggflow.functions.crystal import NICKEL
from braggflow.operators import reflections, refine
from braggflow.plans import derive as D

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("options", [{}, {"max_spots": 4}, {"lattice_tolerance": (0.02, 0, 0, 0, 0, 0)}, {"method": "model"}])
def test_fits_equal_single_fits(spark, options):
    rng = np.random.default_rng(4)
    hkl = np.array([[r.h, r.k, r.l] for r in D.hkls(spark).orderBy("hkl_id").collect()], "f8").T
    images = [np.where(rng.random((64, 64)) < lit, rng.uniform(1, 9, (64, 64)), 0).astype("f4") for lit in (0.2, 0.05, 0.0)]
    oms, frame = [refine.matrix_of(rng.uniform(0.2, 2.8, 3)) for _ in range(9)], [0, 1, 2] * 3
    for at, (om, cell, best) in enumerate(refine.fits(oms, frame, images, NICKEL, hkl, D.DETECTOR, **options)):
        one = refine.fit(oms[at], NICKEL, hkl, images[frame[at]], D.DETECTOR, **options)
        assert np.array_equal(om, one[0]) and (cell, best) == one[1:]


def test_frames_share_batches_and_parts_share_frames(spark, monkeypatch):
    rows = D.grid(spark, DATA).orderBy("row_nr").limit(8)
    candidates = rows.select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("image_nr"), F.col("row_nr").alias("grain_nr"), F.lit(1).cast("long").alias("n_solutions"), "row_nr", F.lit(1.0).alias("score"), "om")
    pixels, hkls = D.pixels(spark, DATA), D.hkls(spark)
    run = lambda: sorted(refine.refine(candidates, pixels, reflections.primitive(hkls), NICKEL, D.DETECTOR, min_spots=1)[0].collect())
    whole = run()
    for name, value in (("PART_ROWS", 3), ("FITS", 2), ("IMAGE_BYTES", 1)):
        monkeypatch.setattr(refine, name, value)
    assert run() == whole and len({r.image_nr for r in whole}) > 1
    listed = hkls.orderBy("hkl_id").select("h", "k", "l").toPandas().to_numpy("f8").T
    image = np.zeros((64, 64), "f4")
    for r in pixels.where(f"image_nr = {whole[0].image_nr} and v > 0").collect():
        image.reshape(-1)[r.pix] = r.v
    start = np.array(candidates.where(f"row_nr = {whole[0].row_nr}").first().om).reshape(3, 3)
    assert refine.fit(start, NICKEL, listed, image, D.DETECTOR, max_spots=90)[2] == whole[0].objective


def test_many_fits_are_few_array_operations(monkeypatch):
    """Fits are not made one after another any more."""
    calls, overlaps = [], refine._overlaps
    monkeypatch.setattr(refine, "_overlaps", lambda m, *args: (calls.append(len(m)), overlaps(m, *args))[1])
    monkeypatch.setattr(refine, "overlap", None)
    rng, axis = np.random.default_rng(1), np.arange(-3, 4)
    hkl = np.stack([x.reshape(-1) for x in np.meshgrid(axis, axis, axis)]).astype("f8")
    hkl = hkl[:, (hkl != 0).any(axis=0)]
    oms = [refine.matrix_of(rng.uniform(0.3, 2.5, 3)) for _ in range(40)]
    refine.fits(oms, [0] * 40, [np.ones((64, 64), "f4")], NICKEL, hkl, D.DETECTOR, max_spots=90)
    assert len(calls) <= 200 < sum(calls)
