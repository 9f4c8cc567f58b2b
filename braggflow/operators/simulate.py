"""Simulated frames: the spots of given orientations, with random intensities and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braggflow.functions.crystal import Detector, Lattice
from braggflow.operators import forward


def simulate(orientations: DataFrame, hkls: DataFrame, lattice: Lattice, detector: Detector, *, skip_percent: int = 0, seed: int = 1, brightest: int = 16_000) -> DataFrame:
    """(grain, hkl_id, x, y, kept, v): every spot of every orientation (row_nr, om); open bounds, as a simulated detector has them.

    Skipped spots are told by a draw from a hash of seed, grain and reflection, so a row does not depend on its partition.
    """
    rows = forward.project(orientations, hkls.select("hkl_id", "h", "k", "l"), lattice, detector)
    inside = (F.col("px") >= 0) & (F.col("px") < detector.nr_px_x - 1) & (F.col("py") >= 0) & (F.col("py") < detector.nr_px_y - 1)
    rows = rows.where(inside & (F.col("energy") > detector.e_lo) & (F.col("energy") < detector.e_hi))
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "row_nr", "hkl_id"), F.lit(n))
    kept = (draw(1, 11) >= skip_percent // 10).cast("int")
    return rows.select(F.col("row_nr").alias("grain"), "hkl_id", F.col("px").alias("x"), F.col("py").alias("y"), kept.alias("kept"), (1.0 + draw(2, brightest)).alias("v"))


def paint(simulated: DataFrame, detector: Detector, image_nr: int = 0) -> DataFrame:
    """Sparse pixels (image_nr, pix, v) of the kept spots; spots on one pixel add up."""
    pix = F.floor("y").cast("long") * detector.nr_px_x + F.floor("x").cast("long")
    return simulated.where("kept = 1").groupBy(pix.alias("pix")).agg(F.sum("v").alias("v")).select(F.lit(image_nr).cast("long").alias("image_nr"), "pix", "v")
