"""Fits are made once, however many outputs read them."""

from pyspark.sql import functions as F

from braggflow.functions.crystal import NICKEL
from braggflow.operators import reflections, refine
from braggflow.plans import derive as D

DATA = "/root/testdata/sf0.001"


def test_outputs_read_stored_fits(spark):
    rows = D.grid(spark, DATA).orderBy("row_nr").limit(3)
    candidates = rows.select(F.lit(0).cast("long").alias("image_nr"), F.col("row_nr").alias("grain_nr"), F.lit(1).cast("long").alias("n_solutions"), "row_nr", F.lit(1.0).alias("score"), "om")
    found = refine.refine(candidates, D.pixels(spark, DATA), reflections.primitive(D.hkls(spark)), NICKEL, D.DETECTOR, min_spots=1)
    for df in found:
        assert "CoGroups" not in df._jdf.queryExecution().executedPlan().toString()
    assert found[0].count() > 0
