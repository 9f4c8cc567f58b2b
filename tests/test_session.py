"""Geometry in SQL equals the column functions and the forward operator."""

import math

import numpy as np
from pyspark.sql import functions as F

from braggflow.functions import geometry as G
from braggflow.functions import session
from braggflow.functions.crystal import NICKEL
from braggflow.operators import forward
from braggflow.plans import derive as D


def test_sql_functions_equal_columns(spark):
    rng = np.random.default_rng(4)
    q = rng.normal(size=(60, 2, 4))
    q /= np.linalg.norm(q, axis=2)[:, :, None]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(q)], "i int, p array<double>, q array<double>")
    for space_group in (225, 1):
        session.register_functions(spark, space_group)
        df.createOrReplaceTempView("turns")
        got = spark.sql("SELECT i, laue_misorientation(p, q) AS deg, laue_apart(slice(p, 2, 3), slice(q, 2, 3)) AS apart, laue_energy(3D, p[0] - 0.5D) AS energy FROM turns")
        apart = G.angle_deg([F.col("p")[i] for i in (1, 2, 3)], [F.col("q")[i] for i in (1, 2, 3)])
        expect = df.select("i", G.misorientation_deg(G.elements("p", 4), G.elements("q", 4), space_group).alias("deg"), apart.alias("apart"), G.energy_kev(F.lit(3.0), F.col("p")[0] - 0.5).alias("energy"))
        close = lambda x, y: (x is None and y is None) or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9)
        for x, y in zip(got.orderBy("i").collect(), expect.orderBy("i").collect(), strict=True):
            assert all(close(a, b) for a, b in zip(x, y, strict=True))
    assert spark.sql("SELECT laue_apart(array(0D, 0D, 0D), array(1D, 0D, 0D)) AS d").first().d is None


def test_table_function_equals_forward_spots(spark):
    orientations, hkls = D.grid(spark, "/root/testdata/sf0.001"), D.hkls(spark)
    session.register_spots(spark, hkls, NICKEL, D.DETECTOR, max_spots=9)
    orientations.createOrReplaceTempView("orientations")
    got = spark.sql("SELECT s.* FROM laue_spots(TABLE(orientations)) s")
    expect = forward.spots(orientations, hkls, NICKEL, D.DETECTOR, max_spots=9)
    rows = sorted(tuple(r) for r in expect.collect())
    assert sorted(tuple(r) for r in got.select(*expect.columns).collect()) == rows and len(rows) > 300
    assert spark.sql("SELECT * FROM laue_spots(TABLE(SELECT * FROM orientations WHERE row_nr < 0))").count() == 0
