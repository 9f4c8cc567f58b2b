"""Pairs of a frame in blocks, against the expressions over joined rows; pairs are not shuffled."""

import numpy as np
from pyspark.sql import functions as F

from braggflow.functions import geometry as G
from braggflow.operators import pairs
from braggflow.plans import registry


def test_blocks_equal_expressions_over_joined_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 4)
    q = np.random.default_rng(4).normal(size=(23, 4))
    q[7] = q[3]
    q /= np.linalg.norm(q, axis=1)[:, None]
    rows = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(q)], "image_nr int, at long, q array<double>")
    left, right = rows.selectExpr("image_nr", "at as a", "q as p"), rows.selectExpr("image_nr", "at as b", "q")
    p, q = G.elements("p", 4), G.elements("q", 4)
    joined = left.join(right, "image_nr").where("a < b").withColumn("axis", G.disorientation_axis(p, q))
    expect = joined.select("image_nr", "a", "b", F.round(G.misorientation_deg(p, q, 225), 6), *[F.round(F.col("axis")[i], 6) for i in range(3)])
    found = pairs.disorientations(rows)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.select("image_nr", "a", "b", F.round("angle_deg", 6), *[F.round(f"x{i}", 6) for i in range(3)])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == sorted(map(tuple, expect.collect()), key=lambda r: r[:3])
    assert found.where("a = 3 and b = 7").first().x0 is None


def test_numbers_are_rounded_by_the_task_as_spark_would(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 63, 2_000), rng.integers(0, 630_000, 2_000) / 10_000 + 5e-5, np.nextafter(rng.integers(0, 9_999, 500) / 10_000 + 5e-5, 0), [0.0, 1.0, 62.79995, np.nan]])
    for digits in (4, 6):
        rows = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", F.round("x", digits).alias("r")).collect()
        expect = {repr(r.x): r.r for r in rows}
        got = pairs.rounded(x, digits)
        assert all(np.isnan(v) and np.isnan(g) or expect[repr(float(v))] == g for v, g in zip(x, got, strict=True))
    plan = registry.QUERIES["disorientation_axes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan
