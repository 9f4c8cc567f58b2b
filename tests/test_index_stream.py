"""The whole run as a stream: simulated frames in, the orientations that made them out."""

import numpy as np
from pyspark.sql import functions as F

from braggflow.functions.crystal import NICKEL
from braggflow.operators import forward, imaging
from braggflow.operators.refine import matrix_of
from braggflow.plans import derive as D
from braggflow.streaming import frames


def test_simulated_frames_give_their_orientations(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = [(i, matrix_of(rng.uniform(0.3, 2.5, 3)).reshape(-1).tolist()) for i in range(12)]
    orientations, hkls = spark.createDataFrame(made, "row_nr long, om array<double>"), D.hkls(spark)
    forward.spots(orientations, hkls, NICKEL, D.DETECTOR).write.parquet(str(tmp_path / "forward"))
    table = spark.read.parquet(str(tmp_path / "forward"))
    most = table.groupBy("row_nr").count().orderBy(F.desc("count"), "row_nr").limit(2).collect()
    lit = table.join(spark.createDataFrame([(r.row_nr, i) for i, r in enumerate(most)], "row_nr long, image_nr long"), "row_nr")
    floor = spark.range(D.SIZE * D.SIZE).select(F.col("id").alias("pix"), F.lit(5.0).alias("v"))
    full = floor.crossJoin(spark.range(2).toDF("image_nr")).join(lit.select("image_nr", "pix", F.lit(900.0).alias("s")), ["image_nr", "pix"], "left")
    full.select("image_nr", "pix", (F.col("v") + F.coalesce("s", F.lit(0.0))).alias("v")).coalesce(1).write.parquet(str(tmp_path / "landing"))
    query = frames.index_stream(
        frames.landing(spark, str(tmp_path / "landing")), orientations, hkls, NICKEL, D.DETECTOR, table, str(tmp_path / "out"), str(tmp_path / "state"),
        background=floor, threshold=lambda p: imaging.fixed(p, 100.0), available_now=True, min_spots=most[1]["count"] - 1, min_fit_spots=2, angle_deg=0.5,
    )
    query.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out" / "kept"))
    assert {(r.image_nr, r.row_nr) for r in kept.collect()} >= {(i, r.row_nr) for i, r in enumerate(most)}
    assert spark.read.parquet(str(tmp_path / "out" / "spots")).count() > 0
