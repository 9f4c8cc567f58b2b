"""Another choice of grains from stored results, without indexing again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braggflow.operators import claims
from braggflow.sources import readers


def stored_results(spark: SparkSession, solutions: str, spots: str, layout: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Solutions and spots of text tables, as the evidence operators take them; a batch table is frame 1."""
    framed = lambda df: df.withColumn("image_nr", F.coalesce("image_nr", F.lit(1).cast("long")))
    return framed(readers.solutions(spark, solutions, layout)), framed(readers.spots(spark, spots, layout)).withColumnRenamed("source_row", "spot_row")


def choose_again(
    solutions: DataFrame, spots: DataFrame, labels: DataFrame | None = None, *, width: int = 2048, height: int = 2048,
    robust: bool = True, space_group: int = 225, **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept solutions, their spots, claims). Without labels each place on the detector that a spot lies on is a region."""
    if labels is None:  # any number that a place has alone does: labels are compared, never shown
        inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
        labels = F.when(inside, F.col("y").cast("long") * width + F.col("x") + 1)
    return claims.postprocess(solutions, spots, labels, robust=robust, space_group=space_group, **options)
