"""Whole runs: frames in, solutions and spots out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from braggflow.functions.crystal import Detector, Lattice
from braggflow.operators import claims, forward, match, merge, reflections
from braggflow.operators.refine import refine
from braggflow.sources.store import stored


def index_frames(pixels: DataFrame, orientations: DataFrame, hkls: DataFrame, lattice: Lattice, detector: Detector, *, labels: DataFrame | None = None, max_spots: int = 30, min_spots: int = 5, min_fit_spots: int = 5, min_intensity: float = 0.0, max_angle_deg: float = 5.0, forward_table: DataFrame | None = None, store: str | None = None, **options) -> dict[str, DataFrame]:
    """Coarse match, merge, refine, claims and choice for all frames; a stored forward table may stand in for the simulation.

    store: a shared folder that fits are written to and read back from, so several outputs do not fit again.
    """
    table = forward_table if forward_table is not None else stored(forward.spots(orientations, hkls, lattice, detector, max_spots=max_spots), "forward")
    coarse = match.coarse(table, pixels, min_spots=min_spots, min_intensity=min_intensity)
    merged = merge.merge(coarse, orientations, space_group=lattice.space_group, max_angle_deg=max_angle_deg)
    candidates = merged.join(orientations.select("row_nr", "om"), "row_nr")
    solutions, spots = refine(candidates, pixels, reflections.primitive(hkls), lattice, detector, min_spots=min_fit_spots, max_spots=3 * max_spots, **options)
    if store is not None:
        solutions, spots = _written(solutions, f"{store}/solutions"), _written(spots, f"{store}/spots")
    spots = spots.withColumn("spot_row", spots["spot_nr"])
    if labels is None:
        from braggflow.operators.relations import fallback_labels

        labels = fallback_labels(spots)
    kept, kept_spots, found = claims.postprocess(solutions, spots, labels, space_group=lattice.space_group)
    return {"coarse": coarse, "merged": merged, "solutions": solutions, "spots": spots, "kept": kept, "kept_spots": kept_spots, "claims": found}


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
