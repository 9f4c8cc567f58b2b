"""Joins and aggregates around solutions, spots, peaks and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["image_nr", "grain_nr"]


def split_by_image(solutions: DataFrame, spots: DataFrame) -> DataFrame:
    """Solutions without a frame number, once for each frame that their grain has spots in."""
    return solutions.join(spots.select("image_nr", "grain_nr").distinct(), "grain_nr")


def image_ids(spots: DataFrame, solutions: DataFrame) -> DataFrame:
    """Frames that have spots or solutions."""
    return spots.select("image_nr").union(solutions.select("image_nr")).distinct()


def per_frame(solutions: DataFrame, spots: DataFrame) -> DataFrame:
    """(image_nr, n_solutions, n_spots) of every frame that either side knows; an absent side counts zero."""
    left = solutions.groupBy("image_nr").agg(F.count("*").alias("n_solutions"))
    right = spots.groupBy("image_nr").agg(F.count("*").alias("n_spots"))
    both = left.join(right, "image_nr", "full_outer")
    return both.select("image_nr", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_solutions", "n_spots")])


def with_mapping(per_image: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per-frame rows with file, frame, skipped and reason; null where the mapping lacks the frame."""
    return per_image.join(mapping, "image_nr", "left")


def spots_of_grains(solutions: DataFrame, spots: DataFrame) -> DataFrame:
    """Spots with their grain's quality."""
    return spots.join(solutions.select(*KEYS, "quality"), KEYS)


def label_spots(spots: DataFrame, labels: DataFrame) -> DataFrame:
    """Spots with the region under them; null outside regions and outside the frame."""
    pixels = labels.select("image_nr", "x", "y", "label").hint("merge")  # a row a pixel: never broadcast, whatever its source's size
    return spots.join(pixels, ["image_nr", "x", "y"], "left")


def fallback_labels(spots: DataFrame) -> DataFrame:
    """A label of its own for each distinct place of a frame, numbered by first appearance (spots: image_nr, x, y, spot_row)."""
    first = spots.groupBy("image_nr", "x", "y").agg(F.min("spot_row").alias("first_row"))
    number = F.row_number().over(Window.partitionBy("image_nr").orderBy("first_row", "x", "y"))
    return first.select("image_nr", "x", "y", number.alias("label"))


def _cells(x: Column, size: float) -> Column:
    return F.floor(x / size)


def nearest_peak(spots: DataFrame, peaks: DataFrame, reach: float = 5.0) -> DataFrame:
    """(image_nr, spot_row, peak_index): the nearest peak within reach, the first of equals, its label less one; -1 if none.

    Peaks are met over a grid of cells as wide as the reach, so the join is an equality on cells.
    spots (image_nr, spot_row, px, py); peaks (image_nr, label, cx, cy).
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = spots.select("image_nr", "spot_row", "px", "py", around.alias("o"))
    near = near.withColumn("gx", _cells(F.col("px"), reach) + F.col("o.i")).withColumn("gy", _cells(F.col("py"), reach) + F.col("o.j"))
    held = peaks.select("image_nr", "label", "cx", "cy", _cells(F.col("cx"), reach).alias("gx"), _cells(F.col("cy"), reach).alias("gy"))
    d2 = F.expr("(px - cx) * (px - cx) + (py - cy) * (py - cy)")
    met = near.join(held.hint("merge"), ["image_nr", "gx", "gy"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    best = met.groupBy("image_nr", "spot_row").agg(F.min(F.struct("d2", "label")).alias("best"))
    return spots.join(best, ["image_nr", "spot_row"], "left").select("image_nr", "spot_row", F.coalesce(F.col("best.label") - 1, F.lit(-1)).alias("peak_index"))


def nearest_spacing(peaks: DataFrame, reach: float) -> DataFrame:
    """(image_nr, spacing): the least distance between two peaks of a frame, null if none is within reach."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    held = peaks.select("image_nr", "label", "cx", "cy", _cells(F.col("cx"), reach).alias("gx"), _cells(F.col("cy"), reach).alias("gy"))
    asked = held.select("image_nr", F.col("label").alias("l2"), F.col("cx").alias("x2"), F.col("cy").alias("y2"), "gx", "gy", around.alias("o"))
    asked = asked.withColumn("gx", F.col("gx") + F.col("o.i")).withColumn("gy", F.col("gy") + F.col("o.j"))
    # rows grow with the peaks, whatever their source's size: never broadcast
    d2 = F.expr("(cx - x2) * (cx - x2) + (cy - y2) * (cy - y2)")
    met = held.join(asked.hint("merge"), ["image_nr", "gx", "gy"]).where("label <> l2").withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    least = met.groupBy("image_nr").agg(F.sqrt(F.min("d2")).alias("spacing"))
    return peaks.select("image_nr").distinct().join(least.hint("merge"), "image_nr", "left")


def distinct_simulated(simulated: DataFrame) -> DataFrame:
    """The first simulated spot of each rounded place of a grain (half to even); simulated: (grain_nr, sim_row, x, y)."""
    rounded = simulated.withColumn("rx", F.bround("x").cast("int")).withColumn("ry", F.bround("y").cast("int"))
    order = Window.partitionBy("grain_nr", "rx", "ry").orderBy("sim_row")
    return rounded.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def missing_simulated(simulated: DataFrame, spots: DataFrame) -> DataFrame:
    """Distinct simulated spots without a measured spot of their grain closer than two pixels."""
    sim = distinct_simulated(simulated)
    seen = spots.select(F.col("grain_nr").alias("g"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    close = (F.col("grain_nr") == F.col("g")) & F.expr("(rx - sx) * (rx - sx) + (ry - sy) * (ry - sy) < 4")
    return sim.join(seen, close, "left_anti")


def quality_map(solutions: DataFrame, spots: DataFrame, claims: DataFrame) -> DataFrame:
    """(image_nr, x, y, best): the best quality at each spot, raised by a tenth for each region of the grain's own."""
    boost = F.col("quality") * (1 + 0.1 * F.coalesce("n_unique_labels", F.lit(0)))
    rated = solutions.join(claims, KEYS, "left").select(*KEYS, boost.alias("boosted"))
    return spots.join(rated, KEYS).groupBy("image_nr", "x", "y").agg(F.max("boosted").alias("best"))


def spots_per_grain(spots: DataFrame) -> DataFrame:
    return spots.groupBy(*KEYS).agg(F.count("*").alias("n_spots"))


def distinct_places(spots: DataFrame) -> DataFrame:
    """(image_nr, grain_nr, n_places): distinct pixels that a grain's spots lie on."""
    return spots.groupBy(*KEYS).agg(F.count_distinct("x", "y").alias("n_places"))


def report(spots: DataFrame) -> DataFrame:
    """One row: grains, spots, and spots a grain on average."""
    return spots_per_grain(spots).agg(F.count("*").alias("n_grains"), F.sum("n_spots").alias("n_spots"), (F.sum("n_spots") / F.count("*")).alias("mean_spots"))


def image_summary(solutions: DataFrame, kept: DataFrame, spots: DataFrame) -> DataFrame:
    """(image_nr, n_orient, n_filtered, n_spots) of every frame."""
    counts = [df.groupBy("image_nr").agg(F.count("*").alias(name)) for df, name in ((solutions, "n_orient"), (kept, "n_filtered"), (spots, "n_spots"))]
    out = counts[0].join(counts[1], "image_nr", "full_outer").join(counts[2], "image_nr", "full_outer")
    return out.select("image_nr", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_orient", "n_filtered", "n_spots")])


def batch_summary(results: DataFrame) -> DataFrame:
    """One row of a batch (ok boolean, seconds): successes, failures, mean time of the successes."""
    return results.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.avg(F.when(F.col("ok"), F.col("seconds"))).alias("mean_seconds"))


def progress(mapping: DataFrame, total: int, elapsed_s: float) -> DataFrame:
    """One row: frames sent and skipped, rate, and seconds left at that rate."""
    done = mapping.agg(F.count("*").alias("n_done"), F.count_if("skipped").alias("n_skipped"))
    rate = F.col("n_done") / F.lit(float(elapsed_s))
    return done.select("n_done", "n_skipped", rate.alias("per_second"), F.try_divide(F.lit(float(total)) - F.col("n_done"), rate).alias("seconds_left"))


def rms_error(spots: DataFrame, misorientation: DataFrame) -> DataFrame:
    """(image_nr, grain_nr, rms): root mean square of the spots' known errors; the misorientation where none is known.

    Squares are summed as decimals, so the mean does not depend on the order of rows.
    """
    square = (F.col("err_deg") * F.col("err_deg")).cast("decimal(28,10)")
    errors = spots.groupBy(*KEYS).agg(F.sqrt(F.sum(square).cast("double") / F.nullif(F.count("err_deg"), F.lit(0))).alias("rms"))
    return misorientation.join(errors, KEYS, "left").select(*KEYS, F.coalesce("rms", "misorientation_deg").alias("rms"))


def cell_corners(solutions: DataFrame, scale: float = 0.2) -> DataFrame:
    """(image_nr, grain_nr, corner, x, y, z): the eight corners of a cell that the orientation's rows span."""
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = solutions.select(*KEYS, "om", corner.alias("corner"))
    bit = lambda b: F.shiftright("corner", b).bitwiseAND(1)
    part = lambda axis: sum((bit(b) * scale * F.col("om")[3 * b + axis] for b in range(3)), F.lit(0.0))
    return rows.select(*KEYS, "corner", *[part(i).alias(n) for i, n in enumerate("xyz")])
