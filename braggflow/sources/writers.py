"""Writers: text tables, index files, summaries, frame mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["image_nr", "grain_nr"]


def _matrix(m: str) -> Column:
    row = lambda i: F.format_string("{%.7f,%.7f,%.7f}", *[F.col(m)[3 * i + j] for j in range(3)])
    return F.concat(F.lit("{"), row(0), row(1), row(2), F.lit("}"))


#: Columns of a solutions row and how each is written; arrays follow n_spots_calc in this order.
_BEFORE = {"grain_nr": "%d", "n_solutions": "%d", "intensity": "%.4f", "nmatches_x_intensity": "%.4f", "quality": "%.4f", "n_matches": "%d", "n_spots_calc": "%d"}
_ARRAYS = {"recip": 9, "lattice": 6, "om": 9}
_AFTER = {"coarse_quality": "%.4f", "misorientation_deg": "%.7f", "row_nr": "%d"}
_SPOT = {"grain_nr": "%d", "spot_nr": "%d", "h": "%d", "k": "%d", "l": "%d", "x": "%d", "y": "%d", "qx": "%.7f", "qy": "%.7f", "qz": "%.7f", "intensity": "%.4f"}


def _field(df: DataFrame, name: str, layout: str) -> Column:
    kind = "long" if layout == "%d" else "double"
    return F.format_string(layout, F.coalesce(F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind), F.lit(0).cast(kind)))


def solution_lines(solutions: DataFrame, layout: str = "batch") -> DataFrame:
    """(image_nr, grain_nr, value): a solutions row as tab-parted text that readers.solutions reads; absent columns are zero."""
    head = [F.col("image_nr").cast("string")] if layout == "stream" else []
    arrays = [F.array_join(F.transform(F.col(c) if c in solutions.columns else F.array_repeat(F.lit(0.0), n), lambda v: F.format_string("%.7f", v)), "\t") for c, n in _ARRAYS.items()]
    fields = [*(_field(solutions, c, f) for c, f in _BEFORE.items()), *arrays, *(_field(solutions, c, f) for c, f in _AFTER.items())]
    return solutions.select(*KEYS, F.concat_ws("\t", *head, *fields).alias("value"))


def spot_lines(spots: DataFrame, layout: str = "batch") -> DataFrame:
    """(image_nr, grain_nr, spot_nr, value): a spots row as tab-parted text that readers.spots reads; absent columns are zero."""
    head = [F.col("image_nr").cast("string")] if layout == "stream" else []
    return spots.select(*KEYS, "spot_nr", F.concat_ws("\t", *head, *(_field(spots, c, f) for c, f in _SPOT.items())).alias("value"))


def index_patterns(solutions: DataFrame, spots: DataFrame) -> DataFrame:
    """(image_nr, grain_nr, value): the block of each pattern of an index file, spots in order.

    solutions: (image_nr, grain_nr, quality, rms, om, recip, euler); spots: (image_nr, grain_nr, spot_nr, qx, qy, qz, h, k, l,
    intensity, energy, err_deg, peak_index). A frame's patterns are numbered by falling quality.
    """
    line = F.format_string(
        "    [%3d]   (%10.7f %10.7f %10.7f)     (%3d %3d %3d)    %.4f,   %8.4f,   %.5f      %d",
        *[F.col(c) for c in ("nr", "qx", "qy", "qz", "h", "k", "l", "intensity", "energy", "err_deg", "peak_index")],
    )
    nr = F.row_number().over(Window.partitionBy(*KEYS).orderBy("spot_nr")) - 1
    listed = spots.withColumn("nr", nr).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    at = F.row_number().over(Window.partitionBy("image_nr").orderBy(F.desc("quality"), "grain_nr")) - 1
    both = solutions.withColumn("at", at).join(listed, KEYS, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    text = F.concat_ws(
        "\n",
        F.format_string("$pattern%d", "at"),
        F.format_string("$EulerAngles%d { %12.8f, %12.8f, %12.8f}\t// Euler angles for this pattern (deg)", F.col("at"), *[F.col("euler")[i] for i in range(3)]),
        F.format_string("$goodness%d\t\t%.4f", "at", "quality"),
        F.format_string("$rms_error%d\t\t%.5f", "at", "rms"),
        F.concat(F.format_string("$rotation_matrix%d\t\t", "at"), _matrix("om")),
        F.concat(F.format_string("$recip_lattice%d\t\t", "at"), _matrix("recip")),
        F.format_string("$array%d\t %2d   %-8d     G^                         (hkl)       intens      E(keV)      err(deg)   PkIndex", F.col("at"), F.size("lines"), F.size("lines")),
        F.array_join("lines", "\n"),
    )
    return both.select(*KEYS, "at", F.size("lines").alias("n_spots"), text.alias("value"))


def index_files(patterns: DataFrame, header: DataFrame) -> DataFrame:
    """(image_nr, value): one text a frame: file type, counts, keywords (header: image_nr, position, keyword, value), patterns."""
    keys = header.groupBy("image_nr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("$"), "keyword", F.lit("\t\t"), "value").alias("line")))), lambda s: s["line"]), "\n").alias("keys"))
    blocks = patterns.groupBy("image_nr").agg(
        F.count("*").alias("n"), F.sum("n_spots").alias("n_spots"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]), "\n\n").alias("blocks")
    )
    counts = F.format_string("$filetype\tIndexFile\n$NpatternsFound\t\t%d\n$Nindexed\t\t%d", F.coalesce("n", F.lit(0)), F.coalesce("n_spots", F.lit(0)))
    return keys.join(blocks, "image_nr", "full_outer").select("image_nr", F.concat_ws("\n", counts, "keys", F.lit(""), "blocks").alias("value"))


def mapping_json(mapping: DataFrame) -> DataFrame:
    """(image_nr, value): a frame's entry as JSON; null fields are left out."""
    return mapping.select("image_nr", F.to_json(F.struct(*[c for c in mapping.columns if c != "image_nr"])).alias("value"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """(image_nr, value) of an image summary."""
    return summary.select("image_nr", F.format_string("image %d: %d orientations, %d kept, %d spots", "image_nr", "n_orient", "n_filtered", "n_spots").alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """One folder of text for each frame."""
    lines.select("image_nr", "value").repartition("image_nr").write.mode("overwrite").partitionBy("image_nr").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by frame, for the tables that belong to frames."""
    df.write.mode("overwrite").partitionBy("image_nr").parquet(path) if "image_nr" in df.columns else df.write.mode("overwrite").parquet(path)
