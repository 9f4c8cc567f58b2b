"""Readers: text tables of solutions and spots, reflection lists, binary orientations and frames, frame mappings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braggflow.sources import connectors

#: Scalar columns of a solutions row and the slices of its arrays, by position after the frame number.
SOLUTION_SCALARS = {"grain_nr": (0, "long"), "n_solutions": (1, "long"), "intensity": (2, "double"), "nmatches_x_intensity": (3, "double"), "quality": (4, "double"), "n_matches": (5, "long"), "n_spots_calc": (6, "long"), "coarse_quality": (31, "double"), "misorientation_deg": (32, "double"), "row_nr": (33, "long")}
SOLUTION_ARRAYS = {"recip": (7, 9), "lattice": (16, 6), "om": (22, 9)}
SPOT_SCALARS = {"grain_nr": (0, "long"), "spot_nr": (1, "int"), "h": (2, "int"), "k": (3, "int"), "l": (4, "int"), "x": (5, "int"), "y": (6, "int"), "qx": (7, "double"), "qy": (8, "double"), "qz": (9, "double"), "intensity": (10, "double")}
#: Columns of the two layouts: as a batch run writes them, and as a stream writes them with the frame number first.
WIDTHS = {"batch": {"solutions": 34, "spots": 11}, "stream": {"solutions": 35, "spots": 12}}


def text_rows(spark: SparkSession, path: str, *, data_only: bool = False) -> DataFrame:
    """(source_row, fields) of a text table: header and empty lines left out, fields parted by any white space.

    source_row counts lines from 0 in the order of file names, file blocks and lines, headers and empty lines included, or data
    rows only. Only the number of lines of each block is gathered to count on from; rows are numbered within their block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    data = ~F.trim("value").startswith("%") & (F.trim("value") != "")
    if data_only:
        lines = lines.where(data).withColumn("at", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    lines = lines.join(F.broadcast(blocks.select("file", "block", "first", before.alias("before"))), ["file", "block"])  # or every line would be shuffled
    lines = lines.where(data)
    row = F.col("before") + F.col("at") - F.col("first")
    return lines.select(row.alias("source_row"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("fields"))


def _fields(rows: DataFrame, table: str, layout: str, scalars: dict, arrays: dict) -> DataFrame:
    if layout not in WIDTHS:
        raise ValueError(f"unknown layout {layout!r}")
    width, off = WIDTHS[layout][table], int(layout == "stream")
    checked = F.when(F.size("fields") >= width, F.col("fields")).otherwise(F.raise_error(F.format_string(f"a {table} row of layout {layout} has {width} columns, not %d", F.size("fields"))).cast("array<string>"))
    rows = rows.select("source_row", checked.alias("fields"))
    number = lambda i, kind: F.col("fields")[i + off].cast("double").cast(kind)
    columns: list[Column] = [F.col("fields")[0].cast("double").cast("long").alias("image_nr") if off else F.lit(None).cast("long").alias("image_nr")]
    columns += [number(i, kind).alias(name) for name, (i, kind) in scalars.items()]
    columns += [F.transform(F.slice("fields", i + off + 1, n), lambda v: v.cast("double")).alias(name) for name, (i, n) in arrays.items()]
    return rows.select("source_row", *columns)


def solutions(spark: SparkSession, path: str, layout: str = "batch") -> DataFrame:
    """Typed solutions of a text table; image_nr is null in the batch layout."""
    return _fields(text_rows(spark, path), "solutions", layout, SOLUTION_SCALARS, SOLUTION_ARRAYS)


def spots(spark: SparkSession, path: str, layout: str = "batch") -> DataFrame:
    return _fields(text_rows(spark, path), "spots", layout, SPOT_SCALARS, {})


def hkl_list(spark: SparkSession, path: str) -> DataFrame:
    """(hkl_id, h, k, l, n2) of a reflection list, numbered by line; further columns are ignored."""
    rows = text_rows(spark, path).withColumn("hkl_id", F.row_number().over(Window.orderBy("source_row")) - 1)  # thousands of rows
    h, k, l = (F.col("fields")[i].cast("int") for i in range(3))
    return rows.select("hkl_id", h.alias("h"), k.alias("k"), l.alias("l"), (h * h + k * k + l * l).alias("n2"))


def orientation_text(spark: SparkSession, path: str) -> DataFrame:
    """(row_nr, om) of nine-column rows, or of a solutions table; rows are numbered from 0, headers and empty lines not counted."""
    rows = text_rows(spark, path, data_only=True)
    om = F.when(F.size("fields") >= WIDTHS["batch"]["solutions"], F.slice("fields", SOLUTION_ARRAYS["om"][0] + 1, 9)).otherwise(F.slice("fields", 1, 9))
    return rows.select(F.col("source_row").alias("row_nr"), F.transform(om, lambda v: v.cast("double")).alias("om"))


def orientation_records(spark: SparkSession, path: str) -> DataFrame:
    """(row_nr, om) of headerless files of nine 64-bit floats a record, of any size, in byte ranges of whole records.

    A file whose size is no multiple of the record is refused.
    """
    connectors.register(spark)
    return spark.read.format("laue_orientations").load(path)


def frame_images(spark: SparkSession, path: str, width: int, height: int, kind: str = "<f8") -> DataFrame:
    """(file, status, pix, v) of raw frames: lit pixels of each file, or one row with a status where its size is wrong."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    itemsize = np.dtype(kind).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                buffer = content.as_buffer()
                if buffer.size != width * height * itemsize:
                    found = ([name], ["shape mismatch"], [None], [None])
                else:
                    values = np.frombuffer(buffer, kind)
                    pix = np.flatnonzero(values > 0)
                    found = ([name] * len(pix), ["ok"] * len(pix), pix, values[pix].astype("f8")) if len(pix) else ([name], ["no_spots"], [None], [None])
                kinds = (pa.string(), pa.string(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], ["file", "status", "pix", "v"])

    return raw.mapInArrow(work, "file string, status string, pix long, v double")


def background_image(spark: SparkSession, path: str, width: int, height: int, kind: str = "<f8") -> DataFrame:
    """(pix, v) of a raw background for all frames; no rows, which is a background of zeros, where there is no file of the right size."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path) if path else None
    if name is None or not name.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(name):
        return spark.range(0).select(F.col("id").alias("pix"), F.lit(0.0).alias("v"))
    return frame_images(spark, path, width, height, kind).where("status = 'ok'").select("pix", "v")


def chosen_frames(frames: DataFrame, *, limit: int | None = None, image_nr: int | None = None) -> DataFrame:
    """Of frames with image_nr, those of the first `limit` files by name, or one frame; a limit of 0 or none takes all."""
    if limit:
        first = frames.select("file").distinct().orderBy("file").limit(limit)
        frames = frames.join(F.broadcast(first) if limit <= 10_000 else first, "file", "left_semi")
    return frames if image_nr is None else frames.where(F.col("image_nr") == image_nr)


def numbered(frames: DataFrame) -> DataFrame:
    """Frames (file, frame, ...) with image_nr by file name and frame, from 1."""
    order = frames.select("file", "frame").distinct().withColumn("image_nr", F.row_number().over(Window.orderBy("file", "frame")))  # a row for each frame
    return frames.join(order, ["file", "frame"])


def legacy_names(spark: SparkSession, first: str, n: int) -> DataFrame:
    """(image_nr, file) of n files counted up from a name like stem_001.ext, with its number of digits."""
    row = spark.range(n).select(F.lit(first).alias("first"), F.col("id"))
    digits = F.regexp_extract("first", r"(\d+)(\.[^.]*)?$", 1)
    number = F.lpad((digits.cast("long") + F.col("id")).cast("string"), F.greatest(F.length(digits), F.length((digits.cast("long") + F.col("id")).cast("string"))), "0")
    return row.select((F.col("id") + 1).alias("image_nr"), F.concat(F.regexp_extract("first", r"^(.*?)\d+(\.[^.]*)?$", 1), number, F.regexp_extract("first", r"(\.[^.]*)?$", 0)).alias("file"))


MAPPING = "map<string, struct<file: string, frame: int, skipped: boolean, n_spots: int, reason: string>>"


def frame_mapping(lines: DataFrame) -> DataFrame:
    """(image_nr, file, frame, skipped, n_spots, reason) of JSON objects keyed by frame number (column value)."""
    entries = lines.select(F.explode(F.from_json("value", MAPPING)).alias("key", "m"))
    return entries.select(F.col("key").cast("long").alias("image_nr"), "m.*")


def weak_fingerprint(raw: DataFrame, head: int = 1 << 20) -> DataFrame:
    """(path, fingerprint) of binary files (path, content, length): SHA-256 over head, tail if larger, and size."""
    tail = F.when(F.col("length") > head, F.expr(f"substring(content, cast(length - {head} as int) + 1, {head})")).otherwise(F.lit(b""))
    size = F.reverse(F.array(*[F.lpad(F.hex(F.shiftright("length", 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)][::-1]))
    return raw.select("path", F.sha2(F.concat(F.expr(f"substring(content, 1, {head})"), tail, F.unhex(F.array_join(size, ""))), 256).alias("fingerprint"))
