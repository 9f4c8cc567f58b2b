"""A cell index on rotations, and ordered choices over it in rounds.

Rotations are unit quaternions up to a symmetry group. A row's *home* is its equivalent of largest scalar part, so homes
fill the fundamental region. Two rows lie within an angle if some equivalent of the one is no further than
``chord(angle)`` from the home of the other, so cells of that width over the vector parts hold all that is near: a home's
neighbours have an equivalent in its own cell or one of the 26 around it. Such an equivalent's scalar part is at most two
chords below that of its own home, which tells the few equivalents that need a place in the index: one for most rows, and
more where the fundamental region ends and neighbours lie across.

Choices that depend on the order of rows are settled in rounds for frames of more than a bound of undecided rows, all
such frames at once, and by a walk in one task for what is left of a frame then, or for all of a small frame.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braggflow.sources.store import discard, is_empty, stored

#: Bits of a cell number for each axis.
BITS = 21
#: What is added to a cell's number for each of its neighbours and itself.
AROUND = [(x << 2 * BITS) + (y << BITS) + z for x, y, z in itertools.product((-1, 0, 1), repeat=3)]
#: Rows that differ from the limit by rounding alone count as within it.
ROUNDING = 1e-12


def chord(angle_deg: float) -> float:
    """Distance of the quaternions of two rotations that are an angle apart."""
    return 2 * math.sin(math.radians(angle_deg) / 4)


def equivalents(q: np.ndarray, symmetry: np.ndarray) -> np.ndarray:
    """(row, operation, 4): the products of each quaternion with each operation, both signs."""
    a, b, c, d = (q[:, i, None] for i in range(4))
    e, f, g, h = symmetry.T
    one = np.stack([a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e], axis=2)
    return np.concatenate([one, -one], axis=1)


def numbered(vector: np.ndarray, width: float) -> np.ndarray:
    """The number of the cell of each vector part."""
    x, y, z = (np.floor(vector / width).astype("i8") + (1 << BITS - 1)).T
    return (x << 2 * BITS) + (y << BITS) + z


def places(q: np.ndarray, symmetry: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, equivalent, whether it is the row's home) of the equivalents that are indexed for cells of a width."""
    images = equivalents(q, symmetry)
    best = images[:, :, 0].argmax(axis=1)
    top = images[np.arange(len(images)), best, 0]
    row, which = np.nonzero(images[:, :, 0] >= top[:, None] - 2 * width)
    return row, images[row, which], which == best[row]


def index(rows: DataFrame, symmetry: Sequence[Sequence[float]], width: float, *, moved: Sequence[Sequence[float]] = ()) -> DataFrame:
    """(image_nr, at, cell, home, w, x, y, z): the places of rows (image_nr, at, q) in cells that hold what is within the distance `width`.

    moved: rotations by which each row is turned before, a row for each of them. Rows without a quaternion have no place.
    """
    group, turns, width, keys = np.array(symmetry), np.array(moved), width + 1e-9, ["image_nr", "at"]
    names = [*keys, "cell", "home", "w", "x", "y", "z"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.array(batch.column("q").flatten()).reshape(-1, 4)
            if len(turns):
                q = equivalents(q, turns)[:, : len(turns)].reshape(-1, 4)
            of = np.arange(len(q)) // max(1, len(turns))
            row, found, home = places(q, group, width)
            columns = [batch.column(k).take(pa.array(of[row])) for k in keys]
            columns += [pa.array(numbered(found[:, 1:], width)), pa.array(home), *(pa.array(found[:, i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", cell long, home boolean, w double, x double, y double, z double"
    return rows.where("q is not null").select(*keys, "q").mapInArrow(work, schema)


def around(cell: str | Column = "cell") -> Column:
    """Rows for a cell and its neighbours."""
    return F.explode(F.array(*[(F.col(cell) if isinstance(cell, str) else cell) + F.lit(n) for n in AROUND]))


def first_in_reach(placed: DataFrame) -> DataFrame:
    """(image_nr, cell, first): the least `at` that has a place in a cell or next to it."""
    least = placed.groupBy("image_nr", "cell").agg(F.min("at").alias("first"))
    return least.select("image_nr", around().alias("cell"), "first").groupBy("image_nr", "cell").agg(F.min("first").alias("first"))


def large_frames(undecided: DataFrame, most: int) -> DataFrame | None:
    """(image_nr) of the frames with more than `most` rows, stored; None if there are none."""
    large = stored(undecided.groupBy("image_nr").agg(F.count("*").alias("n")).where(F.col("n") > most).select("image_nr"), "frames")
    if is_empty(large):
        discard(large)
        return None
    return large


def meetings(homes: DataFrame, placed: DataFrame, angle_deg: float, *, strict: bool = False) -> DataFrame:
    """(image_nr, near, at): rows `at` of placed that lie within the angle of a home row `near`; an equal pair may come twice."""
    least = math.cos(math.radians(angle_deg) / 2)
    asked = homes.select("image_nr", F.col("at").alias("near"), around().alias("cell"), *[F.col(c).alias(f"h{c}") for c in "wxyz"])
    dot = sum((F.col(c) * F.col(f"h{c}") for c in "xyz"), F.col("w") * F.col("hw"))
    within = dot > least + ROUNDING if strict else dot >= least - ROUNDING
    return asked.join(placed, ["image_nr", "cell"]).where(within).select("image_nr", "near", "at")
