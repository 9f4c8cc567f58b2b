"""All pairs of orientations of a frame, in blocks: rows are shuffled once a block, pairs never."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braggflow.functions.crystal import symmetry_quaternions

#: Rows of a block; a task holds the pairs of two blocks.
BLOCK_ROWS = 500


def _between(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
    """The rotations from p to q, in the order of operations of geometry.quaternion_product."""
    a, b, c, d = p[0], -p[1], -p[2], -p[3]
    e, f, g, h = q
    return [a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e]


def _angle(between: list[np.ndarray], symmetry: list) -> np.ndarray:
    widest = np.zeros(len(between[0]))
    for s in symmetry:
        dot = between[0] * s[0]
        for i in range(1, 4):
            dot = dot + between[i] * -s[i]
        widest = np.maximum(widest, np.abs(dot))
    return np.degrees(2.0 * np.arccos(np.minimum(1.0, widest)))


def _sorted(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Three or four arrays in ascending order at each place, by a network of minima and maxima: a sort of so few is mostly overhead."""
    parts = list(parts)
    for i, j in ((0, 1), (1, 2), (0, 1)) if len(parts) == 3 else ((0, 1), (2, 3), (0, 2), (1, 3), (1, 2)):
        parts[i], parts[j] = np.minimum(parts[i], parts[j]), np.maximum(parts[i], parts[j])
    return parts


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half up by the shortest decimals, as Spark's round does one by one; only what lies next to a half takes that way here."""
    scaled = x * 10.0**digits
    whole = np.floor(scaled)
    rest = scaled - whole
    out = (whole + (rest >= 0.5)) / 10.0**digits
    near = np.flatnonzero(np.abs(rest - 0.5) < 1e-9 * np.maximum(1.0, np.abs(scaled)))
    unit = Decimal(1).scaleb(-digits)
    out[near] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in x[near].tolist()]
    return out


def _axis(between: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted absolute parts of the cubic disorientation's axis, nan for equal orientations (see geometry.disorientation_axis)."""
    d, c, b, a = _sorted([np.abs(x) for x in between])
    root = 1 / math.sqrt(2)
    scalars = [a, (a + b) * root, (a + b + c + d) / 2.0]
    vectors = [[b, c, d], [(a - b) * root, (c + d) * root, (c - d) * root], [(a - b + c - d) / 2.0, (a + b - c - d) / 2.0, (a - b - c + d) / 2.0]]
    best = np.argmax(scalars, axis=0)
    vector = _sorted([np.abs(np.choose(best, [v[i] for v in vectors])) for i in range(3)])
    size = np.sqrt(vector[0] * vector[0] + vector[1] * vector[1] + vector[2] * vector[2])
    size[~(size > 0)] = np.nan
    return [v / size for v in vector]


def disorientations(rows: DataFrame, *, angle: bool = True, axis: bool = True, space_group: int = 225, digits: int | None = None) -> DataFrame:
    """(image_nr, a, b, angle_deg, x0, x1, x2) of all pairs a < b of a frame's rows (image_nr, at, q); what isn't asked for is null.

    The axis is that of cubic crystals, sorted and absolute, and null for equal orientations. digits: decimals that are left.
    """
    spark, symmetry, kinds = rows.sparkSession, symmetry_quaternions(space_group), dict(rows.dtypes)
    largest = rows.groupBy("image_nr").count().agg(F.count("*"), F.max("count")).first()
    blocks = max(1, -(-(largest[1] or 0) // BLOCK_ROWS))
    schema = f"image_nr {kinds['image_nr']}, a {kinds['at']}, b {kinds['at']}, angle_deg double, x0 double, x1 double, x2 double"
    names = ["image_nr", "a", "b", "angle_deg", "x0", "x1", "x2"]

    def work(table: pa.Table) -> pa.Table:
        at, block = table.column("at").to_numpy(), table.column("block").to_numpy()
        q = np.array(table.column("q").combine_chunks().flatten()).reshape(-1, 4)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        i, j = (x.reshape(-1) for x in np.meshgrid(np.flatnonzero(block == low), np.flatnonzero(block == high), indexing="ij"))
        if low != high:
            i, j = np.where(at[i] < at[j], i, j), np.where(at[i] < at[j], j, i)
        keep = at[i] < at[j]
        i, j = i[keep], j[keep]
        between = _between([q[i, n] for n in range(4)], [q[j, n] for n in range(4)])
        none = pa.nulls(len(i), pa.float64())
        told = (lambda x: x) if digits is None else (lambda x: rounded(x, digits))
        angles = pa.array(told(_angle(between, symmetry))) if angle else none
        axes = [pa.array(told(x), from_pandas=True) for x in _axis(between)] if axis else [none] * 3
        frame = table.column("image_nr").combine_chunks().take(pa.array(np.zeros(len(i), "i8")))
        return pa.Table.from_arrays([frame, pa.array(at[i]), pa.array(at[j]), angles, *axes], names)

    own, other = F.col("block"), F.col("other")
    placed = rows.select("image_nr", "at", "q", F.pmod(F.hash("at"), F.lit(blocks)).alias("block"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    placed = placed.select("image_nr", "at", "q", "block", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"))
    groups = (largest[0] or 0) * blocks * (blocks + 1) // 2
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(groups, 2000))  # few bytes become many pairs: not to be coalesced
    return placed.repartition(tasks, "image_nr", "low", "high").groupBy("image_nr", "low", "high").applyInArrow(work, schema)
