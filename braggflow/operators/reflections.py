"""Reflection lists: every (h, k, l) of a cube that a centring allows, in the order that later steps rely on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braggflow.functions.crystal import HC_KEV_NM, Detector, Lattice


def _multiple(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n)) == 0


def allowed(centring: str, *, hexagonal_axes: bool = False) -> Column:
    """Extinction rule of a lattice centring: P, B (no rule), F, I, C, A or R."""
    h, k, l = F.col("h"), F.col("k"), F.col("l")
    rules = {
        "P": F.lit(True),
        "B": F.lit(True),
        "F": _multiple(h + k, 2) & _multiple(k + l, 2),
        "I": _multiple(h + k + l, 2),
        "C": _multiple(h + k, 2),
        "A": _multiple(k + l, 2),
        "R": (_multiple(-h + k + l, 3) | _multiple(h - k + l, 3)) if hexagonal_axes else F.lit(True),
    }
    if centring not in rules:
        raise ValueError(f"unknown centring {centring!r}")
    return rules[centring]


def allowed_hexagonal() -> Column:
    """Further rule of hexagonal space groups (168 to 194)."""
    return ~_multiple(F.col("h") + 2 * F.col("k"), 3) | _multiple(F.col("l"), 2)


def has_hexagonal_axes(lattice: Lattice) -> bool:
    return abs(90 - lattice.alpha) + abs(90 - lattice.beta) + abs(120 - lattice.gamma) < 1e-6


def largest_index(lattice: Lattice, detector: Detector) -> int:
    """Bound of the cube: what the highest energy reaches at the top edge of the detector."""
    p = detector.p_array
    y = ((detector.nr_px_y - 1) - 0.5 * (detector.nr_px_y - 1)) * detector.px_y + p[1]
    x, z = p[0], p[2]
    rotated = detector.rotation() @ [x, y, z]
    theta = math.atan2(float(rotated[1]), float(rotated[2])) / 2
    q_max = 4 * math.pi * math.sin(abs(theta)) * detector.e_hi / HC_KEV_NM
    return math.floor(q_max / (2 * math.pi / lattice.a))


def generate(spark: SparkSession, h_max: int, centring: str = "P", *, space_group: int = 225, hexagonal_axes: bool = False) -> DataFrame:
    """(hkl_id, h, k, l, n2), ordered by n2, h, k, l; the order is part of the result, since first spots win later."""
    side = spark.range(-h_max, h_max + 1).select(F.col("id").cast("int").alias("v"))
    cube = side.toDF("h").crossJoin(F.broadcast(side.toDF("k"))).crossJoin(F.broadcast(side.toDF("l")))
    keep = allowed(centring, hexagonal_axes=hexagonal_axes)
    if 168 <= space_group <= 194:
        keep = keep & allowed_hexagonal()
    listed = cube.withColumn("n2", F.expr("h * h + k * k + l * l")).where("n2 > 0").where(keep)
    number = F.row_number().over(Window.orderBy("n2", "h", "k", "l")) - 1  # a few thousand rows, broadcast afterwards
    return listed.select(number.alias("hkl_id"), "h", "k", "l", "n2")


def primitive(hkls: DataFrame) -> DataFrame:
    """The list with (ph, pk, pl): each reflection's direction without its common divisor."""
    bound = hkls.agg(F.max(F.greatest(F.abs("h"), F.abs("k"), F.abs("l")))).first()[0] or 1
    divides = lambda d: (F.col("h") % d == 0) & (F.col("k") % d == 0) & (F.col("l") % d == 0)
    common = F.greatest(F.lit(1), F.lit(1), *[F.when(divides(d), F.lit(d)).otherwise(F.lit(1)) for d in range(2, bound + 1)])
    listed = hkls.withColumn("common", common)
    return listed.select(*hkls.columns, *[F.expr(f"cast({x} / common as int)").alias(f"p{x}") for x in "hkl"])
