"""Geometry in SQL: functions and a table function of a session.

The functions are SQL functions, so their bodies go into the query's plan as expressions. The table function gives the spots of
orientations; it takes a table and keeps its partitions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from braggflow.functions.crystal import HC_KEV_NM, Detector, Lattice, symmetry_quaternions
from braggflow.operators import forward


def _double(x: float) -> str:
    return f"{float(x)!r}D"


def _turn_between(p: str, q: str) -> list[str]:
    """The parts of the product of p's inverse with q, as SQL."""
    signs = [["+", "+", "+", "+"], ["+", "-", "-", "+"], ["+", "+", "-", "-"], ["+", "-", "+", "-"]]
    order = [[(0, 0), (1, 1), (2, 2), (3, 3)], [(0, 1), (1, 0), (2, 3), (3, 2)], [(0, 2), (1, 3), (2, 0), (3, 1)], [(0, 3), (1, 2), (2, 1), (3, 0)]]
    return [" ".join(f"{s} {p}[{i}] * {q}[{j}]" for s, (i, j) in zip(row, pairs, strict=True)) for row, pairs in zip(signs, order, strict=True)]


def register_functions(spark: SparkSession, space_group: int = 225) -> None:
    """laue_energy(qlen, qz) in keV, null for what faces away; laue_misorientation(p, q), laue_apart(a, b) in degrees."""
    d = _turn_between("p", "q")
    scalars = [" + ".join(f"({d[i]}) * {_double(s[0] if i == 0 else -s[i])}" for i in range(4)) for s in symmetry_quaternions(space_group)]
    widest = f"greatest({', '.join(f'abs({x})' for x in scalars)})" if len(scalars) > 1 else f"abs({scalars[0]})"
    norm = lambda v: f"sqrt({' + '.join(f'{v}[{i}] * {v}[{i}]' for i in range(3))})"
    dot = " + ".join(f"a[{i}] * b[{i}]" for i in range(3))
    bodies = {
        "laue_energy(qlen DOUBLE, qz DOUBLE)": f"CASE WHEN qz < 0 THEN {_double(HC_KEV_NM)} * qlen / ({_double(4 * math.pi)} * -qz) END",
        "laue_misorientation(p ARRAY<DOUBLE>, q ARRAY<DOUBLE>)": f"degrees(2D * acos(least(1D, {widest})))",
        "laue_apart(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": f"CASE WHEN {norm('a')} * {norm('b')} > 0 THEN degrees(acos(greatest(-1D, least(1D, ({dot}) / nullif({norm('a')} * {norm('b')}, 0D))))) END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")


def register_spots(spark: SparkSession, hkls: DataFrame, lattice: Lattice, detector: Detector, *, max_spots: int = 30, name: str = "laue_spots") -> None:
    """laue_spots(TABLE(t)): (row_nr, spot_nr, hkl_id, pix) of each orientation (row_nr, om) of a table, as forward.spots gives them."""
    listed = forward.reflection_list(hkls)
    shared = spark.sparkContext.broadcast((listed["hkl_id"].to_numpy("i4"), listed[["h", "k", "l"]].to_numpy("f8").T))
    recip, rotation = lattice.reciprocal(), detector.rotation().T

    @F.udtf(returnType="row_nr: bigint, spot_nr: int, hkl_id: int, pix: bigint")
    class Spots:
        def eval(self, row: Row):
            ids, hkl = shared.value
            om = np.array(row["om"], dtype=float).reshape(1, 3, 3)
            found = forward._project_batch(om, hkl, recip, rotation, detector)
            _, which, pix, nr = forward._first_spots(*found, detector.nr_px_x * detector.nr_px_y, max_spots)
            yield from zip([int(row["row_nr"])] * len(nr), nr.tolist(), ids[which].tolist(), pix.tolist(), strict=True)

    spark.udtf.register(name, Spots)
