"""Geometry as Column expressions: everything here stays in generated code.

Matrices are lists of nine columns in row order, vectors of three, quaternions of four (scalar first).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from braggflow.functions.crystal import CSL, CSL_AXIS_TOLERANCE, EPS, HC_KEV_NM, Detector, symmetry_quaternions

Columns = Sequence[Column]


def elements(array: str | Column, n: int) -> list[Column]:
    """The n parts of an array column."""
    array = F.col(array) if isinstance(array, str) else array
    return [array[i] for i in range(n)]


def _sum(terms: Columns) -> Column:
    return reduce(lambda a, b: a + b, terms)


def matrix_product(left: Columns, right: Sequence[Column | float]) -> list[Column]:
    """3x3 by 3x3; factors that are the constant 0 are left out."""

    def entry(i: int, j: int) -> Column:
        terms = [left[3 * i + k] * right[3 * k + j] for k in range(3) if not (isinstance(right[3 * k + j], float) and right[3 * k + j] == 0.0)]
        return _sum(terms) if terms else F.lit(0.0)

    return [entry(i, j) for i in range(3) for j in range(3)]


def matrix_vector(matrix: Sequence[Column | float], vector: Columns) -> list[Column]:
    return [_sum([vector[k] * matrix[3 * i + k] for k in range(3)]) for i in range(3)]


def transpose(matrix: Sequence) -> list:
    return [matrix[3 * j + i] for i in range(3) for j in range(3)]


def norm(vector: Columns) -> Column:
    return F.sqrt(_sum([v * v for v in vector]))


def reflected(qhat: Columns) -> list[Column]:
    """The beam along z after reflection: k - 2 (k.q) q."""
    return [F.lit(-2.0) * qhat[2] * qhat[0], F.lit(-2.0) * qhat[2] * qhat[1], F.lit(1.0) - F.lit(2.0) * qhat[2] * qhat[2]]


def detector_frame(kf: Columns, detector: Detector) -> list[Column]:
    """A beam direction with the detector's rotation undone."""
    return matrix_vector([float(x) for x in detector.rotation().T.reshape(-1)], kf)


def pixel(xyz: Columns, detector: Detector) -> tuple[Column, Column]:
    """Pixel coordinates, as doubles, where a direction in the detector's frame meets it; z must be positive."""
    p = detector.p_array
    px = (xyz[0] * p[2] / xyz[2] - p[0]) / detector.px_x + 0.5 * (detector.nr_px_x - 1)
    py = (xyz[1] * p[2] / xyz[2] - p[1]) / detector.px_y + 0.5 * (detector.nr_px_y - 1)
    return px, py


def energy_kev(qlen: Column, qhat_z: Column) -> Column:
    """Energy that a reflection selects; null where the reflection faces away."""
    return F.when(qhat_z < 0, F.lit(HC_KEV_NM) * qlen / (F.lit(4 * math.pi) * -qhat_z))


def pixel_to_qhat(px: Column, py: Column, detector: Detector) -> list[Column]:
    """Unit scattering vector of a pixel: the direction of (kf - ki)."""
    p = detector.p_array
    xyz = [(px - 0.5 * (detector.nr_px_x - 1)) * detector.px_x + p[0], (py - 0.5 * (detector.nr_px_y - 1)) * detector.px_y + p[1], F.lit(p[2])]
    kf = matrix_vector([float(x) for x in detector.rotation().reshape(-1)], xyz)
    length = norm(kf)
    q = [kf[0] / length, kf[1] / length, kf[2] / length - 1.0]
    size = F.nullif(norm(q), F.lit(0.0))
    return [v / size for v in q]


def angle_deg(a: Columns, b: Columns) -> Column:
    """Angle between two vectors in degrees; null if one is zero."""
    size = F.nullif(norm(a) * norm(b), F.lit(0.0))
    cosine = _sum([x * y for x, y in zip(a, b, strict=True)]) / size
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))  # least() skips nulls


def quaternion_normalised(q: Columns) -> list[Column]:
    size = norm(q)
    sign = F.when(q[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [sign * v / size for v in q]


def quaternion_product(p: Columns, q: Columns) -> list[Column]:
    a, b, c, d = p
    e, f, g, h = q
    return [a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e]


def matrix_to_quaternion(m: Columns) -> list[Column]:
    """Unit quaternion of a rotation matrix: the largest of the four squared parts is the safe divisor."""
    squares = [1.0 + m[0] + m[4] + m[8], 1.0 + m[0] - m[4] - m[8], 1.0 - m[0] + m[4] - m[8], 1.0 - m[0] - m[4] + m[8]]
    differences = [m[7] - m[5], m[2] - m[6], m[3] - m[1]]
    sums = {(1, 2): m[1] + m[3], (1, 3): m[2] + m[6], (2, 3): m[5] + m[7]}

    def case(top: int) -> list[Column]:
        others = []
        for i in range(4):
            if i == top:
                others.append(squares[top])
            elif 0 in (i, top):
                others.append(differences[max(i, top) - 1])
            else:
                others.append(sums[tuple(sorted((i, top)))])
        return quaternion_normalised(others)

    cases, largest = [case(i) for i in range(4)], F.greatest(*squares)
    return [
        F.when(squares[0] == largest, cases[0][i]).when(squares[1] == largest, cases[1][i]).when(squares[2] == largest, cases[2][i]).otherwise(cases[3][i])
        for i in range(4)
    ]


def quaternion_to_matrix(q: Columns) -> list[Column]:
    w, x, y, z = q
    return [
        w * w + x * x - y * y - z * z, 2.0 * (x * y - w * z), 2.0 * (x * z + w * y),
        2.0 * (x * y + w * z), w * w - x * x + y * y - z * z, 2.0 * (y * z - w * x),
        2.0 * (x * z - w * y), 2.0 * (y * z + w * x), w * w - x * x - y * y + z * z,
    ]


def _angle_of(sine: Column, cosine: Column) -> Column:
    """Angle in [0, 2 pi) by its sine's sign and its cosine."""
    at = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return F.when(sine >= 0, at).otherwise(F.lit(2 * math.pi) - at)


def matrix_to_euler(m: Columns, eps: float = EPS) -> list[Column]:
    """Bunge angles (psi, phi, theta) in radians."""
    flat = F.abs(m[8] - 1.0) < eps
    phi = F.when(flat, F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[8]))))
    sine = F.sin(phi)
    degenerate = F.abs(sine) < eps
    safe = F.when(degenerate, F.lit(1.0)).otherwise(sine)
    psi = F.when(degenerate, F.lit(0.0)).otherwise(_angle_of(m[2] / safe, -m[5] / safe))
    theta = F.when(degenerate, _angle_of(F.when(flat, m[3]).otherwise(-m[3]), m[0])).otherwise(_angle_of(m[6] / safe, m[7] / safe))
    return [psi, phi, theta]


def euler_degrees(m: Columns) -> list[Column]:
    """Bunge angles in degrees, the first and third in (-180, 180]."""
    psi, phi, theta = (F.degrees(x) for x in matrix_to_euler(m, 1e-9))
    wrap = lambda x: F.when(x > 180.0, x - 360.0).otherwise(x)
    return [wrap(psi), phi, wrap(theta)]


def euler_to_matrix(psi: Column, phi: Column, theta: Column) -> list[Column]:
    cps, sps, cph, sph, cth, sth = F.cos(psi), F.sin(psi), F.cos(phi), F.sin(phi), F.cos(theta), F.sin(theta)
    return [
        cth * cps - sth * cph * sps, -cth * cph * sps - sth * cps, sph * sps,
        cth * sps + sth * cph * cps, cth * cph * cps - sth * sps, -sph * cps,
        sth * sph, cth * sph, cph,
    ]


def _reduced(q: Columns, space_group: int) -> list[list[Column]]:
    return [quaternion_product(q, [F.lit(x) for x in s]) for s in symmetry_quaternions(space_group)]


def fundamental(q: Columns, space_group: int) -> Column:
    """The symmetric equivalent with the largest scalar part, as array<double>; the first operation wins ties."""
    images = [[F.when(p[0] < 0, -v).otherwise(v) for v in p] for p in _reduced(q, space_group)]
    ranked = F.array(*[F.struct(p[0].alias("w"), F.lit(-i).alias("nr"), F.array(*p).alias("q")) for i, p in enumerate(images)])
    return F.array_max(ranked)["q"]


def misorientation_deg(p: Columns, q: Columns, space_group: int) -> Column:
    """Smallest rotation angle between two orientations, over the symmetry group, in degrees."""
    between = quaternion_product([p[0], -p[1], -p[2], -p[3]], q)
    scalars = [F.abs(_sum([b * (s[0] if i == 0 else -s[i]) for i, b in enumerate(between)])) for s in symmetry_quaternions(space_group)]
    widest = F.greatest(*scalars) if len(scalars) > 1 else scalars[0]
    return F.degrees(2.0 * F.acos(F.least(F.lit(1.0), widest)))


def disorientation_axis(p: Columns, q: Columns) -> Column:
    """Sorted absolute axis, array<double>, of the cubic disorientation: null for equal orientations.

    For a cubic quaternion with absolute parts a >= b >= c >= d, the representative of largest scalar
    part is one of three; its vector part is the axis.
    """
    between = quaternion_product([p[0], -p[1], -p[2], -p[3]], q)
    parts = F.array_sort(F.array(*[F.abs(b) for b in between]))
    d, c, b, a = (parts[i] for i in range(4))
    root = 1 / math.sqrt(2)
    options = [
        (a, [b, c, d]),
        ((a + b) * root, [(a - b) * root, (c + d) * root, (c - d) * root]),
        ((a + b + c + d) / 2.0, [(a - b + c - d) / 2.0, (a + b - c - d) / 2.0, (a - b - c + d) / 2.0]),
    ]
    best = F.array_max(F.array(*[F.struct(w.alias("w"), F.lit(-i).alias("nr"), F.array(*[F.abs(x) for x in v]).alias("v")) for i, (w, v) in enumerate(options)]))
    vector = F.array_sort(best["v"])
    size = F.nullif(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))
    return F.transform(vector, lambda x: x / size)


def csl_related(angle: Column, axis: Column, sigmas: Sequence[int] = (3,), tolerance_deg: float = 3.0) -> Column:
    """Whether a disorientation is one of the named coincidence boundaries."""
    found = F.lit(False)
    for sigma in sigmas:
        if sigma in CSL:
            at, ref = CSL[sigma]
            off = F.sqrt(_sum([(axis[i] - ref[i]) * (axis[i] - ref[i]) for i in range(3)]))
            found = found | ((F.abs(angle - at) < tolerance_deg) & F.coalesce(off < CSL_AXIS_TOLERANCE, F.lit(False)))
    return found
