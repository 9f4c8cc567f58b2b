"""Driver-side constants: lattices, detectors, symmetry groups. Small, so they go into plans as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Planck constant times speed of light in keV nm; snap-to-zero limit.
HC_KEV_NM = 1.2398419739
EPS = 1e-12
#: Space groups in rhombohedral setting.
RHOMBOHEDRAL = (146, 148, 155, 160, 161, 166, 167)
#: Coincidence boundaries of cubic crystals: Sigma -> (angle in degrees, sorted axis).
CSL = {3: (60.0, (0.57735, 0.57735, 0.57735)), 9: (38.94, (0.0, 0.70711, 0.70711)), 11: (50.48, (0.0, 0.70711, 0.70711))}
CSL_AXIS_TOLERANCE = 0.08


def _snap(x: float) -> float:
    return 0.0 if abs(x) < EPS else x


@dataclass(frozen=True)
class Lattice:
    """Cell lengths in nm, angles in degrees."""

    a: float
    b: float
    c: float
    alpha: float = 90.0
    beta: float = 90.0
    gamma: float = 90.0
    space_group: int = 225

    def direct(self) -> np.ndarray:
        """Cell vectors as rows."""
        ca, cb, cg = (math.cos(math.radians(x)) for x in (self.alpha, self.beta, self.gamma))
        if self.space_group in RHOMBOHEDRAL:
            p, q = math.sqrt(1 + 2 * ca), math.sqrt(1 - ca)
            off, on = self.a / 3 * (p - q), self.a / 3 * (p + 2 * q)
            return np.full((3, 3), off) + np.eye(3) * (on - off)
        sg = math.sin(math.radians(self.gamma))
        phi = math.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
        cell = [[self.a, 0, 0], [self.b * cg, self.b * sg, 0], [self.c * cb, self.c * (ca - cb * cg) / sg, self.c * phi / sg]]
        return np.array([[_snap(x) for x in row] for row in cell])

    def reciprocal(self) -> np.ndarray:
        """Reciprocal vectors, with the factor 2 pi, as columns."""
        a, b, c = self.direct()
        volume = float(np.dot(a, np.cross(b, c)))
        columns = [np.cross(b, c), np.cross(c, a), np.cross(a, b)]
        return np.array([[_snap(2 * math.pi * v[i] / volume) for v in columns] for i in range(3)])


@dataclass(frozen=True)
class Detector:
    """Positions in metres, rotation vector in radians, energies in keV."""

    p_array: tuple[float, float, float]
    r_array: tuple[float, float, float]
    px_x: float
    px_y: float
    nr_px_x: int
    nr_px_y: int
    e_lo: float = 5.0
    e_hi: float = 30.0

    def __post_init__(self):
        if min(self.px_x, self.px_y, self.nr_px_x, self.nr_px_y) <= 0 or self.e_lo >= self.e_hi:
            raise ValueError("a detector needs positive sizes and e_lo < e_hi")

    def rotation(self) -> np.ndarray:
        """Rodrigues rotation of r_array; the identity for a zero vector."""
        angle = math.sqrt(sum(x * x for x in self.r_array))
        if angle == 0:
            return np.eye(3)
        x, y, z = (v / angle for v in self.r_array)
        cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        axis = np.array([x, y, z])
        return math.cos(angle) * np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * np.outer(axis, axis)


def rotation_quaternion(axis: tuple[float, float, float], degrees: float) -> tuple[float, ...]:
    half = math.radians(degrees) / 2
    norm = math.sqrt(sum(x * x for x in axis))
    return (math.cos(half), *(math.sin(half) * x / norm for x in axis))


def quaternion_product(p, q) -> tuple[float, ...]:
    a, b, c, d = p
    e, f, g, h = q
    return (a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def _generate(generators: list[tuple[float, ...]]) -> list[tuple[float, ...]]:
    """The rotation group that the generators span, as quaternions with a non-negative first part."""

    def key(q):
        q = tuple(round(x, 6) + 0.0 for x in q)
        return tuple(-x + 0.0 for x in q) if next(x for x in q if x) < 0 else q

    def settled(q):
        sign = -1.0 if next(x for x in q if abs(x) > 1e-6) < 0 else 1.0
        size = math.sqrt(sum(x * x for x in q))
        return tuple(sign * x / size if abs(x) > 1e-12 else 0.0 for x in q)

    group = {key((1.0, 0.0, 0.0, 0.0)): (1.0, 0.0, 0.0, 0.0)}
    while True:
        more = {key(q): settled(q) for q in (quaternion_product(p, g) for p in group.values() for g in generators) if key(q) not in group}
        if not more:
            return [group[k] for k in sorted(group, reverse=True)]
        group |= more


def symmetry_quaternions(space_group: int, unique_axis: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> list[tuple[float, ...]]:
    """Proper rotations of the Laue class of a space group; unique_axis is the two-fold axis of monoclinic crystals."""
    x, y, z = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)
    turn = rotation_quaternion
    if space_group <= 2:
        return _generate([])
    if space_group <= 15:
        return _generate([turn(unique_axis, 180)])
    if space_group <= 74:
        return _generate([turn(x, 180), turn(y, 180)])
    if space_group <= 142:
        return _generate([turn(z, 90), turn(x, 180)])
    if space_group <= 167:
        return _generate([turn(z, 120), turn(y, 180)])
    if space_group <= 194:
        return _generate([turn(z, 60), turn(x, 180)])
    return _generate([turn(z, 90), turn((1.0, 1.0, 1.0), 120)])


def cubic_matrices() -> np.ndarray:
    """Matrices of the 24 proper rotations of a cube, from the quaternions of its group."""
    w, v = (lambda q: (q[:, 0], q[:, 1:]))(np.array(symmetry_quaternions(225)))
    cross = np.cross(np.eye(3)[None], v[:, None])  # row i is the product of unit vector i with v
    return np.rint((w * w - (v * v).sum(axis=1))[:, None, None] * np.eye(3) + 2 * v[:, :, None] * v[:, None, :] + 2 * w[:, None, None] * cross)


#: The nickel example geometry that tests and queries use.
NICKEL = Lattice(0.35238, 0.35238, 0.35238)
NICKEL_DETECTOR = Detector((0.028828, 0.002715, 0.512993), (-1.20161887, -1.21404493, -1.21852276), 0.0002, 0.0002, 2048, 2048)
