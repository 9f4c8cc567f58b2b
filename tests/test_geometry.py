import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggflow.functions import config, crystal
from braggflow.functions import geometry as G


def rotation(axis, degrees):
    axis = np.asarray(axis, float) / np.linalg.norm(axis)
    cross = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    angle = math.radians(degrees)
    return math.cos(angle) * np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * np.outer(axis, axis)


def random_rotations(n, seed=1):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    w, x, y, z = q.T
    return np.stack([w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z], axis=1)


def angle_axis(spark, pairs):
    rows = [(i, a.reshape(-1).tolist(), b.reshape(-1).tolist()) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    df = df.select("i", F.array(*G.matrix_to_quaternion(G.elements("a", 9))).alias("p"), F.array(*G.matrix_to_quaternion(G.elements("b", 9))).alias("q"))
    p, q = G.elements("p", 4), G.elements("q", 4)
    df = df.select("i", G.misorientation_deg(p, q, 225).alias("angle"), G.disorientation_axis(p, q).alias("axis"))
    df = df.withColumn("s3", G.csl_related(F.col("angle"), F.col("axis"))).withColumn("s9", G.csl_related(F.col("angle"), F.col("axis"), (3, 9, 11)))
    return df.orderBy("i").collect()


def test_known_boundaries(spark):
    base = random_rotations(1)[0].reshape(3, 3)
    cases = [((1, 1, 1), 60.0), ((1, 1, 0), 38.94), ((2, 1, 0), 25.0), ((1, 0, 0), 1.5)]
    found = angle_axis(spark, [(base, base @ rotation(axis, at)) for axis, at in cases])
    assert [round(r.angle, 2) for r in found] == [60.0, 38.94, 25.0, 1.5]
    assert np.allclose(found[0].axis, [0.57735] * 3, atol=1e-4) and np.allclose(found[2].axis, [0, 0.447214, 0.894427], atol=1e-4)
    assert [(r.s3, r.s9) for r in found] == [(True, True), (False, True), (False, False), (False, False)]


def test_misorientation_equals_brute_force(spark):
    ms = random_rotations(40).reshape(-1, 3, 3)
    ops = crystal.cubic_matrices()
    for row, (a, b) in zip(angle_axis(spark, list(zip(ms[:20], ms[20:], strict=True))), zip(ms[:20], ms[20:], strict=True), strict=True):
        traces = [np.trace(p @ a.T @ b @ q) for p in ops for q in ops]
        assert abs(row.angle - math.degrees(math.acos(min(1, (max(traces) - 1) / 2)))) < 1e-6


def test_symmetry_leaves_no_misorientation(spark):
    base = random_rotations(1)[0].reshape(3, 3)
    assert all(r.angle < 1e-5 for r in angle_axis(spark, [(base, base @ op) for op in crystal.cubic_matrices()]))


@pytest.mark.parametrize(("group", "n"), [(1, 1), (15, 2), (74, 4), (142, 8), (167, 6), (194, 12), (225, 24)])
def test_group_orders(group, n):
    assert len(crystal.symmetry_quaternions(group)) == n


def test_euler_round_trip(spark):
    ms = [*random_rotations(30), np.eye(3).reshape(-1), np.diag([1.0, -1, -1]).reshape(-1)]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(ms)], "i int, om array<double>")
    df = df.select("i", F.array(*G.matrix_to_euler(G.elements("om", 9))).alias("e")).select("i", F.array(*G.euler_to_matrix(*G.elements("e", 3))).alias("om"))
    for row in df.collect():
        assert np.allclose(row.om, ms[row.i], atol=1e-7)


def test_zero_rotation_is_identity_and_lattices_invert():
    assert np.allclose(crystal.Detector((0, 0, 1), (0, 0, 0), 1, 1, 2, 2).rotation(), np.eye(3))
    for cell in (crystal.NICKEL, crystal.Lattice(0.3, 0.4, 0.5, 80, 95, 110, 2), crystal.Lattice(0.4, 0.4, 0.4, 70, 70, 70, 166)):
        assert np.allclose(cell.direct() @ cell.reciprocal(), 2 * math.pi * np.eye(3), atol=1e-9)


def test_pixel_inverse(spark):
    d = crystal.NICKEL_DETECTOR
    df = spark.createDataFrame([(100.0, 1500.0), (1023.5, 1023.5), (2000.0, 3.0)], "px double, py double")
    df = df.select("px", "py", F.array(*G.pixel_to_qhat(F.col("px"), F.col("py"), d)).alias("q"))
    df = df.select("px", "py", F.array(*G.detector_frame(G.reflected(G.elements("q", 3)), d)).alias("x"))
    for row in df.select("px", "py", *[c.alias(n) for c, n in zip(G.pixel(G.elements("x", 3), d), ("qx", "qy"), strict=True)]).collect():
        assert abs(row.px - row.qx) < 1e-6 and abs(row.py - row.qy) < 1e-6


def test_config_round_trip_and_environment():
    text = "SpaceGroup 225\nLatticeParameter 0.352380 0.352380 0.352380 90 90 90\nP_Array 0.028828 0.002715 0.512993\nElo 5.0\nWatershedImage 0\n"
    got = config.parse(text)
    assert got["SpaceGroup"] == 225 and got["P_Array"][2] == 0.512993 and got["WatershedImage"] is False
    assert config.parse(config.render(got)) == got
    assert config.parse('{"Elo": 7}')["Elo"] == 7.0 and config.parse("Elo: 8\n")["Elo"] == 8.0
    assert config.with_environment(got, {"BRAGGFLOW_ELO": "9", "OTHER": "1"})["Elo"] == 9.0
    assert config.lattice(got).a == 0.35238 and config.detector(got).nr_px_x == 2048
