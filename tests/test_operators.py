import random

import numpy as np
from pyspark.sql import functions as F

from braggflow.functions.crystal import NICKEL, Detector
from braggflow.operators import claims, forward, imaging, match, merge, orientations, reflections, relations, simulate
from braggflow.plans.index import index_frames
from braggflow.plans import derive


def test_unique_claims_equal_a_walk(spark):
    rng = random.Random(3)
    for _ in range(3):
        solutions = [(rng.randint(0, 1), g, float(rng.randint(1, 4)), g) for g in range(12)]
        image = {s[1]: s[0] for s in solutions}
        spots = [(image[g], g, i, rng.randint(0, 5), rng.randint(0, 5)) for i, g in enumerate(rng.choices(range(12), k=120))]
        labels = [(i, x, y, rng.choice([0, 0, 1, 2, 3])) for i in (0, 1) for x in range(5) for y in range(5)]
        at = {(i, x, y): v for i, x, y, v in labels}
        expect = {}
        for frame in (0, 1):
            regions, places = set(), set()
            for _, g, _, _ in sorted((s for s in solutions if s[0] == frame), key=lambda s: (-s[2], -s[3])):
                n = m = 0
                for i, _, row, x, y in sorted((s for s in spots if s[1] == g), key=lambda s: s[2]):
                    region = at.get((i, x, y), 0)
                    if (x, y) not in places and (region == 0 or region not in regions):
                        places.add((x, y))
                        regions.add(region)
                        n, m = n + 1, m + (region > 0)
                expect[frame, g] = (n, m)
        got = claims.unique_claims(
            spark.createDataFrame(solutions, "image_nr int, grain_nr int, quality double, source_row int"),
            spark.createDataFrame(spots, "image_nr int, grain_nr int, spot_row int, x int, y int"),
            spark.createDataFrame(labels, "image_nr int, x int, y int, label int"),
        )
        assert {(r.image_nr, r.grain_nr): (r.n_unique, r.n_unique_labels) for r in got.collect()} == expect


def test_robust_keeps_twins_and_drops_duplicates(spark):
    from tests.test_geometry import rotation

    base = np.eye(3)
    oms = [base, rotation((1, 0, 0), 1.0), rotation((1, 1, 1), 60.0), rotation((2, 1, 0), 25.0), rotation((3, 2, 1), 20.0)]
    rows = [(0, i + 1, 100.0 - i, i, 6.0 if i != 4 else 3.0, m.reshape(-1).tolist()) for i, m in enumerate(oms)]
    solutions = spark.createDataFrame(rows, "image_nr int, grain_nr int, quality double, source_row int, n_matches double, om array<double>")
    found = spark.createDataFrame([(0, 4, 6, 2)], "image_nr int, grain_nr int, n_unique long, n_unique_labels long")
    assert sorted(r.grain_nr for r in claims.keep_robust(solutions, found).collect()) == [1, 3, 4]


def test_leaders_equal_a_walk():
    from braggflow.functions.crystal import symmetry_quaternions

    rng = np.random.default_rng(2)
    q = rng.normal(size=(60, 4))
    q[20:] = q[rng.integers(0, 20, 40)] + rng.normal(scale=0.01, size=(40, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    sym = np.array(symmetry_quaternions(225))

    def angle(p, r):
        a, b, c, d = p[0], -p[1], -p[2], -p[3]
        e, f, g, h = r
        t = np.array([a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e])
        best = max(abs(t[0] * s[0] - t[1] * s[1] - t[2] * s[2] - t[3] * s[3]) for s in sym)
        return np.degrees(2 * np.arccos(min(1, best)))

    owner = [-1] * len(q)
    for i in range(len(q)):
        if owner[i] < 0:
            for j in range(i, len(q)):
                if owner[j] < 0 and angle(q[i], q[j]) <= 2.0:
                    owner[j] = i
    assert merge.leaders(q, sym, 2.0).tolist() == owner


def test_relational_and_array_projection_agree(spark):
    detector = derive.DETECTOR
    candidates = orientations.uniform(spark, 300)
    hkls = reflections.generate(spark, 5, "F")
    whole = forward.project(candidates, hkls.select("hkl_id", "h", "k", "l"), NICKEL, detector)
    seen = {(r.row_nr, r.pix) for r in whole.select("row_nr", (F.col("py").cast("int") * 64 + F.col("px").cast("int")).alias("pix")).collect()}
    spots = forward.spots(candidates, hkls, NICKEL, detector, max_spots=10_000).collect()
    assert {(r.row_nr, r.pix) for r in spots} == seen and len(spots) == len(seen)
    capped = forward.spots(candidates, hkls, NICKEL, detector, max_spots=3)
    assert capped.agg(F.max("spot_nr")).first()[0] == 2


def test_orientations_are_rotations(spark):
    m = np.array([r.om for r in orientations.uniform(spark, 200).collect()]).reshape(-1, 3, 3)
    assert np.allclose(m @ m.transpose(0, 2, 1), np.eye(3), atol=1e-10) and np.allclose(np.linalg.det(m), 1)


def test_simulated_grains_are_found_again(spark):
    detector = Detector((0.0288, 0.0027, 0.513), (-1.2016, -1.214, -1.2185), 0.002, 0.002, 205, 205)
    hkls = reflections.generate(spark, 8, "F")
    database = orientations.uniform(spark, 400)
    truth = database.where("row_nr in (37, 211)")
    pixels = simulate.paint(simulate.simulate(truth, hkls, NICKEL, detector), detector)
    found = index_frames(pixels, database, hkls, NICKEL, detector, max_spots=60, min_spots=12, min_fit_spots=8)
    best = found["solutions"].orderBy(F.desc("quality")).limit(2).collect()
    assert {r.row_nr for r in best} == {37, 211}
    assert all(r.misorientation_deg < 0.5 and r.n_matches >= 12 for r in best)
    assert {r.grain_nr for r in found["kept"].collect()} >= {r.grain_nr for r in best[:1]}


def frame(spark, image, number=0):
    rows = [(number, int(i), float(v)) for i, v in enumerate(np.asarray(image).reshape(-1)) if v > 0]
    return spark.createDataFrame(rows, "image_nr int, pix long, v double")


def test_thresholds_equal_numpy(spark):
    rng = np.random.default_rng(5)
    image = np.where(rng.random((40, 50)) < 0.3, rng.gamma(2.0, 30.0, (40, 50)), 0.0)
    pixels = frame(spark, image)
    lit = image[image > 0]
    med = np.median(lit)
    one = lambda df: df.first().threshold
    assert abs(one(imaging.noise_floor(pixels)) - max(med + 4 * 1.4826 * np.median(abs(lit - med)), 1)) < 1e-9
    assert abs(one(imaging.percentile(pixels, 93.0, image.size)) - np.percentile(image, 93.0)) < 1e-9
    assert one(imaging.deviation(pixels, image.size)) == 60 * (1 + image.std() // 60)
    counts, edges = np.histogram(image, 256, (0, image.max()))
    mid = (edges[1:] + edges[:-1]) / 2
    w1, w2 = np.cumsum(counts), image.size - np.cumsum(counts)
    m = np.cumsum(counts * mid)
    with np.errstate(all="ignore"):
        between = np.nan_to_num(w1 * w2 * (m / w1 - (m[-1] - m) / w2) ** 2)
    assert abs(one(imaging.otsu(pixels, image.size)) - mid[np.argmax(between)]) < 1e-9


def test_regions_and_kernels(spark):
    image = np.zeros((8, 9))
    image[1:3, 1:3], image[3, 3], image[6, 6:9] = 5, 7, 2
    pixels = frame(spark, image)
    eight = imaging.components(pixels, 9)
    assert eight.select("label").distinct().count() == 2 and imaging.components(pixels, 9, eight=False).select("label").distinct().count() == 3
    stats = {r.label: (r.area, r.x, r.y, r.w, r.h) for r in imaging.region_stats(eight, 9).collect()}
    assert stats == {1: (5, 1, 1, 3, 3), 2: (3, 6, 6, 3, 1)}
    assert np.isclose(imaging.gaussian(image, 1.0).sum(), image.sum())
    assert np.array_equal(imaging.median_filter(image, 1), image)
    markers = np.zeros((8, 9), int)
    markers[1, 1], markers[3, 3] = 1, 2
    flooded = imaging.watershed(-image, markers, image > 0)
    assert set(np.unique(flooded)) == {0, 1, 2} and flooded[6, 6] == 0 and flooded[3, 3] == 2
    assert imaging.preprocess(pixels, 9, 8, thresholds=imaging.fixed(pixels, 1.0), min_area=4)["centres"].count() == 1
    assert imaging.cleanup(pixels.withColumn("v", F.col("v") * 100), pixels.withColumn("v", F.lit(0.0)), 9, 72).count() == 3


def test_nearest_peak_and_spacing(spark):
    peaks = spark.createDataFrame([(0, 1, 10.0, 10.0), (0, 2, 14.0, 10.0), (0, 3, 90.0, 90.0)], "image_nr int, label int, cx double, cy double")
    spots = spark.createDataFrame([(0, 0, 12.0, 10.0), (0, 1, 95.0, 90.0), (0, 2, 50.0, 50.0)], "image_nr int, spot_row int, px double, py double")
    assert {r.spot_row: r.peak_index for r in relations.nearest_peak(spots, peaks).collect()} == {0: 0, 1: 2, 2: -1}
    assert relations.nearest_spacing(peaks, 50.0).first().spacing == 4.0


def test_coarse_match_beyond_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "row_nr long, pix long")
    pixels = spark.createDataFrame([(0, 5, 4.0), (0, 6, 5.0), (1, 5, 1.0)], "image_nr int, pix long, v double")
    first = sorted(match.coarse(table, pixels, min_spots=1).collect())
    monkeypatch.setattr(match, "BROADCAST_PIXELS", 0)
    assert sorted(match.coarse(table, pixels, min_spots=1).collect()) == first and len(first) == 4
