"""Refinement of candidates: a bounded search for the orientation (and lattice) that lights most of a frame."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braggflow.functions.crystal import HC_KEV_NM, Detector, Lattice
from braggflow.operators import forward
from braggflow.sources.store import stored


#: Candidates of a part of a frame, which has the frame's lit pixels, candidates that are fitted side by side, and those of a task.
PART_ROWS, FITS, TASK_FITS = 64, 256, 5_000
#: Bytes of images that a task holds, one at least.
IMAGE_BYTES = 64 << 20


def euler_of(m: np.ndarray) -> np.ndarray:
    phi = np.arccos(np.clip(m[2, 2], -1, 1))
    if abs(np.sin(phi)) < 1e-12:
        return np.array([0.0, phi, np.arctan2(m[1, 0] * np.sign(m[2, 2] or 1), m[0, 0])])
    return np.array([np.arctan2(m[0, 2], -m[1, 2]), phi, np.arctan2(m[2, 0], m[2, 1])])


def matrix_of(e: np.ndarray) -> np.ndarray:
    (a, b, c), (x, y, z) = np.cos(e), np.sin(e)
    return np.array([[c * a - z * b * x, -c * b * x - z * a, y * x], [c * x + z * b * a, c * b * a - z * x, -y * a], [z * y, c * y, b]])


def _matrices(e: np.ndarray) -> np.ndarray:
    """matrix_of for rows of angles."""
    (a, b, c), (x, y, z) = np.cos(e).T, np.sin(e).T
    return np.stack([c * a - z * b * x, -c * b * x - z * a, y * x, c * x + z * b * a, c * b * a - z * x, -y * a, z * y, c * y, b], axis=-1).reshape(-1, 3, 3)


def directions(hkl: np.ndarray) -> np.ndarray:
    """A number for each column's direction; columns that are multiples of each other share it."""
    whole = hkl.astype("i8")
    return np.unique(whole // np.gcd.reduce(whole, axis=0), axis=1, return_inverse=True)[1].reshape(-1)


def reachable(om: np.ndarray, recip: np.ndarray, hkl: np.ndarray, detector: Detector, turn: float) -> np.ndarray:
    """Which columns may lie in the energy window after a rotation by at most `turn` (rad); the others never count in the fit.

    Such a rotation moves the beam component of a unit vector by 2 sin(turn / 2) at most, and energy follows from it.
    """
    q = om @ recip @ hkl
    length = np.sqrt((q * q).sum(axis=0))
    down, slack = -q[2] / length, 2 * np.sin(min(turn, np.pi) / 2)
    scale = HC_KEV_NM * length / (4 * np.pi)
    return (scale <= detector.e_hi * np.minimum(1.0, down + slack)) & (scale >= detector.e_lo * np.maximum(0.0, down - slack))


@lru_cache(maxsize=16)
def _turned(detector: Detector) -> np.ndarray:
    """From the laboratory's axes to the detector's; a fit asks for it some hundred times."""
    return detector.rotation().T


def overlap(om: np.ndarray, recip: np.ndarray, hkl: np.ndarray, direction: np.ndarray, image: np.ndarray, detector: Detector, max_spots: int | None = None) -> float:
    """Lit spots times the root of their summed intensity.

    Of each direction the first column inside the energy window and detector counts, and of these the first max_spots, lit or not.
    """
    q = om @ recip @ hkl
    down = q[2] < 0
    q, direction = q[:, down], direction[down]
    length = np.sqrt((q * q).sum(axis=0))
    qh = q / length
    energy = HC_KEV_NM * length / (4 * np.pi * -qh[2])
    kf = np.array([[0.0], [0.0], [1.0]]) - 2 * qh[2] * qh
    x, y, z = _turned(detector) @ kf
    with np.errstate(divide="ignore", invalid="ignore"):
        p = detector.p_array
        px = (x * p[2] / z - p[0]) / detector.px_x + 0.5 * (detector.nr_px_x - 1)
        py = (y * p[2] / z - p[1]) / detector.px_y + 0.5 * (detector.nr_px_y - 1)
        ok = (z > 0) & (energy >= detector.e_lo) & (energy <= detector.e_hi) & (px >= 0) & (px <= detector.nr_px_x - 1) & (py >= 0) & (py <= detector.nr_px_y - 1)
    first = np.sort(np.unique(direction[ok], return_index=True)[1])[:max_spots]
    lit = image[py[ok][first].astype(int), px[ok][first].astype(int)]
    lit = lit[lit > 0]
    return len(lit) * float(np.sqrt(lit.sum()))


def _steps(start: np.ndarray, width: np.ndarray, *, evaluations: int = 200, tolerance: float = 1e-6) -> Generator[list[np.ndarray], list[float], tuple[np.ndarray, float]]:
    """Nelder-Mead within start +- width as a generator: it yields points, is sent their values, and returns the best."""
    low, high = start - width, start + width
    inside = lambda v: np.minimum(np.maximum(v, low), high)
    points = [start] + [start + width * 0.5 * e for e in np.eye(len(start))]
    values = yield [inside(p) for p in points]
    used = len(points)
    while used < evaluations:
        order = sorted(range(len(points)), key=values.__getitem__)[::-1]
        points, values = [points[i] for i in order], [values[i] for i in order]
        spread = np.array(points)
        if np.abs(spread[0] - spread).max() < tolerance:
            break
        centre = np.mean(spread[:-1], axis=0)
        point = centre + (centre - points[-1])
        (value,) = yield [inside(point)]
        used += 1
        if value > values[0]:
            further = centre + 2.0 * (centre - points[-1])
            (v,) = yield [inside(further)]
            if v > value:
                point, value = further, v
            used += 1
        elif value <= values[-2]:
            point = centre + 0.5 * (points[-1] - centre)
            (value,) = yield [inside(point)]
            used += 1
            if value <= values[-1]:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + (yield [inside(p) for p in points[1:]])
                used += len(points) - 1
                continue
        points[-1], values[-1] = point, value
    best = int(np.argmax(values))
    return inside(points[best]), values[best]


def simplex(objective, start: np.ndarray, width: np.ndarray, *, evaluations: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Nelder-Mead within start +- width, for the largest value; the start is among the candidates, so it never gets worse."""
    return together([_steps(start, width, evaluations=evaluations, tolerance=tolerance)], lambda of, points: [objective(p) for p in points])[0]


def together(searches: list[Generator], values_of) -> list[tuple[np.ndarray, float]]:
    """Run searches side by side: values_of(which search, point) gets the points of all that are not done in one call."""
    found: list = [None] * len(searches)
    asked = {i: next(search) for i, search in enumerate(searches)}
    while asked:
        of = [i for i, points in asked.items() for _ in points]
        values, at = values_of(of, [p for points in asked.values() for p in points]), 0
        for i, points in list(asked.items()):
            try:
                asked[i] = searches[i].send(values[at : at + len(points)])
            except StopIteration as end:
                found[i] = end.value
                del asked[i]
            at += len(points)
    return found


def _quadratic(points: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) at 0 of the quadratic through the points whose Hessian has the least Frobenius norm."""
    m, n = points.shape
    flat = np.hstack([np.ones((m, 1)), points])
    system = np.block([[0.5 * (points @ points.T) ** 2, flat], [flat.T, np.zeros((n + 1, n + 1))]])
    found = np.linalg.lstsq(system, np.concatenate([values, np.zeros(n + 1)]), rcond=1e-12)[0]
    return found[m + 1 :], (points.T * found[:m]) @ points


def _highest(gradient: np.ndarray, hessian: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A step within the box that raises the quadratic, one coordinate after another, each to its best place."""
    step = np.zeros(len(gradient))
    for _ in range(12):
        before = step.copy()
        for i in range(len(step)):
            slope, bend = gradient[i] + hessian[i] @ step - hessian[i, i] * step[i], hessian[i, i]
            ends = np.array([low[i], high[i]] + ([np.clip(-slope / bend, low[i], high[i])] if bend < 0 else []))
            step[i] = ends[np.argmax(slope * ends + 0.5 * bend * ends * ends)]
        if np.abs(step - before).max() < 1e-9:
            break
    return step


def model_search(objective, start: np.ndarray, width: np.ndarray, *, evaluations: int = 66, tolerance: float = 1e-6, radius: float = 0.5) -> tuple[np.ndarray, float]:
    """Largest value within start +- width by quadratic models in a trust region; the start is among the candidates.

    Models go through 2 n + 1 points. A step that lowers the value shrinks the region, after points that lie outside
    have been fetched back: each takes the place opposite to the nearest point.
    """
    n = len(start)
    at = lambda z: objective(start + width * z)
    points = np.vstack([np.zeros(n), radius * np.eye(n), -radius * np.eye(n)])
    values = np.array([at(z) for z in points])
    used = len(points)
    while used < evaluations and radius > tolerance:
        best = int(np.argmax(values))
        centre = points[best].copy()
        spread = points - centre
        gradient, hessian = _quadratic(spread / radius, values)
        low, high = np.maximum(-1 - centre, -radius), np.minimum(1 - centre, radius)
        step = _highest(gradient, hessian, low / radius, high / radius)
        gain = gradient @ step + 0.5 * step @ hessian @ step
        far = int(np.argmax(np.abs(spread).max(axis=1)))
        if gain <= 1e-9 * max(1.0, abs(values[best])) or np.abs(step).max() < 0.05:  # the model sees nothing: look elsewhere or closer
            if np.abs(spread[far]).max() <= 2 * radius:
                radius *= 0.5
                continue
            trial, gain = np.clip(centre - radius * spread[far] / np.abs(spread[far]).max(), -1, 1), None
        else:
            trial = centre + radius * step
        value, used = at(trial), used + 1
        better = value > values[best]
        points[far if far != best else int(np.argmin(values))], values[far if far != best else int(np.argmin(values))] = trial, value
        if gain is not None:
            if better:
                radius = min(1.0, radius * 1.5) if value - np.sort(values)[-2] > 0.7 * gain else radius
            elif np.abs(spread[far]).max() <= 2 * radius:
                radius *= 0.5
    best = int(np.argmax(values))
    return start + width * points[best], float(values[best])


def search(objective, start: np.ndarray, width: np.ndarray, *, evaluations: int = 110) -> tuple[np.ndarray, float]:
    """The model search over the whole width, then a simplex around what it found; never worse than the start."""
    coarse = evaluations * 2 // 5
    found, best = model_search(objective, start, width, evaluations=coarse, tolerance=1e-3)
    near = np.minimum(0.04 * width, np.maximum(start + width - found, found - start + width))
    inside = lambda v: objective(np.clip(v, start - width, start + width))
    polished, value = simplex(inside, found, near, evaluations=evaluations - coarse)
    return (np.clip(polished, start - width, start + width), value) if value > best else (found, best)


METHODS = {"simplex": simplex, "model": search}


def _problem(om: np.ndarray, lattice: Lattice, hkl: np.ndarray, detector: Detector, *, angle_deg: float = 3.0, lattice_tolerance: tuple[float, ...] = (0,) * 6, c_over_a: float = 0.0):
    """(start, width, lattice at a point, its reciprocal, columns that may count) of a fit."""
    base = np.array([lattice.a, lattice.b, lattice.c, lattice.alpha, lattice.beta, lattice.gamma])
    free = [] if c_over_a else [i for i, t in enumerate(lattice_tolerance) if t]
    start = np.concatenate([euler_of(om), base[free], [lattice.c / lattice.a] if c_over_a else []])
    width = np.concatenate([np.full(3, np.radians(angle_deg)), [base[i] * lattice_tolerance[i] for i in free], [lattice.c / lattice.a * c_over_a] if c_over_a else []])

    def built(v: np.ndarray) -> Lattice:
        if len(v) == 3:
            return lattice
        if c_over_a:
            a = (lattice.a * lattice.b * lattice.c / v[3]) ** (1 / 3)
            return replace(lattice, a=a, b=a, c=a * v[3])
        cell = base.copy()
        cell[free] = v[3:]
        return replace(lattice, **dict(zip(("a", "b", "c", "alpha", "beta", "gamma"), cell.tolist(), strict=True)))

    fixed = lattice.reciprocal() if len(start) == 3 else None
    if fixed is not None:
        hkl = hkl[:, reachable(om, fixed, hkl, detector, float(width[:3].sum()))]
    return start, width, built, (lambda v: built(v).reciprocal()) if fixed is None else (lambda v: fixed), hkl


def fit(om: np.ndarray, lattice: Lattice, hkl: np.ndarray, image: np.ndarray, detector: Detector, *, max_spots: int | None = None, method: str = "simplex", **options) -> tuple[np.ndarray, Lattice, float]:
    """(orientation, lattice, objective). lattice_tolerance: relative width for a, b, c and the angles, 0 keeps a value.

    c_over_a frees the ratio c/a at constant volume instead, and then the lattice lengths are not free.
    method: "simplex", or "model" for quadratic models first, which finds distant maxima more often.
    """
    start, width, built, reciprocal, hkl = _problem(om, lattice, hkl, detector, **options)
    direction = directions(hkl)
    value = lambda v: overlap(matrix_of(v[:3]), reciprocal(v), hkl, direction, image, detector, max_spots)
    found, best = METHODS[method](value, start, width)
    return matrix_of(found[:3]), built(found), best


def _overlaps(m: np.ndarray, of: np.ndarray, hkl: np.ndarray, direction: np.ndarray, images: np.ndarray, frame: np.ndarray, detector: Detector, max_spots: int | None) -> list[float]:
    """`overlap` of many points at once: a matrix each and the fit that it is of; fits have padded columns and the number of their image."""
    q = m @ hkl[of]
    point, column = np.nonzero(q[:, 2] < 0)
    q = q.transpose(1, 0, 2)[:, point, column]
    length = np.sqrt((q * q).sum(axis=0))
    qh = q / length
    energy = HC_KEV_NM * length / (4 * np.pi * -qh[2])
    ok = (energy >= detector.e_lo) & (energy <= detector.e_hi)
    point, column, qh = point[ok], column[ok], qh[:, ok]
    kf = np.array([[0.0], [0.0], [1.0]]) - 2 * qh[2] * qh
    x, y, z = _turned(detector) @ kf
    with np.errstate(divide="ignore", invalid="ignore"):
        p = detector.p_array
        px = (x * p[2] / z - p[0]) / detector.px_x + 0.5 * (detector.nr_px_x - 1)
        py = (y * p[2] / z - p[1]) / detector.px_y + 0.5 * (detector.nr_px_y - 1)
        ok = (z > 0) & (px >= 0) & (px <= detector.nr_px_x - 1) & (py >= 0) & (py <= detector.nr_px_y - 1)
    point, column, px, py = point[ok], column[ok], px[ok], py[ok]
    first = np.sort(np.unique(point * direction.shape[1] + direction[of[point], column], return_index=True)[1])
    point, px, py = point[first], px[first], py[first]
    if max_spots is not None:
        few = np.arange(len(point)) - np.searchsorted(point, point) < max_spots
        point, px, py = point[few], px[few], py[few]
    lit = images[frame[of[point]], py.astype(int), px.astype(int)]
    point, lit = point[lit > 0], lit[lit > 0]
    ends = np.searchsorted(point, np.arange(len(m) + 1)).tolist()
    return [(b - a) * float(np.sqrt(lit[a:b].sum())) for a, b in zip(ends, ends[1:], strict=False)]


def fits(oms: list[np.ndarray], frame: list[int], images: list[np.ndarray], lattice: Lattice, hkl: np.ndarray, detector: Detector, *, max_spots: int | None = None, method: str = "simplex", **options) -> list[tuple[np.ndarray, Lattice, float]]:
    """`fit` of many orientations, each on the image of its number; simplex searches go side by side, as array operations over all of them."""
    if method != "simplex":
        return [fit(om, lattice, hkl, images[at], detector, max_spots=max_spots, method=method, **options) for om, at in zip(oms, frame, strict=True)]
    problems = [_problem(om, lattice, hkl, detector, **options) for om in oms]
    most = max(1, max(p[4].shape[1] for p in problems))
    columns, direction = np.zeros((len(oms), 3, most)), np.zeros((len(oms), most), "i8")
    for i, p in enumerate(problems):
        columns[i, :, : p[4].shape[1]] = p[4]
        direction[i, : p[4].shape[1]] = directions(p[4])
    stack, number = np.stack(images), np.array(frame)

    def values(of: list[int], points: list[np.ndarray]) -> list[float]:
        m = _matrices(np.stack([v[:3] for v in points])) @ np.stack([problems[i][3](v) for i, v in zip(of, points, strict=True)])
        return _overlaps(m, np.array(of), columns, direction, stack, number, detector, max_spots)

    found = together([_steps(p[0], p[1]) for p in problems], values)
    return [(matrix_of(v[:3]), p[2](v), best) for (v, best), p in zip(found, problems, strict=True)]


def refine(candidates: DataFrame, pixels: DataFrame, hkls: DataFrame, lattice: Lattice, detector: Detector, *, min_spots: int = 5, max_spots: int = 90, **options) -> tuple[DataFrame, DataFrame]:
    """(solutions, spots) of candidates (image_nr, grain_nr, n_solutions, row_nr, score, om) on their frames.

    Candidates of a frame are dealt in parts of some PART_ROWS, each of which the packed frame goes to, as a row before them. A task
    fits FITS candidates side by side, of one frame or several. A candidate is fitted on the reflections that it may light within
    the search (on all where the lattice is free), and every objective takes the first of a direction that it lights; then its
    spots come from the whole list by the relational plan. Solutions with fewer than min_spots lit spots go.
    """
    spark = candidates.sparkSession
    listed = forward.reflection_list(hkls)
    shared = spark.sparkContext.broadcast(listed[["h", "k", "l"]].to_numpy("f8").T)
    kinds = dict(candidates.dtypes)
    schema = f"image_nr {kinds['image_nr']}, grain_nr {kinds['grain_nr']}, n_solutions long, row_nr {kinds['row_nr']}, coarse_quality double, om array<double>, lattice array<double>, objective double, misorientation_deg double"
    numbers = pa.list_(pa.float64())
    held = max(1, IMAGE_BYTES // (4 * detector.nr_px_x * detector.nr_px_y))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, own, rows, images, frame = None, None, [], [], []
        kinds_of: dict[str, pa.DataType] = {}

        def done() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            starts = [np.asarray(r["om"], dtype=float).reshape(3, 3) for r in rows]
            found = fits(starts, frame, images, lattice, shared.value, detector, max_spots=max_spots, **options)
            cells = [[cell.a, cell.b, cell.c, cell.alpha, cell.beta, cell.gamma] for _, cell, _ in found]
            turns = [float(np.degrees(np.arccos(np.clip((np.trace(start.T @ om) - 1) / 2, -1, 1)))) for start, (om, _, _) in zip(starts, found, strict=True)]
            columns = {c: pa.array([r[c] for r in rows], kinds_of[c]) for c in ("image_nr", "grain_nr", "n_solutions", "row_nr")} | {
                "coarse_quality": pa.array([r["score"] for r in rows], pa.float64()), "om": pa.array([om.reshape(-1).tolist() for om, _, _ in found], numbers),
                "lattice": pa.array(cells, numbers), "objective": pa.array([best for _, _, best in found], pa.float64()), "misorientation_deg": pa.array(turns, pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(columns)
            rows.clear(), images.clear(), frame.clear()

        for batch in batches:
            kinds_of = {f.name: f.type for f in batch.schema}
            for i, row in enumerate(batch.select([c for c in batch.schema.names if c not in ("pix", "v")]).to_pylist()):
                if not row["candidate"] or own != (row["image_nr"], row["part"]):
                    own, image = (row["image_nr"], row["part"]), np.zeros((detector.nr_px_y, detector.nr_px_x), "f4")
                if not row["candidate"]:
                    image.reshape(-1)[batch.column("pix")[i].values.to_numpy()] = batch.column("v")[i].values.to_numpy()
                    continue
                if len(rows) >= FITS or (len(images) >= held and image is not images[-1]):
                    yield from done()
                if not images or image is not images[-1]:
                    images.append(image)
                rows.append(row)
                frame.append(len(images) - 1)
        yield from done()

    columns = ["image_nr", "grain_nr", F.col("n_solutions").cast("long").alias("n_solutions"), "row_nr", F.col("score").cast("double").alias("score"), "om"]
    candidates = stored(candidates.select(*columns), "to-fit")
    sizes = candidates.groupBy("image_nr").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    part = F.coalesce(F.pmod("grain_nr", "parts"), F.lit(0)).cast("int").alias("part")
    dealt = candidates.join(sizes, "image_nr", "left").select(*candidates.columns, part, F.lit(True).alias("candidate"))
    packed = pixels.where("v > 0").groupBy("image_nr").agg(F.collect_list(F.col("pix").cast("long")).alias("pix"), F.collect_list(F.col("v").cast("double")).alias("v"))
    frames = dealt.select("image_nr", "part").distinct().join(packed, "image_nr")  # a frame goes, as one row, to the parts that there are
    rows = dealt.unionByName(frames.withColumn("candidate", F.lit(False)), allowMissingColumns=True)
    tasks = max(4 * spark.sparkContext.defaultParallelism, candidates.count() // TASK_FITS)  # few bytes, much work: not to be coalesced
    rows = rows.repartition(tasks, "image_nr", "part").sortWithinPartitions("image_nr", "part", "candidate")
    fitted = stored(rows.mapInArrow(work, schema), "fits")  # each output below reads them more than once
    keys = ["image_nr", "grain_nr"]
    predicted = forward.exact_spots(fitted.select(*keys, "om"), hkls, lattice, detector, keys=keys, max_spots=max_spots)
    lit = predicted.join(pixels.where("v > 0"), ["image_nr", "pix"], "left").withColumnRenamed("v", "intensity")
    counts = lit.groupBy(*keys).agg(F.count("intensity").alias("n_matches"), F.count("*").alias("n_spots_calc"), F.sum("intensity").alias("sum_intensity"))
    solutions = fitted.join(counts.where(F.col("n_matches") >= min_spots), keys)
    per_spot = F.col("objective") / F.col("n_matches")
    solutions = solutions.withColumn("intensity", per_spot * per_spot).withColumn("quality", F.col("objective")).withColumn("source_row", F.col("grain_nr"))
    return solutions, lit.where("intensity is not null").join(solutions.select(*keys), keys, "left_semi")
