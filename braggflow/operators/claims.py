"""Evidence of solutions: which spots a grain alone explains, and which grains to keep."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braggflow.functions import geometry as G
from braggflow.functions.crystal import CSL, CSL_AXIS_TOLERANCE, rotation_quaternion, symmetry_quaternions
from braggflow.operators import cells
from braggflow.sources.store import discard, stored

#: A space group with cubic symmetry; all have the same rotations.
CUBIC = 225
#: Undecided rows of a frame that one task may walk over, each against all that are kept; frames with more are settled in rounds.
WALK_ROWS = 2000


def unique_claims(solutions: DataFrame, spots: DataFrame, labels: DataFrame | Column) -> DataFrame:
    """(image_nr, grain_nr, n_unique, n_unique_labels) of each solution.

    Grains claim spots in order of falling quality (equal quality: the later row first). A spot's key is its labelled
    region, or its position where there is none; the first claim of a key is accepted. One ranking per key says the same
    as the walk over all grains, since a region is claimed by the first spot in it and never again.

    solutions (image_nr, grain_nr, quality, source_row); spots (image_nr, grain_nr, spot_row, x, y); labels (image_nr, x, y, label),
    or the label of each spot as a column over x and y, which needs no join.
    """
    ranked = spots.join(solutions.select("image_nr", "grain_nr", "quality", "source_row"), ["image_nr", "grain_nr"])
    if isinstance(labels, Column):
        placed = ranked.withColumn("label", F.when(labels > 0, labels))
    else:
        regions = labels.where("label > 0").select("image_nr", "x", "y", "label").hint("merge")  # a row a pixel: never broadcast, whatever its source's size
        placed = ranked.join(regions, ["image_nr", "x", "y"], "left")
    free = F.col("label").isNull()
    key = [F.when(free, F.lit(0)).otherwise(F.col("label")).alias("region"), F.when(free, F.col("x")).alias("kx"), F.when(free, F.col("y")).alias("ky")]
    order = Window.partitionBy("image_nr", "region", "kx", "ky").orderBy(F.desc("quality"), F.desc("source_row"), "spot_row")
    first = placed.select("image_nr", "grain_nr", "quality", "source_row", "spot_row", *key).withColumn("n", F.row_number().over(order)).where("n = 1")
    counted = first.groupBy("image_nr", "grain_nr").agg(F.count("*").alias("n_unique"), F.count_if(F.col("region") > 0).alias("n_unique_labels"))
    return with_claims(solutions.select("image_nr", "grain_nr"), counted)


def with_claims(solutions: DataFrame, claims: DataFrame) -> DataFrame:
    """Solutions with their claims, zero where a grain has none."""
    found = solutions.join(claims, ["image_nr", "grain_nr"], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_unique", "n_unique_labels")})


def keep_by_labels(solutions: DataFrame, claims: DataFrame, min_unique: int = 2) -> DataFrame:
    """Solutions with at least min_unique regions of their own."""
    return solutions.join(claims.where(F.col("n_unique_labels") >= min_unique).select("image_nr", "grain_nr"), ["image_nr", "grain_nr"], "left_semi")


def kept_spots(spots: DataFrame, kept: DataFrame) -> DataFrame:
    """Spots of the kept grains."""
    return spots.join(kept.select("image_nr", "grain_nr"), ["image_nr", "grain_nr"], "left_semi")


def by_quality(solutions: DataFrame, n: int | None = None) -> DataFrame:
    """Best first, equal quality by the later row; the best n of each frame if n is given."""
    order = Window.partitionBy("image_nr").orderBy(F.desc("quality"), F.desc("source_row"))
    ranked = solutions.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def _boundaries(sigmas: tuple[int, ...]) -> np.ndarray:
    """The rotations across the named coincidence boundaries of cubic crystals; of those that differ by symmetry, one."""
    found = {}
    for angle, axis in (CSL[s] for s in sigmas if s in CSL):
        for signs in itertools.product((1, -1), repeat=3):
            for order in itertools.permutations(range(3)):
                q = np.array([rotation_quaternion(tuple(signs[i] * axis[order[i]] for i in range(3)), angle)])
                alike = np.round(cells.equivalents(q, np.array(symmetry_quaternions(CUBIC)))[0], 6) + 0.0
                found.setdefault(max(map(tuple, alike)), q[0])
    return np.array(list(found.values())).reshape(-1, 4)


def _slack(sigmas: tuple[int, ...], tolerance_deg: float) -> float:
    """How far, as quaternions, a pair may be from a named boundary and still count as one."""
    widest = max((CSL[s][0] for s in sigmas if s in CSL), default=0.0)
    return cells.chord(tolerance_deg) + math.sin(math.radians(min(180.0, widest + tolerance_deg)) / 2) * (CSL_AXIS_TOLERANCE + 1e-4)


def _twins(kept: DataFrame, weak: DataFrame, variants: DataFrame, sigmas: tuple[int, ...], tolerance_deg: float) -> DataFrame:
    """(image_nr, at) of the weak rows that have a coincidence boundary with an earlier row of kept; both (image_nr, at, q)."""
    turned = variants.join(kept.select("image_nr", F.col("at").alias("before"), F.col("q").alias("p")), ["image_nr", "before"])
    asked = weak.select("image_nr", "at", "q", cells.around().alias("cell"))
    pairs = asked.join(turned.select("image_nr", "cell", "before", "p"), ["image_nr", "cell"]).where("before < at").dropDuplicates(["image_nr", "at", "before"])
    p, q = G.elements("p", 4), G.elements("q", 4)
    pairs = pairs.withColumn("angle", G.misorientation_deg(p, q, CUBIC)).withColumn("axis", G.disorientation_axis(p, q))
    return pairs.where(G.csl_related(F.col("angle"), F.col("axis"), sigmas, tolerance_deg)).select("image_nr", "at").distinct()


def cubic_disorientations(own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles in degrees and sorted absolute axes of the cubic disorientations of a unit quaternion from others.

    For absolute parts a >= b >= c >= d of the rotation between, the representative of largest scalar part is one
    of three. A null rotation has no axis (nan).
    """
    w, v = own[0], own[1:]
    between = np.column_stack([w * others[:, 0] + others[:, 1:] @ v, w * others[:, 1:] - others[:, :1] * v - np.cross(v, others[:, 1:])])
    a, b, c, d = np.sort(np.abs(between), axis=1)[:, ::-1].T
    root = np.sqrt(0.5)
    scalars = np.stack([a, (a + b) * root, (a + b + c + d) / 2])
    vectors = np.stack([[b, c, d], [(a - b) * root, (c + d) * root, (c - d) * root], [(a - b + c - d) / 2, (a + b - c - d) / 2, (a - b - c + d) / 2]])
    best, at = np.argmax(scalars, axis=0), np.arange(len(others))
    axes = np.sort(np.abs(vectors[best, :, at]), axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        axes = axes / np.linalg.norm(axes, axis=1, keepdims=True)
    return np.degrees(2 * np.arccos(np.minimum(1.0, scalars[best, at]))), axes


def _walk(frame: pd.DataFrame, max_angle_deg: float, sigmas: tuple[int, ...], tolerance_deg: float) -> pd.DataFrame:
    """The rows (image_nr, at) of one frame that are kept, in order, of rows (at, strong, rescued, q)."""
    named = [CSL[s] for s in sigmas if s in CSL]
    frame = frame.sort_values("at")
    kept, rotations = [], np.empty((0, 4))
    for at, strong, rescued, q in zip(frame["at"], frame["strong"], frame["rescued"], frame["q"], strict=True):
        angles, axes = cubic_disorientations(q, rotations)
        if (angles < max_angle_deg).any():
            continue
        if strong or rescued or any(((np.abs(angles - a) < tolerance_deg) & (np.linalg.norm(axes - np.array(axis), axis=1) < CSL_AXIS_TOLERANCE)).any() for a, axis in named):
            kept.append(at)
            rotations = np.vstack([rotations, q])
    return pd.DataFrame({"image_nr": [frame["image_nr"].iloc[0]] * len(kept), "at": kept})


def _settled(rows: DataFrame, max_angle_deg: float, sigmas: tuple[int, ...], tolerance_deg: float, walk_rows: int | None = None) -> list[DataFrame]:
    """Stored tables (image_nr, at) of the rows (image_nr, at, strong, q) that are kept.

    In each round the rows that no undecided earlier one is near to are clear. Strong clear rows are kept, and so are weak ones
    that have a boundary with a kept row. What lies near a kept row goes, and weak rows that no earlier row, kept or undecided, could
    still rescue go too. The first undecided row of a frame is always decided. What is left of a frame when it is small is walked over.
    """
    symmetry, keys = symmetry_quaternions(CUBIC), ["image_nr", "at"]
    most, kinds = WALK_ROWS if walk_rows is None else walk_rows, dict(rows.dtypes)
    schema = f"image_nr {kinds['image_nr']}, at {kinds['at']}"
    walked = lambda df: df.groupBy("image_nr").applyInPandas(lambda frame: _walk(frame, max_angle_deg, sigmas, tolerance_deg), schema)
    undecided = rows.withColumn("rescued", F.lit(False))
    large = cells.large_frames(undecided, most)
    if large is None:
        return [stored(walked(undecided), "kept")]
    kept = [stored(walked(undecided.join(large, "image_nr", "left_anti")), "kept")]
    undecided = stored(undecided.join(large, "image_nr", "left_semi"), "undecided")
    places = stored(cells.index(undecided, symmetry, cells.chord(max_angle_deg)), "places")
    slack, boundaries = _slack(sigmas, tolerance_deg), _boundaries(sigmas)
    homes = stored(cells.index(undecided.where("not strong"), symmetry, slack).where("home").select(*keys, "cell"), "homes")
    moved = cells.index(undecided, symmetry, slack, moved=boundaries) if len(boundaries) else cells.index(undecided, symmetry, slack).limit(0)
    variants = stored(moved.select("image_nr", "cell", F.col("at").alias("before")).distinct(), "variants")
    while large is not None:
        now = undecided.join(large, "image_nr", "left_semi")
        alive = now.select(*keys)
        near = places.join(alive, keys, "left_semi")
        clear = near.where("home").join(cells.first_in_reach(near), ["image_nr", "cell"]).where("at = first").select(*keys, F.lit(True).alias("clear"))
        rescuers = variants.join(alive.withColumnRenamed("at", "before"), ["image_nr", "before"], "left_semi").withColumnRenamed("before", "at")
        waiting = homes.join(cells.first_in_reach(rescuers), ["image_nr", "cell"]).where("first < at").select(*keys, F.lit(True).alias("waits"))
        state = now.join(clear, keys, "left").join(waiting, keys, "left")
        state = stored(state.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("clear", "waits")}), "state")
        new = stored(state.where("clear and (strong or rescued)").select(*keys, "q"), "new")
        kept.append(stored(new.select(*keys), "kept"))
        gone = cells.meetings(places.where("home").join(new.select(*keys), keys, "left_semi"), near, max_angle_deg, strict=True).select(*keys)
        gone = gone.union(new.select(*keys)).union(state.where("not strong and not rescued and not waits").select(*keys)).distinct()
        left = undecided.join(gone, keys, "left_anti")
        weak = left.where("not strong and not rescued").select(*keys, "q").join(homes, keys)
        twins = _twins(new, weak, variants, sigmas, tolerance_deg).withColumn("twin", F.lit(True))
        left = stored(left.join(twins, keys, "left").withColumn("rescued", F.col("rescued") | F.coalesce("twin", F.lit(False))).drop("twin"), "undecided")
        discard(undecided, state, new, large)
        undecided, large = left, cells.large_frames(left, most)
    kept.append(stored(walked(undecided), "kept"))
    discard(undecided, places, homes, variants)
    return kept


def keep_robust(
    solutions: DataFrame, claims: DataFrame, *, min_unique: int = 2, max_angle_deg: float = 5.0, min_total: int = 5,
    sigmas: tuple[int, ...] = (3,), tolerance_deg: float = 3.0, cubic: bool = True, walk_rows: int | None = None,
) -> DataFrame:
    """Twin-aware choice, best quality first: near-duplicates of a kept grain go; of the rest stays what has min_total
    spots and is the first, has min_unique regions of its own, or is a coincidence boundary of a kept grain.

    What has too few spots is never kept and changes nothing. The first of the others in each frame is always kept, so it
    counts as strong, like those with regions of their own. All others are settled in rounds over a cell index (see
    _settled), so a frame's solutions are spread over tasks. Solutions without an orientation, and all where cubic is false, are
    near to nothing and twins of nothing. A missing quality comes last; missing matches count as none.
    """
    table = with_claims(solutions, claims)
    order = Window.partitionBy("image_nr").orderBy(F.desc_nulls_last("quality"), F.desc_nulls_last("source_row"))
    total = F.when(F.col("n_unique") != 0, F.col("n_unique")).otherwise(F.coalesce(F.bround(F.col("n_matches").cast("double")), F.lit(0)))
    rotation = F.when(F.size("om") == 9, F.array(*G.matrix_to_quaternion(G.elements("om", 9)))) if cubic else F.lit(None).cast("array<double>")
    rows = table.withColumn("__at", F.row_number().over(order)).where(total >= min_total).withColumn("__q", rotation)
    rows = stored(rows.withColumn("__strong", (F.col("n_unique_labels") >= min_unique) | (F.row_number().over(order) == 1)), "eligible")
    brief = rows.select("image_nr", F.col("__at").alias("at"), F.col("__strong").alias("strong"), F.col("__q").alias("q"))
    kept = brief.where("q is null and strong").select("image_nr", "at")
    for more in _settled(brief.where("q is not null"), max_angle_deg, sigmas, tolerance_deg, walk_rows):
        kept = kept.union(more.select("image_nr", "at"))
    return rows.join(kept.withColumnRenamed("at", "__at"), ["image_nr", "__at"], "left_semi").select(*table.columns)


def postprocess(solutions: DataFrame, spots: DataFrame, labels: DataFrame | Column, *, robust: bool = True, space_group: int = 225, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept solutions, their spots, claims): claims, choice, and the semi join of spots, for all frames at once.

    Claims are stored: the choice and the result both need them, and spots are ranked once for both.
    """
    claims = stored(unique_claims(solutions, spots, labels), "claims")
    if robust:
        kept = keep_robust(solutions, claims, cubic=195 <= space_group <= 230, **options).select(*solutions.columns)
    else:
        kept = keep_by_labels(solutions, claims, **options)
    return by_quality(kept), kept_spots(spots, kept), claims
