"""Merging of coarse matches: symmetry-aware leader clustering within each frame.

Rows of a frame stand in an order. An unclaimed row leads and claims all later unclaimed rows within an angle. So a row
leads if no earlier leader is within the angle, and otherwise belongs to the earliest leader that is. That is decided for all
frames at once, in rounds over a cell index on rotations (see operators/cells.py): a row that is earlier than all
undecided rows in its cell and the cells around it leads, since nothing undecided could claim it, and what lies within
its angle is then decided. Each round takes grouped minima, so a frame's rows are spread over tasks and no pairs of rows are
made. What a frame has left when it is small is walked over by one task. In the end rows meet the leaders around them, of
which a cell has few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braggflow.functions import geometry as G
from braggflow.functions.crystal import symmetry_quaternions
from braggflow.operators import cells
from braggflow.sources.store import discard, stored


#: Undecided rows of a frame that one task may walk over, some 2 KB each; frames with more are settled in rounds until no more are left.
WALK_ROWS = 20_000


def capped(scored: DataFrame, most: int) -> DataFrame:
    """The candidates that are merged and their order `at`: by row number, or the best `most` by score where a frame has more."""
    frame = Window.partitionBy("image_nr")
    ranked = scored.withColumn("by_score", F.row_number().over(frame.orderBy(F.desc("score"), "row_nr")))
    ranked = ranked.withColumn("n_frame", F.count("*").over(frame)).where(F.col("by_score") <= most)
    return ranked.withColumn("at", F.when(F.col("n_frame") > most, F.col("by_score")).otherwise(F.col("row_nr"))).drop("by_score", "n_frame")


def leaders(q: np.ndarray, symmetry: np.ndarray, max_angle_deg: float) -> np.ndarray:
    """The position of each row's leader, by a walk over the rows of one frame; a leader meets what has a place in the cells around it."""
    least, width = np.cos(np.radians(max_angle_deg) / 2) - cells.ROUNDING, cells.chord(max_angle_deg) + 1e-9
    row, found, home = cells.places(q, symmetry, width)
    numbers = cells.numbered(found[:, 1:], width)
    order = np.argsort(numbers, kind="stable")
    row, found, own = row[order], found[order], np.empty(len(q), "i8")
    own[row[home[order]]] = np.flatnonzero(home[order])
    cell, start = np.unique(numbers[order], return_index=True)
    spans = dict(zip(cell.tolist(), zip(start.tolist(), np.append(start[1:], len(row)).tolist(), strict=True), strict=True))
    owner = np.full(len(q), -1)
    for i in range(len(q)):
        if owner[i] >= 0:
            continue
        centre = int(numbers[order[own[i]]])
        near = np.concatenate([np.arange(*spans[c]) for c in (centre + n for n in cells.AROUND) if c in spans])
        hit = row[near[found[near] @ found[own[i]] >= least]]
        owner[hit[owner[hit] < 0]] = i
    return owner


def leading(rows: DataFrame, *, space_group: int = 225, max_angle_deg: float = 5.0, walk_rows: int | None = None) -> DataFrame:
    """(image_nr, at, leader): the leader of each row, of distinct (image_nr, at) with a quaternion q. Stored."""
    symmetry, keys, most = symmetry_quaternions(space_group), ["image_nr", "at"], WALK_ROWS if walk_rows is None else walk_rows
    group, kinds = np.array(symmetry), dict(rows.dtypes)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        at = frame["at"].to_numpy()
        return pd.DataFrame({"image_nr": frame["image_nr"].iloc[0], "at": at, "leader": at[leaders(np.stack(frame["q"].to_numpy()), group, max_angle_deg)]})

    walked = lambda df: df.groupBy("image_nr").applyInPandas(walk, f"image_nr {kinds['image_nr']}, at {kinds['at']}, leader {kinds['at']}")
    rows = rows.where("q is not null").select(*keys, "q")
    large = cells.large_frames(rows, most)
    if large is None:
        return stored(walked(rows), "leaders")
    small = stored(walked(rows.join(large, "image_nr", "left_anti")), "leaders")
    rows = rows.join(large, "image_nr", "left_semi")
    placed = stored(cells.index(rows, symmetry, cells.chord(max_angle_deg)), "places")
    undecided, found = placed, []
    while large is not None:
        near = undecided.join(large, "image_nr", "left_semi")
        first = near.where("home").join(cells.first_in_reach(near), ["image_nr", "cell"]).where("at = first").drop("first")
        found.append(stored(first, "leaders"))
        claimed = cells.meetings(found[-1], near, max_angle_deg).select(*keys).distinct()
        left = stored(undecided.join(claimed, keys, "left_anti"), "places")
        discard(undecided if undecided is not placed else None, large)
        undecided, large = left, cells.large_frames(left.where("home"), most)
    rest = walked(undecided.where("home").select(*keys, F.array(*"wxyz").alias("q"))).where("at = leader").select(*keys)
    found.append(stored(placed.where("home").join(rest, keys, "left_semi").select(*found[0].columns), "leaders"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    near = cells.meetings(every, placed, max_angle_deg).where("near <= at")
    out = stored(small.unionByName(near.groupBy(*keys).agg(F.min("near").alias("leader"))), "leaders")
    discard(placed, undecided, small, *found)
    return out


def merge(scored: DataFrame, orientations: DataFrame, *, space_group: int = 225, max_angle_deg: float = 5.0, most: int | None = None) -> DataFrame:
    """(image_nr, grain_nr, n_solutions, row_nr, n_spots, total, score): one row a cluster, its best member by score.

    Rows stand in the order of their numbers. most: candidates of a frame that are merged, the best by score where there are
    more, in order of score then; all by default. Of members of equal score the earliest is taken; grains are numbered in
    the order of their leaders. Candidates whose orientation is not in the list are left out. Where orientations are folded
    (`copies`), a row counts for all of its copies: equal rotations have one leader, and the earliest is the best of them.
    """
    copies = F.col("copies") if "copies" in orientations.columns else F.lit(1)
    rows = scored.withColumn("at", F.col("row_nr")) if most is None else capped(scored, most)
    rows = rows.join(orientations.select("row_nr", "om", copies.cast("long").alias("copies")), "row_nr").select("image_nr", "row_nr", "n_spots", "total", "score", "at", "copies", F.array(*G.matrix_to_quaternion(G.elements("om", 9))).alias("q"))
    rows = stored(rows, "candidates")
    owned = rows.drop("q").join(leading(rows.select("image_nr", "at", "q"), space_group=space_group, max_angle_deg=max_angle_deg), ["image_nr", "at"])
    best = F.max_by(F.struct("row_nr", "n_spots", "total", "score"), F.struct("score", -F.col("at"))).alias("best")
    clusters = owned.groupBy("image_nr", "leader").agg(F.sum("copies").alias("n_solutions"), best)
    number = F.row_number().over(Window.partitionBy("image_nr").orderBy("leader")).cast("long")
    return clusters.select("image_nr", number.alias("grain_nr"), "n_solutions", "best.*")
