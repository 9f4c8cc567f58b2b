"""The queries of the diffraction operators, by name, and the SQL that each is held against."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braggflow.functions import geometry as G
from braggflow.functions.crystal import HC_KEV_NM, NICKEL, symmetry_quaternions
from braggflow.operators import claims, forward, imaging, kernels, match, merge, orientations, pairs, reflections, relations
from braggflow.plans import derive as D
from braggflow.sources.store import new_path, stored

N_PIXELS = D.SIZE * D.SIZE
_NF = "(SELECT count(*) FROM supplier)"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL where it has one."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _d(x: float) -> str:
    """A double literal in any SQL."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


# SQL of the derived tables

_Q = ["a", "b", "c", "d"]
_ORIENT = (
    "orient AS (SELECT row_nr, " + ", ".join(f"{e} AS m{i}" for i, e in enumerate(D._matrix(*_Q)))
    + " FROM (SELECT o_orderkey AS row_nr, 1 + o_orderkey % 7 AS a, o_custkey % 11 AS b, (o_orderkey // 7) % 13 AS c, (o_custkey * 3 + o_orderkey) % 5 AS d FROM orders))"
)

_GRID = (
    "orient AS (SELECT row_nr, " + ", ".join(f"{e} AS m{i}" for i, e in enumerate(D._matrix(*_Q)))
    + " FROM (SELECT c_custkey AS row_nr, 1 + c_custkey % 7 AS a, c_custkey % 11 AS b, (c_custkey // 7) % 13 AS c, (c_nationkey * 3 + c_custkey) % 5 AS d FROM customer))"
)


def _hkl_sql(h_max: int, rule: str = "true") -> str:
    v = f"SELECT CAST(v AS INTEGER) AS v FROM range({-h_max}, {h_max + 1}) t(v)"
    return (
        "SELECT CAST(row_number() OVER (ORDER BY n2, h, k, l) - 1 AS INTEGER) AS hkl_id, h, k, l, n2 FROM "
        f"(SELECT x.v AS h, y.v AS k, z.v AS l, x.v * x.v + y.v * y.v + z.v * z.v AS n2 FROM ({v}) x, ({v}) y, ({v}) z) WHERE n2 > 0 AND ({rule})"
    )


_MOD = lambda e, n: f"((({e}) % {n}) + {n}) % {n} = 0"
_RULES = {
    "f": ("F", {}, f"{_MOD('h + k', 2)} AND {_MOD('k + l', 2)}"),
    "i": ("I", {}, _MOD("h + k + l", 2)),
    "c": ("C", {}, _MOD("h + k", 2)),
    "a": ("A", {}, _MOD("k + l", 2)),
    "rhex": ("R", {"space_group": 166, "hexagonal_axes": True}, f"{_MOD('-h + k + l', 3)} OR {_MOD('h - k + l', 3)}"),
    "hex": ("P", {"space_group": 194, "hexagonal_axes": True}, f"NOT ({_MOD('h + 2 * k', 3)}) OR {_MOD('l', 2)}"),
}
for _name, (_centring, _options, _rule) in _RULES.items():
    query(f"hkl_generate_{_name}", f"SELECT p_partkey AS crystal, hkl_id, h, k, l, n2 FROM part JOIN ({_hkl_sql(6, _rule)}) ON n2 <= p_size")(
        lambda spark, sf_dir, centring=_centring, options=_options: D.within_limits(spark, sf_dir, reflections.generate(spark, 6, centring, **options))
    )

_PIXELS = (
    f"pixels AS (SELECT l_suppkey % {_NF} AS image_nr, (l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % {N_PIXELS} AS pix, max(l_extendedprice) AS v "
    "FROM lineitem GROUP BY 1, 2)"
)
_SOLUTIONS = f"solutions AS (SELECT o_orderkey % {_NF} AS image_nr, o_orderkey AS grain_nr, o_totalprice AS quality, o_orderkey AS source_row, o_custkey % 20 AS n_matches FROM orders)"
_SPOTS = (
    f"spots AS (SELECT l_orderkey % {_NF} AS image_nr, l_orderkey AS grain_nr, l_orderkey * 8 + l_linenumber AS spot_row, "
    f"(l_partkey * 7 + l_linenumber) % {D.SIZE} AS x, (l_suppkey * 13 + l_partkey) % {D.SIZE} AS y FROM lineitem)"
)
_LABELS = (
    "seg AS (SELECT image_nr, x, y, CASE WHEN (x * 3 + y * 5) % 7 < 3 THEN 1 + (x // 8) * 8 + y // 8 ELSE 0 END AS label FROM "
    f"(SELECT s_suppkey % {_NF} AS image_nr, id % {D.SIZE} AS x, id // {D.SIZE} AS y FROM supplier, range({N_PIXELS}) t(id)))"
)
_CLAIMS = """claims AS (
  WITH placed AS (SELECT s.image_nr, s.grain_nr, o.quality, o.source_row, s.spot_row, s.x, s.y, CASE WHEN g.label > 0 THEN g.label ELSE 0 END AS region
      FROM spots s JOIN solutions o USING (image_nr, grain_nr) LEFT JOIN seg g USING (image_nr, x, y)),
  firsts AS (SELECT image_nr, grain_nr, region, row_number() OVER (PARTITION BY image_nr, region, CASE WHEN region = 0 THEN x END, CASE WHEN region = 0 THEN y END
      ORDER BY quality DESC, source_row DESC, spot_row) AS n FROM placed),
  counted AS (SELECT image_nr, grain_nr, count(*) AS n_unique, count(*) FILTER (region > 0) AS n_unique_labels FROM firsts WHERE n = 1 GROUP BY 1, 2)
  SELECT image_nr, grain_nr, coalesce(n_unique, 0) AS n_unique, coalesce(n_unique_labels, 0) AS n_unique_labels
  FROM solutions LEFT JOIN counted USING (image_nr, grain_nr))"""

_R = [_d(x) for x in D.DETECTOR.rotation().T.reshape(-1)]
_RECIP = _d(NICKEL.reciprocal()[0][0])
_P = [_d(x) for x in D.DETECTOR.p_array]
_HALF = _d(0.5 * (D.SIZE - 1))
_PROJECT = f"""
m AS (SELECT row_nr, {", ".join(f"m{i} * {_RECIP} AS r{i}" for i in range(9))} FROM orient),
q AS (SELECT row_nr, hkl_id, {", ".join(f"h * r{3 * i} + k * r{3 * i + 1} + l * r{3 * i + 2} AS q{i}" for i in range(3))} FROM m, hkls),
u AS (SELECT *, sqrt(q0 * q0 + q1 * q1 + q2 * q2) AS qlen FROM q WHERE q2 < 0),
v AS (SELECT row_nr, hkl_id, qlen, q0 / qlen AS qx, q1 / qlen AS qy, q2 / qlen AS qz FROM u),
e AS (SELECT *, {_d(HC_KEV_NM)} * qlen / ({_d(4 * math.pi)} * -qz) AS energy FROM v),
k AS (SELECT row_nr, hkl_id, energy, -2e0 * qz * qx AS k0, -2e0 * qz * qy AS k1, 1e0 - 2e0 * qz * qz AS k2 FROM e WHERE energy BETWEEN {_d(D.DETECTOR.e_lo)} AND {_d(D.DETECTOR.e_hi)}),
x AS (SELECT row_nr, hkl_id, energy, {", ".join(f"k0 * {_R[3 * i]} + k1 * {_R[3 * i + 1]} + k2 * {_R[3 * i + 2]} AS {n}" for i, n in enumerate("xyz"))} FROM k),
p AS (SELECT row_nr, hkl_id, energy, (x * {_P[2]} / z - {_P[0]}) / {_d(D.DETECTOR.px_x)} + {_HALF} AS px, (y * {_P[2]} / z - {_P[1]}) / {_d(D.DETECTOR.px_y)} + {_HALF} AS py FROM x WHERE z > 0),
lit AS (SELECT row_nr, hkl_id, energy, CAST(trunc(py) AS BIGINT) * {D.SIZE} + CAST(trunc(px) AS BIGINT) AS pix FROM p WHERE px > -1 AND px < {D.SIZE} AND py > -1 AND py < {D.SIZE}),
firsts AS (SELECT row_nr, pix, min(hkl_id) AS hkl_id FROM lit GROUP BY 1, 2),
fwd AS (SELECT * FROM (SELECT row_nr, row_number() OVER (PARTITION BY row_nr ORDER BY hkl_id) - 1 AS spot_nr, hkl_id, pix FROM firsts) WHERE spot_nr < 30)"""
_FORWARD = f"WITH hkls AS ({_hkl_sql(D.H_MAX, _RULES['f'][2])}), {_ORIENT}, {_PROJECT}"
_COARSE = f"""WITH hkls AS ({_hkl_sql(D.H_MAX, _RULES['f'][2])}), {_GRID}, {_PROJECT}, {_PIXELS},
coarse AS (SELECT *, total * sqrt(CAST(n_spots AS DOUBLE)) AS score FROM (SELECT image_nr, row_nr, count(*) AS n_spots, CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) AS total
  FROM fwd JOIN pixels USING (pix) GROUP BY 1, 2) WHERE n_spots >= 2)"""


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward.spots(D.orientations(spark, sf_dir), D.hkls(spark), NICKEL, D.DETECTOR)


def _grid_forward(spark: SparkSession, sf_dir: str, grid: DataFrame | None = None) -> DataFrame:
    return forward.spots(D.grid(spark, sf_dir) if grid is None else grid, D.hkls(spark), NICKEL, D.DETECTOR)


def _coarse(spark: SparkSession, sf_dir: str, min_spots: int = 2, best: int | None = None, grid: DataFrame | None = None) -> DataFrame:
    """The coarse matches of the grid, or of another list of orientations."""
    lines = D.table(spark, sf_dir, "lineitem").count()  # of the file's footer; pixels would be shuffled to be counted
    return match.coarse(stored(_grid_forward(spark, sf_dir, grid), "forward"), D.pixels(spark, sf_dir), min_spots=min_spots, best=best, n_pixels=lines)


def _folded_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid without repeated orientations: what is matched, merged and fitted then grows with frames, not with frames times rows."""
    return stored(orientations.folded(D.grid(spark, sf_dir)), "grid")


@query("forward_spots", f"{_FORWARD} SELECT row_nr, spot_nr, hkl_id, pix FROM fwd")
def forward_spots(spark, sf_dir):
    return _forward(spark, sf_dir)


@query("forward_packed", f"{_FORWARD} SELECT row_nr, count(*) AS n_pixels, sum(pix * (spot_nr + 1)) AS checksum FROM fwd GROUP BY 1")
def forward_packed(spark, sf_dir):
    stored = forward.packed(_forward(spark, sf_dir))
    back = forward.unpacked(stored)
    return back.groupBy("row_nr").agg(F.count("*").alias("n_pixels"), F.sum(F.col("pix") * (F.col("spot_nr") + 1)).alias("checksum"))


@query("energy", f"{_FORWARD} SELECT row_nr, hkl_id, round(energy, 6) AS energy FROM lit")
def energy(spark, sf_dir):
    rows = forward.project(D.orientations(spark, sf_dir), D.hkls(spark).select("hkl_id", "h", "k", "l"), NICKEL, D.DETECTOR)
    return rows.select("row_nr", "hkl_id", F.round("energy", 6).alias("energy"))


@query("coarse_match", f"{_COARSE} SELECT image_nr, row_nr, n_spots, round(total, 4) AS total, round(score, 4) AS score FROM coarse")
def coarse_match(spark, sf_dir):
    fold = _folded_grid(spark, sf_dir)
    found = _coarse(spark, sf_dir, grid=fold).withColumns({c: F.round(c, 4) for c in ("total", "score")})
    return orientations.unfolded(found, orientations.members(D.grid(spark, sf_dir), fold)).drop("om")


@query("score_rank_topk", f"{_COARSE} SELECT * FROM (SELECT image_nr, row_nr, n_spots, round(score, 4) AS score, row_number() OVER (PARTITION BY image_nr ORDER BY score DESC, row_nr) AS rank FROM coarse) WHERE rank <= 10")
def score_rank_topk(spark, sf_dir):
    # a row of a folded orientation comes after the first rows of all that come before it, and after its own earlier rows
    fold = _folded_grid(spark, sf_dir)
    best = match.top(_coarse(spark, sf_dir, best=10, grid=fold), 10).drop("rank")
    found = match.top(orientations.unfolded(best, orientations.members(D.grid(spark, sf_dir), fold, 10)), 10)
    return found.select("image_nr", "row_nr", "n_spots", F.round("score", 4).alias("score"), "rank")


@query("orientation_lookup", f"{_COARSE} SELECT image_nr, row_nr, {', '.join(f'm{i}' for i in range(9))} FROM coarse JOIN orient USING (row_nr)")
def orientation_lookup(spark, sf_dir):
    fold = _folded_grid(spark, sf_dir)
    found = orientations.lookup_folded(_coarse(spark, sf_dir, grid=fold).select("image_nr", "row_nr"), D.grid(spark, sf_dir), fold)
    return found.select("image_nr", "row_nr", *[F.col("om")[i].alias(f"m{i}") for i in range(9)])


@query("frame_pixel_stats", f"WITH {_PIXELS} SELECT image_nr, count(*) FILTER (v > 0) AS n_lit, max(v) AS brightest FROM pixels GROUP BY 1")
def frame_pixel_stats(spark, sf_dir):
    return match.pixel_stats(D.pixels(spark, sf_dir))


# Geometry

_QUAT = (
    "quat AS (SELECT vec_id, image_nr, " + ", ".join(f"e{i} / sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) AS q{i}" for i in range(4))
    + " FROM (SELECT vec_id, vec_id % 25 AS image_nr, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(4)) + " FROM embeddings))"
)
_PROD = lambda p, q: [
    f"({p[0]}) * ({q[0]}) - ({p[1]}) * ({q[1]}) - ({p[2]}) * ({q[2]}) - ({p[3]}) * ({q[3]})", f"({p[0]}) * ({q[1]}) + ({p[1]}) * ({q[0]}) + ({p[2]}) * ({q[3]}) - ({p[3]}) * ({q[2]})",
    f"({p[0]}) * ({q[2]}) - ({p[1]}) * ({q[3]}) + ({p[2]}) * ({q[0]}) + ({p[3]}) * ({q[1]})", f"({p[0]}) * ({q[3]}) + ({p[1]}) * ({q[2]}) - ({p[2]}) * ({q[1]}) + ({p[3]}) * ({q[0]})",
]
_BETWEEN = _PROD(["p.q0", "-p.q1", "-p.q2", "-p.q3"], [f"q.q{i}" for i in range(4)])
_PAIRS = f"WITH {_QUAT}, pairs AS (SELECT p.image_nr, p.vec_id AS a, q.vec_id AS b, {', '.join(f'{e} AS d{i}' for i, e in enumerate(_BETWEEN))} FROM quat p JOIN quat q ON p.image_nr = q.image_nr AND p.vec_id < q.vec_id)"
_SYM = symmetry_quaternions(225)
_DOTS = ", ".join("abs(" + " + ".join(f"d{i} * {_d(s[i] if i == 0 else -s[i])}" for i in range(4)) + ")" for s in _SYM)
_ANGLE = f"degrees(2e0 * acos(least(1e0, greatest({_DOTS}))))"


def _pairs(spark, sf_dir, **parts):
    return pairs.disorientations(D.quaternions(spark, sf_dir).withColumnRenamed("vec_id", "at"), **parts)


@query("misorientation_pairs", f"{_PAIRS} SELECT image_nr, a, b, round({_ANGLE}, 6) AS angle_deg FROM pairs")
def misorientation_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, axis=False, digits=6).select("image_nr", "a", "b", "angle_deg")


# A walk in SQL: the rows of a frame are numbered, and step k of the recursion decides on row k of every frame, by the lists of the
# earlier rows that it has to do with. A scalar part's limit stands for an angle.
_LEAST = _d(math.cos(math.radians(2.5)) - 1e-12)
_GRID_QUAT = "gq AS (SELECT row_nr, " + ", ".join(f"{e} / sqrt(CAST(a * a + b * b + c * c + d * d AS DOUBLE)) AS q{i}" for i, e in enumerate("abcd")) + (
    " FROM (SELECT c_custkey AS row_nr, 1 + c_custkey % 7 AS a, c_custkey % 11 AS b, (c_custkey // 7) % 13 AS c, (c_nationkey * 3 + c_custkey) % 5 AS d FROM customer))"
)
_MERGE = f"""{_COARSE.replace("WITH hkls", "WITH RECURSIVE hkls", 1)}, {_GRID_QUAT},
rows_ AS MATERIALIZED (SELECT image_nr, row_number() OVER (PARTITION BY image_nr ORDER BY row_nr) AS k, row_nr, n_spots, total, score, q0, q1, q2, q3 FROM coarse JOIN gq USING (row_nr)),
between_ AS (SELECT p.image_nr, p.k AS i, q.k AS j, {', '.join(f'{e} AS d{n}' for n, e in enumerate(_BETWEEN))} FROM rows_ p JOIN rows_ q ON p.image_nr = q.image_nr AND p.k < q.k),
near_ AS (SELECT image_nr, i, j FROM between_ WHERE greatest({_DOTS}) >= {_LEAST}),
earlier AS MATERIALIZED (SELECT image_nr, k, coalesce(js, []) AS js FROM rows_ LEFT JOIN (SELECT image_nr, j AS k, list(i) AS js FROM near_ GROUP BY 1, 2) USING (image_nr, k)),
walk AS (SELECT image_nr, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS leads FROM (SELECT DISTINCT image_nr FROM rows_)
  UNION ALL SELECT w.image_nr, e.k, CASE WHEN list_has_any(w.leads, e.js) THEN w.leads ELSE list_append(w.leads, e.k) END FROM walk w JOIN earlier e ON e.image_nr = w.image_nr AND e.k = w.k + 1),
leads AS (SELECT image_nr, unnest(leads) AS k FROM (SELECT image_nr, leads, row_number() OVER (PARTITION BY image_nr ORDER BY k DESC) AS n FROM walk) WHERE n = 1),
owned AS (SELECT image_nr, k, k AS leader FROM leads UNION ALL SELECT n.image_nr, n.j, min(n.i) FROM near_ n JOIN leads l ON l.image_nr = n.image_nr AND l.k = n.i
  WHERE NOT EXISTS (SELECT 1 FROM leads m WHERE m.image_nr = n.image_nr AND m.k = n.j) GROUP BY 1, 2),
ranked AS (SELECT image_nr, leader, row_nr, n_spots, total, score, count(*) OVER (PARTITION BY image_nr, leader) AS n_solutions,
  row_number() OVER (PARTITION BY image_nr, leader ORDER BY score DESC, k) AS n FROM owned JOIN rows_ USING (image_nr, k))
SELECT image_nr, row_number() OVER (PARTITION BY image_nr ORDER BY leader) AS grain_nr, n_solutions, row_nr, n_spots, round(total, 4) AS total, round(score, 4) AS score FROM ranked WHERE n = 1"""


@query("merge_leaders", _MERGE)
def merge_leaders(spark, sf_dir):
    """All coarse matches of each frame, merged."""
    fold = _folded_grid(spark, sf_dir)
    found = merge.merge(_coarse(spark, sf_dir, grid=fold), fold, max_angle_deg=5.0)
    return found.withColumns({c: F.round(c, 4) for c in ("total", "score")})


_ROOT = _d(1 / math.sqrt(2))
_AXIS_STEPS = f"""s AS (SELECT *, list_sort([abs(d0), abs(d1), abs(d2), abs(d3)]) AS z, {_ANGLE} AS angle FROM pairs),
w AS (SELECT *, z[4] AS k1, (z[4] + z[3]) * {_ROOT} AS k2, (z[4] + z[3] + z[2] + z[1]) / 2e0 AS k3 FROM s),
x AS (SELECT *, list_sort(CASE WHEN k1 >= k2 AND k1 >= k3 THEN [z[3], z[2], z[1]]
   WHEN k2 >= k3 THEN [abs(z[4] - z[3]) * {_ROOT}, abs(z[2] + z[1]) * {_ROOT}, abs(z[2] - z[1]) * {_ROOT}]
   ELSE [abs(z[4] - z[3] + z[2] - z[1]) / 2e0, abs(z[4] + z[3] - z[2] - z[1]) / 2e0, abs(z[4] - z[3] - z[2] + z[1]) / 2e0] END) AS v FROM w),
y AS (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS n FROM x)"""
_AXIS = f"{_PAIRS}, {_AXIS_STEPS}"


@query("disorientation_axes", f"{_AXIS} SELECT image_nr, a, b, round(v[1] / n, 4) AS x0, round(v[2] / n, 4) AS x1, round(v[3] / n, 4) AS x2 FROM y")
def disorientation_axes(spark, sf_dir):
    return _pairs(spark, sf_dir, angle=False, digits=4).select("image_nr", "a", "b", "x0", "x1", "x2")


_CSL_SQL = " OR ".join(
    f"(abs(angle - {_d(at)}) < 1e1 AND sqrt({' + '.join(f'(v[{i + 1}] / n - {_d(ref[i])}) * (v[{i + 1}] / n - {_d(ref[i])})' for i in range(3))}) < 8e-2)"
    for at, ref in ((60.0, (0.57735,) * 3), (38.94, (0.0, 0.70711, 0.70711)), (50.48, (0.0, 0.70711, 0.70711)))
)


@query("csl_pairs", f"{_AXIS} SELECT image_nr, a, b, {_CSL_SQL} AS related FROM y")
def csl_pairs(spark, sf_dir):
    axis = F.when(F.col("x0").isNotNull(), F.array("x0", "x1", "x2"))
    return _pairs(spark, sf_dir).select("image_nr", "a", "b", G.csl_related(F.col("angle_deg"), axis, (3, 9, 11), 10.0).alias("related"))


_IMAGES = [_PROD([f"q{i}" for i in range(4)], [_d(x) for x in s]) for s in _SYM]


@query("fundamental_region", f"WITH {_QUAT} SELECT vec_id, round(greatest({', '.join(f'abs({p[0]})' for p in _IMAGES)}), 6) AS w FROM quat")
def fundamental_region(spark, sf_dir):
    return D.quaternions(spark, sf_dir).select("vec_id", F.round(G.fundamental(G.elements("q", 4), 225)[0], 6).alias("w"))


_ANG = lambda s, c: f"CASE WHEN {s} >= 0 THEN acos(greatest(-1e0, least(1e0, {c}))) ELSE {_d(2 * math.pi)} - acos(greatest(-1e0, least(1e0, {c}))) END"


@query(
    "euler_from_matrix",
    f"""WITH {_ORIENT}, f AS (SELECT *, abs(m8 - 1e0) < 1e-12 AS flat, CASE WHEN abs(m8 - 1e0) < 1e-12 THEN 0e0 ELSE acos(greatest(-1e0, least(1e0, m8))) END AS phi FROM orient),
    g AS (SELECT *, abs(sin(phi)) < 1e-12 AS deg, CASE WHEN abs(sin(phi)) < 1e-12 THEN 1e0 ELSE sin(phi) END AS s FROM f)
    SELECT row_nr, round(CASE WHEN deg THEN 0e0 ELSE {_ANG("m2 / s", "-m5 / s")} END, 6) AS psi, round(phi, 6) AS phi,
      round(CASE WHEN deg THEN {_ANG("(CASE WHEN flat THEN m3 ELSE -m3 END)", "m0")} ELSE {_ANG("m6 / s", "m7 / s")} END, 6) AS theta FROM g""",
)
def euler_from_matrix(spark, sf_dir):
    angles = G.matrix_to_euler(G.elements("om", 9))
    return D.orientations(spark, sf_dir).select("row_nr", *[F.round(a, 6).alias(n) for a, n in zip(angles, ("psi", "phi", "theta"), strict=True)])


@query("euler_to_matrix", f"WITH {_ORIENT} SELECT row_nr, {', '.join(f'round(m{i}, 4) + 0e0 AS m{i}' for i in range(9))} FROM orient")
def euler_to_matrix(spark, sf_dir):
    angles = D.orientations(spark, sf_dir).select("row_nr", F.array(*G.matrix_to_euler(G.elements("om", 9))).alias("e"))
    back = angles.select("row_nr", F.array(*G.euler_to_matrix(*G.elements("e", 3))).alias("om"))
    return back.select("row_nr", *[(F.round(F.col("om")[i], 4) + 0.0).alias(f"m{i}") for i in range(9)])


_RT = [_d(x) for x in D.DETECTOR.rotation().reshape(-1)]
_INVERSE = f"""WITH t AS (SELECT o_orderkey AS spot_row, (o_orderkey * 53 % 640) / 10e0 AS px, (o_custkey * 71 % 640) / 10e0 AS py FROM orders),
x AS (SELECT *, (px - {_HALF}) * {_d(D.DETECTOR.px_x)} + {_P[0]} AS x, (py - {_HALF}) * {_d(D.DETECTOR.px_y)} + {_P[1]} AS y, {_P[2]} AS z FROM t),
k AS (SELECT *, {", ".join(f"x * {_RT[3 * i]} + y * {_RT[3 * i + 1]} + z * {_RT[3 * i + 2]} AS k{i}" for i in range(3))} FROM x),
n AS (SELECT *, sqrt(k0 * k0 + k1 * k1 + k2 * k2) AS len FROM k),
q AS (SELECT *, k0 / len AS a0, k1 / len AS a1, k2 / len - 1e0 AS a2 FROM n),
u AS (SELECT spot_row, a0 / sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS g0, a1 / sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS g1, a2 / sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS g2 FROM q)"""


@query("pixel_inverse", f"{_INVERSE} SELECT spot_row, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2 FROM u")
def pixel_inverse(spark, sf_dir):
    g = G.pixel_to_qhat(F.col("px"), F.col("py"), D.DETECTOR)
    return D.peak_spots(spark, sf_dir).select("spot_row", *[F.round(x, 6).alias(f"g{i}") for i, x in enumerate(g)])


@query("angular_error", f"{_INVERSE} SELECT spot_row, round(degrees(acos(greatest(-1e0, least(1e0, (g0 * 6e-1 + g1 * 0e0 + g2 * -8e-1) / (sqrt(g0 * g0 + g1 * g1 + g2 * g2) * 1e0))))), 6) AS err_deg FROM u")
def angular_error(spark, sf_dir):
    g = D.peak_spots(spark, sf_dir).select("spot_row", F.array(*G.pixel_to_qhat(F.col("px"), F.col("py"), D.DETECTOR)).alias("g"))
    err = G.angle_deg(G.elements("g", 3), [F.lit(0.6), F.lit(0.0), F.lit(-0.8)])
    return g.select("spot_row", F.round(err, 6).alias("err_deg"))


# Evidence

_EVIDENCE = f"WITH {_SOLUTIONS}, {_SPOTS}, {_LABELS}, {_CLAIMS}"


def _claims(spark, sf_dir):
    return claims.unique_claims(D.solutions(spark, sf_dir), D.spots(spark, sf_dir), D.labels(spark, sf_dir))


@query("unique_claims", f"{_EVIDENCE} SELECT * FROM claims")
def unique_claims(spark, sf_dir):
    return _claims(spark, sf_dir)


@query("filter_legacy", f"{_EVIDENCE} SELECT s.* FROM solutions s JOIN claims USING (image_nr, grain_nr) WHERE n_unique_labels >= 1")
def filter_legacy(spark, sf_dir):
    return claims.keep_by_labels(D.solutions(spark, sf_dir), _claims(spark, sf_dir), 1).drop("om")


@query("kept_spots", f"{_EVIDENCE} SELECT s.* FROM spots s WHERE grain_nr IN (SELECT grain_nr FROM claims WHERE n_unique_labels >= 1)")
def kept_spots(spark, sf_dir):
    return claims.kept_spots(D.spots(spark, sf_dir), claims.keep_by_labels(D.solutions(spark, sf_dir), _claims(spark, sf_dir), 1))


_ORDER_QUAT = "oq AS (SELECT grain_nr, " + ", ".join(f"{e} / sqrt(CAST(a * a + b * b + c * c + d * d AS DOUBLE)) AS q{i}" for i, e in enumerate("abcd")) + (
    " FROM (SELECT o_orderkey AS grain_nr, 1 + o_orderkey % 7 AS a, o_custkey % 11 AS b, (o_orderkey // 7) % 13 AS c, (o_custkey * 3 + o_orderkey) % 5 AS d FROM orders))"
)
_SIGMA3 = f"abs(angle - 6e1) < 3e0 AND n > 0 AND sqrt({' + '.join(f'(v[{i + 1}] / n - {_d(0.57735)}) * (v[{i + 1}] / n - {_d(0.57735)})' for i in range(3))}) < 8e-2"
_ROBUST = f"""{_EVIDENCE.replace("WITH solutions", "WITH RECURSIVE solutions", 1).replace("claims AS (", "claims AS MATERIALIZED (")}, {_ORDER_QUAT},
rows_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_nr ORDER BY quality DESC, source_row DESC) AS k, CASE WHEN n_unique <> 0 THEN n_unique ELSE n_matches END >= 2 AS enough
  FROM solutions JOIN claims USING (image_nr, grain_nr) JOIN oq USING (grain_nr)),
pairs AS MATERIALIZED (SELECT p.image_nr, p.k AS i, q.k AS j, {', '.join(f'{e} AS d{n}' for n, e in enumerate(_BETWEEN))} FROM rows_ p JOIN rows_ q ON p.image_nr = q.image_nr AND p.k < q.k AND p.enough AND q.enough),
{_AXIS_STEPS},
told AS MATERIALIZED (SELECT image_nr, j AS k, list(i) FILTER (angle < 5e0) AS near_, list(i) FILTER ({_SIGMA3}) AS twins FROM y GROUP BY 1, 2),
listed AS MATERIALIZED (SELECT r.image_nr, r.k, enough, n_unique_labels >= 1 AS strong, coalesce(near_, []) AS near_, coalesce(twins, []) AS twins FROM rows_ r LEFT JOIN told USING (image_nr, k)),
walk AS (SELECT image_nr, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_nr FROM rows_)
  UNION ALL SELECT w.image_nr, e.k, CASE WHEN e.enough AND NOT list_has_any(w.kept, e.near_) AND (e.strong OR len(w.kept) = 0 OR list_has_any(w.kept, e.twins)) THEN list_append(w.kept, e.k) ELSE w.kept END
  FROM walk w JOIN listed e ON e.image_nr = w.image_nr AND e.k = w.k + 1),
kept AS (SELECT image_nr, unnest(kept) AS k FROM (SELECT image_nr, kept, row_number() OVER (PARTITION BY image_nr ORDER BY k DESC) AS n FROM walk) WHERE n = 1)
SELECT image_nr, grain_nr, quality, source_row, n_matches, n_unique, n_unique_labels FROM rows_ JOIN kept USING (image_nr, k)"""


@query("filter_robust", _ROBUST)
def filter_robust(spark, sf_dir):
    return claims.keep_robust(D.solutions(spark, sf_dir), _claims(spark, sf_dir), min_unique=1, min_total=2).drop("om")


@query("top_by_quality", f"WITH {_SOLUTIONS} SELECT * FROM (SELECT image_nr, grain_nr, quality, row_number() OVER (PARTITION BY image_nr ORDER BY quality DESC, source_row DESC) AS rank FROM solutions) WHERE rank <= 5")
def top_by_quality(spark, sf_dir):
    return claims.by_quality(D.solutions(spark, sf_dir), 5).select("image_nr", "grain_nr", "quality", "rank")


@query("fallback_labels", f"WITH {_SPOTS} SELECT image_nr, x, y, row_number() OVER (PARTITION BY image_nr ORDER BY first_row, x, y) AS label FROM (SELECT image_nr, x, y, min(spot_row) AS first_row FROM spots GROUP BY 1, 2, 3)")
def fallback_labels(spark, sf_dir):
    return relations.fallback_labels(D.spots(spark, sf_dir))


# Joins and summaries


@query("split_by_image", f"WITH {_SOLUTIONS}, {_SPOTS} SELECT s.grain_nr, s.quality, p.image_nr FROM solutions s JOIN (SELECT DISTINCT image_nr, grain_nr FROM spots) p USING (grain_nr)")
def split_by_image(spark, sf_dir):
    return relations.split_by_image(D.solutions(spark, sf_dir).select("grain_nr", "quality"), D.spots(spark, sf_dir))


@query("image_ids", f"WITH {_SOLUTIONS}, {_SPOTS} SELECT image_nr FROM spots UNION SELECT image_nr FROM solutions")
def image_ids(spark, sf_dir):
    return relations.image_ids(D.spots(spark, sf_dir), D.solutions(spark, sf_dir))


@query("frame_cogroup", f"WITH {_SOLUTIONS}, {_SPOTS} SELECT image_nr, coalesce(a, 0) AS n_solutions, coalesce(b, 0) AS n_spots FROM (SELECT image_nr + 1 AS image_nr, count(*) AS a FROM solutions GROUP BY 1) FULL JOIN (SELECT image_nr, count(*) AS b FROM spots GROUP BY 1) USING (image_nr)")
def frame_cogroup(spark, sf_dir):
    later = D.solutions(spark, sf_dir).withColumn("image_nr", F.col("image_nr") + 1)  # so each side lacks a frame
    return relations.per_frame(later, D.spots(spark, sf_dir))


@query("spots_of_grains", f"WITH {_SOLUTIONS}, {_SPOTS} SELECT s.image_nr, s.grain_nr, s.spot_row, s.x, s.y, o.quality FROM spots s JOIN solutions o USING (image_nr, grain_nr)")
def spots_of_grains(spark, sf_dir):
    return relations.spots_of_grains(D.solutions(spark, sf_dir), D.spots(spark, sf_dir))


@query("label_spots", f"WITH {_SPOTS}, {_LABELS} SELECT s.image_nr, s.grain_nr, s.spot_row, s.x, s.y, g.label FROM (SELECT image_nr, grain_nr, spot_row, x + 14 AS x, y FROM spots) s LEFT JOIN seg g USING (image_nr, x, y)")
def label_spots(spark, sf_dir):
    moved = D.spots(spark, sf_dir).withColumn("x", F.col("x") + 14)  # some lie outside the frame
    return relations.label_spots(moved, D.labels(spark, sf_dir))


_PEAKS = f"peaks AS (SELECT p_partkey % {_NF} AS image_nr, p_partkey AS label, (p_partkey * 37 % 640) / 10e0 AS cx, (p_partkey * 91 % 640) / 10e0 AS cy FROM part)"
_ASKED = f"asked AS (SELECT o_orderkey % {_NF} AS image_nr, o_orderkey AS spot_row, (o_orderkey * 53 % 640) / 10e0 AS px, (o_custkey * 71 % 640) / 10e0 AS py FROM orders)"


@query("nearest_peak", f"""WITH {_PEAKS}, {_ASKED}, d AS (SELECT image_nr, spot_row, label, (px - cx) * (px - cx) + (py - cy) * (py - cy) AS d2 FROM asked JOIN peaks USING (image_nr)),
  b AS (SELECT image_nr, spot_row, label, row_number() OVER (PARTITION BY image_nr, spot_row ORDER BY d2, label) AS n FROM d WHERE d2 <= 25)
  SELECT image_nr, spot_row, coalesce(label - 1, -1) AS peak_index FROM asked LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (image_nr, spot_row)""")
def nearest_peak(spark, sf_dir):
    return relations.nearest_peak(D.peak_spots(spark, sf_dir), D.peaks(spark, sf_dir))


@query("gaussian_sigma", f"""WITH {_PEAKS}, s AS (SELECT a.image_nr, sqrt(min((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS spacing FROM peaks a JOIN peaks b ON a.image_nr = b.image_nr AND a.label <> b.label GROUP BY 1)
  SELECT image_nr, round(CASE WHEN spacing IS NULL THEN 3e0 ELSE greatest(1e0, 25e-2 * least(spacing, {_d(2500 * math.tan(math.radians(0.4)))})) END, 6) AS sigma FROM (SELECT DISTINCT image_nr FROM peaks) LEFT JOIN s USING (image_nr)""")
def gaussian_sigma(spark, sf_dir):
    spacing = relations.nearest_spacing(D.peaks(spark, sf_dir), 128.0)
    return imaging.smoothing_width(spacing, 2500.0, 0.4).select("image_nr", F.round("sigma", 6).alias("sigma"))


_SIM = "sim AS (SELECT c_custkey % 50 AS grain_nr, c_custkey AS sim_row, (c_custkey * 17 % 128) / 2e0 AS x, (c_custkey * 29 % 128) / 2e0 AS y FROM customer), one AS (SELECT * FROM (SELECT *, CAST(round_even(x, 0) AS INTEGER) AS rx, CAST(round_even(y, 0) AS INTEGER) AS ry, row_number() OVER (PARTITION BY grain_nr, round_even(x, 0), round_even(y, 0) ORDER BY sim_row) AS n FROM sim) WHERE n = 1)"


@query("distinct_simulated", f"WITH {_SIM} SELECT grain_nr, sim_row, x, y, rx, ry FROM one")
def distinct_simulated(spark, sf_dir):
    return relations.distinct_simulated(D.simulated(spark, sf_dir))


@query("missing_sim_spots", f"WITH {_SIM}, {_SPOTS} SELECT grain_nr, sim_row, x, y, rx, ry FROM one WHERE NOT EXISTS (SELECT 1 FROM spots s WHERE s.grain_nr = one.grain_nr AND (rx - s.x) * (rx - s.x) + (ry - s.y) * (ry - s.y) < 4)")
def missing_sim_spots(spark, sf_dir):
    return relations.missing_simulated(D.simulated(spark, sf_dir), D.spots(spark, sf_dir))


@query("quality_map", f"{_EVIDENCE} SELECT image_nr, x, y, max(quality * (1 + 1e-1 * n_unique_labels)) AS best FROM spots JOIN solutions USING (image_nr, grain_nr) JOIN claims USING (image_nr, grain_nr) GROUP BY 1, 2, 3")
def quality_map(spark, sf_dir):
    return relations.quality_map(D.solutions(spark, sf_dir), D.spots(spark, sf_dir), _claims(spark, sf_dir))


@query("report_counts", f"WITH {_SPOTS}, g AS (SELECT count(*) AS n FROM spots GROUP BY image_nr, grain_nr) SELECT count(*) AS n_grains, CAST(sum(n) AS BIGINT) AS n_spots, round(sum(n) / count(*), 6) AS mean_spots FROM g")
def report_counts(spark, sf_dir):
    return relations.report(D.spots(spark, sf_dir)).withColumn("mean_spots", F.round("mean_spots", 6))


@query("unique_spot_counts", f"WITH {_SPOTS} SELECT image_nr, grain_nr, count(DISTINCT (x, y)) AS n_places FROM spots GROUP BY 1, 2")
def unique_spot_counts(spark, sf_dir):
    return relations.distinct_places(D.spots(spark, sf_dir))


@query("image_summary", f"{_EVIDENCE}, f AS (SELECT image_nr, count(*) AS n_filtered FROM claims WHERE n_unique_labels >= 1 GROUP BY 1) SELECT image_nr, coalesce(n_orient, 0) AS n_orient, coalesce(n_filtered, 0) AS n_filtered, coalesce(n_spots, 0) AS n_spots FROM (SELECT image_nr, count(*) AS n_orient FROM solutions GROUP BY 1) FULL JOIN f USING (image_nr) FULL JOIN (SELECT image_nr, count(*) AS n_spots FROM spots GROUP BY 1) USING (image_nr)")
def image_summary(spark, sf_dir):
    kept = claims.keep_by_labels(D.solutions(spark, sf_dir), _claims(spark, sf_dir), 1)
    return relations.image_summary(D.solutions(spark, sf_dir), kept, D.spots(spark, sf_dir))


@query("batch_summary", "SELECT count(*) FILTER (value >= 20) AS n_ok, count(*) FILTER (NOT value >= 20) AS n_failed, round(avg(CASE WHEN value >= 20 THEN value END), 4) AS mean_seconds FROM events")
def batch_summary(spark, sf_dir):
    results = D.table(spark, sf_dir, "events").selectExpr("value >= 20 as ok", "value as seconds")
    return relations.batch_summary(results).withColumn("mean_seconds", F.round("mean_seconds", 4))


@query("progress", "SELECT count(*) AS n_done, count(*) FILTER (value < 20) AS n_skipped, round(count(*) / 5e1, 6) AS per_second, round((1e6 - count(*)) / (count(*) / 5e1), 4) AS seconds_left FROM events")
def progress(spark, sf_dir):
    done = relations.progress(D.mapping(spark, sf_dir), 1_000_000, 50.0)
    return done.select("n_done", "n_skipped", F.round("per_second", 6).alias("per_second"), F.round("seconds_left", 4).alias("seconds_left"))


@query("rms_error", f"WITH {_SPOTS}, {_SOLUTIONS}, e AS (SELECT image_nr, grain_nr, sqrt(CAST(sum(CASE WHEN x < 32 THEN CAST(((x + y) / 1e2) * ((x + y) / 1e2) AS DECIMAL(28,10)) END) AS DOUBLE) / count(CASE WHEN x < 32 THEN 1 END)) AS rms FROM spots GROUP BY 1, 2) SELECT image_nr, grain_nr, round(coalesce(rms, quality / 1e4), 6) AS rms FROM solutions LEFT JOIN e USING (image_nr, grain_nr)")
def rms_error(spark, sf_dir):
    spots = D.spots(spark, sf_dir).withColumn("err_deg", F.when(F.col("x") < 32, (F.col("x") + F.col("y")) / 100.0))  # the others' errors are unknown
    solutions = D.solutions(spark, sf_dir).withColumn("misorientation_deg", F.col("quality") / 1e4)
    return relations.rms_error(spots, solutions).withColumn("rms", F.round("rms", 6))


_BITS = ["corner & 1", "(corner >> 1) & 1", "(corner >> 2) & 1"]


@query("cell_corners", f"WITH {_ORIENT} SELECT row_nr % {_NF} AS image_nr, row_nr AS grain_nr, corner, " + ", ".join(f"round({' + '.join(f'({_BITS[b]}) * 2e-1 * m{3 * b + i}' for b in range(3))}, 6) + 0e0 AS {n}" for i, n in enumerate("xyz")) + " FROM orient, (SELECT CAST(c AS INTEGER) AS corner FROM range(8) t(c))")
def cell_corners(spark, sf_dir):
    corners = relations.cell_corners(D.solutions(spark, sf_dir))
    return corners.select("image_nr", "grain_nr", "corner", *[(F.round(n, 6) + 0.0).alias(n) for n in "xyz"])


# Images


def _threshold(name: str, sql: str, build) -> None:
    query(f"threshold_{name}", sql)(lambda spark, sf_dir: build(D.pixels(spark, sf_dir)).select("image_nr", F.round("threshold", 6).alias("threshold")))


_threshold("mad", f"WITH {_PIXELS}, m AS (SELECT image_nr, median(v) AS med FROM pixels WHERE v > 0 GROUP BY 1) SELECT image_nr, round(greatest(max(med) + 4e0 * 1.4826e0 * median(abs(v - med)), 1e0), 6) AS threshold FROM pixels JOIN m USING (image_nr) WHERE v > 0 GROUP BY 1", imaging.noise_floor)
_threshold("fixed", f"WITH {_PIXELS} SELECT DISTINCT image_nr, 24e1 AS threshold FROM pixels", lambda p: imaging.fixed(p, 240))
_threshold("std", f"WITH {_PIXELS}, s AS (SELECT image_nr, sum(v) AS s, sum(v * v) AS s2 FROM pixels GROUP BY 1) SELECT image_nr, 6e1 * (1 + floor(sqrt(greatest(s2 / {N_PIXELS} - (s / {N_PIXELS}) * (s / {N_PIXELS}), 0e0)) / 60)) AS threshold FROM s", lambda p: imaging.deviation(p, N_PIXELS))
_DENSE = f"{_PIXELS}, dense AS (SELECT f.image_nr, t.pix, coalesce(p.v, 0e0) AS v FROM (SELECT DISTINCT image_nr FROM pixels) f CROSS JOIN range({N_PIXELS}) t(pix) LEFT JOIN pixels p ON p.image_nr = f.image_nr AND p.pix = t.pix)"
_threshold("percentile", f"WITH {_DENSE} SELECT image_nr, round(quantile_cont(v, 0.95), 6) AS threshold FROM dense GROUP BY 1", lambda p: imaging.percentile(p, 95.0, N_PIXELS))
_threshold(
    "otsu",
    f"""WITH {_DENSE}, t AS (SELECT image_nr, max(v) AS top FROM dense GROUP BY 1),
    h AS (SELECT image_nr, top, CAST(least(floor(v / top * 256), 255) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS c FROM dense JOIN t USING (image_nr) GROUP BY 1, 2, 3),
    g AS (SELECT image_nr, bin, c, (bin + 5e-1) * top / 256 AS mid FROM h),
    w AS (SELECT image_nr, bin, mid, sum(c) OVER u AS w1, sum(c * mid) OVER u AS m1, sum(c) OVER a AS w, sum(c * mid) OVER a AS m FROM g
      WINDOW u AS (PARTITION BY image_nr ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_nr)),
    b AS (SELECT image_nr, bin, mid, CASE WHEN w > w1 THEN w1 * (w - w1) * pow(m1 / w1 - (m - m1) / (w - w1), 2) ELSE -1 END AS between_ FROM w)
    SELECT image_nr, round(mid, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_nr ORDER BY between_ DESC, bin) AS n FROM b) WHERE n = 1""",
    lambda p: imaging.otsu(p, N_PIXELS),
)


@query("above_threshold", f"WITH {_PIXELS} SELECT image_nr, pix, floor(v) % 65536e0 AS v FROM pixels WHERE v > 30000.5 AND floor(v) % 65536e0 > 0")
def above_threshold(spark, sf_dir):
    return imaging.above(D.pixels(spark, sf_dir), imaging.fixed(D.pixels(spark, sf_dir), 30000.5))


@query("quantised_pixels", f"WITH {_PIXELS}, t AS (SELECT image_nr, max(v) AS top FROM pixels GROUP BY 1) SELECT image_nr, pix, CAST(greatest(floor(v * 255 / top), 1) AS INTEGER) AS level FROM pixels JOIN t USING (image_nr) WHERE v > 0")
def quantised_pixels(spark, sf_dir):
    return imaging.quantised(D.pixels(spark, sf_dir))


@query("log_pixels", f"WITH {_PIXELS} SELECT image_nr, pix, round(ln(CASE WHEN v <= 3e4 THEN 1e0 ELSE v - 3e4 END), 6) AS v FROM pixels")
def log_pixels(spark, sf_dir):
    return imaging.log_image(D.pixels(spark, sf_dir).withColumn("v", F.col("v") - 30000.0)).withColumn("v", F.round("v", 6))


_SEG_PIX = f"{_LABELS}, lab AS (SELECT image_nr, y * {D.SIZE} + x AS pix, label FROM seg WHERE label > 0)"


def _labelled(spark, sf_dir):
    return D.labels(spark, sf_dir).where("label > 0").selectExpr("image_nr", f"y * {D.SIZE} + x as pix", "label")


@query("component_stats", f"WITH {_SEG_PIX} SELECT image_nr, label, count(*) AS area, min(pix % {D.SIZE}) AS x, min(pix // {D.SIZE}) AS y, max(pix % {D.SIZE}) - min(pix % {D.SIZE}) + 1 AS w, max(pix // {D.SIZE}) - min(pix // {D.SIZE}) + 1 AS h FROM lab GROUP BY 1, 2")
def component_stats(spark, sf_dir):
    return imaging.region_stats(_labelled(spark, sf_dir), D.SIZE)


_CENTRES = f"cen AS (SELECT image_nr, label, CAST(sum((pix % {D.SIZE}) * CAST(v AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) AS cx, CAST(sum((pix // {D.SIZE}) * CAST(v AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) AS cy, count(*) AS area FROM lab JOIN pixels USING (image_nr, pix) GROUP BY 1, 2 HAVING count(*) >= 4)"


@query("centre_of_mass", f"WITH {_SEG_PIX}, {_PIXELS}, {_CENTRES} SELECT image_nr, label, round(cx, 6) AS cx, round(cy, 6) AS cy, area FROM cen")
def centre_of_mass(spark, sf_dir):
    found = imaging.centres(_labelled(spark, sf_dir), D.pixels(spark, sf_dir), D.SIZE, min_area=4)
    return found.select("image_nr", "label", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "area")


@query("small_components_removed", f"WITH {_SEG_PIX}, {_PIXELS}, {_CENTRES} SELECT l.* FROM lab l SEMI JOIN cen USING (image_nr, label)")
def small_components_removed(spark, sf_dir):
    labels = _labelled(spark, sf_dir)
    return imaging.keep_regions(labels, imaging.centres(labels, D.pixels(spark, sf_dir), D.SIZE, min_area=4))


@query(
    "connected_components",
    f"""WITH RECURSIVE {_PIXELS}, lit AS (SELECT image_nr, pix FROM pixels),
    near AS (SELECT a.image_nr, a.pix, b.pix AS other FROM lit a JOIN lit b ON a.image_nr = b.image_nr AND abs(a.pix % {D.SIZE} - b.pix % {D.SIZE}) <= 1 AND abs(a.pix // {D.SIZE} - b.pix // {D.SIZE}) <= 1),
    reach AS (SELECT image_nr, pix, pix AS root FROM lit UNION SELECT n.image_nr, n.other, r.root FROM reach r JOIN near n ON n.image_nr = r.image_nr AND n.pix = r.pix)
    SELECT image_nr, pix, CAST(dense_rank() OVER (PARTITION BY image_nr ORDER BY root) AS INTEGER) AS label FROM (SELECT image_nr, pix, min(root) AS root FROM reach GROUP BY 1, 2)""",
)
def connected_components(spark, sf_dir):
    return imaging.components(D.pixels(spark, sf_dir), D.SIZE)


@query("preprocess_frames")
def preprocess_frames(spark, sf_dir):
    return imaging.preprocess(D.pixels(spark, sf_dir), D.SIZE, D.SIZE, thresholds=imaging.fixed(D.pixels(spark, sf_dir), 20000.0), min_area=2)["centres"]


_FLOOR = f"floor_ AS (SELECT g.image_nr, g.x, g.y, CAST(1 + (g.x * 7 + g.y * 11 + g.image_nr) % 50 AS DOUBLE) + coalesce(floor(p.v / 1000), 0) AS v FROM seg g LEFT JOIN pixels p ON p.image_nr = g.image_nr AND p.pix = g.y * {D.SIZE} + g.x)"
_BACK = lambda c: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {D.SIZE} THEN {2 * D.SIZE - 1} - ({c}) ELSE {c} END"  # noqa: E731  edges reflected


@query("background_median", f"""WITH {_PIXELS}, {_LABELS}, {_FLOOR}, o AS (SELECT CAST(i AS BIGINT) AS i FROM range(-2, 3) t(i)),
  near AS (SELECT f.image_nr, f.x, f.y, {_BACK("f.x + a.i")} AS nx, {_BACK("f.y + b.i")} AS ny FROM floor_ f, o a, o b)
  SELECT n.image_nr, n.y * {D.SIZE} + n.x AS pix, median(f.v) AS v FROM near n JOIN floor_ f ON f.image_nr = n.image_nr AND f.x = n.nx AND f.y = n.ny GROUP BY 1, 2""")
def background_median(spark, sf_dir):
    return imaging.background_median(D.lit_background(spark, sf_dir), D.SIZE, D.SIZE, size=5)


@query("background_median_wide")
def background_median_wide(spark, sf_dir):
    """The production size; too many window rows for SQL, so tests hold it against the direct filter."""
    return imaging.background_median(D.lit_background(spark, sf_dir), D.SIZE, D.SIZE, size=101)


_STENCIL = "stencil AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i - len(kernels.weights(1.5)) // 2} AS BIGINT), {_d(w)})" for i, w in enumerate(kernels.weights(1.5))) + ") t(d, w))"


@query("gaussian_blur", f"""WITH {_PIXELS}, {_STENCIL}, start AS (SELECT image_nr, pix % {D.SIZE} AS x, pix // {D.SIZE} AS y, v FROM pixels),
  places AS (SELECT CAST(i AS BIGINT) AS i, d, w, {_BACK("CAST(i AS BIGINT) + d")} AS near_ FROM range({D.SIZE}) t(i), stencil),
  along AS (SELECT image_nr, y, i AS x, sum(v * w) AS v FROM start JOIN places ON near_ = x GROUP BY 1, 2, 3),
  both_ AS (SELECT image_nr, i AS y, a.x, sum(v * w) AS v FROM along a JOIN places ON near_ = a.y GROUP BY 1, 2, 3)
  SELECT image_nr, y * {D.SIZE} + x AS pix, round(v, 4) AS v FROM both_""")
def gaussian_blur(spark, sf_dir):
    return imaging.blur(D.pixels(spark, sf_dir), D.SIZE, D.SIZE, 1.5).withColumn("v", F.round("v", 4))


@query("contrast_pixels", f"""WITH {_PIXELS}, span AS (SELECT image_nr, CASE WHEN count(*) < {N_PIXELS} THEN least(min(v), 0e0) ELSE min(v) END AS low, max(v) AS high FROM pixels GROUP BY 1),
  r AS (SELECT image_nr, pix, v, low, high, pix // {D.SIZE} AS y, pix % {D.SIZE} AS x, CAST(least(floor((v - low) / (high - low) * 256), 255) AS BIGINT) AS bin FROM pixels JOIN span USING (image_nr) WHERE low < high),
  c AS (SELECT image_nr, y * 8 // {D.SIZE} AS ty, x * 8 // {D.SIZE} AS tx, bin, count(*) AS c FROM r GROUP BY 1, 2, 3, 4),
  n AS (SELECT image_nr, ty, tx, sum(c) AS n FROM c GROUP BY 1, 2, 3),
  g AS (SELECT image_nr, CAST(a AS BIGINT) AS ty, CAST(b AS BIGINT) AS tx, CAST(s AS BIGINT) AS bin, CAST(least(floor((0e0 - low) / (high - low) * 256), 255) AS BIGINT) AS zero FROM span, range(8) t(a), range(8) u(b), range(256) w(s) WHERE low < high),
  f AS (SELECT image_nr, ty, tx, bin, CAST(coalesce(c.c, 0) + CASE WHEN bin = zero THEN {N_PIXELS // 64} - coalesce(n.n, 0) ELSE 0 END AS DOUBLE) AS c FROM g LEFT JOIN c USING (image_nr, ty, tx, bin) LEFT JOIN n USING (image_nr, ty, tx)),
  cut AS (SELECT *, least(c, greatest(1e0, 3e-2 * {N_PIXELS // 64})) AS cut FROM f),
  even AS (SELECT *, cut + sum(c - cut) OVER (PARTITION BY image_nr, ty, tx) / 256 AS e FROM cut),
  shares AS (SELECT image_nr, ty, tx, bin, sum(e) OVER (PARTITION BY image_nr, ty, tx ORDER BY bin ROWS UNBOUNDED PRECEDING) / {N_PIXELS // 64} AS share FROM even),
  at_ AS (SELECT *, (y + 5e-1) * 8 / {D.SIZE} - 5e-1 AS fy, (x + 5e-1) * 8 / {D.SIZE} - 5e-1 AS fx FROM r),
  w AS (SELECT image_nr, pix, low, high, bin, CAST(greatest(0, least(7, floor(fy) + a)) AS BIGINT) AS ty, CAST(greatest(0, least(7, floor(fx) + b)) AS BIGINT) AS tx,
    CASE WHEN a = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE WHEN b = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS w FROM at_, range(2) t(a), range(2) u(b))
  SELECT image_nr, pix, round(low + sum(w * share) * (high - low) + 1e-6, 4) AS v FROM w JOIN shares USING (image_nr, ty, tx, bin) GROUP BY image_nr, pix, low, high
  UNION ALL SELECT image_nr, pix, round(v + 1e-6, 4) FROM pixels JOIN span USING (image_nr) WHERE low = high""")
def contrast_pixels(spark, sf_dir):
    # shares are multiples of small binary fractions, so many values end in a 5 just after the last digit: they are moved off it
    return kernels.equalise(D.pixels(spark, sf_dir), D.SIZE, D.SIZE).withColumn("v", F.round(F.col("v") + 1e-6, 4))


@query("enhanced_frames")
def enhanced_frames(spark, sf_dir):
    """Frames on a full background, denoised and sharpened."""
    return kernels.enhance(D.lit_background(spark, sf_dir), D.SIZE, D.SIZE, denoised=True, strength=0.1, edges=True)


@query("watershed_labels")
def watershed_labels(spark, sf_dir):
    pixels = D.pixels(spark, sf_dir)
    seeds = imaging.components(pixels.where("v > 60000"), D.SIZE)
    return imaging.split_touching(pixels, seeds, D.SIZE, D.SIZE)


@query("image_cleanup")
def image_cleanup(spark, sf_dir):
    pixels = D.pixels(spark, sf_dir)
    return imaging.cleanup(pixels, pixels.withColumn("v", F.lit(1000.0)), D.SIZE, N_PIXELS, min_area=2, max_area=50)


# Simulation, refinement, text and streams


@query("simulate_spots")
def simulate_spots(spark, sf_dir):
    from braggflow.operators import simulate

    return simulate.simulate(D.orientations(spark, sf_dir), D.hkls(spark), NICKEL, D.DETECTOR, skip_percent=20)


@query("refine_candidates")
def refine_candidates(spark, sf_dir):
    from braggflow.operators.refine import refine

    fold, pixels = _folded_grid(spark, sf_dir), D.pixels(spark, sf_dir)
    merged = merge.merge(_coarse(spark, sf_dir, 5, None, fold), fold)
    found, _ = refine(merged.join(fold.drop("copies"), "row_nr"), pixels, reflections.primitive(D.hkls(spark)), NICKEL, D.DETECTOR, min_spots=1)
    return found.select("image_nr", "grain_nr", "row_nr", "n_matches", "n_spots_calc", F.round("quality", 4).alias("quality"))


@query("hkl_primitive", f"SELECT p_partkey AS crystal, hkl_id, h, k, l, n2, CAST(h / g AS INTEGER) AS ph, CAST(k / g AS INTEGER) AS pk, CAST(l / g AS INTEGER) AS pl FROM (SELECT *, gcd(gcd(abs(h), abs(k)), abs(l)) AS g FROM ({_hkl_sql(D.H_MAX, _RULES['f'][2])})) JOIN part ON n2 <= p_size")
def hkl_primitive(spark, sf_dir):
    return D.within_limits(spark, sf_dir, reflections.primitive(D.hkls(spark)))


@query("orientation_grid")
def orientation_grid(spark, sf_dir):
    return orientations.uniform(spark, 10 * D.table(spark, sf_dir, "customer").count())


@query("frame_mapping_json", "SELECT event_id AS image_nr, concat('frame_', event_type, '.h5') AS file, CAST(user_id % 10 AS INTEGER) AS frame, value < 20 AS skipped, CAST(trunc(value) AS INTEGER) AS n_spots FROM events")
def frame_mapping_json(spark, sf_dir):
    from braggflow.sources import readers, writers

    lines = writers.mapping_json(D.mapping(spark, sf_dir))
    keyed = lines.select(F.concat(F.lit('{"'), "image_nr", F.lit('": '), "value", F.lit("}")).alias("value"))
    return readers.frame_mapping(keyed).drop("reason")


@query("spot_lines", f"WITH {_SPOTS} SELECT image_nr, grain_nr, spot_row AS spot_nr, concat_ws(chr(9), CAST(grain_nr AS VARCHAR), CAST(spot_row AS VARCHAR), '0', '0', '0', CAST(x AS VARCHAR), CAST(y AS VARCHAR), '0.0000000', '0.0000000', '0.0000000', '0.0000') AS value FROM spots")
def spot_lines(spark, sf_dir):
    from braggflow.sources import writers

    return writers.spot_lines(D.spots(spark, sf_dir).withColumnRenamed("spot_row", "spot_nr"))


@query("solution_lines", f"WITH {_SOLUTIONS} SELECT image_nr, grain_nr, concat_ws(chr(9), CAST(grain_nr AS VARCHAR), '0', '0.0000', '0.0000', printf('%.4f', quality), CAST(n_matches AS VARCHAR), '0', {', '.join(repr('0.0000000') for _ in range(24))}, '0.0000', '0.0000000', '0') AS value FROM solutions")
def solution_lines(spark, sf_dir):
    from braggflow.sources import writers

    return writers.solution_lines(D.solutions(spark, sf_dir).drop("om"))


@query("requery_results", f"""WITH {_SOLUTIONS}, {_SPOTS},
  firsts AS (SELECT image_nr, grain_nr, row_number() OVER (PARTITION BY image_nr, x, y ORDER BY o.quality DESC, grain_nr DESC) AS n FROM spots s JOIN solutions o USING (image_nr, grain_nr)),
  counted AS (SELECT image_nr, grain_nr, count(*) AS n_unique FROM firsts WHERE n = 1 GROUP BY 1, 2)
  SELECT image_nr, grain_nr, n_unique, round(quality, 4) AS quality, n_matches FROM solutions JOIN counted USING (image_nr, grain_nr) WHERE n_unique >= 2""")
def requery_results(spark, sf_dir):
    """Results are written as text, read back, and chosen from again, each place being a region of its own."""
    from braggflow.plans import requery
    from braggflow.sources import writers

    where = new_path(spark, "requery")
    best = D.solutions(spark, sf_dir).orderBy("grain_nr")
    writers.solution_lines(best, "stream").select("value").write.text(f"{where}/solutions", compression="lz4")
    writers.spot_lines(D.spots(spark, sf_dir).withColumnRenamed("spot_row", "spot_nr"), "stream").select("value").write.text(f"{where}/spots", compression="lz4")
    solutions, spots = requery.stored_results(spark, f"{where}/solutions", f"{where}/spots", "stream")
    kept, _, counted = requery.choose_again(solutions, spots, width=D.SIZE, height=D.SIZE, robust=False, min_unique=2)
    found = kept.join(counted.select("image_nr", "grain_nr", "n_unique"), ["image_nr", "grain_nr"])
    return found.select("image_nr", "grain_nr", "n_unique", F.round("quality", 4).alias("quality"), "n_matches")


@query("index_pattern_lines")
def index_pattern_lines(spark, sf_dir):
    from braggflow.sources import writers

    solutions = D.solutions(spark, sf_dir).withColumn("recip", F.transform("om", lambda v: v * NICKEL.reciprocal()[0][0])).withColumn("rms", F.lit(0.0))
    solutions = solutions.withColumn("euler", F.array(*G.euler_degrees(G.elements("om", 9))))
    spots = D.spots(spark, sf_dir).withColumn("spot_nr", F.col("spot_row"))
    spots = spots.withColumns({c: F.lit(0.0) for c in ("qx", "qy", "qz", "energy", "err_deg")} | {c: F.lit(1) for c in "hkl"} | {"intensity": F.col("x") * 1.0, "peak_index": F.lit(-1)})
    return writers.index_patterns(solutions, spots)


@query("legacy_names", "SELECT i + 1 AS image_nr, 'scan_' || lpad(CAST(7 + i AS VARCHAR), CAST(greatest(3, length(CAST(7 + i AS VARCHAR))) AS INTEGER), '0') || '.h5' AS file FROM range((SELECT count(*) FROM supplier)) t(i)")
def legacy_names(spark, sf_dir):
    from braggflow.sources import readers

    return readers.legacy_names(spark, "scan_007.h5", D.frames(spark, sf_dir))


@query("stream_frames", f"{_COARSE} SELECT image_nr, row_nr, n_spots, round(total, 4) AS total, round(score, 4) AS score FROM coarse")
def stream_frames(spark, sf_dir):
    """The coarse matches of a drained stream of landed frames; the same rows as the batch."""
    from braggflow.streaming import frames

    shared = new_path(spark, "stream")
    D.pixels(spark, sf_dir).repartition("image_nr").sortWithinPartitions("image_nr").write.parquet(f"{shared}/landing")
    fold = _folded_grid(spark, sf_dir)
    _grid_forward(spark, sf_dir, fold).write.parquet(f"{shared}/forward")  # simulated once, read by every batch
    stream = frames.match_stream(frames.landing(spark, f"{shared}/landing"), spark.read.parquet(f"{shared}/forward"), f"{shared}/out", f"{shared}/state", min_spots=2, available_now=True)
    stream.awaitTermination()
    found = spark.read.parquet(f"{shared}/out").drop("batch").withColumns({c: F.round(c, 4) for c in ("total", "score")})
    return orientations.unfolded(found, orientations.members(D.grid(spark, sf_dir), fold)).drop("om").select("image_nr", "row_nr", "n_spots", "total", "score")


@query("stored_orientations", f"WITH {_ORIENT} SELECT row_number() OVER (ORDER BY row_nr) - 1 AS row_nr, {', '.join(f'round(m{i}, 9) AS m{i}' for i in range(9))} FROM orient")
def stored_orientations(spark, sf_dir):
    """The orientations written as records, and read back in byte ranges."""
    from braggflow.sources import connectors

    connectors.register(spark)
    where = new_path(spark, "orientations")
    D.orientations(spark, sf_dir).orderBy("row_nr").select("om").write.format("laue_orientations").mode("append").save(where)
    found = spark.read.format("laue_orientations").option("splitbytes", 1 << 16).load(where)
    return found.select("row_nr", *[F.round(F.col("om")[i], 9).alias(f"m{i}") for i in range(9)])


def _land_frames(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """The pixels written as raw frames, a file each, and the stream that reads them."""
    from braggflow.sources import connectors

    connectors.register(spark)
    shape = {"width": D.SIZE, "height": D.SIZE}
    frames = D.pixels(spark, sf_dir).groupBy("image_nr").agg(F.collect_list("pix").alias("pix"), F.collect_list("v").alias("v"))
    frames.write.format("laue_frames").options(**shape).mode("append").save(f"{where}/landing")
    return spark.readStream.format("laue_frames").options(**shape, log=f"{where}/log", suffix=".raw").load(f"{where}/landing")


@query("landed_frames", f"WITH {_PIXELS} SELECT dense_rank() OVER (ORDER BY image_nr) AS image_nr, 'frame_' || lpad(CAST(image_nr AS VARCHAR), 10, '0') || '.raw' AS file, 'ok' AS status, pix, v FROM pixels")
def landed_frames(spark, sf_dir):
    """Raw frames that landed, drained as a stream."""
    where = new_path(spark, "landed")
    stream = _land_frames(spark, sf_dir, where).writeStream.format("parquet").option("checkpointLocation", f"{where}/state")
    stream.trigger(availableNow=True).start(f"{where}/out").awaitTermination()
    return spark.read.parquet(f"{where}/out")


#: Options of the whole run, as a stream and as a batch.
_RUN = {"min_spots": 4, "min_fit_spots": 2}


@query("index_stream")
def index_stream(spark, sf_dir):
    """The orientations that the whole run keeps, of a drained stream of landed frames: threshold, small regions, match, fit, choice."""
    from braggflow.streaming import frames

    where = new_path(spark, "index-stream")
    D.pixels(spark, sf_dir).repartition("image_nr").write.parquet(f"{where}/landing")
    fold = _folded_grid(spark, sf_dir)
    _grid_forward(spark, sf_dir, fold).write.parquet(f"{where}/forward")  # simulated once, read by every batch
    stream = frames.index_stream(
        frames.landing(spark, f"{where}/landing"), fold, D.hkls(spark), NICKEL, D.DETECTOR, spark.read.parquet(f"{where}/forward"), f"{where}/out", f"{where}/state",
        threshold=lambda p: imaging.fixed(p, 1000.0), available_now=True, **_RUN,
    )
    stream.awaitTermination()
    return _kept(spark.read.parquet(f"{where}/out/kept"))


def _kept(kept: DataFrame) -> DataFrame:
    return kept.select("image_nr", "row_nr", "n_solutions", "n_matches", "n_spots_calc", F.round("quality", 4).alias("quality"))
