"""Domain tables derived from the driver's star-schema tables, with arithmetic that any SQL engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braggflow.functions.crystal import NICKEL_DETECTOR, Detector
from braggflow.operators import reflections

SIZE = 64
DETECTOR = Detector(NICKEL_DETECTOR.p_array, NICKEL_DETECTOR.r_array, 0.0064, 0.0064, SIZE, SIZE)
H_MAX = 6
#: Crystals of a task, each with some hundred reflections.
CRYSTALS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> int:
    """Frames of a scan: one for each supplier, so that frames grow with the tables and stay sparse."""
    return table(spark, sf_dir, "supplier").count()


def _matrix(a: str, b: str, c: str, d: str):
    """Rotation matrix of an integer quaternion."""
    n = f"cast({a} * {a} + {b} * {b} + {c} * {c} + {d} * {d} as double)"
    parts = [
        f"{a} * {a} + {b} * {b} - {c} * {c} - {d} * {d}", f"2 * ({b} * {c} - {a} * {d})", f"2 * ({b} * {d} + {a} * {c})",
        f"2 * ({b} * {c} + {a} * {d})", f"{a} * {a} - {b} * {b} + {c} * {c} - {d} * {d}", f"2 * ({c} * {d} - {a} * {b})",
        f"2 * ({b} * {d} - {a} * {c})", f"2 * ({c} * {d} + {a} * {b})", f"{a} * {a} - {b} * {b} - {c} * {c} + {d} * {d}",
    ]
    return [f"({p}) / {n}" for p in parts]


def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as row_nr", "1 + o_orderkey % 7 as a", "o_custkey % 11 as b", "(o_orderkey div 7) % 13 as c", "(o_custkey * 3 + o_orderkey) % 5 as d"
    )
    return rows.select("row_nr", F.array(*[F.expr(e) for e in _matrix("a", "b", "c", "d")]).alias("om"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orientations that frames are matched with."""
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as row_nr", "1 + c_custkey % 7 as a", "c_custkey % 11 as b", "(c_custkey div 7) % 13 as c", "(c_nationkey * 3 + c_custkey) % 5 as d"
    )
    return rows.select("row_nr", F.array(*[F.expr(e) for e in _matrix("a", "b", "c", "d")]).alias("om"))


def hkls(spark: SparkSession) -> DataFrame:
    return reflections.generate(spark, H_MAX, "F")


def within_limits(spark: SparkSession, sf_dir: str, hkls: DataFrame) -> DataFrame:
    """The reflections of each crystal, a row of `part`, up to its own limit of h^2 + k^2 + l^2; numbers in the list stay.

    Crystals are dealt before they are multiplied, since a small file is one task, and meet the list of their limit, of which there are
    as many as values of n2 at most, by equality.
    """
    parts, most = table(spark, sf_dir, "part"), hkls.agg(F.max("n2")).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, parts.count() // CRYSTALS)
    crystals = parts.selectExpr("p_partkey as crystal", f"least(p_size, {most}) as most").repartition(tasks)
    lists = spark.range(1, most + 1).select(F.col("id").cast("int").alias("most")).join(F.broadcast(hkls), F.col("n2") <= F.col("most"))
    return crystals.join(F.broadcast(lists), "most").select("crystal", *hkls.columns)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"l_suppkey % {frames(spark, sf_dir)} as image_nr", f"(l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % {SIZE * SIZE} as pix", "l_extendedprice as v")
    return rows.groupBy("image_nr", "pix").agg(F.max("v").alias("v"))


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(f"o_orderkey % {frames(spark, sf_dir)} as image_nr", "o_orderkey as grain_nr", "o_totalprice as quality", "o_orderkey as source_row", "o_custkey % 20 as n_matches")
    return rows.join(orientations(spark, sf_dir), rows["grain_nr"] == F.col("row_nr")).drop("row_nr")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"l_orderkey % {frames(spark, sf_dir)} as image_nr", "l_orderkey as grain_nr", "l_orderkey * 8 + l_linenumber as spot_row",
        f"(l_partkey * 7 + l_linenumber) % {SIZE} as x", f"(l_suppkey * 13 + l_partkey) % {SIZE} as y",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = SIZE * SIZE
    cells = table(spark, sf_dir, "supplier").selectExpr(f"s_suppkey % {frames(spark, sf_dir)} as image_nr", f"explode(sequence(0, {n - 1})) as id")
    cells = cells.selectExpr("image_nr", f"id % {SIZE} as x", f"id div {SIZE} as y")
    return cells.selectExpr("image_nr", "x", "y", "case when (x * 3 + y * 5) % 7 < 3 then 1 + (x div 8) * 8 + y div 8 else 0 end as label")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        f"p_partkey % {frames(spark, sf_dir)} as image_nr", "p_partkey as label", "(p_partkey * 37 % 640) / 10e0 as cx", "(p_partkey * 91 % 640) / 10e0 as cy"
    )


def peak_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots at places of their own, a row each."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey % {frames(spark, sf_dir)} as image_nr", "o_orderkey as spot_row", "(o_orderkey * 53 % 640) / 10e0 as px", "(o_custkey * 71 % 640) / 10e0 as py"
    )


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey % 50 as grain_nr", "c_custkey as sim_row", "(c_custkey * 17 % 128) / 2e0 as x", "(c_custkey * 29 % 128) / 2e0 as y")


def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id % 25 as image_nr", *[f"cast(embedding[{i}] as double) as e{i}" for i in range(4)])
    size = "sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3)"
    return rows.selectExpr("vec_id", "image_nr", f"array(e0 / {size}, e1 / {size}, e2 / {size}, e3 / {size}) as q")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as image_nr", "concat('frame_', event_type, '.h5') as file", "user_id % 10 as frame", "value < 20 as skipped", "cast(value as int) as n_spots"
    )


def lit_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels on a background that covers the frame."""
    floor = labels(spark, sf_dir).selectExpr("image_nr", f"y * {SIZE} + x as pix", "cast(1 + (x * 7 + y * 11 + image_nr) % 50 as double) as b")
    found = floor.join(pixels(spark, sf_dir), ["image_nr", "pix"], "left")
    return found.select("image_nr", "pix", (F.col("b") + F.coalesce(F.floor(F.col("v") / 1000), F.lit(0))).alias("v"))
