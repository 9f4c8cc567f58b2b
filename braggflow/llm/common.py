"""What several of the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rows of a side that is hinted for broadcast; callers count before they hint.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors cost no recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braggflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few constant rows as a local relation, without an RDD."""
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(schema).fields
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, *, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, and without one otherwise (a shuffled join then).

    weight: rows that a row counts for, for rows with arrays; df is a stored table then.
    """
    if weight is None:
        return F.broadcast(df) if len(df.select(F.lit(1)).take(limit + 1)) <= limit else df
    total = df.agg(F.sum(F.lit(1) + weight)).first()[0] or 0
    return F.broadcast(df) if total <= 2 * limit else df
