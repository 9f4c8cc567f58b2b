"""Where results came from: input fingerprints, time, versions and settings, as a one-row table."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file's head, and of its tail if it is larger, that the weak hash covers.
PART = 1 << 20
INPUTS = "array<struct<path: string, basename: string, size: long, mtime_utc: timestamp, missing: boolean, sha256: string, sha256_head: string>>"


def _streams(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, where


def fingerprint(spark: SparkSession, path: str, *, strong: bool = False) -> Row:
    """Size, time and hash of a file in any store that Spark reads. Head and tail are read at most, or the whole file piece by piece."""
    fs, where = _streams(spark, path)
    absent = Row(path=path, basename=None, size=None, mtime_utc=None, missing=True, sha256=None, sha256_head=None)
    if not fs.exists(where):
        return absent
    status = fs.getFileStatus(where)
    size, digest, source = status.getLen(), hashlib.sha256(), fs.open(where)
    try:
        if strong:
            while piece := bytes(source.readNBytes(PART)):
                digest.update(piece)
        else:
            digest.update(bytes(source.readNBytes(PART)))
            if size > PART:
                source.seek(size - PART)
                digest.update(bytes(source.readNBytes(PART)))
            digest.update(size.to_bytes(8, "little"))
    finally:
        source.close()
    found = {"sha256": digest.hexdigest() if strong else None, "sha256_head": None if strong else digest.hexdigest()}
    return Row(path=path, basename=where.getName(), size=size, mtime_utc=status.getModificationTime(), missing=False, **found)


def collect(spark: SparkSession, files: Iterable[str] = (), *, config: Mapping | None = None, extra: Mapping | None = None, strong: bool = False) -> DataFrame:
    """One row: schema_version, timestamp_utc, host, versions, config and extra (JSON), inputs. A file that is not there is marked missing."""
    inputs = [fingerprint(spark, str(path), strong=strong).asDict() for path in files]
    raw = T._parse_datatype_string(INPUTS.replace("mtime_utc: timestamp", "mtime_utc: long"))
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("python", T.StringType()), T.StructField("spark", T.StringType()), T.StructField("config", T.StringType()), T.StructField("extra", T.StringType()), T.StructField("inputs", raw)])
    dumped = lambda value: None if value is None else json.dumps(value, sort_keys=True, default=str)
    row = spark.createDataFrame([(platform.node(), platform.python_version(), spark.version, dumped(config), dumped(extra), inputs)], schema)
    timed = F.transform("inputs", lambda i: i.withField("mtime_utc", F.timestamp_millis(i["mtime_utc"])))
    return row.select(F.lit(1).alias("schema_version"), F.current_timestamp().alias("timestamp_utc"), "host", "python", "spark", "config", "extra", timed.alias("inputs"))


def write(record: DataFrame, path: str) -> None:
    """The record as one JSON line beside the results."""
    record.coalesce(1).write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    schema = f"schema_version int, timestamp_utc timestamp, host string, python string, spark string, config string, extra string, inputs {INPUTS}"
    return spark.read.schema(schema).json(path)
