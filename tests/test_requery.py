"""Stored results: text that reads back, another choice of grains, the command line, provenance and large record files."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggflow.__main__ import main
from braggflow.operators import claims, relations
from braggflow.sources import provenance, readers, writers

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
SOLUTIONS = "image_nr long, grain_nr long, n_solutions long, intensity double, nmatches_x_intensity double, quality double, n_matches long, n_spots_calc long, recip array<double>, lattice array<double>, om array<double>, coarse_quality double, misorientation_deg double, row_nr long"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(1, g, 2, 5.5, 11.0, 100.0 - g, 8, 9, EYE, [0.35] * 3 + [90.0] * 3, EYE, 7.25, 0.5, 40 + g) for g in (1, 2, 3)]
    solutions = spark.createDataFrame(rows, SOLUTIONS)
    spots = [(1, 1, n, 1, 1, n, 10 + n, 20, 0.1, 0.2, -0.9, 3.5) for n in range(3)] + [(1, 2, n, 1, 1, n, 10 + n, 20, 0.1, 0.2, -0.9, 3.5) for n in range(2)] + [(1, 3, n, 1, 1, n, 40, 20 + n, 0.1, 0.2, -0.9, 3.5) for n in range(2)]
    spots = spark.createDataFrame(spots, "image_nr long, grain_nr long, spot_nr int, h int, k int, l int, x int, y int, qx double, qy double, qz double, intensity double")
    for name, lines in (("s.txt", writers.solution_lines(solutions)), ("p.txt", writers.spot_lines(spots))):
        (tmp_path / name).write_text("%header\n" + "\n".join(r.value for r in lines.orderBy("grain_nr").collect()) + "\n")
    return solutions, spots, str(tmp_path / "s.txt"), str(tmp_path / "p.txt")


def test_all_columns_read_back(spark, stored):
    solutions, spots, s, p = stored
    own = [r.asDict() for r in solutions.drop("image_nr").orderBy("grain_nr").collect()]
    got = readers.solutions(spark, s).orderBy("source_row")
    assert [r.source_row for r in got.collect()] == [1, 2, 3]
    assert [r.asDict() for r in got.select(*own[0]).collect()] == own
    assert sorted(readers.spots(spark, p).select(*spots.drop("image_nr").columns).collect()) == sorted(spots.drop("image_nr").collect())


def test_command_line(spark, stored, tmp_path, capsys):
    _, _, s, p = stored
    assert main(["parse", s]) == 0
    assert "3 solutions (batch layout)" in capsys.readouterr().out
    assert main(["filter", "--solutions", s, "--spots", p, "--by-labels", "--out", str(tmp_path / "kept")]) == 0
    assert "kept 2 of 3" in capsys.readouterr().out
    back = [line.split("\t")[0] for line in (r.value for r in spark.read.text(str(tmp_path / "kept")).collect())]
    assert sorted(back) == ["1", "3"]
    assert main(["filter", "--solutions", s, "--spots", p, "--min-total", "1"]) == 0
    assert "kept 1 of 3" in capsys.readouterr().out  # all orientations are one
    with pytest.raises(SystemExit) as stop:
        main(["--version"])
    assert stop.value.code == 0


def test_provenance(spark, tmp_path, capsys):
    data = bytes(range(256)) * 9000
    (tmp_path / "in.bin").write_bytes(data)
    weak = provenance.collect(spark, [str(tmp_path / "in.bin"), str(tmp_path / "none")], config={"b": 1, "a": 2}, extra={"n": 3})
    row = weak.first()
    assert row.inputs[0].sha256_head == hashlib.sha256(data[: 1 << 20] + data[-(1 << 20) :] + len(data).to_bytes(8, "little")).hexdigest()
    assert (row.inputs[0].size, row.inputs[0].basename, row.inputs[0].missing, row.inputs[1].missing) == (len(data), "in.bin", False, True)
    assert json.loads(row.config) == {"a": 2, "b": 1} and json.loads(row.extra) == {"n": 3} and row.spark == spark.version
    strong = provenance.collect(spark, [str(tmp_path / "in.bin")], strong=True)
    assert strong.first().inputs[0].sha256 == hashlib.sha256(data).hexdigest()
    provenance.write(strong, str(tmp_path / "prov"))
    assert provenance.read(spark, str(tmp_path / "prov")).first().inputs[0].sha256 == hashlib.sha256(data).hexdigest()
    assert main(["provenance", str(tmp_path / "in.bin")]) == 0 and "sha256_head" in capsys.readouterr().out


def test_records_of_a_large_file_in_splits(spark, tmp_path):
    """A file above 2 GB that holds zeros but for its last record; two splits are read, not the file in one value."""
    n = 30_000_000
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((n - 1) * 72)
        f.seek(0, 2)
        f.write(np.arange(9, dtype="<f8").tobytes())
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.minsize", "1")
    found = readers.orientation_records(spark, str(tmp_path / "large.bin"))
    assert found.rdd.getNumPartitions() > 1
    small = np.arange(9 * 5000, dtype="<f8")
    small.tofile(tmp_path / "small.bin")
    got = readers.orientation_records(spark, str(tmp_path / "small.bin")).orderBy("row_nr").collect()
    assert [r.row_nr for r in got] == list(range(5000)) and got[4321].om == small[9 * 4321 : 9 * 4322].tolist()


def test_lines_are_not_shuffled_to_be_numbered(spark, stored):
    """Blocks are few: even where nothing is broadcast by size, lines stay where they are read."""
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = readers.text_rows(spark, stored[2])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_labels_of_spots_as_a_column(spark):
    """A place's own number does as a table of numbered places does; spots off the detector are free in both."""
    solutions = spark.range(40).selectExpr("id % 3 as image_nr", "id as grain_nr", "cast(id % 7 as double) as quality", "id as source_row")
    spots = spark.range(900).selectExpr("id % 40 % 3 as image_nr", "id % 40 as grain_nr", "id as spot_row", "cast(id * 7 % 11 - 2 as int) as x", "cast(id * 5 % 9 - 1 as int) as y")
    inside = spots.where("x between 0 and 6 and y between 0 and 5")
    by_table = claims.unique_claims(solutions, spots, relations.fallback_labels(inside))
    by_column = claims.unique_claims(solutions, spots, F.expr("if(x between 0 and 6 and y between 0 and 5, y * 7 + x + 1, 0)"))
    assert sorted(by_column.collect()) == sorted(by_table.collect()) and by_table.where("n_unique > n_unique_labels").count()
