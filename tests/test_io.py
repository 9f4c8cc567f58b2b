import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggflow.sources import readers, writers
from braggflow.streaming import frames


def write(path, text):
    path.write_text(text)
    return str(path)


def row(n, first=()):
    return " \t\t".join([*map(str, first), *[f"{i + 0.5:.4f}" if i > 6 else str(i) for i in range(n)]]) + "\n"


def test_text_tables(spark, tmp_path):
    batch = write(tmp_path / "s.txt", "%GrainNr header\n" + row(34) + "\n" + row(34))
    got = readers.solutions(spark, batch).collect()
    assert len(got) == 2 and got[0].grain_nr == 0 and got[0].quality == 4.0 and got[0].om[0] == 22.5 and got[0].row_nr == 33 and got[0].image_nr is None
    stream = readers.solutions(spark, write(tmp_path / "t.txt", "%h\n" + row(34, [7])), "stream").first()
    assert stream.image_nr == 7 and stream.om == got[0].om
    spots = readers.spots(spark, write(tmp_path / "p.txt", "%h\n1\t0\t2\t-2\t2\t  482\t 1214\t0.05\t0.65\t-0.75\t2585.4\n")).first()
    assert (spots.h, spots.k, spots.x, spots.y, spots.intensity) == (2, -2, 482, 1214, 2585.4)
    assert readers.solutions(spark, write(tmp_path / "e.txt", "%h\n")).count() == 0
    with pytest.raises(Exception, match="columns"):
        readers.solutions(spark, batch, "stream").collect()
    with pytest.raises(ValueError, match="layout"):
        readers.solutions(spark, batch, "other")
    assert readers.orientation_text(spark, batch).first().om[0] == 22.5
    hkls = readers.hkl_list(spark, write(tmp_path / "h.txt", "1 1 1 3\n2 0 0 4\n")).collect()
    assert [(r.hkl_id, r.h, r.n2) for r in hkls] == [(0, 1, 3), (1, 2, 4)]


def test_binaries(spark, tmp_path):
    om = np.arange(27, dtype="<f8")
    om.tofile(tmp_path / "o.bin")
    got = readers.orientation_records(spark, str(tmp_path / "o.bin")).orderBy("row_nr").collect()
    assert [r.row_nr for r in got] == [0, 1, 2] and got[1].om == om[9:18].tolist()
    image = np.zeros((3, 4))
    image[1, 2] = 5
    image.astype("<f8").tofile(tmp_path / "a.raw")
    np.zeros(12).tofile(tmp_path / "b.raw")
    np.zeros(5).tofile(tmp_path / "c.raw")
    status = {r.file[-5:]: (r.status, r.pix) for r in readers.frame_images(spark, str(tmp_path / "*.raw"), 4, 3).collect()}
    assert status == {"a.raw": ("ok", 6), "b.raw": ("no_spots", None), "c.raw": ("shape mismatch", None)}
    raw = spark.read.format("binaryFile").load(str(tmp_path / "o.bin"))
    import hashlib

    data = om.tobytes()
    assert readers.weak_fingerprint(raw).first().fingerprint == hashlib.sha256(data + len(data).to_bytes(8, "little")).hexdigest()
    assert readers.weak_fingerprint(raw, 100).first().fingerprint == hashlib.sha256(data[:100] + data[-100:] + len(data).to_bytes(8, "little")).hexdigest()


def test_mapping_and_index_file(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps({"3": {"file": "a.h5", "frame": 1, "skipped": True, "reason": "no_spots"}}),)], "value string")
    got = readers.frame_mapping(lines).first()
    assert (got.image_nr, got.file, got.skipped, got.n_spots, got.reason) == (3, "a.h5", True, None, "no_spots")
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    solutions = spark.createDataFrame([(0, 1, 9.0, 0.1, eye, eye, [1.0, 2.0, 3.0])], "image_nr int, grain_nr int, quality double, rms double, om array<double>, recip array<double>, euler array<double>")
    spot = spark.createDataFrame([(0, 1, 4, 0.1, 0.2, -0.9, 1, -1, 2, 12.5, 9.0, 0.01, 3)], "image_nr int, grain_nr int, spot_nr int, qx double, qy double, qz double, h int, k int, l int, intensity double, energy double, err_deg double, peak_index int")
    header = spark.createDataFrame([(0, 1, "SpaceGroup", "225")], "image_nr int, position int, keyword string, value string")
    text = writers.index_files(writers.index_patterns(solutions, spot), header).first().value
    assert text.startswith("$filetype\tIndexFile\n$NpatternsFound\t\t1\n$Nindexed\t\t1\n$SpaceGroup\t\t225") and "(  1  -1   2)" in text
    writers.write_text(spark.createDataFrame([(1, "x"), (2, "y")], "image_nr int, value string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("image_nr = 2").first().value == "y"


def test_stream_drains_once(spark, tmp_path):
    table = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "row_nr long, pix long")
    landing = str(tmp_path / "landing")
    for i in range(3):
        spark.createDataFrame([(i, 5, 4.0), (i, 6, 5.0)], "image_nr long, pix long, v double").coalesce(1).write.mode("append").parquet(landing)
    for _ in range(2):  # a second start finds nothing new
        query = frames.match_stream(frames.landing(spark, landing, files_per_batch=1), table, str(tmp_path / "out"), str(tmp_path / "state"), min_spots=1, available_now=True)
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.where(F.col("row_nr") == 1).select("image_nr").distinct().count() == 3
