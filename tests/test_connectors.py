"""Orientation records and raw frames as data sources: splits, empty folders, refusals, and a stream that stops and starts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggflow.sources import connectors


@pytest.fixture()
def source(spark):
    connectors.register(spark)
    return spark


def test_records_follow_each_other_in_any_split(source, tmp_path):
    rows = np.random.default_rng(1).random((1000, 9))
    (tmp_path / "in").mkdir()
    for name, part in (("a.bin", rows[:400]), ("b.bin", rows[:0]), ("c.bin", rows[400:])):
        part.astype("<f8").tofile(tmp_path / "in" / name)
    for split, spans in ((72 * 130, 4 + 5), (1 << 20, 2)):
        got = source.read.format("laue_orientations").option("splitbytes", split).load(str(tmp_path / "in"))
        found = sorted(got.collect())
        assert got.rdd.getNumPartitions() == spans and [r.row_nr for r in found] == list(range(1000)) and np.array_equal([r.om for r in found], rows)
    assert [s.n for s in connectors._RecordReader(str(tmp_path / "in"), 1).partitions()] == [1] * 1000
    with open(tmp_path / "in" / "c.bin", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="no whole number of records"):
        source.read.format("laue_orientations").load(str(tmp_path / "in")).count()
    assert source.read.format("laue_orientations").load(str(tmp_path / "none")).count() == 0


def test_written_records_come_back_in_order(source, tmp_path):
    df = source.range(0, 700, 1, 5).select(F.array(*[(F.col("id") * 9 + i).cast("double") for i in range(9)]).alias("om"))
    df.write.format("laue_orientations").mode("append").save(str(tmp_path / "o"))
    got = sorted(source.read.format("laue_orientations").load(str(tmp_path / "o")).collect())
    assert [(r.row_nr, r.om[8]) for r in got] == [(i, i * 9 + 8.0) for i in range(700)]
    with pytest.raises(Exception, match="is not empty"):
        df.write.format("laue_orientations").mode("append").save(str(tmp_path / "o"))
    df.limit(3).coalesce(1).write.format("laue_orientations").mode("overwrite").save(str(tmp_path / "o"))
    assert source.read.format("laue_orientations").load(str(tmp_path / "o")).count() == 3
    for bad in (F.array(F.lit(1.0)), F.lit(None).cast("array<double>"), F.array(*[F.lit(None).cast("double")] * 9)):
        with pytest.raises(Exception, match="nine numbers"):
            source.range(2).select(bad.alias("om")).write.format("laue_orientations").mode("append").save(str(tmp_path / f"bad{hash(str(bad))}"))


def land(folder, name, values):
    draft = folder / f".{name}"
    np.asarray(values, "<f8").tofile(draft)
    os.replace(draft, folder / name)


def test_every_frame_has_a_row(source, tmp_path):
    land(tmp_path, "a.raw", [0, 0, 0, 7, 0, 2.5])
    land(tmp_path, "b.raw", [0.0] * 6)
    land(tmp_path, "c.raw", [1.0] * 5)
    land(tmp_path, "note.txt", [1.0] * 6)
    got = source.read.format("laue_frames").options(width=3, height=2, suffix=".raw").load(str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a.raw", "ok", 3, 7.0), (1, "a.raw", "ok", 5, 2.5), (2, "b.raw", "no_spots", None, None), (3, "c.raw", "shape mismatch", None, None)]
    reader = connectors._FrameReader(str(tmp_path), 3, 2, "<f8", "")
    gone = list(reader.read(connectors.Frames([(9, str(tmp_path / "lost.raw"))])))
    assert [b.to_pylist() for b in gone] == [[{"image_nr": 9, "file": "lost.raw", "status": "unreadable", "pix": None, "v": None}]]


def test_a_stream_that_starts_again_loses_and_repeats_nothing(source, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    frames = source.readStream.format("laue_frames").options(width=2, height=1, log=str(tmp_path / "log"), suffix=".raw").load(str(landing))

    def drain(state="state", to=out):
        frames.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start(to).awaitTermination()

    def rows(where=out):
        return sorted((r.image_nr, r.file, r.pix, r.v) for r in source.read.parquet(where).collect())

    for i in (5, 3):
        land(landing, f"f{i}.raw", [0, i])
    drain()
    first = [(1, "f3.raw", 1, 3.0), (2, "f5.raw", 1, 5.0)]
    assert rows() == first
    drain()
    assert rows() == first
    for i in (9, 1):  # one of a smaller name than those that are done
        land(landing, f"f{i}.raw", [i, 0])
    drain()
    every = [*first, (3, "f1.raw", 0, 1.0), (4, "f9.raw", 0, 9.0)]
    assert rows() == every
    # a batch whose commit was lost runs again over the same files, though more have landed
    commits = sorted((p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    land(landing, "f0.raw", [4, 0])
    drain()
    assert rows() == every
    drain()
    assert rows() == [*every, (5, "f0.raw", 0, 4.0)]
    drain("other", str(tmp_path / "again"))  # a stream of its own reads the whole log under the same numbers
    assert rows(str(tmp_path / "again")) == rows()


def test_an_entry_of_the_log_is_bounded(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        land(tmp_path / "in", f"{i}.raw", [1, 1])
    stream = lambda: connectors._FrameStream(str(tmp_path / "log"), 2, path=str(tmp_path / "in"), width=2, height=1, kind="<f8", suffix="")
    one = stream()
    assert [one.latestOffset()["entry"] for _ in range(4)] == [1, 2, 3, 3] and stream().latestOffset() == {"entry": 3}
    listed = lambda a, b: [(n, f[-5:]) for t in stream().partitions({"entry": a}, {"entry": b}) for n, f in t.listed]
    assert listed(1, 3) == [(3, "2.raw"), (4, "3.raw"), (5, "4.raw")] and listed(3, 3) == []
