"""Row numbers of text tables, missing backgrounds, chosen frames; a stream's first background and its reports."""

import numpy as np
from pyspark.sql import functions as F

from braggflow.operators import imaging
from braggflow.plans import derive as D
from braggflow.sources import readers
from braggflow.streaming import frames


def test_orientations_are_numbered_without_headers(spark, tmp_path):
    nine = lambda v: " ".join([str(v)] * 9)
    (tmp_path / "o.txt").write_text(f"%header\n\n{nine(1.5)}\n%more\n{nine(2.5)}\n\n{nine(3.5)}\n")
    got = readers.orientation_text(spark, str(tmp_path / "o.txt")).collect()
    assert sorted((r.row_nr, r.om[0]) for r in got) == [(0, 1.5), (1, 2.5), (2, 3.5)]
    assert [r.source_row for r in readers.text_rows(spark, str(tmp_path / "o.txt")).collect()] == [2, 4, 6]


def test_backgrounds_of_the_wrong_size_are_zero(spark, tmp_path):
    np.arange(12, dtype="<f8").tofile(tmp_path / "b.raw")
    got = {r.pix: r.v for r in readers.background_image(spark, str(tmp_path / "b.raw"), 4, 3).collect()}
    assert got == {i: float(i) for i in range(1, 12)}
    for path, width in ((str(tmp_path / "b.raw"), 5), (str(tmp_path / "none.raw"), 4), ("", 4)):
        assert readers.background_image(spark, path, width, 3).count() == 0


def test_chosen_frames(spark):
    df = spark.createDataFrame([(f"{c}.h5", f, n) for n, (c, f) in enumerate((c, f) for c in "cab" for f in (0, 1))], "file string, frame int, image_nr int")
    files = lambda df: sorted({r.file for r in df.collect()})
    assert files(readers.chosen_frames(df, limit=2)) == ["a.h5", "b.h5"] and files(readers.chosen_frames(df, limit=0)) == ["a.h5", "b.h5", "c.h5"]
    assert [r.image_nr for r in readers.chosen_frames(df, image_nr=3).collect()] == [3]


def test_first_background_is_kept(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = lambda k: [(k, int(i), float(v)) for i, v in enumerate(rng.integers(1, 30, D.SIZE * D.SIZE))]
    first, later = (spark.createDataFrame(rows(k), "image_nr long, pix long, v double") for k in (4, 2))
    told = lambda df: {r.pix: r.v for r in frames.first_background(df, D.DETECTOR, str(tmp_path / "b"), 9).collect()}
    expect = {r.pix: r.v for r in imaging.background_median(first, D.SIZE, D.SIZE, 9).collect()}
    assert told(first) == expect and told(later) == expect
    less = imaging.subtract_shared(later, spark.createDataFrame(list(expect.items()), "pix long, v double"))
    both = {(r.image_nr, r.pix): r.v for r in imaging.subtract(later, spark.createDataFrame([(2, p, v) for p, v in expect.items()], "image_nr long, pix long, v double")).collect()}
    assert {(r.image_nr, r.pix): r.v for r in less.collect()} == both


def test_reports_of_a_drained_stream(spark, tmp_path):
    progress = frames.Progress("counted-frames")
    spark.streams.addListener(progress)
    for k in range(3):
        spark.createDataFrame([(k, p, float(p % 4)) for p in range(40)], frames.PIXELS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    forward = spark.createDataFrame([(r, p) for r in range(5) for p in range(r, 40, 3)], "row_nr long, pix long")
    run = lambda: frames.match_stream(frames.counted(frames.landing(spark, str(tmp_path / "in"), files_per_batch=1)), forward, str(tmp_path / "out"), str(tmp_path / "state"), min_spots=1, available_now=True, name="counted-frames").awaitTermination()
    run()
    spark.createDataFrame([(9, 1, 0.0), (9, 2, 3.0)], frames.PIXELS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # a restart takes what is new, and nothing twice
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    import time

    for _ in range(50):  # reports reach Python by a thread of their own
        if progress.batches == 4:
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert progress.batches == 4 and progress.counts["rows"] == 122 and progress.counts["dark"] == 31 and progress.rate() > 0
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.image_nr for r in out.select("image_nr").distinct().collect()} == {0, 1, 2, 9}
    assert out.groupBy("image_nr", "row_nr").count().where("count > 1").count() == 0
