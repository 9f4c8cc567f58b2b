"""The query of the whole run as a stream equals the run over all frames at once."""

from braggflow.functions.crystal import NICKEL
from braggflow.operators import imaging
from braggflow.plans import derive as D
from braggflow.plans import registry
from braggflow.plans.index import index_frames

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    pixels = D.pixels(spark, DATA)
    ready = imaging.preprocess(pixels, D.SIZE, D.SIZE, thresholds=imaging.fixed(pixels, 1000.0), min_area=1)["pixels"]
    found = index_frames(ready, D.grid(spark, DATA), D.hkls(spark), NICKEL, D.DETECTOR, store=f"{registry.new_path(spark, 'batch')}", **registry._RUN)
    batch = sorted(map(tuple, registry._kept(found["kept"]).collect()))
    assert batch and sorted(map(tuple, registry.QUERIES["index_stream"](spark, DATA).collect())) == batch
