"""Tasks of the data sources do not grow with the number of small ranges or frames."""

import numpy as np

from braggflow.sources import connectors


def test_small_ranges_share_tasks(tmp_path):
    om = np.arange(9 * 5_000, dtype="<f8")
    om.tofile(tmp_path / "part-0.bin")
    om[: 9 * 7].tofile(tmp_path / "part-1.bin")
    reader = connectors._RecordReader(str(tmp_path), 2 * connectors.RECORD)
    tasks = reader.partitions()
    assert len(tasks) <= connectors.MOST_TASKS + 1 and sum(t.n for t in tasks) == 5_007  # a range lies in one file
    batches = [b for t in tasks for b in reader.read(t)]
    assert np.concatenate([b.column("row_nr").to_numpy() for b in batches]).tolist() == list(range(5_007))
    assert np.concatenate([b.column("om").flatten().to_numpy() for b in batches]).tolist() == [*om.tolist(), *om[: 9 * 7].tolist()]


def test_large_ranges_stay_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(connectors, "SPLIT_BYTES", 20 * connectors.RECORD)
    monkeypatch.setattr(connectors, "MOST_TASKS", 2)
    np.zeros(9 * 100).tofile(tmp_path / "a.bin")
    assert [t.n for t in connectors._RecordReader(str(tmp_path), 5 * connectors.RECORD).partitions()] == [20] * 5
    assert len(connectors._RecordReader(str(tmp_path / "none"), 72).partitions()) == 1


def test_frames_share_tasks():
    listed = [(i, f"frame_{i}.raw") for i in range(100_000)]
    reading = connectors._FrameReading("/nowhere", 2, 2, "<f8", "")
    tasks = reading.tasks(listed)
    assert len(tasks) <= connectors.MOST_TASKS and [f for t in tasks for f in t.listed] == listed
    assert len(reading.tasks(listed[:17])) == 3
