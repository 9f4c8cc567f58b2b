"""Python data sources: orientation records and raw frames, read in byte ranges and by file, as batches and as streams.

Register them once with ``register(spark)``:

* ``laue_orientations``: headerless files of nine 64-bit floats a record. Files follow each other by name, and a record's
  number follows from its place, so that every task reads its own byte range and nothing is counted. Writing gives one
  file a partition, in the order of partitions.
* ``laue_frames``: raw frames, a file each. Reading gives the lit pixels of each frame, or a row with a status where a frame
  has none, has the wrong size or can't be read. As a stream it keeps a log of what landed; writing gives a file a frame.

Paths are those of pyarrow's file systems. Written files depend on a task's rows alone and are moved into place, so a task that
runs again only writes the same file again. Empty folders give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Bytes of an orientation, records of a batch, and default bytes of a split.
RECORD, BATCH_RECORDS, SPLIT_BYTES = 72, 1 << 16, 128 << 20
#: Frames that a task reads one after another, at least.
FRAMES_PER_TASK = 8
#: Tasks that small ranges or frames are dealt over at most: a task costs as much to start as megabytes to read.
MOST_TASKS = 1024


def register(spark: SparkSession) -> None:
    for source in (OrientationRecords, RawFrames):
        spark.dataSource.register(source)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _files(path: str, suffix: str = "") -> list[fs.FileInfo]:
    """The file, or the files of a folder by name; hidden ones are left out, and a missing folder is empty."""
    files, where = _place(path)
    found = files.get_file_info(where)
    if found.type == fs.FileType.File:
        return [found]
    listed = files.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return sorted((f for f in listed if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(suffix)), key=lambda f: f.base_name)


def _write_whole(path: str, name: str, parts: Iterator[bytes]) -> None:
    """Write a file under a name of its own and move it into place."""
    files, where = _place(path)
    files.create_dir(where, recursive=True)
    draft = f"{where}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    files.move(draft, f"{where}/{name}")


def _cleared(path: str, overwrite: bool) -> None:
    if _files(path):
        if not overwrite:
            raise ValueError(f"{path} is not empty")
        files, where = _place(path)
        files.delete_dir_contents(where)


@dataclass
class Span(InputPartition):
    """Records first .. first + n of all, which begin at a byte of a file."""

    file: str
    at: int
    first: int
    n: int


class OrientationRecords(DataSource):
    """Options: path, and splitbytes, the most bytes that a task reads unless that made more than MOST_TASKS tasks."""

    @classmethod
    def name(cls) -> str:
        return "laue_orientations"

    def schema(self) -> str:
        return "row_nr long, om array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        _cleared(self.options["path"], overwrite)
        return _RecordWriter(self.options["path"])


class _RecordReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.step = path, max(1, split_bytes // RECORD)

    def partitions(self) -> list[Span]:
        spans, base, files = [], 0, _files(self.path)
        step = max(self.step, min(SPLIT_BYTES // RECORD, -(-sum(f.size for f in files) // (RECORD * MOST_TASKS))))
        for file in files:
            n, rest = divmod(file.size, RECORD)
            if rest:
                raise ValueError(f"{file.path} has {file.size} bytes, no whole number of records of {RECORD}")
            spans += [Span(file.path, at * RECORD, base + at, min(step, n - at)) for at in range(0, n, step)]
            base += n
        return spans or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.n:
            return
        with _place(self.path)[0].open_input_file(span.file) as source:
            source.seek(span.at)
            for done in range(0, span.n, BATCH_RECORDS):
                n = min(BATCH_RECORDS, span.n - done)
                values = np.frombuffer(source.read(n * RECORD), "<f8")
                om = pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * n + 1, 9, dtype="i4")), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + span.first + done), om], ["row_nr", "om"])


class _RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        def raw() -> Iterator[bytes]:
            for batch in batches:
                om = batch.column("om")
                values = om.flatten()
                if om.null_count or values.null_count or not pc.all(pc.equal(pc.list_value_length(om), 9), min_count=0).as_py():
                    raise ValueError("an orientation has nine numbers")
                yield values.to_numpy(zero_copy_only=False).astype("<f8").tobytes()

        _write_whole(self.path, f"part-{TaskContext.get().partitionId():08d}.bin", raw())
        return WriterCommitMessage()


@dataclass
class Frames(InputPartition):
    """Frames (number, file)."""

    listed: list[tuple[int, str]]


class RawFrames(DataSource):
    """Options: path, width, height; kind, the type of a value (<f8); suffix of the file names; log and maxfiles of a stream.

    A stream's log is a folder that only it writes to: an entry names the files that were new when the stream looked. Offsets
    are numbers of entries, so a stream that starts again reads the same files for the same offsets, whatever has landed
    since. A file must land whole (by a move) and under a name that had none before. maxfiles bounds an entry and so a batch; leave it unset with availableNow,
    which Spark runs as one batch for a Python source (the batch that was not committed, if there is one, else what is new).
    """

    @classmethod
    def name(cls) -> str:
        return "laue_frames"

    def schema(self) -> str:
        return "image_nr long, file string, status string, pix long, v double"

    def _options(self) -> dict:
        o = self.options
        return {"path": o["path"], "width": int(o["width"]), "height": int(o["height"]), "kind": o.get("kind", "<f8"), "suffix": o.get("suffix", "")}

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(**self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FrameStream(self.options["log"], int(self.options.get("maxfiles", 0)), **self._options())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        _cleared(self.options["path"], overwrite)
        return _FrameWriter(**self._options())


class _FrameReading:
    def __init__(self, path: str, width: int, height: int, kind: str, suffix: str):
        self.path, self.shape, self.kind, self.suffix = path, (height, width), np.dtype(kind), suffix

    def tasks(self, listed: list[tuple[int, str]]) -> list[Frames]:
        each = max(FRAMES_PER_TASK, -(-len(listed) // MOST_TASKS))
        return [Frames(listed[i : i + each]) for i in range(0, len(listed), each)] or [Frames([])]

    def read(self, task: Frames) -> Iterator[pa.RecordBatch]:
        files = _place(self.path)[0]
        for number, file in task.listed:
            status, pix, v = self.frame(files, file)
            n = max(1, len(pix))
            columns = [pa.array(np.full(n, number)), pa.repeat(file.rsplit("/", 1)[-1], n), pa.repeat(status, n)]
            columns += [pa.array(pix), pa.array(v.astype("f8"))] if len(pix) else [pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["image_nr", "file", "status", "pix", "v"])

    def frame(self, files: fs.FileSystem, file: str) -> tuple[str, np.ndarray, np.ndarray]:
        nothing = np.empty(0, "i8")
        try:
            with files.open_input_file(file) as source:
                raw = source.read()
        except OSError:
            return "unreadable", nothing, nothing
        if len(raw) != self.shape[0] * self.shape[1] * self.kind.itemsize:
            return "shape mismatch", nothing, nothing
        values = np.frombuffer(raw, self.kind)
        pix = np.flatnonzero(values > 0)
        return ("ok" if len(pix) else "no_spots"), pix, values[pix]


class _FrameReader(_FrameReading, DataSourceReader):
    def partitions(self) -> list[Frames]:
        return self.tasks([(i, f.path) for i, f in enumerate(_files(self.path, self.suffix), 1)])


class _FrameStream(_FrameReading, DataSourceStreamReader):
    def __init__(self, log: str, most: int, **options):
        super().__init__(**options)
        self.log, self.most, self.entries = log, most, None

    def told(self) -> list[dict]:
        """The entries of the log: read once, then kept."""
        if self.entries is None:
            files, self.entries = _place(self.log)[0], []
            for file in _files(self.log, ".json"):
                with files.open_input_file(file.path) as source:
                    self.entries.append(json.loads(source.read()))
            self.seen = {name for entry in self.entries for name in entry["files"]}
        return self.entries

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        entries = self.told()
        new = [f.base_name for f in _files(self.path, self.suffix) if f.base_name not in self.seen]
        if new := new[: self.most or None]:
            before = entries[-1]["first"] + len(entries[-1]["files"]) if entries else 1
            entry = {"first": before, "files": new}
            _write_whole(self.log, f"{len(entries):010d}.json", iter([json.dumps(entry).encode()]))
            entries.append(entry)
            self.seen.update(new)
        return {"entry": len(entries)}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        where = _place(self.path)[1]
        return self.tasks([(e["first"] + i, f"{where}/{name}") for e in self.told()[start["entry"] : end["entry"]] for i, name in enumerate(e["files"])])

    def commit(self, end: dict) -> None:
        """The log stays: it is what a later start numbers on from."""


class _FrameWriter(DataSourceArrowWriter):
    """Rows (image_nr, pix, v), one a frame with its lit pixels as arrays."""

    def __init__(self, path: str, width: int, height: int, kind: str, suffix: str):
        self.path, self.n, self.kind, self.suffix = path, width * height, kind, suffix or ".raw"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        for batch in batches:
            for number, pix, v in zip(*(batch.column(c) for c in ("image_nr", "pix", "v")), strict=True):
                image = np.zeros(self.n, self.kind)
                image[pix.values.to_numpy()] = v.values.to_numpy()
                _write_whole(self.path, f"frame_{number.as_py():010d}{self.suffix}", iter([image.tobytes()]))
        return WriterCommitMessage()
