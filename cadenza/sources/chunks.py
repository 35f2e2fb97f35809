"""Numbered chunks as a Python data source `chunks`, for batches and streams, both to read and to write.

A chunk is a raw depth file chunk-0000.vrd, and maybe a chunk-0000.motion with a record for each of its frames. Chunks
follow each other by number, and their frames by index, from frame 0 in chunk 0 on; a file of another name is none of
ours. A stream's offset is the next chunk and the next frame, so a restart from a checkpoint neither loses nor repeats
a frame. Chunks are admitted in order, up to the first number that is missing; a `.vrd` file is published last, so its
motion is there when it is. Once Spark has committed a batch its chunks are removed, with all that lies beside them,
unless `keep` is true.

Options of readers: `path`; `motion`: `optional` (null without a file) or `required`; `frames`: the timeline's length,
over which no frame may go; of streams also `keep`, `maxChunksPerTrigger` (the first batch after a restart takes all
there is), and `timeout`: seconds after which a producer that adds nothing, while frames are missing, is an error.

Writers take rows in order of frame within a partition, write chunks of `chunk` frames under temporary names, and
publish those of all tasks together when the job commits: their frames must go on where the folder's end. What is to be
renamed is written down first, so a commit that was cut off is finished when its batch is run again, and a batch that
was published already is not published twice.
"""

from __future__ import annotations

import json
import re
import struct
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from .sidecars import _BATCH_BYTES, MODES, MOTION_HEADER, MOTION_MAGICS, SCHEMAS, VRD_HEADER, VRD_MAGIC, VRD_RECORD, _require, read_motion, read_vrd

NAME = re.compile(r"chunk-(\d{4,})\.vrd")
MOTION = "struct<version: int, width: int, height: int, tile: int, tiles_x: int, tiles_y: int, reset: boolean, records: array<struct<dx: float, dy: float, valid: boolean, confidence: smallint>>>"
SCHEMA = f"chunk int, {SCHEMAS['vrd']}, motion {MOTION}"
#: Files that go with a chunk.
BESIDE = (".vrd", ".motion", ".depth", ".rgb")
_START = {"chunk": 0, "frame": 0}
_READ, _WRITTEN = "_read.json", "_written.json"


def _name(chunk: int, end: str = ".vrd") -> str:
    return f"chunk-{chunk:04d}{end}"


@dataclass
class _Chunk(InputPartition):
    chunk: int
    first: int
    count: int
    size: int
    motion_size: int | None


class _Folder:
    """A folder of chunks."""

    def __init__(self, options: dict):
        from pyarrow import fs

        self.options = options
        self.system, self.path = fs.FileSystem.from_uri(options["path"])
        self.frames = int(options["frames"]) if "frames" in options else None

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        return {i.base_name: i.size for i in self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True)) if i.is_file}

    def note(self, name: str) -> dict | None:
        if not self.system.get_file_info(f"{self.path}/{name}").is_file:
            return None
        with self.system.open_input_stream(f"{self.path}/{name}") as file:
            return json.loads(file.read())

    def put_note(self, name: str, value: dict) -> None:
        beside = f"{self.path}/{name}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(beside) as file:
            file.write(json.dumps(value).encode())
        self.system.move(beside, f"{self.path}/{name}")

    def remove(self, names: list[str]) -> None:
        for name in names:
            self.system.delete_file(f"{self.path}/{name}")

    def header(self, chunk: int) -> tuple[int, int]:
        """The first frame and the number of frames of a chunk."""
        path = f"{self.path}/{_name(chunk)}"
        with self.system.open_input_file(path) as file:
            head = file.read(VRD_HEADER.size + 8)
        _require(len(head) >= VRD_HEADER.size, path, "short header")
        magic, _, _, count, _ = VRD_HEADER.unpack(head[: VRD_HEADER.size])
        _require(magic == VRD_MAGIC, path, "wrong magic")
        return (struct.unpack("<Q", head[VRD_HEADER.size :])[0] if count else -1), count

    def following(self, start: dict, end: int | None = None) -> tuple[list[_Chunk], dict]:
        """The chunks from offset `start` on, to the first that is missing or the chunk `end`, and the offset after them. Their frames must go on without a gap."""
        sizes = self.sizes()
        numbers = []
        while _name(number := start["chunk"] + len(numbers)) in sizes and (end is None or number < end):
            numbers.append(number)
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(self.header, numbers))
        found, frame = [], start["frame"]
        for number, (first, count) in zip(numbers, headers, strict=True):
            name = f"{self.path}/{_name(number)}"
            _require(not count or first == frame, name, f"frame {first} follows {frame - 1}")
            frame += count
            _require(self.frames is None or frame <= self.frames, name, f"frames go over the timeline of {self.frames}")
            motion = sizes.get(_name(number, ".motion"))
            _require(motion is not None or self.options.get("motion", "optional") != "required", name, "motion is missing")
            found.append(_Chunk(number, first, count, sizes[_name(number)], motion))
        return found, {"chunk": start["chunk"] + len(found), "frame": frame}

    def read(self, part: _Chunk, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        path, motion_path = f"{self.path}/{_name(part.chunk)}", f"{self.path}/{_name(part.chunk, '.motion')}"
        rows, held = [], 0
        with self.system.open_input_file(path) as file:
            if part.motion_size is None:
                motions, other = None, None
            else:
                other = self.system.open_input_file(motion_path)
                motions = read_motion(motion_path, other, part.motion_size)
            try:
                for row in read_vrd(path, file, part.size):
                    motion = next(motions, None) if motions else None
                    _require(motions is None or motion is not None, motion_path, "fewer records than frames")
                    rows.append(row | {"chunk": part.chunk, "motion": motion})
                    held += 8 * len(row["values"]) + (64 * len(motion["records"]) if motion else 0)
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                _require(motions is None or next(motions, None) is None, motion_path, "more records than frames")
            finally:
                if other:
                    other.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Chunk]:
        found, _ = _Folder(self.options).following(_START)
        return found or [_Chunk(-1, 0, 0, 0, None)]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        if partition.chunk >= 0:
            yield from _Folder(self.options).read(partition, _arrow(self.schema))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        self.at: dict | None = None  # the last known position of the query
        self.returned: dict | None = None  # the offset that was given and not planned yet
        self.seen: dict | None = None
        self.since = time.monotonic()

    def _keeps(self) -> bool:
        return self.options.get("keep", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return dict(_START)

    def latestOffset(self) -> dict:
        folder = _Folder(self.options)
        known = self.at or (None if self._keeps() else folder.note(_READ) or _START)
        most = None
        if known and "maxchunkspertrigger" in self.options:
            # What was returned and not planned was nothing new: a restart may be a batch ahead of what is noted.
            base = known if self.returned is None else self.returned
            most = base["chunk"] + int(self.options["maxchunkspertrigger"])
        _, end = folder.following(known or _START, most)
        self.returned = end
        if end != self.seen:
            self.seen, self.since = end, time.monotonic()
        elif (folder.frames or end["frame"] + 1) > end["frame"] and time.monotonic() - self.since > float(self.options.get("timeout", "inf")):
            raise TimeoutError(f"{folder.path}: nothing new for {self.options['timeout']} s after frame {end['frame'] - 1}")
        return end

    def partitions(self, start: dict, end: dict) -> list[_Chunk]:
        found, reached = _Folder(self.options).following(start, end["chunk"])
        _require(reached == end, self.options["path"], f"chunk {reached['chunk']} is gone or has changed")
        self.at, self.returned = dict(end), None
        return found

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        yield from _Folder(self.options).read(partition, _arrow(self.schema))

    def commit(self, end: dict) -> None:
        if self._keeps():
            return
        folder = _Folder(self.options)
        folder.put_note(_READ, end)
        done = re.compile(rf"chunk-(\d{{4,}})({'|'.join(map(re.escape, BESIDE))})")
        folder.remove([name for name in folder.sizes() if (m := done.fullmatch(name)) and int(m[1]) < end["chunk"]])


@dataclass
class _Written(WriterCommitMessage):
    #: (temporary name without its end, first frame, frames, whether motion is beside it)
    files: list[tuple[str, int, int, bool]] = field(default_factory=list)


class _Writing:
    """What batch and stream writers share."""

    def __init__(self, options: dict):
        self.options, self.run = {k.lower(): v for k, v in options.items()}, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        folder, out, rows = _Folder(self.options), _Written(), []
        chunk, prefix = int(self.options.get("chunk", 1024)), f"_{self.run}-{TaskContext.get().taskAttemptId()}"
        folder.system.create_dir(folder.path)
        for batch in iterator:
            for row in batch.to_pylist():
                _require(not rows or row["frame"] == rows[-1]["frame"] + 1, prefix, "frames are not in order")
                rows.append(row)
                if len(rows) == chunk:
                    out.files.append(self._file(folder, f"{prefix}-{len(out.files)}", rows))
                    rows = []
        if rows:
            out.files.append(self._file(folder, f"{prefix}-{len(out.files)}", rows))
        return out

    def _file(self, folder: _Folder, name: str, rows: list[dict]) -> tuple[str, int, int, bool]:
        shapes = {(r["width"], r["height"], r["mode"]) for r in rows}
        _require(len(shapes) == 1, name, "shapes differ")
        w, h, mode = shapes.pop()
        _require(VRD_HEADER.size + len(rows) * (VRD_RECORD.size + 4 * w * h) <= int(self.options.get("limit", 8 << 30)), name, "over the limit of bytes")
        with folder.system.open_output_stream(f"{folder.path}/{name}.vrd") as file:
            file.write(VRD_HEADER.pack(VRD_MAGIC, w, h, len(rows), MODES.index(mode)))
            for r in rows:
                values = np.array(r["values"], "<f4")
                _require(len(values) == w * h and bool(np.isfinite(values).all()), name, "a grid has the wrong size or a value that is not finite")
                file.write(VRD_RECORD.pack(r["frame"], r["cut"]) + values.tobytes())
        motions = [r.get("motion") for r in rows]
        with_motion = motions[0] is not None
        _require(all((m is not None) == with_motion for m in motions), name, "some frames have motion, some have none")
        if with_motion:
            self._motion(folder, name, motions)
        return name, rows[0]["frame"], len(rows), with_motion

    def _motion(self, folder: _Folder, name: str, motions: list[dict]) -> None:
        shapes = {(m["version"], m["width"], m["height"], m["tile"], m["tiles_x"], m["tiles_y"]) for m in motions}
        _require(len(shapes) == 1, name, "motion's shapes differ")
        version, w, h, tile, tx, ty = shapes.pop()
        number, scale = ("<i2", 16) if version == 1 else ("<f2", 1)
        kind = np.dtype([("dx", number), ("dy", number), ("valid", "u1"), ("confidence", "u1")])
        magic = {v: k for k, v in MOTION_MAGICS.items()}[version]
        with folder.system.open_output_stream(f"{folder.path}/{name}.motion") as file:
            file.write(MOTION_HEADER.pack(magic, w, h, tile, len(motions), tx, ty, 6, 1))
            for m in motions:
                _require(len(m["records"]) == tx * ty, name, "motion has the wrong number of records")
                file.write(np.array([(r["dx"] * scale, r["dy"] * scale, r["valid"], r["confidence"]) for r in m["records"]], kind).tobytes())

    def publish(self, messages: list[_Written | None], batch: int) -> None:
        folder = _Folder(self.options)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        temporary = [f"{name}{end}" for name, _, _, motion in files for end in ([".motion", ".vrd"] if motion else [".vrd"])]
        at = folder.note(_WRITTEN) or {"batch": -1, "chunk": 0, "frame": 0}
        if batch <= at["batch"]:  # the batch is run again, but was published
            return folder.remove(temporary)
        plan = folder.note(f"_plan-{batch}.json")
        if plan:  # its publication was cut off
            folder.remove(temporary)
        else:
            frame, moves = at["frame"], []
            for i, (name, first, count, motion) in enumerate(files):
                _require(first == frame, name, f"frame {first} follows {frame - 1}")
                frame += count
                moves += [(f"{name}{end}", _name(at["chunk"] + i, end)) for end in ([".motion", ".vrd"] if motion else [".vrd"])]
            plan = {"moves": moves, "after": {"batch": batch, "chunk": at["chunk"] + len(files), "frame": frame}}
            folder.system.create_dir(folder.path)
            folder.put_note(f"_plan-{batch}.json", plan)
        there = folder.sizes()
        for name, final in plan["moves"]:
            if name in there:
                folder.system.move(f"{folder.path}/{name}", f"{folder.path}/{final}")
        folder.put_note(_WRITTEN, plan["after"])
        folder.remove([f"_plan-{batch}.json"])

    def clear(self) -> None:
        """Remove what this job has written under temporary names."""
        folder = _Folder(self.options)
        folder.remove([name for name in folder.sizes() if name.startswith(f"_{self.run}-")])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.writing, self.overwrite = _Writing(options), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return self.writing.write(iterator)

    def commit(self, messages: list[_Written | None]) -> None:
        folder = _Folder(self.writing.options)
        if self.overwrite:
            folder.remove([name for name in folder.sizes() if re.fullmatch(r"chunk-\d{4,}\.(vrd|motion)|_written.json|_read.json|_plan-\d+.json", name)])
        at = folder.note(_WRITTEN)
        self.writing.publish(messages, at["batch"] + 1 if at else 0)

    def abort(self, messages: list[_Written | None]) -> None:
        self.writing.clear()


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.writing = _Writing(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return self.writing.write(iterator)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:  # noqa: N803
        self.writing.publish(messages, batchId)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:  # noqa: N803
        self.writing.clear()


class ChunksDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(schema, self.options)

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802
        return _StreamReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:  # noqa: N802
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunksDataSource)
