"""Compact binary sidecars as Python data sources: raw depth (`vrd`), motion (`motion`) and depth (`depth`).

A folder's files are partitions, one each, read by whole records in bounded batches. Headers are checked before any
record; a wrong magic, size or value raises an error that names the file. Writing makes one file per partition under
a temporary name and renames it when the job commits. Files are reached through pyarrow's file systems.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the formats: magics, header layouts, record layouts. Little-endian, packed.
VRD_MAGIC = b"D5VRD001"
MOTION_MAGICS = {b"D5MV0001": 1, b"D5MV0002": 2, b"D5MV0003": 3}
DEPTH_MAGIC = b"D5DP0002"
VRD_HEADER = struct.Struct("<8sIIII")  # magic, width, height, count, mode (0 minmax, 1 max)
VRD_RECORD = struct.Struct("<QB")  # frame index, cut; then height * width f4
MOTION_HEADER = struct.Struct("<8sIIIIIIII")  # magic, width, height, tile, frames, tiles_x, tiles_y, record bytes (6), flags (1)
DEPTH_HEADER = struct.Struct("<8sIIIII")  # magic, width, height, frames, record bytes (2), flags = 1 | tile << 8
MODES = ("minmax", "max")
_BATCH_BYTES = 8 << 20

SCHEMAS = {
    "vrd": "path string, frame long, cut boolean, mode string, height int, width int, values array<float>",
    "motion": "path string, frame long, version int, width int, height int, tile int, tiles_x int, tiles_y int, reset boolean, records array<struct<dx: float, dy: float, valid: boolean, confidence: smallint>>",
    "depth": "path string, frame long, width int, height int, tile int, values array<float>",
}


def _require(good: bool, path: str, what: str) -> None:
    if not good:
        raise ValueError(f"{path}: {what}")


def read_vrd(path: str, file, size: int) -> Iterator[dict]:
    head = file.read(VRD_HEADER.size)
    _require(len(head) == VRD_HEADER.size, path, "short header")
    magic, w, h, count, mode = VRD_HEADER.unpack(head)
    _require(magic == VRD_MAGIC, path, "wrong magic")
    _require(mode in (0, 1) and w > 0 and h > 0, path, "wrong header")
    _require(size == VRD_HEADER.size + count * (VRD_RECORD.size + 4 * w * h), path, "wrong size")
    expected = None
    for _ in range(count):
        frame, cut = VRD_RECORD.unpack(file.read(VRD_RECORD.size))
        values = np.frombuffer(file.read(4 * w * h), "<f4")
        _require(cut in (0, 1), path, "cut is not 0 or 1")
        _require(expected is None or frame == expected, path, "frames are not in order")
        _require(bool(np.isfinite(values).all()), path, "a value is not finite")
        expected = frame + 1
        yield {"path": path, "frame": frame, "cut": bool(cut), "mode": MODES[mode], "height": h, "width": w, "values": values}


def read_motion(path: str, file, size: int) -> Iterator[dict]:
    """Values as stored for version 2 and 3 (3: multiplied by confidence); version 1 holds sixteenths as integers."""
    head = file.read(MOTION_HEADER.size)
    _require(len(head) == MOTION_HEADER.size, path, "short header")
    magic, w, h, tile, frames, tx, ty, record, _flags = MOTION_HEADER.unpack(head)
    _require(magic in MOTION_MAGICS, path, "wrong magic")
    version = MOTION_MAGICS[magic]
    _require(record == 6 and tx > 0 and ty > 0, path, "wrong header")
    _require(size == MOTION_HEADER.size + frames * tx * ty * 6, path, "wrong size")
    kind = np.dtype([("dx", "<i2" if version == 1 else "<f2"), ("dy", "<i2" if version == 1 else "<f2"), ("valid", "u1"), ("confidence", "u1")])
    for frame in range(frames):
        r = np.frombuffer(file.read(tx * ty * 6), kind)
        scale = np.float32(1 / 16 if version == 1 else 1)
        records = [{"dx": float(np.float32(a) * scale), "dy": float(np.float32(b) * scale), "valid": bool(v), "confidence": int(c)} for a, b, v, c in r.tolist()]
        yield {"path": path, "frame": frame, "version": version, "width": w, "height": h, "tile": tile, "tiles_x": tx, "tiles_y": ty, "reset": not r["valid"].any(), "records": records}


def read_depth(path: str, file, size: int) -> Iterator[dict]:
    head = file.read(DEPTH_HEADER.size)
    _require(len(head) == DEPTH_HEADER.size, path, "short header")
    magic, w, h, frames, record, flags = DEPTH_HEADER.unpack(head)
    _require(magic == DEPTH_MAGIC, path, "wrong magic")
    tile = flags >> 8
    _require(record == 2 and flags & 255 == 1 and 0 < tile <= 16, path, "wrong header")
    cells = -(-w // tile) * -(-h // tile)
    _require(size == DEPTH_HEADER.size + frames * cells * 2, path, "wrong size")
    for frame in range(frames):
        yield {"path": path, "frame": frame, "width": w, "height": h, "tile": tile, "values": np.frombuffer(file.read(2 * cells), "<f2").astype(np.float32)}


READERS = {"vrd": (read_vrd, ".vrd"), "motion": (read_motion, ".motion"), "depth": (read_depth, ".depth")}


@dataclass
class _File(InputPartition):
    path: str | None
    size: int = 0


class _Reader(DataSourceReader):
    def __init__(self, kind: str, schema, options: dict):
        self.kind, self.schema, self.path = kind, schema, options["path"]

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        end = READERS[self.kind][1]
        found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.path.endswith(end) and not i.base_name.startswith(("_", ".")))
        return [_File(*f) for f in found] or [_File(None)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.path is None:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.schema)
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            for row in READERS[self.kind][0](partition.path, file, partition.size):
                rows.append(row)
                held += 8 * len(row.get("values", row.get("records")))
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _VrdWriter(DataSourceArrowWriter):
    """Writes raw depth: one file per partition with rows, in order of frame. Option `limit`: bytes a file may have."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.run, self.overwrite = options["path"], uuid.uuid4().hex[:8], overwrite
        self.limit = int(options.get("limit", 8 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyarrow import fs
        from pyspark import TaskContext

        rows = sorted((r for b in iterator for r in b.to_pylist()), key=lambda r: r["frame"])
        if not rows:
            return _Written([])
        shapes = {(r["width"], r["height"], r["mode"]) for r in rows}
        system, path = fs.FileSystem.from_uri(self.path)
        name = f"chunk-{rows[0]['frame']:010d}-{self.run}-{TaskContext.get().taskAttemptId()}.vrd"
        _require(len(shapes) == 1, name, "shapes differ")
        w, h, mode = shapes.pop()
        _require(VRD_HEADER.size + len(rows) * (VRD_RECORD.size + 4 * w * h) <= self.limit, name, "over the limit of bytes")
        system.create_dir(path)
        with system.open_output_stream(f"{path}/_{name}") as file:
            file.write(VRD_HEADER.pack(VRD_MAGIC, w, h, len(rows), MODES.index(mode)))
            for i, r in enumerate(rows):
                values = np.array(r["values"], "<f4")
                _require(r["frame"] == rows[0]["frame"] + i, name, "frames are not in order")
                _require(len(values) == w * h and bool(np.isfinite(values).all()), name, "a grid has the wrong size or a value that is not finite")
                file.write(VRD_RECORD.pack(r["frame"], r["cut"]) + values.tobytes())
        return _Written([name])

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if info.is_file and info.base_name.endswith(".vrd") and not info.base_name.startswith("_"):
                    system.delete_file(info.path)
        for name in [n for m in messages if m for n in m.names]:
            system.move(f"{path}/_{name}", f"{path}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith("_") and self.run in info.base_name:
                system.delete_file(info.path)


class _Sidecar(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMAS[self.kind]

    def reader(self, schema) -> _Reader:
        return _Reader(self.kind, schema, self.options)


class VrdDataSource(_Sidecar):
    kind = "vrd"

    def writer(self, schema, overwrite: bool) -> _VrdWriter:
        return _VrdWriter(self.options, overwrite)


class MotionDataSource(_Sidecar):
    kind = "motion"


class DepthDataSource(_Sidecar):
    kind = "depth"


def register(spark: SparkSession) -> None:
    for source in (VrdDataSource, MotionDataSource, DepthDataSource):
        spark.dataSource.register(source)
