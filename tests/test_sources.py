"""Sidecars: round trips, layouts and rejections."""

import struct

import numpy as np
import pytest

from cadenza.sources import sidecars


@pytest.fixture
def formats(spark):
    sidecars.register(spark)
    return spark


def grids(spark, n, first=0, w=5, h=4):
    rows = [(first + i, i == 0, "max", h, w, [float(np.float32(c + 0.17 * i)) for c in range(w * h)]) for i in range(n)]
    return spark.createDataFrame(rows, "frame long, cut boolean, mode string, height int, width int, values array<float>")


def test_vrd_round_trip(formats, tmp_path):
    path = str(tmp_path / "v")
    for first in (0, 2):
        grids(formats, 2, first).coalesce(1).write.format("vrd").mode("append").save(path)
    out = formats.read.format("vrd").load(path).orderBy("frame").collect()
    assert [(r.frame, r.cut, r.mode) for r in out] == [(0, True, "max"), (1, False, "max"), (2, True, "max"), (3, False, "max")]
    assert np.allclose(out[1]["values"], np.arange(20) + 0.17)


@pytest.mark.parametrize("what", ["magic", "size", "order", "nan", "cut"])
def test_vrd_rejections(formats, tmp_path, what):
    values = np.arange(4, dtype="<f4")
    if what == "nan":
        values[2] = np.nan
    body = b"".join(struct.pack("<QB", i * (2 if what == "order" else 1), 2 if what == "cut" else 0) + values.tobytes() for i in range(2))
    head = struct.pack("<8sIIII", b"XXXXXXXX" if what == "magic" else b"D5VRD001", 2, 2, 2, 0)
    (tmp_path / "a.vrd").write_bytes(head + body + b"x" * (what == "size"))
    with pytest.raises(Exception, match="a.vrd"):
        formats.read.format("vrd").load(str(tmp_path)).collect()


def test_vrd_limit_publishes_nothing(formats, tmp_path):
    path = tmp_path / "v"
    with pytest.raises(Exception, match="limit"):
        grids(formats, 2).coalesce(1).write.format("vrd").option("limit", "20").mode("append").save(str(path))
    assert not list(path.glob("*.vrd"))


@pytest.mark.parametrize("version", [1, 2, 3])
def test_motion(formats, tmp_path, version):
    kind = np.dtype([("dx", "<i2" if version == 1 else "<f2"), ("dy", "<i2" if version == 1 else "<f2"), ("valid", "u1"), ("confidence", "u1")])
    r = np.zeros((2, 6), kind)
    r["dx"], r["confidence"], r["valid"][0] = (24 if version == 1 else 1.5), 255, 1
    head = struct.pack("<8sIIIIIIII", b"D5MV000%d" % version, 48, 32, 16, 2, 3, 2, 6, 1)
    (tmp_path / "m.motion").write_bytes(head + r.tobytes())
    out = formats.read.format("motion").load(str(tmp_path)).orderBy("frame").collect()
    assert [(x.version, x.reset, len(x.records)) for x in out] == [(version, False, 6), (version, True, 6)]
    assert out[0].records[0].dx == 1.5 and out[0].records[0].confidence == 255


def test_depth(formats, tmp_path):
    cells = np.full((3, 6), 0.5, "<f2")
    (tmp_path / "d.depth").write_bytes(struct.pack("<8sIIIII", b"D5DP0002", 48, 32, 3, 2, 1 | 16 << 8) + cells.tobytes())
    out = formats.read.format("depth").load(str(tmp_path)).collect()
    assert len(out) == 3 and out[0]["values"] == [0.5] * 6


def test_other_files_are_ignored(formats, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert formats.read.format("vrd").load(str(tmp_path)).count() == 0


def test_vrd_overwrite_replaces(formats, tmp_path):
    path = str(tmp_path / "v")
    grids(formats, 3).coalesce(1).write.format("vrd").mode("append").save(path)
    grids(formats, 3, 10).coalesce(1).write.format("vrd").mode("overwrite").save(path)
    assert sorted(r.frame for r in formats.read.format("vrd").load(path).collect()) == [10, 11, 12]
