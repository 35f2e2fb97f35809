"""Logs, JSON documents, folders and reports."""

import json

import numpy as np
import pytest

from cadenza.sources import logs


def test_documents_and_tracks(spark, tmp_path):
    schema = "id string, formats array<struct<vcodec: string, acodec: string, url: string>>"
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "formats": [{"vcodec": "none", "acodec": "x", "url": "1"}, {"vcodec": "h", "acodec": "none", "url": "2"}]}, indent=1))
    r = logs.tracks(logs.documents(spark, str(tmp_path), schema), "formats").first()
    assert (r.video, r.audio) == ("2", "1")
    (tmp_path / "b.json").write_text('{"id": "b", "formats": 3')
    with pytest.raises(Exception):
        logs.documents(spark, str(tmp_path), schema).collect()


def test_lines_and_folder(spark, tmp_path):
    (tmp_path / "x.log").write_text("start\nframe=3 ok\nerror\nframe=7 ok frame=8\n")
    out = logs.matching_lines(spark, str(tmp_path), r"frame=(\d+)").collect()
    assert [r.parts for r in out] == [["3"], ["7", "8"]]
    assert [r.size for r in logs.folder(spark, str(tmp_path), "*.log").collect()] == [len((tmp_path / "x.log").read_text())]


def test_chunks_and_reports(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(0, 10, 1, 2).write.parquet(path)
    assert [r.id for r in logs.joined_chunks(spark, path, 2).collect()] == list(range(10))
    with pytest.raises(ValueError):
        logs.joined_chunks(spark, path, 3)
    logs.write_report(spark.sql("select 1 as a, cast(null as int) as b"), str(tmp_path / "r"))
    assert json.loads(next((tmp_path / "r").glob("part*.json")).read_text()) == {"a": 1, "b": None}
    with pytest.raises(Exception):
        logs.write_report(spark.sql("select 1 as a"), str(tmp_path / "r"))


def test_latest_row_wins(spark, tmp_path):
    schema = "k long, t long, v string"
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(0, i, f"a{i}"), (1, 5 - i, f"b{i}")], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = logs.latest(stream, ["k"], "t", str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    out = str(tmp_path / "out")
    assert sorted(p.name for p in (tmp_path / "out").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]
    assert sorted((r.k, r.v) for r in logs.newest(spark, out, ["k"], "t").collect()) == [(0, "a2"), (1, "b0")]
    logs.compacted(spark, out, ["k"], "t")
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
    assert sorted((r.k, r.v) for r in logs.newest(spark, out, ["k"], "t").collect()) == [(0, "a2"), (1, "b0")]


def test_pcm(spark, tmp_path):
    wave = np.sin(np.arange(2500) / 7).astype("<f4")
    (tmp_path / "a.raw").write_bytes(wave.tobytes())
    (tmp_path / "empty.raw").write_bytes(b"")
    rows = sorted(logs.pcm(spark, str(tmp_path), 8000, 1000).collect(), key=lambda r: r["first"])
    assert [(r["first"], r.seconds, len(r["values"])) for r in rows] == [(0, 0, 1000), (1000, 0.125, 1000), (2000, 0.25, 500)]
    assert (np.concatenate([r["values"] for r in rows]) == wave).all()
    (tmp_path / "cut.raw").write_bytes(b"\0" * 5)
    with pytest.raises(Exception, match="ends inside"):
        logs.pcm(spark, str(tmp_path), 8000).collect()
