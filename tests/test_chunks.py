"""Numbered chunks: batches, streams, restarts, consumption and publication."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import chunks, sidecars

GRID = "cast(array(id, 0.5, -id, 1) as array<float>)"
MOTION = "named_struct('version', 3, 'width', 8, 'height', 4, 'tile', 4, 'tiles_x', 2, 'tiles_y', 1, 'reset', false, 'records', array(named_struct('dx', float(id), 'dy', float(0.5), 'valid', true, 'confidence', smallint(200)), named_struct('dx', float(-1), 'dy', float(id), 'valid', id % 2 = 0, 'confidence', smallint(0))))"


def frames(spark, first, last, parts=1, motion=True):
    rows = spark.range(first, last, 1, parts).selectExpr("id as frame", "id % 5 = 0 as cut", "'max' as mode", "2 as height", "2 as width", f"{GRID} as values", *([f"{MOTION} as motion"] if motion else []))
    return rows


def write(spark, path, first, last, chunk=4, **kw):
    chunks.register(spark)
    frames(spark, first, last, **kw).write.format("chunks").mode("append").option("chunk", chunk).save(str(path))


def names(path, end="vrd"):
    return sorted(p.name for p in path.glob(f"chunk-*.{end}"))


def stream(spark, path, out, checkpoint, **options):
    reader = spark.readStream.format("chunks").option("path", str(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select("chunk", "frame", "values", "motion").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).start()


def got(spark, out):
    return sorted((r.frame, r.chunk, tuple(r["values"]), r.motion.records[0].dx if r.motion else None) for r in spark.read.parquet(str(out)).collect())


def expected(last, chunk=4):
    return [(i, i // chunk, (float(i), 0.5, float(-i), 1.0), float(i)) for i in range(last)]


def test_batch_round_trip(spark, tmp_path):
    write(spark, tmp_path / "c", 0, 12, parts=3)
    write(spark, tmp_path / "c", 12, 18)
    rows = spark.read.format("chunks").load(str(tmp_path / "c")).orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(18)) and [r.chunk for r in rows] == [*[i // 4 for i in range(12)], 3, 3, 3, 3, 4, 4]
    assert all(r["values"] == [r.frame, 0.5, -r.frame, 1] and r.motion.records[1].valid == (r.frame % 2 == 0) for r in rows)
    assert names(tmp_path / "c") == [f"chunk-000{i}.vrd" for i in range(5)] == [n.replace("motion", "vrd") for n in names(tmp_path / "c", "motion")]
    sidecars.register(spark)
    assert spark.read.format("vrd").load(str(tmp_path / "c")).count() == 18 == spark.read.format("motion").load(str(tmp_path / "c")).count()
    with pytest.raises(Exception, match="frame 20 follows 17"):
        write(spark, tmp_path / "c", 20, 22)
    chunks.register(spark)
    frames(spark, 0, 3).write.format("chunks").mode("overwrite").save(str(tmp_path / "c"))
    assert names(tmp_path / "c") == ["chunk-0000.vrd"] and not list((tmp_path / "c").glob("_*-*.vrd"))
    assert spark.read.format("chunks").load(str(tmp_path / "c")).count() == 3


def test_stream_equals_batch_and_consumes(spark, tmp_path):
    write(spark, tmp_path / "c", 0, 8)
    (tmp_path / "c" / "unrelated.txt").write_text("preserve")
    (tmp_path / "c" / "chunk-0001.rgb").write_text("goes with its chunk")
    query = stream(spark, tmp_path / "c", tmp_path / "o", tmp_path / "k", maxChunksPerTrigger=1)
    try:
        query.processAllAvailable()
        write(spark, tmp_path / "c", 8, 14)
        query.processAllAvailable()
        write(spark, tmp_path / "c", 14, 15)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(int(p.name) for p in (tmp_path / "k" / "commits").glob("[0-9]*")) == [0, 1, 2, 3, 4]  # one chunk each
    assert got(spark, tmp_path / "o") == [*expected(14), (14, 4, (14.0, 0.5, -14.0, 1.0), 14.0)]
    assert (tmp_path / "c" / "unrelated.txt").read_text() == "preserve" and not (tmp_path / "c" / "chunk-0001.rgb").exists()
    assert len(names(tmp_path / "c")) <= 1  # the last batch is committed with the next one


@pytest.mark.parametrize("keep", ["true", "false"])
def test_restart_loses_and_doubles_nothing(spark, tmp_path, keep):
    for first, last in ((0, 8), (8, 12), (12, 20)):
        write(spark, tmp_path / "c", first, last)
        query = stream(spark, tmp_path / "c", tmp_path / "o", tmp_path / "k", keep=keep, maxChunksPerTrigger=2)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert got(spark, tmp_path / "o") == expected(20)
    assert (len(names(tmp_path / "c")) == 5) == (keep == "true")


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    write(spark, tmp_path / "c", 0, 8)
    found, fail = [], [True]

    def sink(batch, number):
        if fail[0] and number == 1:
            raise RuntimeError("lost")
        found.append((number, sorted(r.frame for r in batch.collect())))

    def run():
        return spark.readStream.format("chunks").option("path", str(tmp_path / "c")).option("maxChunksPerTrigger", 1).load().writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "k")).start()

    with pytest.raises(Exception, match="lost"):
        run().processAllAvailable()
    fail[0] = False
    query = run()
    query.processAllAvailable()
    query.stop()
    assert found == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7])]


def spoiled(spark, tmp_path, spoil, **options):
    write(spark, tmp_path / "c", 0, 8)
    spoil(tmp_path / "c")
    query = stream(spark, tmp_path / "c", tmp_path / "o", tmp_path / "k", **options)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def motion_of(n):
    kind = np.dtype([("dx", "<f2"), ("dy", "<f2"), ("valid", "u1"), ("confidence", "u1")])
    return sidecars.MOTION_HEADER.pack(b"D5MV0003", 8, 4, 4, n, 2, 1, 6, 1) + np.zeros(2 * n, kind).tobytes()


def test_motion_must_match(spark, tmp_path):
    for name, n, message in (("longer", 5, "more records"), ("shorter", 3, "fewer records")):
        with pytest.raises(Exception, match=message):
            spoiled(spark, tmp_path / name, lambda p, n=n: (p / "chunk-0001.motion").write_bytes(motion_of(n)))
    with pytest.raises(Exception, match="motion is missing"):
        spoiled(spark, tmp_path / "missing", lambda p: (p / "chunk-0001.motion").unlink(), motion="required")
    spoiled(spark, tmp_path / "optional", lambda p: (p / "chunk-0001.motion").unlink())
    assert [r[3] for r in got(spark, tmp_path / "optional" / "o")] == [0.0, 1.0, 2.0, 3.0, None, None, None, None]


def test_timeline_is_strict(spark, tmp_path):
    def other(path):  # chunk 1 starts at frame 9
        raw = bytearray((path / "chunk-0001.vrd").read_bytes())
        raw[sidecars.VRD_HEADER.size] = 9
        (path / "chunk-0001.vrd").write_bytes(raw)

    with pytest.raises(Exception, match="frame 9 follows 3"):
        spoiled(spark, tmp_path / "a", other)
    with pytest.raises(Exception, match="over the timeline of 6"):
        spoiled(spark, tmp_path / "b", lambda p: None, frames=6)
    with pytest.raises(Exception, match="over the timeline of 6"):
        spark.read.format("chunks").option("frames", 6).load(str(tmp_path / "b" / "c")).collect()
    spoiled(spark, tmp_path / "gap", lambda p: (p / "chunk-0000.vrd").rename(p / "chunk-0005.vrd"))  # waits for chunk 0
    assert got(spark, tmp_path / "gap" / "o") == []


def test_a_producer_that_stops_is_an_error(spark, tmp_path):
    write(spark, tmp_path / "c", 0, 4)
    query = stream(spark, tmp_path / "c", tmp_path / "o", tmp_path / "k", frames=8, timeout=1.5)
    with pytest.raises(Exception, match="nothing new for 1.5 s after frame 3"):
        query.awaitTermination(60)
    assert got(spark, tmp_path / "o") == expected(4)


def test_stream_sink_publishes_once(spark, tmp_path):
    write(spark, tmp_path / "c", 0, 16)

    def run():
        rows = spark.readStream.format("chunks").option("path", str(tmp_path / "c")).option("maxChunksPerTrigger", 2).load()
        return rows.withColumn("values", F.transform("values", lambda v: v * 2)).drop("chunk", "path").writeStream.format("chunks").option("path", str(tmp_path / "o")).option("chunk", 3).option("checkpointLocation", str(tmp_path / "k")).start()

    query = run()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.format("chunks").load(str(tmp_path / "o")).orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(16)) and all(r["values"][0] == 2 * r.frame and r.motion.records[0].dx == r.frame for r in rows)
    # a batch that is published again: nothing is doubled; one whose publication was cut off: it is finished
    writing = chunks._Writing({"path": str(tmp_path / "o"), "chunk": "3"})
    folder = chunks._Folder(writing.options)
    at = folder.note("_written.json")
    rows = [dict(frame=16 + i, cut=False, mode="max", height=1, width=1, values=[0.0], motion=None) for i in range(2)]
    again = chunks._Written([writing._file(folder, f"_{writing.run}-x", rows)])
    writing.publish([again], at["batch"])
    assert folder.note("_written.json") == at and not list((tmp_path / "o").glob("_*.vrd"))
    first = chunks._Written([writing._file(folder, f"_{writing.run}-y", rows)])
    folder.put_note(f"_plan-{at['batch'] + 1}.json", {"moves": [(f"_{writing.run}-y.vrd", chunks._name(at["chunk"]))], "after": {"batch": at["batch"] + 1, "chunk": at["chunk"] + 1, "frame": 18}})
    second = chunks._Written([writing._file(folder, f"_{writing.run}-z", rows)])
    writing.publish([second], at["batch"] + 1)
    assert first.files and folder.note("_written.json")["frame"] == 18 and not list((tmp_path / "o").glob("_*.vrd"))
    assert spark.read.format("chunks").load(str(tmp_path / "o")).count() == 18


def test_empty_folder(spark, tmp_path):
    chunks.register(spark)
    (tmp_path / "c").mkdir()
    assert spark.read.format("chunks").load(str(tmp_path / "c")).count() == 0
