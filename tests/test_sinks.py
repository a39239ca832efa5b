"""The log sink and the sequence source: retries, crashes, restarts, seeking and looping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import files, logs, velodyne

LOG = "hazard_events"
RAW = "timestamp double, hazard_type string, location_x double, location_y double"


def rows(spark, a, b):
    return spark.createDataFrame([(float(k), "pit", k * 0.5, -1.0) for k in range(a, b)], RAW)


def run(df, path, at, **more):
    q = logs.append(df, str(path), LOG, **more).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def times(spark, path):
    return sorted(r.timestamp for r in logs.read(spark, str(path), LOG).collect())


def parts(path, kind):
    return files.names_of(f"{path}/{LOG}/{kind}", ".parquet")


def test_small_batches_share_files(spark, tmp_path):
    """Twelve batches of twelve rows are two files, and all is there before and after the drain."""
    source = str(tmp_path / "in")
    for k in range(12):
        rows(spark, 12 * k, 12 * k + 12).coalesce(1).write.mode("append").parquet(source)
    q = run(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source), tmp_path, tmp_path / "at", seconds=1e9)
    assert q.exception() is None and len(q.recentProgress) >= 12
    assert times(spark, tmp_path) == [float(k) for k in range(144)]
    assert len(parts(tmp_path, "data")) == 1 and len(parts(tmp_path, "staged")) == 3  # 108 rows, and 36 that wait
    logs.drain(str(tmp_path), LOG)
    assert times(spark, tmp_path) == [float(k) for k in range(144)] and len(parts(tmp_path, "data")) == 2 and not parts(tmp_path, "staged")
    assert logs.read(spark, str(tmp_path), "system_health").count() == 0


def test_age_publishes(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        rows(spark, k, k + 1).coalesce(1).write.mode("append").parquet(source)
    run(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source), tmp_path, tmp_path / "at", seconds=0.0)
    assert times(spark, tmp_path) == [0.0, 1.0, 2.0] and len(parts(tmp_path, "data")) == 3 and not parts(tmp_path, "staged")


def test_a_failed_batch_leaves_nothing_and_a_retry_writes_once(spark, tmp_path):
    source, switch = str(tmp_path / "in"), tmp_path / "broken"
    rows(spark, 0, 50).repartition(3).write.mode("append").parquet(source)

    def fragile(batches):
        import os

        for b in batches:
            yield b
            if os.path.exists(switch) and 40.0 in b.column(0).to_pylist():
                raise ValueError("broken on purpose")

    stream = lambda: spark.readStream.schema(RAW).parquet(source).mapInArrow(fragile, RAW)
    switch.touch()
    with pytest.raises(Exception, match="broken"):
        run(stream(), tmp_path, tmp_path / "at", seconds=0.0)
    assert times(spark, tmp_path) == [] and not parts(tmp_path, "data")
    switch.unlink()
    run(stream(), tmp_path, tmp_path / "at", seconds=0.0)
    logs.drain(str(tmp_path), LOG)
    assert times(spark, tmp_path) == [float(k) for k in range(50)] and not parts(tmp_path, "staged")


def test_commits_are_taken_once(spark, tmp_path):
    """A batch that is committed again, as after a crash of the driver, and publications that die half way."""
    import pyarrow as pa

    writer = logs.LogWriter(f"{tmp_path}/{LOG}", "w", 10, 1e9)
    schema = pa.schema([(c.split()[0], {"double": pa.float64(), "string": pa.string()}[c.split()[1]]) for c in logs.LOGS[LOG].split(", ")])
    batch = lambda a, b: pa.RecordBatch.from_pydict({c: [float(k) for k in range(a, b)] if c == "timestamp" else [None] * (b - a) for c in schema.names}, schema=schema)
    one = writer.write(iter([batch(0, 4)]))
    writer.commit([one, writer.write(iter([]))], 0)
    writer.commit([writer.write(iter([batch(0, 4)]))], 0)  # tried again
    assert times(spark, tmp_path) == [0.0, 1.0, 2.0, 3.0] and len(parts(tmp_path, "staged")) == 1
    log = logs.Log(f"{tmp_path}/{LOG}")
    # a publication that wrote data, and died before its manifest
    log.system.copy_file(parts(tmp_path, "staged")[0], f"{log.root}/data/part-{log.load().published + 1:012d}-small.parquet")
    assert times(spark, tmp_path) == [0.0, 1.0, 2.0, 3.0]
    # a manifest that was half written
    with log.system.open_output_stream(f"{log.root}/manifest/{log.load().version + 1:012d}.json") as f:
        f.write(b'{"version": 9')
    assert times(spark, tmp_path) == [0.0, 1.0, 2.0, 3.0]
    writer.commit([writer.write(iter([batch(4, 30)]))], 1)
    assert times(spark, tmp_path) == [float(k) for k in range(30)] and len(parts(tmp_path, "data")) == 2 and not parts(tmp_path, "staged")
    failed = writer.write(iter([batch(90, 99)]))
    writer.abort([failed, None], 2)
    assert not parts(tmp_path, "staged")


@pytest.fixture()
def sweeps(tmp_path):
    folder = tmp_path / "sweeps"
    folder.mkdir()
    for k in range(7):
        np.full((3, 4), k, "<f4").tofile(folder / f"{k:03d}.bin")
    return folder


def played(spark, name, q):
    q.processAllAvailable()
    q.stop()
    return [(r.frame_id, int(r.x)) for r in spark.table(name).where("point_idx = 0").orderBy("frame_id").collect()]


def test_sequence_goes_on_where_it_was(spark, sweeps, tmp_path):
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def play(start, arrived=0):
        q = velodyne.sequence(spark, str(sweeps), start, per_trigger=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).start()
        q.processAllAvailable()
        sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        q.stop()
        return sizes, [(r.frame_id, int(r.x)) for r in spark.read.parquet(out).where("point_idx = 0").orderBy("frame_id").collect()]

    sizes, got = play(2)
    assert got == [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6)] and max(sizes) == 6  # two sweeps of three points
    for k in range(7, 12):
        np.full((3, 4), k, "<f4").tofile(sweeps / f"{k:03d}.bin")
    sizes, got = play(2)
    assert got == [(k, k + 2) for k in range(10)] and max(sizes) == 6


def test_sequence_seeks_and_loops(spark, sweeps):
    q = velodyne.sequence(spark, str(sweeps), 99).writeStream.format("memory").queryName("held").start()
    assert played(spark, "held", q) == [(0, 6)]
    q = velodyne.sequence(spark, str(sweeps), 5, loop=True, per_trigger=3).writeStream.format("memory").queryName("looped").trigger(processingTime="200 milliseconds").start()
    try:
        import time

        until = time.time() + 60
        while time.time() < until and spark.table("looped").count() < 3 * 15:
            time.sleep(0.5)
    finally:
        q.stop()
    got = [(r.frame_id, int(r.x)) for r in spark.table("looped").where("point_idx = 0").orderBy("frame_id").collect()]
    assert len(got) >= 15 and all(x == (5 + k) % 7 for k, x in got)
    q = velodyne.sequence(spark, str(sweeps / "absent")).writeStream.format("memory").queryName("nothing").start()
    assert played(spark, "nothing", q) == []


def test_a_task_reads_several_files(spark, sweeps):
    for k in range(7, 40):
        np.full((3, 4), k, "<f4").tofile(sweeps / f"{k:03d}.bin")
    velodyne.register(spark)
    df = spark.read.format("velodyne").load(str(sweeps))
    assert df.count() == 120 and df.rdd.getNumPartitions() == 3
    assert df.agg(F.count_distinct("path")).first()[0] == 40
