"""Raw sweep files: a reader over binaryFile, a data source for spark.read.format("velodyne"), a writer, and sequences.

A file is little-endian float32 rows of 4, 5 or 3 values (whichever divides its count, in that order): x, y, z, intensity,
ring. Files that are not whole numbers of floats, or of rows, have no points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from gridloom.sources.files import names_of, system_of

SCHEMA = "path string, point_idx bigint, x float, y float, z float, intensity float, ring int"
#: Intensity of files that have none.
NO_INTENSITY = 15.0


def decode(content: bytes) -> np.ndarray:
    """Rows of x, y, z, intensity, ring (NaN where there is none)."""
    if len(content) % 4:
        return np.zeros((0, 5), np.float32)
    flat = np.frombuffer(content, "<f4")
    width = next((w for w in (4, 5, 3) if flat.size % w == 0), None)
    if width is None:
        return np.zeros((0, 5), np.float32)
    rows = flat.reshape(-1, width)
    out = np.full((len(rows), 5), np.nan, np.float32)
    out[:, :width] = rows
    if width == 3:
        out[:, 3] = NO_INTENSITY
    return out


def encode(x: np.ndarray, y: np.ndarray, z: np.ndarray, intensity: np.ndarray) -> bytes:
    """A file of width 4."""
    return np.column_stack([x, y, z, intensity]).astype("<f4").tobytes()


def _batch(path: str, rows: np.ndarray) -> pa.RecordBatch:
    ring = pa.array(np.nan_to_num(rows[:, 4]).astype(np.int32), mask=np.isnan(rows[:, 4]))
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n)), *[pa.array(rows[:, k]) for k in range(4)], ring], ["path", "point_idx", "x", "y", "z", "intensity", "ring"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield _batch(path.as_py(), decode(content.as_py() or b""))


def read(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Points of all .bin files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "content").mapInArrow(_decoded, SCHEMA)


def numbered(points: DataFrame) -> DataFrame:
    """points with frame_id: the place of the file's name among all, from 0.

    Names alone are ordered, in ranges: a name's place is its rank in its range and the sizes of the ranges before.
    """
    names = points.select("path").distinct().repartitionByRange("path").withColumn("_part", F.spark_partition_id())
    names = names.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy("path")))
    sizes = names.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = names.join(F.broadcast(before), "_part").select("path", (F.col("_before") + F.col("_nth") - 1).cast("bigint").alias("frame_id"))
    return points.join(ranked, "path")


def frame(points: DataFrame, number: int, frames: int, loop: bool = True) -> DataFrame:
    """One frame of a numbered sequence; beyond its ends around it, or held at them."""
    at = number % frames if loop and frames else max(0, min(number, frames - 1))
    return points.where(F.col("frame_id") == at)


def sequence(spark: SparkSession, folder: str, start: int = 0, loop: bool = False, per_trigger: int = 1) -> DataFrame:
    """A stream of a folder's sweeps in the order of their names: frame_id (how many were played before) and SCHEMA.

    It begins with sweep start, held at the ends of the sequence, and plays per_trigger sweeps a batch, around and around if
    loop. A query that is started again from its checkpoint goes on with the sweep that is next, whatever start says; to seek
    or to take another folder, start it with another checkpoint. Sweeps whose names come after the last are played when they
    arrive, unless loop.
    """
    register(spark)
    own = spark.readStream.format("velodyne").option("start", start).option("loop", str(loop).lower()).option("perTrigger", per_trigger)
    frames = own.load(folder)
    return frames.select(F.col("path"), *[c.split()[0] for c in SCHEMA.split(", ")[1:]], F.col("frame_id"))


def stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the files of a folder, so many at a time, as they appear."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.bin").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select("path", "content").mapInArrow(_decoded, SCHEMA)


def folder_of(existing: list[str], mode: str, base: str) -> str | None:
    """The first folder of a dataset that exists: base/mode/velodyne, base/mode, base/training/velodyne, base/velodyne, base."""
    for name in (f"{base}/{mode}/velodyne", f"{base}/{mode}", f"{base}/training/velodyne", f"{base}/velodyne", base):
        if name in existing:
            return name
    return None


def resolved(spark: SparkSession, base: str, mode: str = "static") -> str | None:
    """folder_of() among the folders that Hadoop's file system has, which any store that Spark reads goes through.

    If none of them holds a sweep, base itself, which read() searches through, if there is one anywhere below; else None.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()

    def holds(folder: str, deep: bool = False) -> bool:
        where = path(folder)
        system = where.getFileSystem(conf)
        if not system.exists(where):
            return False
        files = system.listFiles(where, deep)
        while files.hasNext():
            if files.next().getPath().getName().endswith(".bin"):
                return True
        return False

    base = base.rstrip("/")
    there = [f for f in (f"{base}/{mode}/velodyne", f"{base}/{mode}", f"{base}/training/velodyne", f"{base}/velodyne", base) if holds(f)]
    return folder_of(there, mode, base) or (base if holds(base, True) else None)


#: Files that one task of the data source reads.
FILES = 16


class Velodyne(DataSource):
    """format("velodyne"): reads a folder's files, as a table or as a sequence, and writes frames as files."""

    @classmethod
    def name(cls) -> str:
        return "velodyne"

    def schema(self) -> str:
        return SCHEMA if "start" not in self.options else f"{SCHEMA}, frame_id bigint"

    def reader(self, schema):
        return Reader(self.options["path"])

    def streamReader(self, schema):
        return Sequence(self.options["path"], int(self.options.get("start", 0)), self.options.get("loop", "false") == "true", int(self.options.get("perTrigger", 1)))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        names = names_of(self.path, ".bin")
        return [InputPartition(names[k : k + FILES]) for k in range(0, len(names), FILES)] or [InputPartition([])]

    def read(self, partition):
        system, _ = system_of(self.path)
        for name in partition.value:
            with system.open_input_stream(name) as f:
                yield _batch(name, decode(f.read()))


class Sequence(DataSourceStreamReader):
    """Offsets count the sweeps played. The engine tells a reader that is started again where it was by asking for the partitions of
    what it saw last; the limit of a batch goes on from there."""

    def __init__(self, path: str, start: int, loop: bool, per_trigger: int):
        self.path, self.start, self.loop, self.per_trigger = path, start, loop, max(1, per_trigger)
        self.at: int | None = None
        self.names: list[str] = []

    def initialOffset(self):
        return {"played": 0}

    def _first(self) -> int:
        return max(0, min(self.start, len(self.names) - 1))

    def latestOffset(self):
        if not self.names or not self.loop:  # a sequence that goes around is the one it began with
            self.names = names_of(self.path, ".bin")
        self.at = self.at or 0
        left = self.per_trigger if self.loop and self.names else max(0, len(self.names) - self._first() - self.at)
        self.at += min(self.per_trigger, left)
        return {"played": self.at}

    def partitions(self, start, end):
        if self.at is None or self.at < end["played"]:
            self.at = end["played"]
        self.names = self.names or names_of(self.path, ".bin")
        frames = [(k, self.names[(self._first() + k) % len(self.names)]) for k in range(start["played"], end["played"])] if self.names else []
        return [InputPartition(frames[k : k + FILES]) for k in range(0, len(frames), FILES)] or [InputPartition([])]

    def read(self, partition):
        system, _ = system_of(self.path)
        for number, name in partition.value:
            with system.open_input_stream(name) as f:
                own = _batch(name, decode(f.read()))
            yield own.append_column("frame_id", pa.array([number] * own.num_rows, pa.int64()))

    def commit(self, end):
        pass

    def stop(self):
        pass


class Writer(DataSourceArrowWriter):
    """Files by name: a task's rows come sorted by path and place, and a file is written as it goes."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        system, root = system_of(self.path)
        now, out = None, None
        try:
            for batch in iterator:
                paths = batch.column("path").to_pylist()
                x, y, z, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "intensity"))
                cuts = [0, *(k for k in range(1, len(paths)) if paths[k] != paths[k - 1]), len(paths)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if paths[a] != now:
                        if out is not None:
                            out.close()
                        now, out = paths[a], system.open_output_stream(f"{root}/{paths[a].rsplit('/', 1)[-1]}")
                    out.write(encode(x[a:b], y[a:b], z[a:b], i[a:b]))
        finally:
            if out is not None:
                out.close()
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    """Makes format("velodyne") available."""
    spark.dataSource.register(Velodyne)


def write(points: DataFrame, folder: str) -> None:
    """One .bin file of width 4 for each path (its last part is the name); a file's rows are one task's."""
    register(points.sparkSession)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    points.select(*[c if c in points.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))]).repartition("path").sortWithinPartitions("path", "point_idx").select(*columns).write.format("velodyne").mode("append").save(folder)
