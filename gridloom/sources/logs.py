"""A log that streams append to: format("gridloom_log"), written once however often a batch is tried.

Tasks stage their rows as files; a batch's commit names them in a manifest, which is what makes them part of the log. Staged
files are moved or merged into the log's data when there are ROWS of them or the first of them is SECONDS old, so that
small batches do not leave a file or a folder each. Manifests are numbered, and the greatest one counts: a crash between
two of its steps leaves the log as it was before or as it is after. One query writes a log at a time, as one writer.

A folder has staged/, data/ and manifest/. Read it with read(): what is committed is there at once, published or not.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from gridloom.operators.telemetry import LOGS, log_rows
from gridloom.sources.files import names_of, system_of

#: Rows, and seconds, after which what is staged becomes data.
ROWS, SECONDS = 100, 1.0


@dataclass
class Manifest:
    """version, publications so far, the last batch of each writer, staged files with their rows, and since when the first of them waits."""

    version: int = 0
    published: int = 0
    writers: dict[str, int] = field(default_factory=dict)
    staged: list[tuple[str, int]] = field(default_factory=list)
    since: float = 0.0


class Log:
    """The folder of one log and the steps that change it."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.system, self.root = system_of(self.path)

    def make(self) -> None:
        for part in ("staged", "data", "manifest"):
            self.system.create_dir(f"{self.root}/{part}", recursive=True)

    def load(self) -> Manifest:
        for name in reversed(names_of(f"{self.path}/manifest", ".json")):
            with self.system.open_input_stream(name) as f:
                try:
                    return Manifest(**json.loads(f.read()))
                except ValueError:  # half written when its writer died
                    continue
        return Manifest()

    def save(self, m: Manifest) -> None:
        name = f"{self.root}/manifest/{m.version:012d}.json"
        with self.system.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps(vars(m)).encode())
        self.system.move(f"{name}.tmp", name)
        for old in names_of(f"{self.path}/manifest", ".json")[:-2]:
            self.system.delete_file(old)

    def remove(self, names: list[str]) -> None:
        from pyarrow import fs

        for name in names:
            if self.system.get_file_info(f"{self.root}/staged/{name}").type != fs.FileType.NotFound:
                self.system.delete_file(f"{self.root}/staged/{name}")

    def commit(self, files: list[tuple[str, int]], writer: str, batch: int, rows: int, seconds: float) -> None:
        """Makes staged files part of the log, unless the writer's batch already is."""
        m = self.load()
        if batch <= m.writers.get(writer, -1):
            return self.remove([f for f, _ in files])
        m.version += 1
        m.since = m.since if m.staged else time.time()
        m.writers[writer] = batch
        m.staged = [*map(tuple, m.staged), *files]
        self.save(m)
        if sum(n for _, n in m.staged) >= rows or (m.staged and time.time() - m.since >= seconds):
            self.publish(m, rows)

    def publish(self, m: Manifest, rows: int) -> None:
        """Turns staged files into data: one of rows or more as it is, smaller ones merged. Data of a publication that the manifest
        does not count is not there, so the manifest that follows is the one step that matters."""
        import pyarrow.parquet as pq

        if not m.staged:
            return
        nth = m.published + 1
        self.remove_beyond(m.published)
        small = [f for f, n in m.staged if n < rows]
        for k, f in enumerate(f for f, n in m.staged if n >= rows):
            self.system.copy_file(f"{self.root}/staged/{f}", f"{self.root}/data/part-{nth:012d}-{k}.parquet")
        if small:  # fewer than rows each, and as many as wait for rows at most
            with pq.ParquetWriter(f"{self.root}/data/part-{nth:012d}-small.parquet", pq.read_schema(f"{self.root}/staged/{small[0]}", filesystem=self.system), filesystem=self.system) as out:
                for f in small:
                    out.write_table(pq.read_table(f"{self.root}/staged/{f}", filesystem=self.system))
        names = [f for f, _ in m.staged]
        self.save(Manifest(m.version + 1, nth, m.writers, [], 0.0))
        self.remove(names)

    def remove_beyond(self, published: int) -> None:
        """Deletes data that a publication which died has left."""
        for name in names_of(f"{self.path}/data", ".parquet"):
            if int(name.rsplit("/part-", 1)[1][:12]) > published:
                self.system.delete_file(name)


@dataclass
class Staged(WriterCommitMessage):
    """A task's file and its rows."""

    name: str | None
    rows: int


class LogSource(DataSource):
    """Options: path (the log's folder), writer (a name for each checkpoint that writes here), rows, seconds."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_log"

    def streamWriter(self, schema, overwrite):
        return LogWriter(self.options["path"], self.options.get("writer", "default"), int(self.options.get("rows", ROWS)), float(self.options.get("seconds", SECONDS)))


class LogWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, writer: str, rows: int, seconds: float):
        self.path, self.writer, self.rows, self.seconds = path, writer, rows, seconds

    def write(self, iterator):
        """Stages a task's rows, batch by batch; a task that fails takes its file with it."""
        import pyarrow.parquet as pq

        log = Log(self.path)
        log.make()
        name, out, n = f"{uuid.uuid4().hex}.parquet", None, 0
        where = f"{log.root}/staged/{name}"
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                out = out or pq.ParquetWriter(where, batch.schema, filesystem=log.system)
                out.write_table(pa.Table.from_batches([batch]))
                n += batch.num_rows
        except BaseException:
            if out:
                out.close()
                log.remove([name])
            raise
        if out:
            out.close()
        return Staged(name if n else None, n)

    def commit(self, messages, batchId: int) -> None:
        Log(self.path).commit([(m.name, m.rows) for m in messages if m is not None and m.name], self.writer, batchId, self.rows, self.seconds)

    def abort(self, messages, batchId: int) -> None:
        """What the tasks that ended have staged goes."""
        Log(self.path).remove([m.name for m in messages if m is not None and m.name])


def append(rows: DataFrame, path: str, log: str, writer: str = "default", every: int = ROWS, seconds: float = SECONDS):
    """A stream of rows as a DataStreamWriter into <path>/<log>, in the columns of telemetry.LOGS; start() it with a checkpoint.

    After the query has stopped, drain() makes data of what still waits, and removes what failed tasks have left.
    """
    rows.sparkSession.dataSource.register(LogSource)
    out = log_rows(rows, log).writeStream.format("gridloom_log").option("path", f"{path.rstrip('/')}/{log}").option("writer", writer)
    return out.option("rows", every).option("seconds", seconds).outputMode("append")


def drain(path: str, log: str) -> None:
    """Publishes all that is staged and removes files that no manifest names; no query writes the log meanwhile."""
    own = Log(f"{path.rstrip('/')}/{log}")
    own.make()
    m = own.load()
    own.publish(m, ROWS)
    named = {f for f, _ in own.load().staged}
    own.remove([f for f in (n.rsplit("/", 1)[1] for n in names_of(f"{own.path}/staged", ".parquet")) if f not in named])


def read(spark: SparkSession, path: str, log: str) -> DataFrame:
    """All rows of a log that are committed; none if it is not there."""
    own = Log(f"{path.rstrip('/')}/{log}")
    m = own.load()
    out = spark.createDataFrame([], LOGS[log])
    if names_of(f"{own.path}/data", ".parquet"):
        data = spark.read.schema(LOGS[log]).parquet(f"{own.path}/data")
        out = out.unionByName(data.where(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint") <= m.published).select(*out.columns))
    if m.staged:
        out = out.unionByName(spark.read.schema(LOGS[log]).parquet(*[f"{own.path}/staged/{f}" for f, _ in m.staged]))
    return out
