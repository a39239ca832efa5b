"""Tables written between jobs, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Unset, it is set to a temporary folder if all of Spark runs in this process, as in
    tests; on a cluster, whose executors could not read that, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def small_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """df, whose session from now on hands Python workers Arrow batches of about size bytes, however long the texts are.

    The setting is read when a plan runs, which is after these operators return, so it stays as it is.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that df has no column of, whatever their case, one for each name given."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


class Scratch:
    """Writes frames as Parquet under the shared folder, so that a lost executor costs one task and not the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[str] = []

    def save(self, df: DataFrame, label: str = "t", by: tuple[str, ...] = (), plain: tuple[str, ...] = ()) -> DataFrame:
        """Writes df, in folders by the columns of by, and returns the written table.

        plain: columns whose values seldom repeat (a.list.element for those of a list), which are written without a dictionary.

        The driver's garbage is collected, as Spark drops the shuffle files of finished jobs only when their plans are.
        """
        path = f"{self.base}/{self._n:03d}-{label}"
        self._n += 1
        writer = df.write.partitionBy(*by) if by else df.write
        writer.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(path)
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._paths.append(path)
        return out

    def finish(self, df: DataFrame, label: str = "result") -> DataFrame:
        """Writes a result, deletes all else that was saved, and returns the written result."""
        out = self.save(df, label)
        for path in self._paths[:-1]:
            self._delete(path)
        self._paths = self._paths[-1:]
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of save() that no later step reads."""
        self._delete(df._scratch_path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
