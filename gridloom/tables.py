"""Tables written between steps, in the folder that all of the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Unset, a session that runs in this process gets a temporary folder; on a cluster, whose
    executors could not read that, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Tables:
    """What several branches read, or what a round leaves for the next, written once under the shared folder.

    Plans that hold all of the steps before them grow by a factor with each, and a lost executor would cost the lineage of
    them all; a written table cuts both.
    """

    def __init__(self, df: DataFrame, name: str = "frames"):
        self.spark = df.sparkSession
        self.base = f"{shared_folder(self.spark)}/gridloom/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{self._n:03d}-{name}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of save() that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
