"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the session's checkpoint folder. Where neither is set, a local
    session, whose driver and executors are one process, gets a folder of its own; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridgeline-"))
    return spark.sparkContext.getCheckpointDir()


class Stored:
    """Tables written to the shared folder, which cuts lineage: a lost executor costs no earlier stage.

    ``put`` writes and reads back; ``drop`` deletes a table that no later plan reads. What is left, which plans that
    were returned still read, is deleted when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        path = self._path(self.at)
        self._system(path).deleteOnExit(path)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = self.new()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def new(self) -> str:
        """A path that nothing is at yet."""
        self.n += 1
        return f"{self.at}/{self.n}"

    def drop(self, path: str) -> None:
        where = self._path(path)
        self._system(where).delete(where, True)
