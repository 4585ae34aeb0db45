"""Lineage cuts through tables written in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; local masters may do without it.

    A session on a real cluster that names no folder is refused, since a
    machine-local one would be invisible to the other executors.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="lattica-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system layer."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


#: Rows of a file and task where the number of rows is known.
FILE_ROWS = 50_000


class Scratch:
    """Tables of one operator call: ``keep`` writes one and reads it back.

    The folder goes when the JVM ends, also after ``spark.stop()``; tables that
    no later step reads can go earlier by ``drop``, all of them by ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/lattica-{uuid.uuid4().hex}"
        system, target = _file_system(spark, self.path)
        system.mkdirs(target)
        system.deleteOnExit(target)
        self._n = 0

    def keep(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet in the shared folder and return the written table.

        With ``rows``, about how many narrow rows it has, a small table is made by few tasks and
        written in few files, ``FILE_ROWS`` rows in each; every file costs its executor a start of a process.
        """
        self._n += 1
        if rows is not None:
            df = df.coalesce(1 + rows // FILE_ROWS)
        path = f"{self.path}/{self._n:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``keep`` returned."""
        delete(self.spark, df._scratch_path)

    def close(self) -> None:
        """Delete all tables of this call."""
        delete(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()
