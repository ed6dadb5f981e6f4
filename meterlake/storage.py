"""Durable intermediate tables in the shared folder of the session."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor must be able to reach.

    It is the setting `spark.checkpoint.dir`, or else what `SparkContext.setCheckpointDir` was given.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        raise ValueError(f"Set {CHECKPOINT_DIR} to a folder that all executors can reach.")
    return folder.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    return [s.getPath().getName() for s in store.listStatus(where) if s.isDirectory()]


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly in a folder; none if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    return [s.getPath().getName() for s in store.listStatus(where) if s.isFile()]


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_small(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one of this name; tells whether it was written.

    The file is filled under another name and then renamed, and the store refuses the second rename to a
    name, so of several writers one wins and readers see whole files only.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    # File contexts rename without overwriting, in one step where the store can.
    context = hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    own = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        context.rename(own, where, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        return True
    except Py4JJavaError as error:
        store.delete(own, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass()):
            return False
        raise


class Scratch:
    """Tables stored while one operator runs.

    Stored steps survive lost executors and cut the plan. `release` stores the operator's small
    result beside them and removes the rest; `clear` removes everything still held.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/meterlake/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def store(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        df.write.partitionBy(*(partition_by or [])).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame) -> None:
        """Remove a stored table that is no longer read."""
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if f"{self.root.split(':', 1)[-1].lstrip('/')}/" in folder:
                delete_folder(self.spark, folder)

    def release(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}-result"
        df.write.parquet(path)
        self.clear()
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        delete_folder(self.spark, self.root)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table once and read it back, so that later steps do not recompute it."""
    return Scratch(df.sparkSession, name).store(df, name, partition_by)
