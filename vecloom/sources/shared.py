"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and Spark runs in one process, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="vecloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def table(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes `df` once as Parquet to the shared folder and reads it back: later steps neither repeat its work nor
    depend on an executor that may be lost, and Spark knows its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vecloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of what `table` gave, once nothing that is still to run reads them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that are deleted together."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        self.made.append(table(df, name))
        return self.made[-1]

    def parts(self, df: DataFrame, by: str, name: str = "table") -> DataFrame:
        """A table in folders by the values of a column."""
        path = f"{shared_folder(df.sparkSession)}/vecloom-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(by).parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        out.written_to = path
        self.made.append(out)
        return out

    def drop_first(self) -> None:
        """Deletes the oldest table."""
        discard(self.made.pop(0))

    def clear(self) -> None:
        discard(*self.made)
        self.made.clear()
