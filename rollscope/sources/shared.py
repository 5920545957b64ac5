"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where that is unset, as in tests, a folder in its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; what is read from it is fixed."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Folders that `new_folder` has named, until `clear_shared`.
_NAMED: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which `clear_shared` deletes."""
    _NAMED.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again; unlike what `kept` gives, it has a known size."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Delete what this process has put into the shared folder under names of its own; results that read it must be used before."""
    while _NAMED:
        delete_folder(spark, _NAMED.pop())
