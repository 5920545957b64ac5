"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollscope.sources.shared import delete_folder, shared_folder

__all__ = ["bounded_batches", "checkpointed", "delete_folder", "shared_folder", "table", "with_columns_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def with_columns_of(rows: DataFrame, f: Callable, kinds: str, *columns: str) -> DataFrame:
    """doc_id and the columns that `f` makes of the given ones, in Arrow batches; doc_id itself stays in the JVM."""
    return rows.select("doc_id", F.pandas_udf(f, kinds)(*columns).alias("_made")).select("doc_id", "_made.*")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Hold Arrow batches to so many rows and bytes, so that long texts don't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
