"""Hashes, ranks and first rows by group, without one task for a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 4096


def hash32(key: Column | str, seed: int | str = 0) -> Column:
    """The first 32 bits of md5 over seed and key, the same in any SQL engine that has md5."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")


def hash_rank(df: DataFrame, by: Sequence[str], hashed: Column, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the 1-based rank by (hash, ties) in each group of `by`.

    Ranks are taken inside PARTS slices of the hash and added to the slices' counts, so a group of any size is
    spread over many tasks.
    """
    by = list(by)
    keyed = df.withColumn("_hash", hashed).withColumn("_part", F.floor(F.col("_hash") / (2**32 / PARTS)).cast("int"))
    counts = keyed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_part").orderBy("_hash", *ties)
    ranked = keyed.withColumn("_inside", F.row_number().over(inside))
    base = base.withColumnsRenamed({c: f"_by_{c}" for c in [*by, "_part"]})
    at = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in [*by, "_part"]]
    out = ranked.join(base, at).withColumn(name, F.col("_base") + F.col("_inside"))
    return out.drop("_hash", "_part", "_inside", "_base", *(f"_by_{c}" for c in [*by, "_part"]))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`, nulls first; rows are combined before the shuffle. Null keys are one key."""
    if len(order) == 1 and set(df.columns) <= {*key, *order} and order[0] not in key:  # nothing else to carry, so no sort is needed
        least = F.when(F.bool_or(F.col(order[0]).isNull()), F.lit(None)).otherwise(F.min(order[0]))
        return df.groupBy(*key).agg(least.cast(df.schema[order[0]].dataType).alias(order[0])).select(df.columns)
    row = F.struct(*df.columns)
    picked = df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def has_column(df: DataFrame, column: str) -> bool:
    """Whether the column is there; says so if it isn't. No job runs."""
    if column in df.columns:
        return True
    print(f"The input has no column {column}; it is returned unchanged.")
    return False
