"""Splits and samples. All are functions of hashes, so reruns, recomputed tasks and other engines agree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollscope.operators.ranking import hash32, hash_rank
from rollscope.sources.shared import kept

SCALE = 10_000
#: Steps of a histogram, and rows among which the last one of a sample is looked up; both come to the driver.
BINS = 4096
SMALL = 10_000


def split_bucket(key: Column | str, fractions: Sequence[float], seed: int = 0) -> Column:
    """Which part, from 0, a key falls in; a key never falls in two."""
    at = hash32(key, seed) % SCALE
    edge, out = 0.0, F.lit(len(fractions) - 1)
    cuts = []
    for fraction in fractions[:-1]:
        edge += fraction
        cuts.append(round(edge * SCALE))
    for i, cut in reversed(list(enumerate(cuts))):
        out = F.when(at < cut, F.lit(i)).otherwise(out)
    return out


def split_by_key(df: DataFrame, key: str, fractions: Sequence[float] = (0.8, 0.2), seed: int = 0) -> DataFrame:
    """Adds `part`; rows of one key stay together. (0.8, 0.1, 0.1) makes three, (0.9025, 0.0475, 0.05) the nested one."""
    return df.withColumn("part", split_bucket(key, fractions, seed))


def stratified_split(df: DataFrame, key: str, by: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds `part`: 1 for round(fraction * n) rows of each class, picked by hash; 0 for the others."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_by")
    ranked = hash_rank(df, [by], hash32(key, seed), [key], "_r")
    joined = ranked.join(sizes, ranked[by].eqNullSafe(sizes["_by"]))
    return joined.withColumn("part", (F.col("_r") <= F.round(F.col("_n") * fraction)).cast("int")).drop("_r", "_n", "_by")


def sample_per_group(df: DataFrame, key: str, by: str, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    return stratified_split(df, key, by, fraction, seed).filter("part = 1").drop("part")


def _cut(rows: DataFrame, column: str, n: int, low: float | None = None, high: float | None = None) -> tuple[float, float, int, int] | None:
    """(low, high, before, inside): the n-th smallest value lies from low to high; so many rows lie before and inside.

    Each pass counts into BINS equal steps, of which the one with the n-th value is cut next, until it has SMALL rows or one
    value. None if there are fewer than n rows.
    """
    if low is None or high is None:
        low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return None
    before = 0
    while True:
        width = (high - low) / BINS or 1.0
        step = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS))
        inside = rows.filter(F.col(column).between(low, high)).groupBy(step.alias("step"))
        steps = inside.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # BINS + 1 rows
        for at in sorted(steps, key=lambda r: r["low"]):
            if before + at["n"] >= n:
                break
            before += at["n"]
        else:
            return None
        low, high = at["low"], at["high"]
        if at["n"] <= SMALL or low == high:
            return low, high, before, at["n"]


def _any(rows: DataFrame, n: int) -> DataFrame:
    """n of equal rows, counted off partition by partition."""
    rows = kept(rows.withColumn("_part", F.spark_partition_id()))
    quota, left = {}, n
    for part, size in sorted(rows.groupBy("_part").count().collect()):  # a row a partition
        quota[part] = min(size, left)
        left -= quota[part]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = 0
        for batch in batches:
            mine = quota[batch.column("_part")[0].as_py()] - taken if batch.num_rows else 0
            taken += min(mine, batch.num_rows)
            yield batch.slice(0, mine)

    return rows.mapInArrow(take, rows.schema).drop("_part")


def smallest(df: DataFrame, n: int, score: Column, ties: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The n rows with the smallest (score, ties, hash of the row); rows without a score are none of them.

    The n-th score is narrowed down by histograms to a bin of a bounded number of rows, among which the n-th row is looked
    up; the result is a filter on the input. No sort and no limit spans the rows. Only if more than SMALL rows have the very
    score of the n-th are they cut by `ties` and then by their hashes, and only equal rows are counted off. Known bounds
    of the score save a pass.
    """
    hashed = [c for c in df.columns if df.schema[c].dataType.typeName() != "map"]
    rows = df.withColumn("_score", score.cast("double")).withColumn("_row", F.pmod(F.xxhash64(*hashed), F.lit(2**53)).cast("double"))
    rows = rows.filter(F.col("_score").isNotNull() & ~F.isnan("_score"))
    cut = _cut(rows, "_score", n, low, high) if n > 0 else None
    if cut is None:
        return (rows if n > 0 else rows.filter("false")).select(df.columns)
    low, high, before, inside = cut
    sure, edge = F.col("_score") < low, F.col("_score").between(low, high)
    if inside > SMALL:
        for at in rows.filter(edge).groupBy(ties).count().orderBy(ties).toLocalIterator():
            if before + at["count"] >= n:
                break
            before += at["count"]
        sure, edge = sure | edge & F.coalesce(F.col(ties) < F.lit(at[ties]), F.lit(at[ties] is not None)), edge & F.col(ties).eqNullSafe(F.lit(at[ties]))
        low, high, more, inside = _cut(rows.filter(edge), "_row", n - before)
        sure, edge, before = sure | edge & (F.col("_row") < low), edge & F.col("_row").between(low, high), before + more
    if inside > SMALL:  # of one hash
        return rows.filter(sure).unionByName(_any(rows.filter(edge), n - before)).select(df.columns)
    order = F.struct("_score", ties, "_row")
    found = [r[0] for r in rows.filter(edge).select(order).orderBy(order).collect()]  # SMALL rows at most
    last = found[n - before - 1]
    at = F.struct(F.lit(last[0]).alias("_score"), F.lit(last[1]).cast(df.schema[ties].dataType).alias(ties), F.lit(last[2]).alias("_row"))
    if found.count(last) == found[: n - before].count(last):
        return rows.filter(sure | edge & (order <= at)).select(df.columns)
    equal = _any(rows.filter(edge & (order == at)), found[: n - before].count(last))
    return rows.filter(sure | edge & (order < at)).unionByName(equal).select(df.columns)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The n rows with the smallest hashes of `key`, ties by key."""
    return smallest(df, n, hash32(key, seed), key, 0.0, 2.0**32)


def weighted_sample(df: DataFrame, n: int, key: str, weight: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, likelier with more weight: the smallest -ln(u) / weight. Weights are finite; none under 0 counts."""
    u = (hash32(key, seed) + 1) / F.lit(2.0**32 + 1)
    return smallest(df.filter(F.col(weight) > 0), n, -F.log(u) / F.col(weight), key)


def bootstrap_per_group(df: DataFrame, key: str, by: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """`draws` rows of each group with replacement; adds `draw`. Each draw is a hashed row number, met by equi-join."""
    ranked = hash_rank(df, [by], hash32(key, seed), [key], "_r")
    sizes = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    numbers = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    which = hash32(F.concat_ws(":", F.col(by).cast("string"), F.col("draw")), f"{seed}-draw") % F.col("_n") + 1
    picks = numbers.select(by, "draw", which.alias("_r"))
    return ranked.join(picks, [by, "_r"]).drop("_r")


def bootstrap(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows with replacement."""
    return bootstrap_per_group(df.withColumn("_all", F.lit(1)), key, "_all", n, seed).drop("_all")


def balanced_draws(df: DataFrame, key: str, by: str, n: int, seed: int = 0) -> DataFrame:
    """n draws, each of a uniform class and then of a uniform row in it; adds `draw`."""
    ranked = hash_rank(df, [by], hash32(key, seed), [key], "_r")
    sizes = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    classes = sizes.withColumn("_c", F.row_number().over(Window.orderBy(by)) - 1)
    total = sizes.agg(F.count("*").alias("_k"))  # one row
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total))
    draws = draws.withColumn("_c", (hash32("draw", f"{seed}-class") % F.col("_k")).cast("int"))
    picks = draws.join(classes, "_c").select(by, "draw", (hash32("draw", f"{seed}-row") % F.col("_n") + 1).alias("_r"))
    return ranked.join(picks, [by, "_r"]).drop("_r")


def every_nth(df: DataFrame, key: str, by: str, n: int = 999) -> DataFrame:
    """Rows 1, n + 1, 2n + 1, ... of each group in hash order."""
    ranked = hash_rank(df, [by], hash32(key), [key], "_r")
    return ranked.filter((F.col("_r") - 1) % n == 0).drop("_r")
