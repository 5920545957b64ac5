"""Name counts and filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from rollscope.constants import EXCLUDED_STATES, MIN_COUNT, MIN_LENGTH, MIN_OCCURRENCE, NO_LAST
from rollscope.functions.names import sex_code


def name_counts(df: DataFrame, key: str = "last_name") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"))


def name_state_counts(df: DataFrame, key: str = "last_name", state: str = "state") -> DataFrame:
    return df.groupBy(key, state).agg(F.count("*").alias("count"))


def merge_counts(*frames: DataFrame, keys: Sequence[str] = ("last_name", "state")) -> DataFrame:
    """Partial counts of separate files as one table."""
    return reduce(DataFrame.unionByName, frames).groupBy(*keys).agg(F.sum("count").alias("count"))


def cleanup_counts(df: DataFrame) -> DataFrame:
    """Without repeated (last_name, state, count) rows and null names, summed again, largest first."""
    return (
        df.dropDuplicates(["last_name", "state", "count"])
        .na.drop(subset=["last_name"])
        .groupBy("last_name", "state")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "last_name", "state")
    )


def min_occurrence(df: DataFrame, n: int = MIN_OCCURRENCE, key: str = "last_name") -> DataFrame:
    """Rows whose key occurs n times or more. Counts are combined before the shuffle, then semi-joined."""
    return df.join(name_counts(df, key).filter(F.col("count") >= n), key, "left_semi")


def min_count(counts: DataFrame, n: int = MIN_COUNT) -> DataFrame:
    return counts.filter(F.col("count") > n)


def clean_names(df: DataFrame) -> DataFrame:
    """Rows with a readable last name and a sex, outside the excluded states."""
    name = F.col("last_name")
    return df.filter(
        (F.lower(name) != NO_LAST.lower())
        & ~F.col("state").isin(EXCLUDED_STATES)
        & (F.length(name) >= MIN_LENGTH)
        & F.col("sex").isNotNull()
    )


def name_share(df: DataFrame, key: str = "last_name") -> DataFrame:
    """(key, count, share): counts over their total, which is one row."""
    counts = name_counts(df, key)
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "count", (F.col("count") / F.col("total")).alias("share"))


def collect_by_name(df: DataFrame, columns: Sequence[str], key: str = "last_name") -> DataFrame:
    """The values of each column as a sorted list; meant for keys whose rows fit in one row."""
    return df.groupBy(key).agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in columns))


def female_share(df: DataFrame, key: str = "last_name", sex: str = "sex") -> DataFrame:
    """(key, female_prop): readable entries that aren't male; null without readable ones."""
    return df.groupBy(key).agg(F.avg(sex_code(sex)).alias("female_prop"))


def ordered_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, labels): the labels of each key, most frequent first, ties by label."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"))
    by = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))))
    return counts.groupBy(key).agg(F.transform(by, lambda x: x["label"]).alias("labels"))


def unique_pairs(df: DataFrame, key: str = "last_name", state: str = "state") -> DataFrame:
    return df.select(key, state).distinct()


def state_percent(counts: DataFrame, key: str = "last_name") -> DataFrame:
    """Adds `percent` of the key's total."""
    return counts.withColumn("percent", F.col("count") / F.sum("count").over(Window.partitionBy(key)) * 100)


def attach_aggregate(predictions: DataFrame, aggregate: DataFrame, key: str = "last_name") -> DataFrame:
    """Predictions with a per-name aggregate; names without one drop out."""
    return predictions.join(aggregate, key)


def unroll_languages(df: DataFrame, column: str = "languages") -> DataFrame:
    """One row a language of the list column, as `lang`."""
    return df.withColumn("lang", F.explode(column)).drop(column)


def name_profile(counts: DataFrame, name: str) -> DataFrame:
    """The states of one name by percent; the filter reaches the scan."""
    return state_percent(counts.filter(F.col("last_name") == name)).orderBy(F.desc("percent"), "state")


def popularity_slice(df: DataFrame, n: int = 3000, end: str = "top", key: str = "last_name") -> DataFrame:
    """The n most or least frequent names, ties by name."""
    order = F.desc("count") if end == "top" else F.asc("count")
    return name_counts(df, key).orderBy(order, key).limit(n)


def frequency_summary(counts: DataFrame, value: str = "count", quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.997)) -> DataFrame:
    """One row: min, mean, max and linearly interpolated quantiles."""
    found = [F.percentile(value, q).alias(f"q{str(q)[2:]}") for q in quantiles]
    return counts.agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), *found)


def summary_sketches(rows: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """(by, n, least, most, total, quantiles, names) of rows: counters, a quantile sketch of `value` and a sketch of distinct `name`s.

    The opt-in form of `frequency_summary` and of distinct counts: sketches of single files are kept and merged later, so that
    no value is read twice. Ranks are off by 1.65 % at most with a probability of 99 % (k = 200), distinct counts by 0.8 % in the
    mean (lg k = 14). They hold some kB each, whatever the number of rows.
    """
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"),
        F.sum(F.col(value).cast("double")).alias("total"),
        F.kll_sketch_agg_double(F.col(value).cast("double")).alias("quantiles"), F.hll_sketch_agg(name, F.lit(14)).alias("names"),
    )


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of parts as those of the whole; merging merged ones again is the same."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("names").alias("names"),
    )


def read_sketches(sketches: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.997)) -> DataFrame:
    """The columns of `frequency_summary` and `distinct`, as estimated from sketches; min, mean and max are exact."""
    kept_ = [c for c in sketches.columns if c not in ("n", "least", "most", "total", "quantiles", "names")]
    found = [F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q))).alias(f"q{str(q)[2:]}") for q in quantiles]
    return sketches.select(
        *kept_, F.col("least").alias("min"), (F.col("total") / F.col("n")).alias("mean"), F.col("most").alias("max"), *found,
        F.hll_sketch_estimate("names").alias("distinct"),
    )


def first_appearance_codes(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): values numbered from 0 by where they first appear."""
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("at"))
    return first.select(value, (F.row_number().over(Window.orderBy("at", value)) - 1).alias("code"))


def char_vocab(df: DataFrame, column: str = "last_name") -> DataFrame:
    """(char, code): the letters in use, numbered from 1 in order."""
    letters = df.select(F.explode(F.split(column, "")).alias("char")).filter("char <> ''").distinct()
    return letters.withColumn("code", F.row_number().over(Window.orderBy("char")))
