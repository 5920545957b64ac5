"""Exact enrichment of a user's names: the public `last_state`, `state_to_lang` and `list_states`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rollscope.functions.names import normalize_name
from rollscope.operators.ranking import has_column, keep_first


def join_state_corpus(df: DataFrame, column: str, corpus: DataFrame, null_safe: bool = False) -> DataFrame:
    """Adds `__last_name` and the corpus columns; names that the corpus lacks get nulls."""
    keyed = df.withColumn("__last_name", normalize_name(column))
    right = corpus.withColumnRenamed("last_name", "_corpus_name")
    same = F.col("__last_name").eqNullSafe(F.col("_corpus_name")) if null_safe else F.col("__last_name") == F.col("_corpus_name")
    return keyed.join(right, same, "left").drop("_corpus_name")


def last_state(df: DataFrame, column: str, corpus: DataFrame, order_by: str | None = None, null_safe: bool = False) -> DataFrame:
    """The state distribution of each last name.

    Rows are de-duplicated on the raw column, so `Sood` and `sood` both stay; the first row by `order_by` wins, by
    default in read order as far as Spark keeps one. Without the column the input is returned as it is.
    """
    if not has_column(df, column):
        return df
    order = order_by or "_at"
    rows = df if order_by else df.withColumn("_at", F.monotonically_increasing_id())
    return join_state_corpus(keep_first(rows, [column], [order]).drop("_at"), column, corpus, null_safe)


def state_to_lang(df: DataFrame, column: str, dimension: DataFrame, normalize: bool = False) -> DataFrame:
    """Adds the languages of the state; `normalize` ignores case and outer blanks."""
    if not has_column(df, column):
        return df
    key = normalize_name if normalize else F.col
    right = dimension.drop("seq").withColumn("_state", key("state")).drop("state")
    return df.withColumn("_key", key(column)).join(right, F.col("_key") == F.col("_state"), "left").drop("_key", "_state")


def list_states(corpus: DataFrame, column: str = "state") -> DataFrame:
    """Distinct states of a long corpus, in order; of a wide one, its label columns."""
    if column in corpus.columns:
        return corpus.select(column).distinct().orderBy(column)
    labels = [c for c in corpus.columns if c not in ("last_name", "total_n")]
    return corpus.sparkSession.createDataFrame([(c,) for c in labels], f"{column} string")


def column_range(df: DataFrame, first: str, last: str, *keep: str) -> DataFrame:
    """The columns from `first` to `last`, both included, in the order of the table, after those to keep."""
    names = df.columns
    return df.select(*(F.col(f"`{c}`") for c in [*keep, *names[names.index(first) : names.index(last) + 1]]))


def label_union(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(label): the distinct labels of all of the columns, without null."""
    return df.select(F.explode(F.array_distinct(F.array(*columns))).alias("label")).filter("label is not null").distinct()


def with_codes(df: DataFrame, column: str, codes: DataFrame, name: str = "code") -> DataFrame:
    """Adds the code of the column's label by a table (label, code); labels without one get null."""
    return df.join(codes.select(F.col("label").alias(column), F.col("code").alias(name)), column, "left")


def with_labels(df: DataFrame, column: str, codes: DataFrame, name: str = "label") -> DataFrame:
    """Adds the label of a code, the way back."""
    return df.join(codes.select(F.col("code").alias(column), F.col("label").alias(name)), column, "left")
