"""Labels from arrays of values; ties go by label order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def argmax(values: Sequence[Column | str], labels: Sequence[str]) -> Column:
    """The first label with the largest value; null if all values are null."""
    found = F.array(*values)
    names = F.array(*map(F.lit, labels))
    return F.get(names, F.array_position(found, F.array_max(found)).cast("int") - 1)


def modal_label(df: DataFrame, labels: Sequence[str], name: str = "modal") -> DataFrame:
    return df.withColumn(name, argmax([F.col(f"`{c}`") for c in labels], labels))


def top_k(values: Sequence[Column | str], labels: Sequence[str], k: int) -> Column:
    """The labels of the k largest values, ties by label order, as structs (value, label)."""
    entries = [
        F.struct((-F.col(f"`{v}`") if isinstance(v, str) else -v).alias("nv"), F.lit(i).alias("i"), F.lit(c).alias("label"))
        for i, (v, c) in enumerate(zip(values, labels, strict=True))
    ]
    return F.slice(F.sort_array(F.array(*entries)), 1, k)


def top3_labels(df: DataFrame, labels: Sequence[str], names: Sequence[str] = ("first_lang", "second_lang", "third_lang")) -> DataFrame:
    """The k-th is the first label, among the k largest values, whose value equals the smallest of those.

    So with equal values the second can repeat the first: it is not a plain rank.
    """
    top = top_k(list(labels), labels, 3)
    kth = lambda k: F.get(F.filter(F.slice("_top", 1, k), lambda x: x["nv"] == F.get("_top", F.lit(k - 1))["nv"]), F.lit(0))["label"]
    out = df.withColumn("_top", top)
    return out.withColumns({n: kth(k) for k, n in enumerate(names, 1)}).drop("_top")


def three_heads(first: Column, second: Column, third: Column) -> Column:
    """Three ranked label lists as one list of three labels.

    The second falls back to its runner-up if it repeats the first; the third to its third choice if it repeats
    either, whatever that is.
    """
    one, two, three = first[0], second[0], third[0]
    two = F.when(two == one, second[1]).otherwise(two)
    return F.array(one, two, F.when((three == one) | (three == two), F.try_element_at(third, F.lit(3))).otherwise(three))
