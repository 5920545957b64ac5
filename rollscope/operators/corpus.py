"""State distributions and language weights of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rollscope.constants import LANG_ORDER, LANG_WEIGHTS, STATE_COLUMNS
from rollscope.functions.names import clean_language
from rollscope.operators.counts import name_state_counts


def state_proportions(df: DataFrame, key: str = "last_name", state: str = "state") -> DataFrame:
    """Long form: (key, state, n, total_n, proportion)."""
    counts = name_state_counts(df, key, state).withColumnRenamed("count", "n")
    total = df.groupBy(key).agg(F.count(state).alias("total_n"))
    return counts.join(total, key).withColumn("proportion", F.col("n") / F.col("total_n"))


def pivot_states(counts: DataFrame, labels: Sequence[str], value: str = "count", key: str = "last_name", state: str = "state") -> DataFrame:
    """Wide form with one column a label, 0 where there is none. The labels are given, so no job looks for them."""
    sums = [F.sum(F.when(F.col(state) == c, F.col(value))).alias(c) for c in labels]
    return counts.groupBy(key).agg(*sums).na.fill(0, list(labels))


def build_state_corpus(df: DataFrame, labels: Sequence[str] = STATE_COLUMNS, key: str = "last_name", state: str = "state") -> DataFrame:
    """Wide form: key, one proportion a label, total_n. One aggregation: no join, no window."""
    known = F.col(state).isin(list(labels))
    counts = [F.count_if(F.col(state) == c).alias(c) for c in labels]
    wide = df.filter(known).groupBy(key).agg(F.count("*").alias("total_n"), *counts)
    return wide.select(key, *((F.col(f"`{c}`") / F.col("total_n")).alias(c) for c in labels), "total_n")


def match_states(states: DataFrame, dimension: DataFrame, column: str = "state") -> DataFrame:
    """Each state with the last dimension row whose name contains it (`jk` and underscores spelled out), or null.

    The dimension is a few dozen states; the other side is distinct state names.
    """
    said = F.replace(F.lower(column), F.lit("_"), F.lit(" "))
    said = F.when(said == "jk", "jammu and kashmir").otherwise(said)
    small = dimension.select(F.lower("state").alias("_dim"), F.col("state").alias("_name"), F.col("seq").alias("_seq"))
    distinct = states.select(column).distinct().withColumn("_said", said)
    joined = distinct.join(small, F.col("_dim").contains(F.col("_said")), "left")
    return joined.groupBy(column).agg(F.max_by("_name", "_seq").alias("matched"))


def state_langs(states: DataFrame, dimension: DataFrame, column: str = "state") -> DataFrame:
    """(state, first, second, third, fourth): the four most spoken languages in lower case, null for unmatched states."""
    spoken = ["most_spoken_lang", "second_most_spoken_lang", "third_most_spoken_lang", "fourth_most_spoken_lang"]
    matched = match_states(states, dimension, column)
    rows = matched.join(dimension.withColumnRenamed("state", "matched"), "matched", "left")
    picked = [F.lower(c).alias(n) for c, n in zip(spoken[1:], ["second", "third", "fourth"], strict=True)]
    return rows.select(column, clean_language(spoken[0]).alias("first"), *picked)


def allocate_languages(counts: DataFrame, langs: DataFrame, state: str = "state") -> DataFrame:
    """(last_name, lang, weight) rows: the count split over the state's four languages.

    Where two ranks name one language the later rank's weight stands, not the sum. The names of a state without
    languages stay, with a null language and no weight.
    """
    ranks = ["first", "second", "third", "fourth"]
    entries = F.array(*(F.struct(F.lit(r).alias("r"), F.col(c).alias("lang"), F.lit(w).alias("w")) for r, (c, w) in enumerate(zip(ranks, LANG_WEIGHTS, strict=True))))
    last = F.filter("_langs", lambda x: x["lang"].isNotNull() & ~F.exists("_langs", lambda y: (y["lang"] == x["lang"]) & (y["r"] > x["r"])))
    return (
        counts.join(langs, state, "left")
        .withColumn("_langs", entries)
        .withColumn("_one", F.explode_outer(last))
        .select("last_name", F.col("_one.lang").alias("lang"), (F.col("count") * F.coalesce("_one.w", F.lit(0.0))).alias("weight"))
    )


def build_language_corpus(allocated: DataFrame, labels: Sequence[str] = LANG_ORDER) -> DataFrame:
    """Wide form: lower-cased name, one summed weight a language."""
    low = allocated.withColumn("last_name", F.lower("last_name"))
    return pivot_states(low, labels, value="weight", state="lang")


def apply_transliteration(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Full outer merge of counts with (Name, Translated); the translation becomes the name."""
    joined = counts.join(dictionary, counts["last_name"] == dictionary["Name"], "full_outer")
    return joined.select(F.col("Translated").alias("last_name"), "count", "state")


def pending_names(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names that the dictionary doesn't have yet."""
    known = dictionary.select(F.col("Name").alias("last_name"))
    return names.select("last_name").distinct().join(known, "last_name", "left_anti")
