"""Nearest names: by edit distance, by character n-gram cosine and by sequence ratio."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from rollscope.functions.names import char_ngrams
from rollscope.operators.blocks import cosine_answers, edit_answers, in_blocks, ratio_answers
from rollscope.operators.labels import argmax
from rollscope.operators.ranking import has_column
from rollscope.sources.shared import kept

CUTOFF = 0.6
#: Postings of one gram in one piece.
PIECE = 5000


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Over all partitions: names are few bytes, by which partitions would be merged, and much work each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _nearest(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k of each query; Spark limits groups before and after the shuffle."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def _segment(n: Column, i: Column, t: int) -> tuple[Column, Column]:
    """Start, from 1, and size of the i-th of t + 1 segments of a name of n letters; the last ones have one letter more."""
    base, longer = F.floor(n / (t + 1)).cast("int"), (n % (t + 1)).cast("int")
    before = i - 1 - (t + 1 - longer)
    return (i - 1) * base + F.greatest(before, F.lit(0)) + 1, base + (i > t + 1 - longer).cast("int")


def segment_index(names: DataFrame, t: int) -> DataFrame:
    """(neighbour, _n, _i, _seg): names of more than t letters cut into t + 1 segments."""
    cut = names.withColumn("_n", F.length("neighbour")).filter(F.col("_n") > t).withColumn("_i", F.explode(F.array(*map(F.lit, range(1, t + 2)))))
    start, size = _segment(F.col("_n"), F.col("_i"), t)
    return cut.select("neighbour", "_n", "_i", F.substring("neighbour", start, size).alias("_seg"))


def segment_probes(queries: DataFrame, t: int) -> DataFrame:
    """(query, _n, _i, _seg): what of a query can be the i-th segment of a name of n letters within t edits.

    One segment is unchanged with at most i - 1 edits before it and t + 1 - i after it, which bounds its shift from both ends.
    """
    asked = queries.select("query", F.length("query").alias("_q")).filter("_q > 0")
    low = F.greatest(F.lit(t + 1), F.col("_q") - t)
    each = asked.withColumn("_n", F.explode(F.sequence(low, F.col("_q") + t))).withColumn("_i", F.explode(F.array(*map(F.lit, range(1, t + 2)))))
    start, size = _segment(F.col("_n"), F.col("_i"), t)
    each = each.withColumns({"_start": start, "_size": size, "_shift": F.col("_q") - F.col("_n")})
    first = F.greatest(F.lit(1), F.expr("_start - _i + 1"), F.expr(f"_start + _shift - ({t} + 1 - _i)"))
    final = F.least(F.expr("_q - _size + 1"), F.expr("_start + _i - 1"), F.expr(f"_start + _shift + ({t} + 1 - _i)"))
    placed = each.withColumns({"_first": first, "_final": final}).filter("_first <= _final").withColumn("_at", F.explode(F.sequence("_first", "_final")))
    return placed.select("query", "_n", "_i", F.substring("query", F.col("_at"), F.col("_size")).alias("_seg"))


def letters_of(name: str) -> Column:
    return F.array_distinct(F.filter(F.split(name, ""), lambda x: x != ""))


def within_edits(queries: DataFrame, names: DataFrame, t: int, k: int | None = None, small_too: bool = True) -> DataFrame:
    """(query, neighbour, distance): names within t edits of distinct queries; with k, those that can be among the k first.

    Names of more than t letters meet queries on segments. Shorter ones meet them on a letter; a name that has none of the
    query's is at the distance of the longer length, so of these only the k first of each length can be among the k first.
    Without `small_too` no name is that short.
    """
    on = ["_n", "_i", "_seg"]
    met = spread(segment_probes(queries, t), *on).join(spread(segment_index(names, t), *on), on).select("query", "neighbour")
    if not small_too:
        return _checked(met, t)
    small = names.withColumn("_n", F.length("neighbour")).filter(F.col("_n") <= t)
    letters = small.select("neighbour", "_n", F.explode(letters_of("neighbour")).alias("_letter"))
    sizes = F.sequence(F.greatest(F.length("query") - t, F.lit(0)), F.least(F.lit(t), F.length("query") + t))
    near = queries.filter(F.length("query") <= 2 * t).withColumn("_n", F.explode(sizes))
    shared = spread(near.withColumn("_letter", F.explode(letters_of("query"))), "_n", "_letter").join(spread(letters, "_n", "_letter"), ["_n", "_letter"]).select("query", "neighbour")
    order = Window.partitionBy("_n").orderBy("neighbour")
    others = small if k is None else small.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    defaults = near.join(others, "_n").select("query", "neighbour")
    return _checked(met.unionByName(shared).unionByName(defaults), t)


def _checked(pairs: DataFrame, t: int) -> DataFrame:
    return pairs.withColumn("distance", F.expr(f"levenshtein(query, neighbour, {t})")).filter("distance >= 0").distinct()


def edit_knn(queries: DataFrame, corpus: DataFrame, k: int = 3, column: str = "last_name") -> DataFrame:
    """(query, neighbour, distance, rank): the k corpus names at the least edit distance, ties by name.

    Blocks of queries meet blocks of names: the segments of `within_edits` are too short to tell names apart from three edits on,
    and the pairs that met on them grew faster than the names.
    """
    asked = kept(queries.select(F.col(column).alias("query")).filter("query is not null").distinct())
    names = kept(corpus.select(F.col("last_name").alias("neighbour")).filter("neighbour is not null").distinct())
    found = in_blocks(names, asked, partial(edit_answers, k=k), "query string, neighbour string, distance int")
    return _nearest(found, k, F.col("distance"), F.col("neighbour"))


def ngram_counts(names: DataFrame, n: Sequence[int] = (2,), column: str = "last_name") -> DataFrame:
    """(name, gram, tf) of distinct names."""
    distinct = names.select(F.col(column).alias("name")).filter("name is not null").distinct()
    grams = F.concat(*(char_ngrams("name", i) for i in n))
    return distinct.select("name", F.explode(grams).alias("gram")).groupBy("name", "gram").agg(F.count("*").alias("tf"))


def ngram_features(names: DataFrame, n: Sequence[int] = (2,), max_df: float = 1.0, min_df: float = 1, column: str = "last_name") -> DataFrame:
    """(name, gram, tf, df, n_names): counts of grams with a document frequency in the given bounds.

    Bounds below 1, and max_df 1.0, are shares of the names; min_df of 1 or more is a number of names.
    """
    counts = ngram_counts(names, n, column)
    size = names.filter(F.col(column).isNotNull()).agg(F.count_distinct(column).alias("n_names"))  # one row
    low = F.col("n_names") * min_df if min_df < 1 else F.lit(min_df)
    df = counts.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size))
    kept = df.filter((F.col("df") <= F.col("n_names") * max_df) & (F.col("df") >= low))
    return counts.join(kept, "gram").select("name", "gram", "tf", "df", "n_names")


def gram_totals(names: DataFrame, n: Sequence[int] = (2,), column: str = "last_name") -> DataFrame:
    """(gram, df, total): how many names have each gram, and how often it occurs in all of them."""
    return ngram_counts(names, n, column).groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def tfidf(features: DataFrame) -> DataFrame:
    """(name, gram, w): tf * (ln((1 + n) / (1 + df)) + 1), each name scaled to length 1."""
    raw = features.withColumn("w", F.col("tf") * (F.log((1 + F.col("n_names")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("name")))
    return raw.select("name", "gram", (F.col("w") / length).alias("w"), "df", "n_names")


def gram_vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(name, v): the tf-idf vector of each name, of length 1, as structs (df, gram, w, reach), rare grams first.

    `reach` is the length of what is left of the vector from this gram on, so reach * reach - w * w is that after it.
    """
    raw = F.struct("df", "gram", (F.col("tf") * (F.log((1 + F.col("n_names")) / (1 + F.col("df"))) + 1)).alias("w"))
    rows = counts.join(idf, "gram").groupBy("name").agg(F.sort_array(F.collect_list(raw)).alias("v"))
    square = lambda part: F.aggregate(part, F.lit(0.0), lambda got, x: got + x["w"] * x["w"])
    rows = rows.withColumn("_norm", F.sqrt(square(F.col("v"))))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.struct(x["df"].alias("df"), x["gram"].alias("gram"), (x["w"] / F.col("_norm")).alias("w"))))
    reach = lambda x, i: F.struct(x["df"].alias("df"), x["gram"].alias("gram"), x["w"].alias("w"), F.sqrt(square(F.slice("v", i + 1, F.size("v")))).alias("reach"))
    return rows.select("name", F.transform("v", reach).alias("v"))


def postings(vectors: DataFrame) -> DataFrame:
    """(name, gram, reach, _tenth, _piece): lists cut by tenths of the reach, and long ones into pieces by name."""
    rows = vectors.select("name", F.inline("v"))
    return rows.select("name", "gram", "w", "reach", F.floor(F.col("reach") * 10).cast("int").alias("_tenth"), F.pmod(F.hash("name"), F.ceil(F.col("df") / PIECE).cast("int")).alias("_piece"))


def cosine_candidates(asked: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(query, neighbour), distinct: all pairs that can be similar by `least`, of vectors `asked` and `postings` lists.

    With the grams in one order, rare ones first, what two names share lies from their first shared gram on. So there the
    product of their weights and that of their reaches after it add up to their similarity at least. Common grams come
    last and are met by few.
    """
    least = least - 1e-8
    rows = asked.select(F.col("name").alias("query"), F.inline("v")).filter(F.col("reach") >= least).withColumnsRenamed({"reach": "_mine", "w": "_w"})
    tenth = F.least(F.floor(F.lit(max(least, 0.0)) / F.col("_mine") * 10).cast("int"), F.lit(10))
    rows = rows.withColumn("_tenth", F.explode(F.sequence(tenth, F.lit(10))))
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("df") / PIECE).cast("int") - 1)))
    on = ["gram", "_tenth", "_piece"]
    after = lambda reach, w: F.greatest(F.col(reach) * F.col(reach) - F.col(w) * F.col(w), F.lit(0.0))
    most = F.col("_w") * F.col("w") + F.sqrt(after("_mine", "_w") * after("reach", "w"))
    met = spread(rows.select("query", "_w", "_mine", *on), *on).join(spread(lists, *on), on).filter(most >= least)
    return met.select("query", F.col("name").alias("neighbour")).distinct()


def cosine_knn(queries: DataFrame, corpus: DataFrame, k: int = 3, max_df: float = 0.5, min_df: float = 1, column: str = "last_name") -> DataFrame:
    """(query, neighbour, similarity, rank): the k most similar names by tf-idf of bigrams.

    Similarities are rounded to nine places before ties go by name. Grams above max_df are no features. Blocks of queries meet
    blocks of names, so pairs that share a gram are not shuffled.
    """
    names = kept(corpus.select("last_name").filter("last_name is not null").distinct())
    n_names = names.count()
    counts = kept(ngram_counts(names))
    low = n_names * min_df if min_df < 1 else min_df
    df = counts.groupBy("gram").agg(F.count("*").alias("df")).filter((F.col("df") <= n_names * max_df) & (F.col("df") >= low))
    idf = kept(df.withColumn("n_names", F.lit(n_names)))
    known = kept(gram_vectors(counts, idf).select(F.col("name").alias("neighbour"), *_flat("v", "b")))
    mine = kept(gram_vectors(ngram_counts(queries, (2,), column), idf).select(F.col("name").alias("query"), *_flat("v", "a")))
    found = in_blocks(known, mine, partial(cosine_answers, k=k), "query string, neighbour string, similarity double", 24)  # rows are wide
    return _nearest(found, k, F.desc("similarity"), F.col("neighbour"))


def _flat(v: str, name: str) -> list[Column]:
    """Grams as numbers, two code points of 21 bits, and weights as parallel arrays."""
    code = lambda x: F.ascii(F.substring(x["gram"], 1, 1)).cast("long") * (1 << 21) + F.ascii(F.substring(x["gram"], 2, 1))
    return [F.transform(v, code).alias(f"{name}_gram"), F.transform(v, lambda x: x["w"]).alias(f"{name}_w")]


def _codes(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a string, 0 beyond its end, and the lengths."""
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    width = max(1, sizes.max(initial=0))
    raw = "".join(x.ljust(width, "\0") for x in strings).encode("utf-32-le")
    return np.frombuffer(raw, dtype=np.uint32).reshape(len(strings), width), sizes


def _longest_blocks(a: np.ndarray, b: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(start in a, start in b, size) of the longest common block of each span (low a, high a, low b, high b); the first in a, then in b."""
    at = np.arange(b.shape[1])
    open_b = (at >= spans[:, 2:3]) & (at < spans[:, 3:4])
    run = np.zeros((len(a), b.shape[1] + 1), dtype=np.int32)  # of the block that ends at this place of b and the last of a
    best = np.zeros((len(a), 3), dtype=np.int64)
    for i in range(spans[:, 0].min(initial=0), spans[:, 1].max(initial=0)):
        inside = (i >= spans[:, 0]) & (i < spans[:, 1])
        same = (a[:, i : i + 1] == b) & open_b & inside[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        end = run.argmax(axis=1)
        size = run[np.arange(len(a)), end]
        better = np.flatnonzero(size > best[:, 2])
        best[better] = np.stack([i + 1 - size, end - size, size], axis=1)[better]
    return best


def matched_letters(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Letters in the matching blocks of aligned strings: the longest common block, and those left and right of it in turn."""
    (codes_a, sizes_a), (codes_b, sizes_b) = _codes(a), _codes(b)
    total = np.zeros(len(a), dtype=np.int64)
    pair = np.arange(len(a))
    spans = np.stack([np.zeros_like(sizes_a), sizes_a, np.zeros_like(sizes_b), sizes_b], axis=1)
    step = max(1, (1 << 22) // codes_b.shape[1])
    while len(pair):
        found = np.concatenate([_longest_blocks(codes_a[pair[i : i + step]], codes_b[pair[i : i + step]], spans[i : i + step]) for i in range(0, len(pair), step)])
        np.add.at(total, pair, found[:, 2])
        hit = found[:, 2] > 0
        left = np.stack([spans[:, 0], found[:, 0], spans[:, 2], found[:, 1]], axis=1)
        right = np.stack([found[:, 0] + found[:, 2], spans[:, 1], found[:, 1] + found[:, 2], spans[:, 3]], axis=1)
        pair, spans = np.concatenate([pair[hit], pair[hit]]), np.concatenate([left[hit], right[hit]])
        some = (spans[:, 0] < spans[:, 1]) & (spans[:, 2] < spans[:, 3])
        pair, spans = pair[some], spans[some]
    return total


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over the total length, for a batch at a time; 1 for two empty strings, null for null.

    No letter counts as junk, however long the strings.
    """
    known = (a.notna() & b.notna()).to_numpy()
    x, y = a[known].tolist(), b[known].tolist()
    length = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], dtype=float)
    out = np.full(len(a), np.nan)
    out[known] = np.where(length > 0, 2.0 * matched_letters(x, y) / np.maximum(length, 1), 1.0) if len(x) else 0.0
    return pd.Series(out).where(known, None)


def closest_match(queries: DataFrame, corpus: DataFrame, cutoff: float = CUTOFF, column: str = "last_name") -> DataFrame:
    """(query, neighbour, ratio): the best sequence ratio of cutoff or more, ties to the later name; else nulls.

    The best ratio among the nearest names by edit distance is a lower bound of the best one. With it blocks of queries meet
    blocks of names, where few pairs need be compared letter by letter.
    """
    asked = kept(queries.select(F.col(column).alias("query")).filter("query is not null").distinct())
    names = kept(corpus.select(F.col("last_name").alias("neighbour")).filter("neighbour is not null").distinct())
    nearest = edit_knn(asked, names.withColumnRenamed("neighbour", "last_name"), 5, column="query")
    rated = nearest.select("query", sequence_ratio("neighbour", "query").alias("ratio"))
    bounded = kept(rated.groupBy("query").agg(F.greatest(F.lit(cutoff), F.max("ratio")).alias("bound")))
    scored = in_blocks(names, bounded, partial(ratio_answers, matched=matched_letters), "query string, neighbour string, ratio double")
    best = scored.groupBy("query").agg(F.max(F.struct("ratio", "neighbour")).alias("b")).select("query", "b.neighbour", "b.ratio")
    return asked.join(best, "query", "left")


def neighbour_labels(neighbours: DataFrame, corpus: DataFrame, labels: Sequence[str], how: str = "sum") -> DataFrame:
    """(query, one column a label): the neighbours' corpus rows added up or averaged."""
    rows = neighbours.join(corpus, neighbours["neighbour"] == corpus["last_name"])
    add = F.sum if how == "sum" else lambda c: F.round(F.avg(c), 9)  # so that the order of adding makes no ties
    return rows.groupBy("query").agg(*(add(F.col(f"`{c}`")).alias(c) for c in labels))


def knn_state(queries: DataFrame, corpus: DataFrame, labels: Sequence[str], k: int = 5, top: int = 3, column: str = "last_name") -> DataFrame:
    """(query, pred_state): the labels with the largest mean proportion over the k most similar names."""
    from rollscope.operators.labels import top_k

    means = neighbour_labels(cosine_knn(queries, corpus, k, column=column), corpus, labels, "mean")
    return means.select("query", F.transform(top_k(list(labels), labels, top), lambda x: x["label"]).alias("pred_state"))


def knn_sweep(queries: DataFrame, corpus: DataFrame, labels: Sequence[str], ks: Sequence[int] = (3, 5, 10), column: str = "last_name") -> DataFrame:
    """(query, k, pred): the best label for each k; neighbours are ranked once, at the largest k."""
    ranked = cosine_knn(queries, corpus, max(ks), column=column)
    each = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("rank <= k")
    rows = each.join(corpus, each["neighbour"] == corpus["last_name"])
    means = rows.groupBy("query", "k").agg(*(F.round(F.avg(F.col(f"`{c}`")), 9).alias(c) for c in labels))
    return means.select("query", "k", argmax([F.col(f"`{c}`") for c in labels], labels).alias("pred"))


def lookup_lang(df: DataFrame, column: str, corpus: DataFrame, labels: Sequence[str], k: int = 3) -> DataFrame:
    """Adds `predicted_lang`: the language with the most weight over the k nearest names.

    Neighbours are looked up once a distinct name and joined back, so every input row stays. Names are taken as
    they are, neither lower-cased nor stripped. Without the column the input is returned as it is.
    """
    if not has_column(df, column):
        return df
    sums = neighbour_labels(edit_knn(df, corpus, k, column), corpus, labels)
    best = sums.select(F.col("query").alias("_query"), argmax([F.col(f"`{c}`") for c in labels], labels).alias("predicted_lang"))
    return df.join(best, df[column] == best["_query"], "left").drop("_query")
