"""Near-duplicate texts by the Jaccard similarity of their 5-word shingles, found by covering masks over min-wise symbols.

A 64-bit SimHash can't serve at a similarity of 0.8: such texts differ in 10 bits in the mean and in 19 at times, and
masks that cover 19 bits are 2^20 - 1. Here a sketch has GROUPS groups of SYMBOLS minima, which differ in a fifth of
their places at 0.8, and the masks of `covering_masks` cover RADIUS differing symbols of a group: each symbol has one
of the non-zero vectors of RADIUS + 1 bits, each mask keeps the symbols with an odd product, and two differing symbols
span at most two dimensions, so some mask keeps none of them. Every pair with RADIUS or fewer differing symbols
in some group shares a key; at 0.8 a group has more with probability 0.125 (three that leave a mask out are found as
well), all GROUPS of them with one under 5e-7, and more similar pairs more seldom. Whatever shares a key is compared
exactly, shingle set with shingle set, before it counts as a link.

Equal sets are joined into one row first. In a bucket every member is compared with one of them;
then buckets that still hold several components are searched for further pairs, in blocks, inside tasks that give back
links of components and no pairs. There a sketch of one bit a minimum drops pairs that differ in more than FAR of 49 bits: at 0.8 the mean is 4.9, and a pair
exceeds FAR with probability under 1e-7, in all its buckets at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rollscope.llm.common import bounded_batches, checkpointed
from rollscope.llm.components import block_of, blocks_of, connected_components, every_block, mixed_buckets

SHINGLE = 5
RADIUS = 2
SYMBOLS = 2 ** (RADIUS + 1) - 1
GROUPS = 7
FAR = 18
SEED = 42

_rng = np.random.default_rng(5)
_TIMES = _rng.integers(0, 2**64, GROUPS * SYMBOLS, dtype=np.uint64) | np.uint64(1)
_MASKS = np.array([[(s & m).bit_count() % 2 for s in range(1, SYMBOLS + 1)] for m in range(1, SYMBOLS + 1)], dtype=np.uint64)
#: How a mask mixes the symbols of a group that it keeps into a key.
_MIX = (_rng.integers(0, 2**64, (GROUPS, SYMBOLS, SYMBOLS), dtype=np.uint64) | np.uint64(1)) * _MASKS
_TABLE = _rng.integers(0, 2**64, (GROUPS, SYMBOLS), dtype=np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype="<u8")
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, parts, repeat(SEED))
    return np.unique(np.fromiter(hashes, dtype="<u8", count=len(words) - SHINGLE + 1))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash under each of the GROUPS * SYMBOLS multiplications."""
    least = np.full(GROUPS * SYMBOLS, 2**64 - 1, dtype=np.uint64)
    for start in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[start : start + 2048, None] * _TIMES).min(axis=0), out=least)
    return least


def _hashes(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)


def _id(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw)


def _ids(raw: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(_id, raw), dtype="<u8", count=len(raw)).view("<i8"))


def keys_of(least: np.ndarray) -> np.ndarray:
    """(sets, GROUPS * SYMBOLS) minima -> (sets, keys), a key for each group and mask."""
    groups = least.reshape(len(least), GROUPS, 1, SYMBOLS)
    return ((groups * _MIX).sum(axis=3, dtype=np.uint64) + _TABLE).reshape(len(least), -1).view("<i8")


def _described(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in texts:
        sets = [shingle_set(t) for t in some]
        least = np.array([minima(s) for s in sets], dtype=np.uint64).reshape(-1, GROUPS * SYMBOLS)
        bits = np.zeros((len(sets), 64), dtype=np.uint8)
        bits[:, : least.shape[1]] = least >> np.uint64(32) & np.uint64(1)
        ids = np.fromiter((_id(s.tobytes()) for s in sets), dtype="<u8", count=len(sets)).view("<i8")
        yield pd.DataFrame({"id": ids, "sketch": np.packbits(bits, axis=1).view("<i8")[:, 0], "keys": list(keys_of(least))})


def described(text: Column) -> Column:
    """id of the shingle set, its sketch and its keys."""
    return F.pandas_udf(_described, "id long, sketch long, keys array<long>")(text.cast("binary"))


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of 0.8 or more."""
    both = np.sort(np.concatenate([x, y]), kind="stable")  # merges two sorted stretches
    n = int((both[1:] == both[:-1]).sum())
    return 5 * n >= 4 * (len(both) - n)


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = zip(a, b, strict=True)
    return pd.Series([_alike(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")) for x, y in pairs], dtype=bool)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of ids whose sets have a similarity of 0.8 or more."""
    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    other = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    met = pairs.join(one, "a").filter("x is not null").join(other, "b")
    sized = met.filter(5 * F.least(F.length("x"), F.length("y")) >= 4 * F.greatest(F.length("x"), F.length("y")))
    return sized.filter(F.pandas_udf(_similar, "boolean")("x", "y")).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and hashes of the sets of the wanted texts, which are given by their hash."""
    texts = docs.select(F.xxhash64("text").alias("words"), F.col("text").cast("binary").alias("text"))
    made = texts.join(wanted, "words", "left_semi").dropDuplicates(["text"]).select(F.pandas_udf(_hashes, "binary")("text").alias("hashes"))
    return made.select(F.pandas_udf(_ids, "long")("hashes").alias("id"), "hashes")


def _bridges(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the labels of a block of members and one of strays, of one bucket or of those of one component.

    A pair counts if it shares a key; in a bucket alone, if this is the first one that it shares.
    """
    strays, members = (rows[rows["visitor"] == v].reset_index(drop=True) for v in (True, False))
    keys, labels, ids, sketch = np.array(members["keys"].tolist(), dtype=np.int64).reshape(-1, GROUPS * SYMBOLS), *(members[c].to_numpy() for c in ("label", "id", "sketch"))
    sets = [np.frombuffer(x, dtype="<u8") for x in members["hashes"]]
    size, home = np.array([len(x) for x in sets]), ~members["stray"].to_numpy(dtype=bool)
    top: dict[int, int] = {}

    def root(label: int) -> int:
        while label in top:
            label = top[label]
        return label

    links = []
    for one in strays.itertuples():
        mine = np.frombuffer(one.hashes, dtype="<u8")
        same = keys == np.asarray(one.keys)
        met = same.any(axis=1) if one.whole else same.argmax(axis=1) == list(one.keys).index(one.key)
        near = met & (labels != one.label) & (home | (ids > one.id))
        near &= np.bitwise_count(sketch ^ one.sketch) <= FAR
        near &= 5 * np.minimum(size, len(mine)) >= 4 * np.maximum(size, len(mine))
        for k in np.flatnonzero(near).tolist():
            a, b = root(int(one.label)), root(int(labels[k]))
            if a != b and _alike(mine, sets[k]):
                top[max(a, b)] = min(a, b)
                links.append((int(one.label), int(labels[k])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def bridges(labelled: DataFrame, about: DataFrame) -> DataFrame:
    """(key, id, label) and each id's sketch, keys and hashes -> links (a, b) between labels of pairs that share a key.

    The buckets of one main component are mostly views of the same texts; where they are (all together hold at most
    four times as many texts as the largest), they are searched as one, so that a pair is not met once a bucket.
    """
    seen = checkpointed(labelled.join(mixed_buckets(labelled), "key").withColumn("stray", F.col("label") != F.col("main")))
    each = seen.select("main", "id", "label", "stray").distinct()
    sizes = each.groupBy("main").agg(F.count("*").alias("ids"), F.count_if("stray").alias("strays"))
    largest = seen.groupBy("main").agg(F.max("n").alias("most"))
    whole = checkpointed(sizes.join(largest, "main").filter("ids <= 4 * most").select("main", F.col("ids").alias("n"), "strays"))
    columns = ["whole", "key", "id", "label", "stray", "n", "strays"]
    gathered = each.join(whole, "main").withColumn("whole", F.lit(True)).withColumnRenamed("main", "key").select(columns)
    alone = seen.join(whole, "main", "left_anti").withColumn("whole", F.lit(False)).select(columns)
    rows = gathered.unionByName(alone).withColumns({"blocks": blocks_of(F.col("n")), "stray_blocks": blocks_of(F.col("strays"))})
    kept = ["whole", "key", "id", "label", "stray"]
    laid = rows.select(*kept, F.lit(False).alias("visitor"), block_of("blocks").alias("i"), every_block("stray_blocks").alias("j"))
    visits = rows.filter("stray").select(*kept, F.lit(True).alias("visitor"), every_block("blocks").alias("i"), block_of("stray_blocks", 1).alias("j"))
    return laid.unionByName(visits).join(about, "id").groupBy("whole", "key", "i", "j").applyInPandas(_bridges, "a long, b long")


def similar_classes(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct sets (id, sketch, keys, words) -> (id, label): those linked to others, with their component's label.

    `words` is the hash of one text of the set; the sets themselves are made again from `docs` where they are compared.
    """
    # An explicit number: the rows grow 49-fold here, after the sizes by which partitions would be merged.
    spread = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.repartition(spread, "id").select("id", F.explode("keys").alias("key"))
    # Buckets choose by one of four orders: members of a large group meet several of its texts, not one.
    pivot = F.min_by("id", F.xxhash64("id", F.pmod("key", F.lit(4)))).alias("pivot")
    shared = rows.groupBy("key").agg(pivot, F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(rows.join(shared.select("key", "pivot"), "key"))
    about = checkpointed(sets.join(members.select("id").distinct(), "id", "left_semi"))
    inside = checkpointed(sets_of(docs, about.select("words")))
    star = members.filter("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    found = connected_components(verified(star, inside)).withColumnRenamed("node", "id")

    labelled = checkpointed(members.drop("pivot").join(found, "id", "left").withColumn("label", F.coalesce("label", "id")))
    links = bridges(labelled, about.drop("words").join(inside, "id")).distinct()
    second = connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return (
        labelled.select("id", "label").distinct()
        .join(second, "label", "left")
        .select("id", F.coalesce("top", "label").alias("label"))
    )


def labelled_texts(docs: DataFrame) -> DataFrame:
    """doc_id, words (a hash of the text), label: equal for texts of one component. One row a row of `docs`.

    Null, empty and blank texts have no shingles and are equal to each other; a text of fewer than SHINGLE words is one
    shingle; long texts are sketched whole, in parts. Repeated rows stay repeated, null doc_ids are kept, an empty
    table gives none and other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    made = docs.select("doc_id", F.xxhash64("text").alias("words"), described(F.col("text")).alias("made"))
    printed = checkpointed(made.select("doc_id", "words", "made.*"))
    sets = printed.groupBy("id").agg(F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.first("words").alias("words"))
    classes = similar_classes(sets, docs)
    return checkpointed(
        printed.select("doc_id", "words", "id").join(classes, "id", "left").select("doc_id", "words", F.coalesce("label", "id").alias("label"))
    )


def similar_texts(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over texts of similarity 0.8 or more.

    Null doc_ids never name a component unless all of its rows have none; otherwise as `labelled_texts`.
    """
    rows = labelled_texts(docs)
    smallest = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "label").select("doc_id", "component_id")
