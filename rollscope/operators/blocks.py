"""Searches among all names in blocks: a block of queries meets a block of names in one task, whatever the names have in common.

A pair costs a few machine instructions there and no row of a shuffle. What is shuffled is each name once a block of
queries, each query once a block of names, and the best answers of both. Blocks are bounded, so tasks are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Names and queries of one block at most, and blocks that a search is cut into at least.
NAMES, QUERIES, TASKS = 131_072, 32_768, 64
#: Letters are told apart in so many classes, and counted up to so many, by one bit each.
CLASSES, LEVELS = 32, 4


def in_blocks(known: DataFrame, asked: DataFrame, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, tasks: int = TASKS) -> DataFrame:
    """`meet(names, queries)` of each block of `known` (with a column neighbour) and each of `asked` (with a column query).

    There are as many blocks of queries as the rows of both need, or as give `tasks` pairs of blocks.
    """
    n, q = known.count(), asked.count()
    names = max(1, -(-n // NAMES))
    queries = max(1, -(-q // QUERIES), min(-(-tasks // names), -(-q // 64)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    left = known.withColumn("_n", block("neighbour", names)).withColumn("_q", each(queries))
    right = asked.withColumn("_q", block("query", queries)).withColumn("_n", each(names))
    dealt = lambda df: df.repartition(2 * names * queries, "_n", "_q").groupBy("_n", "_q")
    return dealt(left).cogroup(dealt(right)).applyInPandas(lambda a, b: meet(a, b), schema)


class Block:
    """Names by length, then in code-point order, as one run of letters, with bits that bound the letters two names share."""

    def __init__(self, names: list[str]):
        self.names = np.array(sorted(names, key=lambda x: (len(x), x)), dtype=object)
        self.sizes = np.fromiter(map(len, self.names), dtype=np.int32, count=len(names))
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        codes = np.frombuffer("".join(self.names).encode("utf-32-le"), dtype=np.uint32)
        self.letters, self.at = np.unique(codes, return_inverse=True)
        self.number = {int(x): i for i, x in enumerate(self.letters)}
        rows = np.repeat(np.arange(len(names)), self.sizes)
        self.bits, self.more = self._bits(np.bincount(rows * CLASSES + self.at % CLASSES, minlength=len(names) * CLASSES).reshape(-1, CLASSES))
        self.pairs = np.zeros(len(names), dtype=np.uint64)
        inside = rows[1:] == rows[:-1]
        np.bitwise_or.at(self.pairs, rows[1:][inside], self._pair(self.at[:-1], self.at[1:])[inside])

    @staticmethod
    def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two words a row with bit 4 * class + i set for a count over i, and the letters counted beyond that."""
        bits = np.zeros((2, len(counts)), dtype=np.uint64)
        for c in range(CLASSES):
            for i in range(LEVELS):
                place = LEVELS * c + i
                bits[place // 64] |= (counts[:, c] > i).astype(np.uint64) << np.uint64(place % 64)
        return bits, np.maximum(counts - LEVELS, 0).sum(axis=1)

    def numbers(self, query: str) -> list[int]:
        """The query's letters as numbers; one that no name has is the last number."""
        return [self.number.get(ord(x), len(self.letters)) for x in query]

    def span(self, shortest: float, longest: float) -> tuple[int, int]:
        """First row and end of the names of these lengths."""
        return int(np.searchsorted(self.sizes, shortest)), int(np.searchsorted(self.sizes, longest, "right"))

    def shared(self, query: list[int], low: int, high: int) -> np.ndarray:
        """How many letters the names of these rows share with the query at most, wherever they stand."""
        bits, more = [0, 0], 0
        for c, n in Counter(x % CLASSES for x in query if x < len(self.letters)).items():
            place = LEVELS * c
            bits[place // 64] |= ((1 << min(n, LEVELS)) - 1) << place % 64
            more += max(n - LEVELS, 0)
        found = np.bitwise_count(self.bits[0, low:high] & np.uint64(bits[0])) + np.bitwise_count(self.bits[1, low:high] & np.uint64(bits[1]))
        return found if more == 0 else found + np.minimum(self.more[low:high], more)

    def broken(self, query: list[int], rows: np.ndarray) -> np.ndarray:
        """A lower bound of edit distances: an edit takes two letter pairs of either name at most from the other."""
        mine = np.uint64(0)
        for a, b in zip(query, query[1:]):
            mine |= self._pair(a, b)
        pairs = self.pairs[rows]
        return (np.maximum(np.bitwise_count(pairs & ~mine), np.bitwise_count(mine & ~pairs)) + np.uint8(1)) // np.uint8(2)

    @staticmethod
    def _pair(a, b):
        """One of 64 bits for two letters that follow each other."""
        return np.uint64(1) << np.asarray((a * 37 + b * 11) % 64).astype(np.uint64)

    def places(self, query: list[int]) -> np.ndarray:
        """For each letter the bits of its places in the query, which has 64 letters at most."""
        out = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        for i, x in enumerate(query):
            out[x] |= np.uint64(1 << i)
        out[-1] = 0
        return out

    def steps(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Letter by letter: the first of the ascending `rows` that is this long, and the letters there from it on."""
        sizes, starts = self.sizes[rows], self.starts[rows]
        for j in range(int(sizes[-1]) if len(rows) else 0):
            first = int(np.searchsorted(sizes, j, "right"))
            yield first, self.at[starts[first:] + j]

    def distances(self, query: list[int], rows: np.ndarray) -> np.ndarray:
        """Edit distances of ascending rows, by bit vectors of the differences down a column (Myers, Hyyrö)."""
        m = len(query)
        if not 0 < m <= 64:
            return self._long_distances(query, rows)
        one, top, places = np.uint64(1), np.uint64(m - 1), self.places(query)
        up, down = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), dtype=np.uint64)
        out = np.full(len(rows), m, dtype=np.int64)
        for first, letters in self.steps(rows):
            same, u, d = places[letters], up[first:], down[first:]
            across = (((same & u) + u) ^ u) | same
            plus, minus = d | ~(across | u), u & across
            out[first:] += ((plus >> top) & one).astype(np.int64) - ((minus >> top) & one).astype(np.int64)
            plus, same = (plus << one) | one, same | d
            up[first:], down[first:] = (minus << one) | ~(same | plus), plus & same
        return out

    def _long_distances(self, query: list[int], rows: np.ndarray) -> np.ndarray:
        text, at = np.array(query, dtype=np.int64), np.arange(len(query) + 1)
        out = np.zeros(len(rows), dtype=np.int64)
        step = max(1, (1 << 20) // len(at))
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            last = np.tile(at, (len(part), 1))
            for first, letters in self.steps(part):
                old = last[first:]
                new = old + 1
                new[:, 1:] = np.minimum(new[:, 1:], old[:, :-1] + (text != letters[:, None]))
                last[first:] = np.minimum.accumulate(new - at, axis=1) + at
            out[low : low + step] = last[:, -1]
        return out

    def common(self, query: list[int], rows: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences with ascending rows, of a query of 64 letters at most."""
        places, left = self.places(query), np.full(len(rows), ~np.uint64(0))
        for first, letters in self.steps(rows):
            some = left[first:] & places[letters]
            left[first:] = (left[first:] + some) | (left[first:] - some)
        return np.bitwise_count(~left & np.uint64((1 << len(query)) - 1)).astype(np.int64)


def nearest_edits(block: Block, query: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k names of the block at the least edit distance, ties by name.

    A distance is at least the longer length less the letters that both share, so names come up by that bound until it
    exceeds the k-th distance.
    """
    letters, reach, longest = block.numbers(query), 4, int(block.sizes[-1])
    while True:
        low, high = block.span(len(query) - reach, len(query) + reach)
        least = np.maximum(block.sizes[low:high], len(query)) - block.shared(letters, low, high)
        rows, found, bound = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1
        fresh = np.flatnonzero(least <= bound)
        later, broken = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        while True:
            more = block.broken(letters, fresh + low)
            later, broken = np.concatenate([later, fresh]), np.concatenate([broken, more])
            fresh, wait = np.sort(later[broken <= bound]), broken > bound
            later, broken = later[wait], broken[wait]
            if len(fresh):
                rows, found = np.concatenate([rows, fresh + low]), np.concatenate([found, block.distances(letters, fresh + low)])
                near = np.flatnonzero(found <= (np.partition(found, k - 1)[k - 1] if len(found) > k else found.max()))
                rows, found = rows[near], found[near]
            done = len(found) >= k and np.partition(found, k - 1)[k - 1] <= bound
            if done or bound >= reach:
                break
            bound += 1
            fresh = np.flatnonzero(least == bound)
        if done or reach >= max(longest, len(query)):
            order = sorted(range(len(rows)), key=lambda i: (found[i], block.names[rows[i]]))[:k]
            return rows[order], found[order]
        reach *= 2


def _answers(columns: list[str], found: list[tuple]) -> pd.DataFrame:
    """A table of (query, array, array, ...) entries, with the query on each row."""
    queries = np.repeat(np.array([x[0] for x in found], dtype=object), [len(x[1]) for x in found]) if found else []
    rest = [np.concatenate([x[i] for x in found]) if found else [] for i in range(1, len(columns))]
    return pd.DataFrame(dict(zip(columns, [queries, *rest], strict=True)))


def edit_answers(names: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """query, neighbour, distance: the k nearest names of a block for each query of one."""
    found = []
    if len(names):
        block = Block(names["neighbour"].tolist())
        for query in asked["query"]:
            rows, distances = nearest_edits(block, query, k)
            found.append((query, block.names[rows], distances))
    return _answers(["query", "neighbour", "distance"], found)


def cosine_answers(names: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """query, neighbour, similarity: the k most similar vectors of a block for each of another; only those with a product above 0.

    Vectors are lists of numbered grams (b_gram and a_gram) and their weights (b_w, a_w). Products are added up list by list
    of the grams that a query has, and rounded to nine places before ties go by name.
    """
    found = []
    if len(names):
        known, n = names["neighbour"].to_numpy(dtype=object), len(names)
        grams = np.concatenate(names["b_gram"].to_numpy())
        order = np.argsort(grams, kind="stable")
        rows = np.repeat(np.arange(n), names["b_gram"].map(len))[order]
        weights = np.concatenate(names["b_w"].to_numpy())[order]
        numbers, starts = np.unique(grams[order], return_index=True)
        ends = np.append(starts[1:], len(grams))
        at = {int(g): (int(i), int(j)) for g, i, j in zip(numbers, starts, ends, strict=True)}
        for query, mine, by in zip(asked["query"], asked["a_gram"], asked["a_w"], strict=True):
            lists = [(at[g], w) for g, w in zip(mine.tolist(), by.tolist(), strict=True) if g in at]
            if not lists:
                continue
            total = np.bincount(np.concatenate([rows[i:j] for (i, j), _ in lists]), np.concatenate([weights[i:j] * w for (i, j), w in lists]), n)
            for least in (0.7, 0.5, 0.3, 0.0):
                best = np.flatnonzero(total >= least - 1e-9 if least else total > 0)
                if np.count_nonzero(total[best] >= least) >= k:
                    break
            similar = np.round(total[best], 9)
            if len(best) > k:
                near = similar >= np.partition(similar, len(best) - k)[len(best) - k]
                best, similar = best[near], similar[near]
            order = sorted(range(len(best)), key=lambda i: (-similar[i], known[best[i]]))[:k]
            found.append((query, known[best[order]], similar[order]))
    return _answers(["query", "neighbour", "similarity"], found)


def ratio_answers(names: pd.DataFrame, asked: pd.DataFrame, matched: Callable[[list[str], list[str]], np.ndarray]) -> pd.DataFrame:
    """query, neighbour, ratio: the name of a block with the largest sequence ratio of `bound` or more, ties to the later name.

    Matched letters are a common subsequence, and that is among the letters both names share, so names are left out by these
    letters first and by the longest common subsequence then. Of what is left the likeliest few are compared first, which raises
    the bound for the others.
    """
    found = []
    block = Block(names["neighbour"].tolist()) if len(names) else None
    queries, bounds = asked["query"].tolist(), asked["bound"].tolist()
    for begin in range(0, len(queries) if block else 0, 256):
        part = []
        for query, bound in zip(queries[begin : begin + 256], bounds[begin : begin + 256], strict=True):
            letters, m = block.numbers(query), len(query)
            low, high = block.span(bound / (2 - bound) * m - 1e-6, (2 - bound) / bound * m + 1e-6)
            both = block.sizes[low:high] + m
            rows = np.flatnonzero(2.0 * block.shared(letters, low, high) >= (bound - 1e-9) * both)
            both, rows = both[rows], rows + low
            most = 2.0 * block.common(letters, rows) / np.maximum(both, 1) if 0 < m <= 64 else np.ones(len(rows))
            keep = most >= bound - 1e-9
            part.append((query, rows[keep], most[keep], bound))
        first = [np.argsort(-most, kind="stable")[:8] for _, _, most, _ in part]
        best = _compared(block, [(q, rows[i]) for (q, rows, _, _), i in zip(part, first, strict=True)], matched)
        rest = []
        for (query, rows, most, bound), done, got in zip(part, first, best, strict=True):
            again = most >= max(bound, got[0]) - 1e-9
            again[done] = False
            rest.append((query, rows[again]))
        for (query, _, _, bound), one, other in zip(part, best, _compared(block, rest, matched), strict=True):
            ratio, name = max(one, other)
            if ratio >= bound:
                found.append((query, [name], [ratio]))
    return _answers(["query", "neighbour", "ratio"], found)


def _compared(block: Block, wanted: list[tuple[str, np.ndarray]], matched: Callable[[list[str], list[str]], np.ndarray]) -> list[tuple[float, str]]:
    """The best (ratio, name) of each query among the rows wanted for it; (-1, "") without any."""
    best = [(-1.0, "")] * len(wanted)
    owner = np.repeat(np.arange(len(wanted)), [len(rows) for _, rows in wanted])
    every = np.concatenate([rows for _, rows in wanted])
    for low in range(0, len(every), 8192):
        names, owners = block.names[every[low : low + 8192]].tolist(), owner[low : low + 8192].tolist()
        queries = [wanted[i][0] for i in owners]
        for i, name, query, n in zip(owners, names, queries, matched(names, queries).tolist(), strict=True):
            both = len(name) + len(query)
            best[i] = max(best[i], (2.0 * n / both if both else 1.0, name))
    return best
