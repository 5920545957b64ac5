"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND by every passage.

Items and passages are sequences of lower-case words without ASCII punctuation; terms are pairs of neighbouring
words (a one-word item has its word as a term). Each item is indexed whole and, if it has several sentences, by its
question as well. Document frequencies, their number and the mean length are those of the whole benchmark. An
entry's BM25 scores are divided by its score against itself, so a passage that holds all of it scores 1.

Passages of an item are windows of twice its size class (the next power of two of its words, 32 at least), each shifted
by half, so every item lies whole in some passage and what else is in the benchmark changes nothing. A passage whose
terms' largest impacts add up to less than THRESHOLD can reach no item; for the others WAND moves cursors over the
terms' postings, skips entries and blocks that stay below the threshold by their maxima, and yields all at or above it.

Retrieved pairs are verified on SHINGLE-word shingles. An item's last sentence is its answer, what comes before
is its question (the same, if there is one sentence). A pair counts if OVERLAP of the item's shingles are in the
passage, or OVERLAP of the question's shingles and of the answer's words.

The index is built in shards of at most SHARD_WORDS words, one after the other, each of which one scan of the documents
uses, so what the driver holds and the executors get is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rollscope.llm.common import bounded_batches, checkpointed

THRESHOLD = 0.5
SHINGLE = 5
OVERLAP = 0.8
K1 = 1.2
B = 0.75
BLOCK = 32
LEAST_CLASS = 32
SHARD_WORDS = 500_000

_PLAIN = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def shingles(sequence: list) -> set[tuple]:
    """Distinct SHINGLE-word shingles; of a shorter sequence the whole; of none no shingle."""
    if not sequence:
        return set()
    return {tuple(sequence[i : i + SHINGLE]) for i in range(max(1, len(sequence) - SHINGLE + 1))}


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [p for p in map(words, re.split(r"(?<=[.!?])\s+|\n", text)) if p]
    if len(parts) < 2:
        whole = words(text)
        return whole, whole
    return [w for p in parts[:-1] for w in p], parts[-1]


def terms_of(sequence: list[bytes]) -> list[bytes]:
    """Pairs of neighbouring words; of a single word the word."""
    return [a + b" " + b for a, b in zip(sequence, sequence[1:], strict=False)] or sequence


class Statistics(NamedTuple):
    """Of the whole benchmark: items with words, their mean number of terms, and the items that have each term."""

    items: int
    mean: float
    having: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        terms = [terms_of(w) for w in map(words, texts) if w]
        return cls(len(terms), sum(map(len, terms)) / max(1, len(terms)), Counter(t for some in terms for t in set(some)))


class EntryIndex:
    """The inverted index of the entries of one size class: postings by term in order, in blocks with their largest impact."""

    def __init__(self, size: int, entries: list[tuple[int, list[bytes]]], number: dict[bytes, int], stats: Statistics):
        self.size, self.item_of = size, [item for item, _ in entries]
        counts = [Counter(terms_of(ws)) for _, ws in entries]
        code = lambda t: self._code([number[w] for w in t.split(b" ")], len(number))
        codes = {t: code(t) for t in set().union(*counts)}
        self.codes = np.array(sorted(codes.values()), dtype=np.int64)
        self.singles = np.array(sorted(number[t] for t in codes if b" " not in t), dtype=np.int64)
        self.base = len(number)
        at = {c: i for i, c in enumerate(self.codes.tolist())}
        postings: list[list[tuple[int, float]]] = [[] for _ in at]
        for entry, of in enumerate(counts):
            n = sum(of.values())
            idf = {t: math.log(1 + (stats.items - stats.having[t] + 0.5) / (stats.having[t] + 0.5)) for t in of}
            impact = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * n / stats.mean)) for t, c in of.items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                postings[at[codes[t]]].append((entry, x / whole))
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.blocks = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = np.array([max(x) for x in self.impacts])

    @staticmethod
    def _code(numbers: list[int], base: int) -> int:
        return numbers[0] * base + numbers[1] if len(numbers) == 2 else -2 - numbers[0]

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) wherever a term starts, in order; -1 stands for words that no item has."""
        first, second = numbers[:-1], numbers[1:]
        code = np.where((first >= 0) & (second >= 0), first * self.base + second, -1)
        at = np.arange(len(code))
        if len(self.singles):
            alone = np.flatnonzero(np.isin(numbers, self.singles))
            code, at = np.concatenate([code, -2 - numbers[alone]]), np.concatenate([at, alone])
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[place] == code)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], place[hit][order]

    def passages(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, distinct terms) of the passages whose terms could reach the threshold."""
        hit, term = self.hits(numbers)
        if not len(hit):
            return
        bound = np.concatenate([[0.0], np.cumsum(self.most[term])])
        starts = np.arange(0, max(1, len(numbers) - self.size), self.size)
        low, high = np.searchsorted(hit, starts), np.searchsorted(hit, starts + 2 * self.size)
        for i in np.flatnonzero(bound[high] - bound[low] >= THRESHOLD - 1e-9).tolist():
            some = np.unique(term[low[i] : high[i]])
            if self.most[some].sum() >= THRESHOLD - 1e-9:
                yield int(starts[i]), some

    def search(self, terms: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, float]]:
        """(entry, score) of all entries whose impacts over the terms add up to the threshold, by block-max WAND."""
        least = threshold - 1e-9
        most = self.most
        cursors = [[self.items[t][0], 0, t] for t in terms.tolist()]  # entry, place in the postings, term
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                total += most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = 0.0
            for _, place, t in cursors[: pivot + 1]:
                of = self.items[t]
                while place < len(of) and of[min(len(of), (place // BLOCK + 1) * BLOCK) - 1] < item:
                    place = (place // BLOCK + 1) * BLOCK
                block += self.blocks[t][place // BLOCK] if place < len(of) else 0.0
            if block >= least and cursors[0][0] == item:
                score = sum(self.impacts[t][place] for at, place, t in cursors[: pivot + 1] if at == item)
                if score >= least:
                    yield item, score
            # Block maxima that stay below rule this item out as much as a full score does.
            target = item + 1 if block < least or cursors[0][0] == item else item
            kept = []
            for k, (at, place, t) in enumerate(cursors):
                if k <= pivot and at < target:
                    of = self.items[t]
                    while place < len(of) and of[place] < target:
                        place += 1
                    if place == len(of):
                        continue
                    at = of[place]
                kept.append([at, place, t])
            cursors = kept


def size_class(n: int) -> int:
    """The number of words by which passages of an item of n words are shifted, half of their length."""
    return max(LEAST_CLASS, 1 << (n - 1).bit_length())


class ItemIndex:
    """Some items with an index for each of their size classes. Items without words are left out."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics | None = None):
        items = [(i, t) for i, t in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")) if words(t)]
        stats = stats or Statistics.of([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        classes: dict[int, list[tuple[int, list[bytes]]]] = {}
        for item, (whole, (question, _)) in enumerate(zip(self.words, self.parts, strict=True)):
            some = classes.setdefault(size_class(len(whole)), [])
            some.append((item, whole))
            if len(question) > 1 and question != whole:
                some.append((item, question))
        self.classes = [EntryIndex(size, some, self.number, stats) for size, some in sorted(classes.items())]

    def numbers(self, sequence: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, sequence, repeat(-1)), dtype=np.int64, count=len(sequence))

    def verify(self, item: int, passage: list[bytes]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's shingles and of its answer's words in the passage."""
        there, bag = shingles(passage), Counter(passage)
        # A text shorter than a shingle is found as a run of words.
        def share(sequence: list[bytes]) -> float:
            wanted = shingles(sequence)
            if len(sequence) < SHINGLE:
                n = len(sequence)
                return float(any(passage[i : i + n] == sequence for i in range(len(passage) - n + 1)))
            return len(wanted & there) / len(wanted)

        question, answer = self.parts[item]
        asked = Counter(answer)
        return share(self.words[item]), share(question), sum((asked & bag).values()) / len(answer)

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float, float]]:
        """item number -> (score, overlap, question's, answer's) of the verified items, each at its best passage.

        The score is that of the whole item or of its question, whichever is higher.
        """
        sequence = words(text)
        numbers = self.numbers(sequence)
        found: dict[int, tuple[float, float, float, float]] = {}
        for index in self.classes:
            for start, terms in index.passages(numbers):
                passage = sequence[start : start + 2 * index.size]
                scores: dict[int, float] = {}
                for entry, score in index.search(terms):
                    item = index.item_of[entry]
                    scores[item] = max(scores.get(item, 0.0), score)
                for item, score in scores.items():
                    whole, question, answer = self.verify(item, passage)
                    if whole >= OVERLAP or (question >= OVERLAP and answer >= OVERLAP):
                        found[item] = max(found.get(item, (0.0,) * 4), (score, whole, question, answer))
        return found


def item_shards(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of disjoint parts of the benchmark, each of about SHARD_WORDS words or fewer; at least one."""
    size = benchmark.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_WORDS))
    each = F.pandas_udf(lambda texts: pd.Series([terms_of(words(t)) for t in texts], dtype=object), "array<binary>")
    rows = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard")
    )
    terms = checkpointed(rows.select("shard", each(F.coalesce("text", F.lit(""))).alias("terms")))
    n, mean = terms.filter(F.size("terms") > 0).agg(F.count("*"), F.avg(F.size("terms"))).first()
    each_term = terms.select("shard", F.explode(F.array_distinct("terms")).alias("term"))
    having = each_term.groupBy("term").agg(F.count("*").alias("n"))
    per_shard = checkpointed(each_term.distinct().join(having, "term"))
    for k in range(shards):
        stats = Statistics(n, mean or 0.0, {bytes(r.term): r.n for r in per_shard.filter(F.col("shard") == k).select("term", "n").collect()})
        yield ItemIndex([(r.item_id, r.text) for r in rows.filter(F.col("shard") == k).collect()], stats)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap of each leak of an item into a document.

    Null, empty and wordless texts and items take no part; texts and items of any length are read whole. Repeated
    rows give repeated results, items with the same item_id are one each; null ids are kept. Without documents or
    items there are no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    names = ["item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    kinds = "array<struct<item_id: long, score: double, overlap: double, question_overlap: double, answer_overlap: double>>"

    def scan_with(index: ItemIndex):
        def found(text: str) -> list[dict]:
            return [dict(zip(names, (index.ids[i], *of), strict=True)) for i, of in sorted(index.leaks(text).items())]

        return F.pandas_udf(lambda texts: pd.Series([found(t) for t in texts], dtype=object), kinds)

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    out = None
    for index in item_shards(benchmark):
        part = rows.select("doc_id", F.inline(scan_with(index)("text")))
        # With several shards each scan is written before the next index is built.
        out = part if out is None else checkpointed(out).unionByName(checkpointed(part))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified leak, whole and with all columns, repeated rows as often as they were.

    Null, empty and wordless texts stay, as all do if there are no items; null ids stay if their text does.
    """
    bounded_batches(docs.sparkSession)
    out = None
    for index in item_shards(benchmark):
        clean = F.pandas_udf(lambda texts, index=index: pd.Series([not index.leaks(t) for t in texts], dtype=bool), "boolean")
        out = (docs if out is None else checkpointed(out)).filter(clean(F.coalesce("text", F.lit(""))))
    return out
