"""Exact repeated-substring removal with suffix order and longest-previous-factor marks.

A string of LENGTH bytes that starts anywhere else in the corpus is a repeat. Matches never cross documents.

1. Anchors. Each window of LENGTH bytes names its leftmost smallest GRAM-byte hash; neighbouring windows with
   the same anchor form a run. Equal windows always have equal anchors, so repeats are only to be found among
   runs with the same anchor hash. Runs carry a digest of their bytes.
2. Anchors that occur once drop out (aggregated before the shuffle). Runs whose anchor has one digest only are
   whole repeats of each other.
3. The rest, one run a digest, is sorted in suffix order by anchor group: ranks of 8, 24, 72 and 200 bytes by
   prefix tripling, ties in corpus order. The common prefixes of neighbours are compared byte by byte; from them and from
   each suffix's previous and next smaller position in suffix order comes the longest-previous-factor array, and
   from the larger positions the longest-next-factor array. Lengths count up to LENGTH, which is what removal asks for.
   An anchor group of over HOT digests does not fit a task; its windows are counted by 128-bit digests over all
   tasks instead, which decides the same question for groups of any size.
4. The runs' repeated starts give byte ranges, joined to the documents.

Runs are the same if the 64-bit hash of their anchors and the 64-bit digest of their bytes are: two different runs of one
anchor are confused with probability 2^-64. Rows are told apart by 88 bits of their ids and texts: with null or shared ids,
too, two different texts are confused with probability 2^-88.

`keep_first=True` removes later copies and keeps the first in (doc_id, position) order; False removes all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rollscope.llm.common import bounded_batches, checkpointed, with_columns_of

LENGTH = 200
GRAM = 50
SPAN = LENGTH - GRAM + 1
STEP = 1 << 17
HOT = 4096
CHUNK = 1 << 17
PART = 1000
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            column = np.full(STEP + LENGTH + 1, base, dtype=np.uint64)
            column[0] = 1
            _POWERS.append(np.multiply.accumulate(column))
    return _POWERS[0], _POWERS[1]


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each GRAM-byte string, position of the anchor of each window) of at most STEP + LENGTH bytes."""
    power, inverse = _powers()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate([key, np.full(-len(key) % SPAN, ~np.uint64(0))]).reshape(-1, SPAN)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: len(key) - SPAN + 1], before[SPAN - 1 : len(key)])
    return h, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(data: bytes | memoryview, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of concatenated texts: (anchor hash, digest, text index, start in the text, windows)."""
    every = np.frombuffer(data, dtype=np.uint8)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    text_of = np.repeat(np.arange(len(ends), dtype=np.int32), ends - begins)
    for low in range(0, len(every), STEP):
        part = every[low : low + STEP + LENGTH - 1]
        if len(part) < LENGTH:
            return
        h, anchor = anchors(part)
        text = text_of[low : low + len(anchor)]
        start = np.flatnonzero(text == text_of[low + LENGTH - 1 : low + LENGTH - 1 + len(anchor)])
        if not len(start):
            continue
        anchor, text = anchor[start], text[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(new)
        first, n = start[at], np.diff(np.append(at, len(start)))
        raw = memoryview(part)
        digest = np.fromiter(
            (xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist(), strict=True)),
            dtype=np.uint64,
            count=len(first),
        )
        yield h[anchor[at]].view(np.int64), digest.view(np.int64), text[at], first + low - begins[text[at]], n


def _kinds(ids: list[str]) -> str:
    return ", ".join(f"{c} long" for c in ("h", "s", *ids, "pos"))


def _find_runs(ids: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _runs_in(batch, ids)

    return find


def _runs_in(batch: pa.RecordBatch, ids: list[str]) -> Iterator[pa.RecordBatch]:
    texts = batch.column("bytes").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    tag = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)
    for h, s, text, first, n in runs_of(data, offsets[1:] - offsets[0]):
        pos = (first << 32) | (n << 24) | tag[text]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(s), *(batch.column(c).take(pa.array(text)) for c in ids), pa.array(pos)],
            names=["h", "s", *ids, "pos"],
        )


def suffix_order(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The numbers of the starts in order of their first LENGTH bytes, ties by position.

    Prefix tripling: ranks of 8-byte strings, then of 24 and 72, then of LENGTH from three overlapping 72s.
    At most 2^21 bytes.
    """
    padded = np.concatenate([data, np.zeros(LENGTH, dtype=np.uint8)])
    key = np.zeros(len(data), dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + len(data)]

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        rank = np.empty(len(key), dtype=np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]).astype(np.uint64)
        return rank

    def tripled(rank: np.ndarray, step: int, at: np.ndarray | slice) -> np.ndarray:
        longer = np.concatenate([rank, np.zeros(2 * step, dtype=np.uint64)])
        one, two, three = longer[: len(rank)], longer[step : step + len(rank)], longer[2 * step :]
        return (one[at] << np.uint64(42)) | (two[at] << np.uint64(21)) | three[at]

    every = slice(None)
    rank = ranked(tripled(ranked(tripled(ranked(key), 8, every)), 24, every))
    full = tripled(rank, (LENGTH - 72) // 2, starts)
    return np.argsort(full, kind="stable")


def common_prefixes(data: np.ndarray, sorted_starts: np.ndarray) -> np.ndarray:
    """Length of the common prefix, up to LENGTH, of each suffix and the one before it in suffix order; 0 for the first."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    word = np.zeros(len(data), dtype=np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + len(data)]
    lcp = np.full(len(sorted_starts), LENGTH, dtype=np.int64)
    lcp[:1] = 0
    open_ = np.arange(1, len(sorted_starts))
    for k in range(0, LENGTH, 8):
        differ = word[sorted_starts[open_] + k] ^ word[sorted_starts[open_ - 1] + k]
        done = np.flatnonzero(differ)
        high = differ[done]
        equal = np.zeros(len(done), dtype=np.int64)  # leading bytes that agree
        for shift in range(8, 64, 8):
            equal += high < np.uint64(1) << np.uint64(64 - shift)
        lcp[open_[done]] = k + equal
        open_ = open_[differ == 0]
        if not len(open_):
            break
    return lcp


def _nearest_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order the common prefix with the nearest place before it of a smaller position.

    Every place points to the one before it with the common prefix so far; pointers to larger positions take
    over where those point and the smaller of both prefixes, all at once, until none is left.
    """
    before, shared = np.arange(len(position)) - 1, lcp.copy()
    shared[:1] = 0
    open_ = np.arange(1, len(position))
    while len(open_):
        open_ = open_[before[open_] >= 0]
        open_ = open_[position[before[open_]] > position[open_]]
        through = before[open_]
        nearer, least = before[through], np.minimum(shared[open_], shared[through])
        before[open_], shared[open_] = nearer, least
    shared[before < 0] = 0
    return shared


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, by position, the longest prefix up to LENGTH that also starts at a smaller position.

    That earlier match is the nearest smaller position before or after the suffix in suffix order.
    """
    n = len(order)
    after = np.zeros(n, dtype=np.int64)
    after[1:] = lcp[1:][::-1]  # of each place and the one after it, in reverse order
    best = np.maximum(_nearest_smaller(order, lcp), _nearest_smaller(order[::-1], after)[::-1])
    out = np.empty(n, dtype=np.int64)
    out[order] = best
    return out


def factors(strings: list[bytes], later: bool) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """For each string, of the windows in it: longest previous factors, and longest next factors if asked for."""
    lengths = np.array([len(x) for x in strings])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = lengths - LENGTH + 1
    bounds = np.cumsum(counts)
    starts = np.repeat(begins - np.concatenate([[0], bounds[:-1]]), counts) + np.arange(bounds[-1])
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    order = suffix_order(data, starts)
    lcp = common_prefixes(data, starts[order])
    cut = lambda lpf: np.split(lpf, bounds[:-1])
    previous = cut(longest_previous_factors(order, lcp))
    # Positions counted from the end turn next factors into previous ones.
    return previous, cut(longest_previous_factors(len(order) - 1 - order, lcp)[::-1]) if later else None


def _flat(marks: np.ndarray) -> list[int]:
    """Runs of true as start, end, start, end, ..."""
    return np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))).tolist()


def _mark(keep_first: bool):
    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list, list[bytes]]]:
        h, s, texts, size = [], [], [], 0
        for frame in frames:
            for row in zip(frame["h"].tolist(), frame["s"].tolist(), frame["run"].tolist(), strict=True):
                if h and row[:2] == (h[-1], s[-1]):
                    continue  # the same row of the documents given twice
                if size >= CHUNK and row[0] != h[-1]:
                    yield h, s, texts
                    h, s, texts, size = [], [], [], 0
                h.append(row[0])
                s.append(row[1])
                texts.append(row[2])
                size += len(row[2])
        if h:
            yield h, s, texts

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for h, s, texts in groups(frames):
            previous, later = factors(texts, not keep_first)
            longest = previous if keep_first else map(np.maximum, previous, later)
            found = [_flat(x >= LENGTH) for x in longest]
            yield pd.DataFrame({"h": h, "s": s, "marks": found})

    return mark


def _slices(ids: list[str]):
    """The bytes of the runs that are asked for of each text."""

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["h"].map(len).to_numpy()
        pos = np.concatenate(frame["pos"].to_numpy())
        text = frame["bytes"].to_numpy().repeat(n)
        start = pos >> 32
        ends = start + (pos >> 24 & 255) + LENGTH - 1
        return pd.DataFrame(
            {
                "h": np.concatenate(frame["h"].to_numpy()),
                "s": np.concatenate(frame["s"].to_numpy()),
                **{c: frame[c].repeat(n).to_numpy() for c in ids},
                "pos": pos,
                "hot": np.concatenate(frame["hot"].to_numpy()).astype(bool),
                "run": [t[a:b] for t, a, b in zip(text, start.tolist(), ends.tolist(), strict=True)],
            }
        )

    return lambda frames: (cut(frame) for frame in frames if len(frame))


def _digests(ids: list[str]):
    """Each window of the runs of hot anchors with a 128-bit digest."""

    def each(row: dict) -> pd.DataFrame:
        runs = range(len(row["run"]) - LENGTH + 1)
        digests = [xxhash.xxh3_128_digest(row["run"][i : i + LENGTH]) for i in runs]
        return pd.DataFrame({**{c: row[c] for c in ("h", "s", *ids, "pos")}, "at": list(runs), "digest": digests})

    return lambda frames: (each(row) for frame in frames for row in frame.to_dict("records"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as maximal runs in order; ranges that meet are one run."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[new], reach[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def _removed(texts: pd.Series, los: pd.Series, his: pd.Series) -> pd.DataFrame:
    out = []
    for text, lo, hi in zip(texts, los, his, strict=True):
        kept, n = text, 0
        if lo is not None and len(lo):
            starts, ends = merged(np.asarray(lo), np.asarray(hi))
            n = len(starts)
            kept = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True))
        out.append((len(text), len(text) - len(kept), n, kept, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def _without_text(texts: pd.Series, los: pd.Series, his: pd.Series) -> pd.DataFrame:
    return _removed(texts, los, his).drop(columns="kept")


def remove_repeats(docs: DataFrame, keep_first: bool = True, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, unless left out), kept_sha256.

    Null texts are empty. Texts under LENGTH bytes are never touched, longer ones are read whole, in overlapping
    parts. An empty table gives none. Rows that agree in doc_id and text get the
    same result: with keep_first=False they are copies of each other, with True they count as one first copy.
    Null doc_ids are kept. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("bytes"),
    )
    # A row is named by 64 bits of its id and text and 24 of another hash of its text.
    rows = rows.withColumns({"row": F.xxhash64("doc_id", "bytes"), "tag": F.crc32("bytes").bitwiseAND(0xFFFFFF)})
    ids = ["row"]
    if keep_first:
        rows, ids = rows.withColumn("rank", F.coalesce("doc_id", F.lit(-(2**63)))), ["rank", "row"]
    found = rows.mapInArrow(_find_runs(ids), _kinds(ids))
    place = F.struct(*ids, "pos")
    shared = (
        found.groupBy("h")
        .agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"), *([F.min(place).alias("first")] if keep_first else []))
        .filter("n > 1")
        .withColumns({"mixed": F.col("lo") < F.col("hi"), "parts": F.ceil(F.col("n") / PART).cast("int")})
        .drop("n", "lo", "hi")
    )
    # Checkpointed, so that both sides of the join come from plain shuffles and a hot anchor can be split.
    runs = checkpointed(found.join(checkpointed(shared), "h"))

    classes = checkpointed(
        runs.filter("mixed").groupBy("h", "s").agg(F.count("*").alias("c"), F.min(place).alias("head"), F.first("parts").alias("parts"))
    )
    per_anchor = classes.groupBy("h").agg((F.count("*") > HOT).alias("hot"))
    tag = lambda pos: pos.bitwiseAND(0xFFFFFF)
    asked = (
        classes.join(per_anchor, "h")
        .groupBy(F.col("head.row").alias("a_row"), tag(F.col("head.pos")).alias("a_tag"))
        .agg(F.collect_list(F.struct("h", "s", F.col("head.pos").alias("pos"), "hot")).alias("asked"))
    )
    same_row = lambda r, t: (F.col("row") == F.col(r)) & (F.col("tag") == F.col(t))
    texts = (
        rows.join(asked, same_row("a_row", "a_tag"))
        .select(*ids, "bytes", "asked.h", "asked.s", "asked.pos", "asked.hot")
        .mapInPandas(_slices(ids), _kinds(ids) + ", hot boolean, run binary")
    )
    sorted_marks = (
        texts.filter("not hot")
        .select("h", "s", *ids, "pos", "run")
        .repartition("h")
        .sortWithinPartitions("h", *ids, "pos", "s")
        .mapInPandas(_mark(keep_first), "h long, s long, marks array<int>")
    )
    marks = sorted_marks
    if not per_anchor.filter("hot").isEmpty():
        windows = texts.filter("hot").dropDuplicates(["h", "s"]).mapInPandas(_digests(ids), _kinds(ids) + ", at int, digest binary")
        copies = windows.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("w_first")).filter("n > 1")
        marked = windows.join(copies, "digest")
        if keep_first:
            marked = marked.filter(place != F.col("w_first"))
        marks = marks.unionByName(
            marked.groupBy("h", "s").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("marks"))
        )

    start = F.shiftright("pos", 32)
    n = F.shiftright("pos", 24).bitwiseAND(255)
    whole = F.array(F.struct(start.alias("lo"), (start + n + LENGTH - 1).alias("hi")))
    pairs = F.transform(
        F.expr("sequence(0, cast(size(marks) div 2 as int) - 1)"),
        lambda i: F.struct(
            (start + F.get("marks", i * 2)).alias("lo"), (start + F.get("marks", i * 2 + 1) + LENGTH - 1).alias("hi")
        ),
    )
    some = F.when(F.size("marks") > 0, pairs)
    plain = runs.filter("not mixed")
    if keep_first:
        plain = plain.filter(place != F.col("first"))
    plain = plain.select("row", "pos", F.inline(whole))
    # Classes and marks, one row each, come first and are dealt anew to parts, one for each PART runs of the anchor; then the
    # runs meet them in one join of two plain shuffles.
    per_class = classes.join(marks, ["h", "s"], "left").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    dealt = runs.filter("mixed").withColumn("part", F.pmod(F.xxhash64("row", "pos"), F.col("parts")).cast("int")).drop("parts")
    joined = dealt.join(per_class, ["h", "s", "part"])
    is_copy = (place != F.col("head")) if keep_first else (F.col("c") > 1)
    partly = joined.select("row", "pos", F.inline(F.when(is_copy, whole).otherwise(some)))
    ranges = (
        plain.unionByName(partly)
        .groupBy(F.col("row").alias("r_row"), tag(F.col("pos")).alias("r_tag"))
        .agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    )
    out = rows.join(ranges, same_row("r_row", "r_tag"), "left").select("doc_id", "bytes", "ranges.lo", "ranges.hi")
    kinds = "n_bytes long, n_removed long, n_spans long" + ", kept binary" * with_text + ", kept_sha256 string"
    return with_columns_of(out, _removed if with_text else _without_text, kinds, "bytes", "lo", "hi")
