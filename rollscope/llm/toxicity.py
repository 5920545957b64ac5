"""Toxicity: a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words sums their common subsequences of ORDER letters, each weighted by DECAY to the power of
the stretches it covers, so gapped spellings and inserted characters still match. It is normalised to 1 for equal words
and raised to POWER, a kernel again, under which words that share a few letters by chance are nearly orthogonal. Words
are compared as letters only (`i.d.i.o.t` is `idiot`, digits stand for the letters they imitate, lone letters in a row are
one word) after a mark of the word's start.

A text is the set of its words' beginnings, so endings cost nothing, and a landmark is a set of one string. The kernel of
a text with a landmark is the highest of any beginning; normalised values under FLOOR count as 0, which changes a kernel
value by FLOOR to the POWER at most. Pairs that can't reach FLOOR by their letters are not computed: without some of its
letters a landmark keeps only a part of its norm.
Landmarks are strings that set toxic training texts apart, and frequent words of the others. Kernel values with the
landmarks times the inverse root of the landmarks' own kernel matrix are the features (Nyström), a support vector machine
is trained on them by dual coordinate descent, and its margin is mapped to a probability (Platt).

Training texts are whole texts and, of toxic ones, also each sentence that a telling string (SURE or more) shows to
be meant. Strings that a first fit finds toxic on their own are then given in other spellings as well, with a letter inserted,
doubled or left out, unless more than ALIKE of the clean training texts have words that are like them without being them:
such words are none of their spellings. Clean texts are CLEAN_COST times as costly as toxic ones if missed. Training
uses at most TRAIN_TEXTS texts of each label, those with the smallest hashes, of TRAIN_CHARS characters or fewer. Scoring
reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rollscope.llm.common import bounded_batches

ORDER = 3
DECAY = 0.8
LANDMARKS = 104
CLEAN_LANDMARKS = 8
TRAIN_TEXTS = 1500
TRAIN_CHARS = 20_000
LONGEST = 26
START = "^^"
HELD_OUT = 5
POWER = 5
FLOOR = 0.6
ALIKE = 0.02
CLEAN_COST = 2.0
SURE = 0.5

SENTENCE = re.compile(r"[.!?]\s|\n")
LONE = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
# Digits and signs that imitate letters.
IMITATED = str.maketrans("01345@", "oieasa")


def words_of(text: str) -> set[str]:
    """Distinct lower-case words, with runs of lone characters joined as well."""
    low = text.lower()
    found = set(low.split())
    for run in LONE.findall(low):
        parts = run.split()
        found.update(("".join(parts), "".join(parts[1:])))  # the first may be a word of its own
    return found


def letters(word: str) -> list[str]:
    """START and the letters of a word, in overlapping parts of LONGEST if there are more."""
    kept = START + (word if word.isalpha() else "".join(filter(str.isalpha, word.translate(IMITATED))))
    if len(kept) <= LONGEST:
        return [kept]
    return [kept[i : i + LONGEST] for i in range(0, len(kept) - LONGEST // 2, LONGEST // 2)]


def letter_bits(parts: list[str]) -> np.ndarray:
    """A bit for each of a-z and five for all others, per string."""
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    bit = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % 5)
    bits = np.zeros(len(parts), dtype=np.uint32)
    full = np.flatnonzero(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[full]
    if len(full):
        bits[full] = np.bitwise_or.reduceat(np.uint32(1) << bit, starts)
    return bits


def padded(parts: list[str], width: int) -> np.ndarray:
    """Code points, a row a string, 0 beyond its end."""
    raw = "".join(part.ljust(width, "\0") for part in parts).encode("utf-32-le")
    return np.frombuffer(raw, dtype=np.uint32).reshape(len(parts), width)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER of aligned pairs of strings."""
    out = np.zeros(len(left))
    if not left:
        return out
    width = max(1, max(map(len, right)))
    back = np.arange(width)
    fade = np.where(back[None, :] >= back[:, None], DECAY ** (back[None, :] - back[:, None]).clip(0), 0).astype(np.float32)
    order = sorted(range(len(left)), key=lambda i: len(left[i]))
    for low in range(0, len(order), 4096):
        some = order[low : low + 4096]
        a = padded([left[i] for i in some], max(1, max(len(left[i]) for i in some)))
        b = padded([right[i] for i in some], width)
        total = np.zeros(len(some), np.float32)
        # prefix[i][:, j]: subsequences of i + 1 letters that end within the first j letters of b.
        prefix = [np.zeros((len(some), width + 1), np.float32) for _ in range(ORDER - 1)]
        for column in a.T:
            same = ((column[:, None] == b) & (column[:, None] > 0)) * np.float32(DECAY**2)
            total += (same * prefix[-1][:, :-1]).sum(axis=1)
            for i in range(ORDER - 2, -1, -1):
                shorter = prefix[i - 1][:, :-1] if i else np.float32(1)
                prefix[i][:, 1:] = DECAY * prefix[i][:, 1:] + (same * shorter) @ fade
        out[some] = total
    return out


def least_norms() -> np.ndarray:
    """The norm that a string of 1, 2, ... LONGEST letters has at least, that of one of all different letters."""
    n, wide = np.arange(1, LONGEST + 1)[:, None], np.arange(2, LONGEST)[None, :]
    return np.sqrt(((n - wide).clip(0) * (wide - 1) * DECAY ** (2.0 * (wide + 1))).sum(axis=1))


class Landmarks:
    """The landmark strings with their subsequences of three letters and their Nyström map."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.bits = letter_bits(strings)
        codes = sorted({ord(c) for s in strings for c in s})
        self.numbers = np.zeros(max(codes, default=0) + 2, np.int64)  # of the letters of landmarks; 0 for any other
        self.numbers[codes] = np.arange(1, len(codes) + 1)
        self.letters = len(codes) + 1
        weight: Counter = Counter()  # of (subsequence, landmark)
        for number, s in enumerate(strings):
            for at in combinations(range(len(s)), ORDER):
                weight["".join(s[i] for i in at), number] += DECAY ** (at[-1] - at[0] + 1)
        every = sorted({u for u, _ in weight})
        weights = np.zeros((len(every) + 1, len(strings)))  # a row a subsequence, none for row 0
        row = {u: i + 1 for i, u in enumerate(every)}
        for (u, number), w in weight.items():
            weights[row[u], number] = w
        weights /= np.sqrt((weights**2).sum(axis=0))
        # The landmarks that have each subsequence, and the weights there.
        self.holds = (weights > 0).sum(axis=1)
        self.begins = np.cumsum(self.holds) - self.holds
        self.held_by = np.nonzero(weights)[1]
        self.weights = weights[weights > 0]
        # Numbers of the first two letters, and by these and the third that of the subsequence.
        pair = {u: i + 1 for i, u in enumerate(sorted({u[:2] for u in every}))}
        of = lambda c: int(self.numbers[ord(c)])
        self.pairs = np.zeros(self.letters**2, np.int64)
        for u, i in pair.items():
            self.pairs[of(u[0]) * self.letters + of(u[1])] = i
        self.triples = np.zeros((len(pair) + 1) * self.letters, np.int32)
        for u in every:
            self.triples[pair[u[:2]] * self.letters + of(u[2])] = row[u]
        values, vectors = np.linalg.eigh((weights.T @ weights) ** POWER)
        self.whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        bits = letter_bits(every)
        self.spare = [self._spare(b, bits, w**2) for b, w in zip(self.bits, weights[1:].T, strict=True)]

    @staticmethod
    def _spare(own: np.uint32, bits: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The sets of a landmark's letters, as bits, that a word can lack and still have a normalised kernel of FLOOR with it.

        The kernel is the inner product over the subsequences that both have, so, normalised, it is at most the norm of the
        landmark's subsequences without those letters.
        """
        bits, parts = bits[parts > 0], parts[parts > 0]
        each = [1 << i for i in range(32) if int(own) >> i & 1]
        allowed, latest = [0], [0]
        while latest:  # a set is allowed only if all smaller ones are
            larger = {some | one for some in latest for one in each if one > some}
            latest = sorted(x for x in larger if parts[(bits & np.uint32(x)) == 0].sum() >= FLOOR**2)
            allowed += latest
        return np.array(sorted(allowed), dtype=np.uint32)

    def likeness(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, landmark, kernel) of the beginnings of words of LONGEST letters or fewer whose normalised value with
        a landmark is FLOOR or more, raised to POWER."""
        bits = letter_bits(words)
        near = np.zeros(len(words), dtype=bool)
        for own, spare in zip(self.bits, self.spare, strict=True):
            lacking = own & ~bits
            few = np.flatnonzero(np.bitwise_count(lacking) <= np.bitwise_count(spare).max())
            near[few[np.isin(lacking[few], spare)]] = True
        by_length: dict[int, list[int]] = {}
        for i in np.flatnonzero(near).tolist():
            by_length.setdefault(len(words[i]), []).append(i)
        floor = FLOOR * least_norms()
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        begins: list[str] = []
        for n, at in by_length.items():
            if n < ORDER:
                continue
            i, j = np.triu_indices(n, 1)
            number = np.zeros((n, n), dtype=int)
            number[i, j] = np.arange(len(i))
            places = np.array(sorted(combinations(range(n), ORDER), key=lambda x: x[-1]))
            two, last = number[places[:, 0], places[:, 1]], places[:, 2]
            weight = DECAY ** (last - places[:, 0] + 1.0)
            step = max(1, (1 << 17) // len(places))
            for low in range(0, len(at), step):
                some = at[low : low + step]
                a = self.numbers[np.minimum(padded([words[x] for x in some], n), len(self.numbers) - 1)]
                start = self.pairs[a[:, i] * self.letters + a[:, j]] * self.letters
                held = self.triples[start[:, two] + a[:, last]]
                r, c = np.nonzero(held)
                if not len(r):
                    continue
                t = held[r, c]
                times = self.holds[t]
                at_weight = np.repeat(self.begins[t] - np.cumsum(times) + times, times) + np.arange(times.sum())
                cell = np.repeat(r * len(self.strings) * n + last[c], times) + self.held_by[at_weight] * n
                value = np.bincount(cell, np.repeat(weight[c], times) * self.weights[at_weight], len(some) * len(self.strings) * n)
                value = value.reshape(-1, n).cumsum(axis=1)
                x, end = np.nonzero((value >= floor[:n]) & (value > 0))
                word, l = np.divmod(x, len(self.strings))
                found.append((np.array(some)[word], l, value[x, end]))
                begins += [words[some[k]][: e + 1] for k, e in zip(word.tolist(), end.tolist(), strict=True)]
        word, landmark, value = (np.concatenate(x) for x in zip(*found, strict=True))
        distinct = sorted(set(begins))
        norm = dict(zip(distinct, np.sqrt(kernel(distinct, distinct)).tolist(), strict=True))
        value = value / np.array([norm[x] for x in begins])
        alike = value >= FLOOR
        return word[alike], landmark[alike], np.minimum(value[alike], 1.0) ** POWER

    def features(self, texts: Iterable[set[str]]) -> np.ndarray:
        """(texts, landmarks): the kernel of each text with each landmark."""
        texts = list(texts)
        out = np.zeros((len(texts), len(self.strings)))
        holders: dict[str, list[str]] = {}
        for w in set().union(*texts):
            for part in letters(w):
                holders.setdefault(part, []).append(w)
        parts = list(holders)
        if not parts or not self.strings:
            return out
        best: dict[str, dict[int, float]] = {}
        for i, j, v in zip(*(x.tolist() for x in self.likeness(parts)), strict=True):
            for w in holders[parts[i]]:
                of = best.setdefault(w, {})
                of[j] = max(of.get(j, 0.0), v)
        flagged = best.keys()
        for row, text in zip(out, texts, strict=True):
            for w in flagged & text:
                for j, v in best[w].items():
                    row[j] = max(row[j], v)
        return out


def telling_strings(toxic: list[set[str]], clean: list[set[str]], most: int) -> list[str]:
    """Strings of four letters or more found in several toxic texts and in next to no other, greedily.

    Each is grown while nearly all of the words that hold it go on alike, and its words are then done with.
    """
    plain = [{x for w in text for x in letters(w) if len(x) > len(START) + ORDER} for text in toxic]
    other = Counter(x for text in clean for x in {x for w in text for x in letters(w) if len(x) > len(START) + ORDER})
    new = [{w for w in text if other[w] * len(toxic) < 0.05 * len(clean)} for text in plain]
    grams_of = lambda w: {w[i : i + n] for n in (4, 5) for i in range(1, len(w) - n + 1)} | {w[1:]}
    held = Counter(w for text in new for w in text)
    holders: dict[str, list[str]] = {}
    for w in held:
        for g in grams_of(w):
            holders.setdefault(g, []).append(w)
    counts = {g: sum(held[w] for w in ws) for g, ws in holders.items()}
    need = max(3, round(0.02 * len(toxic)))
    asked = {g for g, n in counts.items() if n >= need}
    elsewhere = Counter(g for w in other for g in grams_of(w) & asked)
    found: list[str] = []
    done: set[str] = set()
    for gram in sorted(asked, key=lambda g: (-counts[g], -len(g), g)):
        words = [w for w in holders[gram] if w not in done]
        n = sum(held[w] for w in words)
        if n < need or len(found) >= most or elsewhere[gram] * len(toxic) > 0.02 * n * max(1, len(clean)):
            continue
        grown = gram
        while len(grown) < 14:
            ways = Counter()
            for w in words:
                at = w.find(grown)
                if at > 0:
                    ways[w[at - 1] + grown] += held[w]
                if at >= 0 and at + len(grown) < len(w):
                    ways[grown + w[at + len(grown)]] += held[w]
            best, c = max(ways.items(), key=lambda x: (x[1], x[0]), default=("", 0))
            if c < 0.85 * n:
                break
            grown = best
        found.append(grown)
        done.update(words)
    return found


def spellings(word: str) -> list[str]:
    """A word with one letter inserted, doubled or left out."""
    inner = range(1, len(word))
    inserted = [word[:i] + c + word[i:] for i in inner for c in "qx"]
    return inserted + [word[:i] + word[i] + word[i:] for i in range(len(word))] + [word[:i] + word[i + 1 :] for i in inner]


def shares(y: np.ndarray) -> np.ndarray:
    """The costs of rows, such that clean ones cost CLEAN_COST times as much as toxic ones altogether."""
    return np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), CLEAN_COST * len(y) / max(1, 2 * (y < 0).sum()))


def support_vectors(x: np.ndarray, y: np.ndarray, share: np.ndarray, cost: float = 20.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with hinge loss, by dual coordinate descent in a fixed order; `share` weighs the rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    alpha, w, norm = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(axis=1)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), cost * share[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w[:-1], w[-1]


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels to margins."""
    p = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    x, w = np.stack([margin, np.ones(len(y))], axis=1), np.array([2.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, x.T @ (q - p) + (w - [2.0, 0.0]))
        w = w - step / max(1.0, np.abs(step).max())
    return float(max(w[0], 0.5)), float(w[1])


class Model:
    """From labelled texts to scores. With texts of one label only every score is that label's constant."""

    def __init__(self, texts: list[str], toxic: list[int]):
        y = np.where(np.array(toxic, dtype=int) > 0, 1.0, -1.0)
        sets = [words_of(t) for t in texts]
        bad = [s for s, t in zip(sets, y, strict=True) if t > 0]
        good = [s for s, t in zip(sets, y, strict=True) if t < 0]
        self.constant = None if bad and good else float(bool(bad))
        if self.constant is not None:
            return
        strings = telling_strings(bad, good, LANDMARKS - CLEAN_LANDMARKS)
        usual = Counter(x for s in good for w in s for x in letters(w) if 8 <= len(x) <= 10)
        usual = [w for w, _ in sorted(usual.items(), key=lambda x: (-x[1], x[0])) if not any(t in w or w in t for t in strings)]
        self.landmarks = Landmarks(strings + usual[:CLEAN_LANDMARKS])
        raw = self.landmarks.features(sets)
        parts = [words_of(x) for t, v in zip(texts, y, strict=True) if v > 0 for x in SENTENCE.split(t) if x]
        sentences = self.landmarks.features(parts)
        sentences = sentences[sentences[:, : len(strings)].max(axis=1, initial=0.0) >= SURE]
        nothing = np.zeros((1 + len(y) // 20, raw.shape[1]))  # a text without any of the strings is not toxic
        both = np.concatenate([raw, sentences, nothing]) @ self.landmarks.whiten
        sides = np.concatenate([y, np.ones(len(sentences)), -np.ones(len(nothing))])
        w, b = support_vectors(both, sides, shares(sides))
        alone = self.landmarks.features([{x.removeprefix(START)} for x in strings]) @ self.landmarks.whiten @ w + b > 0
        alike = raw[y < 0][:, : len(strings)]
        apart = ((alike > 0) & (alike < 1)).mean(axis=0) <= ALIKE
        varied = [s.removeprefix(START) for s, own in zip(strings, alone & apart, strict=True) if own]
        other = self.landmarks.features([{x} for s in varied for x in spellings(s)])
        other = other[other.max(axis=1, initial=0.0) > 0] @ self.landmarks.whiten
        costs = np.concatenate([shares(sides), np.ones(len(other))])
        w, b = support_vectors(np.concatenate([both, other]), np.concatenate([sides, np.ones(len(other))]), costs)
        self.weights, self.bias = self.landmarks.whiten @ w, b
        self.slope, self.offset = platt(raw @ self.weights + b, y)

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        sets = [words_of(t) for t in texts]
        if self.constant is not None:
            return np.full(len(sets), self.constant)
        margin = self.landmarks.features(sets) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def held_out(doc_id):
    """Whether crc32 of the doc_id as text is divisible by HELD_OUT; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the bounded sample of labelled texts that aren't held out."""
    rows = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("at", F.md5(F.col("doc_id").cast("string")))
    )
    picked = [rows.filter(test).orderBy("at", "doc_id").limit(TRAIN_TEXTS) for test in ("toxic > 0", "toxic <= 0")]
    ids = picked[0].unionByName(picked[1]).select("doc_id", "toxic", "at")
    texts = docs.select("doc_id", "text").filter(F.length("text") <= TRAIN_CHARS)
    # One text an id, the smallest, so at most 2 x TRAIN_TEXTS rows.
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("at", "doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    found = sorted(sample.collect())
    return Model([r.text for r in found], [r.toxic for r in found])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 from 0.5).

    Null texts are scored as empty ones, long ones whole, by all of their words. Without labels, or with one label only, scores
    are constant. Repeated rows give repeated results; of repeated labels the higher one counts, of repeated ids in training the
    smallest text. An empty table gives no rows. Nothing but the text is an input of a score.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs, labels)

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    score = F.pandas_udf(lambda texts: pd.Series(model.scores(texts)), "double")
    return rows.select("doc_id", score("text").alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, whole and with all columns; null texts are judged as empty ones and stay null."""
    bounded_batches(docs.sparkSession)
    model = train(docs, labels)
    keep = F.pandas_udf(lambda texts: pd.Series(model.scores(texts) < 0.5), "boolean")
    return docs.filter(keep(F.coalesce("text", F.lit(""))))
