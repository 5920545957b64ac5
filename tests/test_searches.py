"""Searches, samples, classifiers and smoothing against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscope.operators import classify, counts, evaluate, sampling, similarity
from rollscope.operators.ranking import hash32
from rollscope.plans import tables


def frame(spark, names):
    return spark.createDataFrame([(x,) for x in names], "last_name string")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(seed, letters, longest, n, shortest=0):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))) for _ in range(n)})


@pytest.mark.parametrize("letters, longest, k", [("ab", 14, 3), ("abcdé", 7, 10), ("abcdefghij", 12, 3)])
def test_edit_knn_against_all_pairs(spark, letters, longest, k):
    """Short and long names, names without a letter of the query, more neighbours asked for than there are near ones."""
    known, asked = words(1, letters, longest, 120), words(2, letters, longest, 30) + ["", "zzzz", "z" * 20]
    got = {(r.query, r["rank"]): (r.distance, r.neighbour) for r in similarity.edit_knn(frame(spark, asked), frame(spark, known), k).collect()}
    want = {(q, i): x for q in asked for i, x in enumerate(sorted((edits(q, n), n) for n in known)[:k], 1)}
    assert got == want


def test_edit_search_meets_few_names(spark, sf):
    """Segments let through a small part of all pairs, and none on their length alone."""
    counted = tables.counted_names(spark, sf)
    names = tables.known_names(counted, 1).withColumnRenamed("last_name", "neighbour")
    asked = tables.asked_names(counted).select(F.col("last_name").alias("query"))
    n, q = names.count(), asked.count()
    for t, share in ((1, 0.02), (2, 0.1)):
        met = similarity.segment_probes(asked, t).join(similarity.segment_index(names, t), ["_n", "_i", "_seg"]).count()
        assert 0 < met < share * n * q, (met, n, q)
    assert similarity.segment_index(names, 2).filter("length(_seg) = 0").isEmpty()


def brute_cosine(asked, known, k):
    grams = lambda s: [s[i : i + 2] for i in range(len(s) - 1)]
    df = {}
    for n in known:
        for g in set(grams(n)):
            df[g] = df.get(g, 0) + 1
    df = {g: d for g, d in df.items() if d <= 0.5 * len(known)}

    def vector(s):
        v = {g: grams(s).count(g) * (math.log((1 + len(known)) / (1 + df[g])) + 1) for g in set(grams(s)) if g in df}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    vectors = {n: vector(n) for n in known}
    out = {}
    for q in asked:
        mine = vector(q)
        scores = [(-round(sum(w * v.get(g, 0) for g, w in mine.items()), 9), n) for n, v in vectors.items()]
        for i, (s, n) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out[q, i] = (n, -s)
    return out


@pytest.mark.parametrize("piece", [5000, 7])
def test_cosine_knn_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(similarity, "PIECE", piece)
    known, asked = words(3, "abcdefghé", 12, 300, 1), words(4, "abcdefghé", 12, 40) + ["zz", "q"]
    got = {(r.query, r["rank"]): (r.neighbour, r.similarity) for r in similarity.cosine_knn(frame(spark, asked), frame(spark, known), 5).collect()}
    want = brute_cosine(asked, known, 5)
    assert got.keys() == want.keys()
    for key, (name, value) in want.items():
        assert got[key][1] == pytest.approx(value, abs=2e-9)
        assert got[key][0] == name or abs(brute_cosine([key[0]], known, 300)[key[0], key[1]][1] - got[key][1]) < 2e-9


def test_cosine_candidates_are_few_and_enough(spark):
    """All pairs that are similar enough are candidates, and most others are not."""
    known = words(5, "abcdefghijklmno", 10, 400, 3)
    names = frame(spark, known)
    counts = similarity.ngram_counts(names)
    idf = counts.groupBy("gram").agg(F.count("*").alias("df")).withColumn("n_names", F.lit(len(known)))
    vectors = similarity.gram_vectors(counts, idf).cache()
    some = vectors.filter(hash32("name") % 5 == 0)
    every = {(q, n): s for (q, _), (n, s) in brute_cosine([r.name for r in some.collect()], known, len(known)).items()}
    for least in (0.7, 0.4):
        met = {tuple(r) for r in similarity.cosine_candidates(some, similarity.postings(vectors), least).collect()}
        assert {pair for pair, s in every.items() if s >= least} <= met
        assert len(met) < 0.35 * some.count() * len(known)
    vectors.unpersist()


def test_samples_take_the_smallest(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SMALL", 20)
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    hashed = sorted((r[0], r[1]) for r in df.select(hash32("k"), "k").collect())
    for n in (0, 1, 250, 2999, 3000, 9999):
        assert sorted(r.k for r in sampling.sample_n(df, n, "k").collect()) == sorted(k for _, k in hashed[:n])
    plan = sampling.sample_n(df, 250, "k")._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "Window" not in plan
    assert sampling.sample_n(df.filter("false"), 5, "k").count() == 0


def test_samples_of_repeated_and_null_keys(spark, monkeypatch):
    """One key on a third of all rows, other rows equal in every column, and keys without a hash of their own."""
    monkeypatch.setattr(sampling, "SMALL", 20)
    rows = [("hot", i % 9) for i in range(900)] + [("same", 1)] * 900 + [(f"k{i}", i) for i in range(890)] + [(None, i) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    order = sorted((r[0], r[1] is not None, r[1] or "") for r in df.select(hash32("k"), "k").collect())
    for n in (1, 300, 1000, 1500, 2500):
        found = sampling.sample_n(df, n, "k").collect()
        assert sorted(r.k or "" for r in found) == sorted(k for _, _, k in order[:n])
        assert sorted(map(str, found)) == sorted(map(str, sampling.sample_n(df.repartition(3), n, "k").collect()))


def test_weighted_samples_take_the_smallest(spark):
    df = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") % 50 == 0, 1e6).otherwise(F.col("id") % 3).cast("double").alias("w"))
    u = lambda h: (h + 1) / (2.0**32 + 1)
    scored = sorted((-math.log(u(h)) / w, k) for h, k, w in df.select(hash32("k"), "k", "w").collect() if w > 0)
    assert sorted(r.k for r in sampling.weighted_sample(df, 500, "k", "w").collect()) == sorted(k for _, k in scored[:500])


def test_naive_bayes_against_plain_sums(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice("abc" if i % 3 else "cde") for _ in range(rng.randint(1, 6))), f"l{i % 5}") for i in range(200)]
    model = classify.NaiveBayes(spark.createDataFrame(rows, "last_name string, label string"))
    grams = lambda s: [s[i : i + 2] for i in range(len(s) - 1)]
    labels = sorted({c for _, c in rows})
    seen = {c: [g for n, x in rows if x == c for g in grams(n)] for c in labels}
    v = len({g for gs in seen.values() for g in gs})
    asked = words(7, "abcdez", 7, 60) + ["zzz", "z"]

    def score(name, c):
        prior = math.log(sum(x == c for _, x in rows) / len(rows))
        return prior + sum(math.log((seen[c].count(g) + 1) / (len(seen[c]) + v)) for g in grams(name))

    found = {(r.name, r.label): (r.score, r.log_prob) for r in model.scores(frame(spark, asked)).collect()}
    for name in asked:
        every = {c: score(name, c) for c in labels}
        total = math.log(sum(math.exp(s) for s in every.values()))
        for c in labels:
            assert found[name, c][0] == pytest.approx(every[c], abs=2e-6)
            assert found[name, c][1] == pytest.approx(every[c] - total, abs=2e-6)
        assert sum(math.exp(found[name, c][1]) for c in labels) == pytest.approx(1, abs=1e-4)
    for k in (1, 3, 9):
        for r in model.top_k(frame(spark, asked), k).collect():
            assert r.pred == [c for _, c in sorted((-found[r.name, c][0], c) for c in labels)][:k]


def brute_smooth(points, span, degree):
    """The same fits with every window found by sorting and every fit by least squares."""
    xs = sorted(x for x, _ in points)
    n, most = len(xs), max(1, math.floor(len(xs) * span * evaluate.CELL))
    cells = max(1, 2 ** math.ceil(math.log2(n / most) - 1e-9))
    at = [max(1, n * k // cells) for k in range(1, cells)]
    pad = max(xs[-1] - xs[0], max(abs(xs[0]), abs(xs[-1])) * 1e-10 + 1e-30) * evaluate.MARGIN
    vertices = sorted({np.mean(sorted({xs[i - 1], xs[i]})) for i in at} | {xs[0] - pad, xs[-1] + pad})
    fits = []
    for v in vertices:
        d = sorted(abs(x - v) for x in xs)
        h = d[math.ceil(n * span) - 1] * evaluate.WIDER or 1.0
        near = [(x, y) for x, y in points if abs(x - v) < h]
        t = np.array([(x - v) / h for x, _ in near])
        w = (1 - np.abs(t) ** 3) ** 3
        some = min(degree, len({x for x, _ in near}) - 1)
        design = np.stack([t**i for i in range(some + 1)], axis=1)
        beta = np.linalg.lstsq(design * np.sqrt(w)[:, None], np.array([y for _, y in near]) * np.sqrt(w), rcond=None)[0]
        fits.append((beta[0], beta[1] / h if some else 0.0))
    out = {}
    for x in set(xs):
        i = next(i for i in range(len(vertices) - 1) if x <= vertices[i + 1])
        h = vertices[i + 1] - vertices[i]
        t, (a, sa), (b, sb) = (x - vertices[i]) / h, fits[i], fits[i + 1]
        out[x] = (1 + 2 * t) * (1 - t) ** 2 * a + t * (1 - t) ** 2 * h * sa + t * t * (3 - 2 * t) * b + t * t * (t - 1) * h * sb
    return out


@pytest.mark.parametrize("degree", [1, 2])
def test_local_smooth_against_least_squares(spark, degree):
    rng = random.Random(9)
    groups = {
        "wave": [(float(x), math.sin(x / 7) + rng.random() / 5) for x in range(90)],
        "ties": [(float(rng.randint(0, 20)), rng.random()) for _ in range(300)],
        "few": [(1.0, 2.0), (2.0, 4.0), (4.0, 1.0)],
        "one": [(3.0, 5.0)] * 4,
    }
    rows = [(g, x, y) for g, points in groups.items() for x, y in points] + [("wave", None, 1.0), ("wave", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = {(r.g, r.x): r.fit for r in evaluate.local_smooth(df, "x", "y", "g", degree=degree).collect()}
    assert found.keys() == {(g, x) for g, points in groups.items() for x, _ in points}
    for g in ("wave", "ties", "one"):
        for x, fit in brute_smooth(groups[g], 0.75, degree).items():
            assert found[g, x] == pytest.approx(fit, abs=1e-6)


def test_local_smooth_gives_parabolas_back(spark):
    df = spark.createDataFrame([("m", float(i), 3.0 * i * i - 2.0 * i + 1) for i in range(50)], "g string, x double, y double")
    lines = spark.createDataFrame([("m", float(i), 2.0 * i + 1) for i in range(50)], "g string, x double, y double")
    for r in evaluate.local_smooth(lines, "x", "y", "g", degree=1).collect():
        assert r.fit == pytest.approx(2 * r.x + 1, abs=1e-6)
    for r in evaluate.local_smooth(df, "x", "y", "g").collect():  # cubics through values and slopes of a parabola are that parabola
        assert r.fit == pytest.approx(3 * r.x * r.x - 2 * r.x + 1, rel=1e-6, abs=1e-5)


def test_sequence_ratio_against_the_standard_library(spark):
    from difflib import SequenceMatcher

    left, right = words(10, "abcde", 14, 500) + ["", "é" * 9, "same"], words(11, "abcde", 14, 500)
    rng = random.Random(12)
    rows = [(a, rng.choice(right)) for a in left] + [("", ""), (None, "a"), ("abcabc", "abc"), ("ab" * 60, "ba" * 60)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", similarity.sequence_ratio("a", "b").alias("ratio")).collect():
        want = None if r.a is None else SequenceMatcher(None, r.a, r.b).ratio()
        assert r.ratio == (want if want is None else pytest.approx(want, abs=1e-12))


def test_sketches_of_parts_are_those_of_the_whole(spark):
    """Merged from parts kept apart, quantiles are within 1.65 % of rank and distinct counts within 3 %."""
    rng = random.Random(13)
    rows = [(f"n{rng.randint(0, 20_000)}", int(rng.paretovariate(0.7))) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "last_name string, count long").repartition(4)
    parts = counts.summary_sketches(df.withColumn("file", F.col("count") % 5), "count", "last_name", "file")
    halves = [counts.merge_sketches(parts.filter(test)) for test in ("file < 2", "file >= 2")]
    found = counts.read_sketches(counts.merge_sketches(halves[0].unionByName(halves[1]))).first()
    values = np.sort([n for _, n in rows])
    assert (found["min"], found["max"], found["mean"]) == (values[0], values[-1], pytest.approx(values.mean()))
    for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.997):
        low, high = (np.searchsorted(values, found[f"q{str(q)[2:]}"], side) / len(values) for side in ("left", "right"))
        assert low - 0.0165 <= q <= high + 0.0165
    assert found["distinct"] == pytest.approx(len({n for n, _ in rows}), rel=0.03)
