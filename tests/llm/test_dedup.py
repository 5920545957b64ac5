import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rollscope.llm import components, decontam, jaccard, neighbours, repeats, simhash
from rollscope.llm.components import connected_components
from rollscope.llm.queries import QUERIES
from tests.llm.fixtures import documents, empty

# --- repeated substrings


def brute_repeats(texts, keep_first):
    """(removed flags) of each text: bytes of LENGTH-byte strings that start elsewhere (earlier, with keep_first)."""
    n = repeats.LENGTH
    count, first = Counter(), {}
    for d, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            count[t[i : i + n]] += 1
            first.setdefault(t[i : i + n], (d, i))
    out = []
    for d, t in enumerate(texts):
        flags = bytearray(len(t))
        for i in range(len(t) - n + 1):
            s = t[i : i + n]
            if (first[s] != (d, i)) if keep_first else count[s] > 1:
                flags[i : i + n] = b"\1" * n
        out.append(flags)
    return out


def repeated_texts(seed, alphabet="abcdefgh é"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passage, line = word(450), word(260)
    texts = [word(rng.randint(0, 900)) for _ in range(12)]
    texts += [word(rng.randint(0, 90)) + passage + word(rng.randint(0, 90)) for _ in range(6)]
    texts += [word(40) + line + word(3) + line + word(50), "x" * 700, "xy" * 300, "", word(199), word(30) + passage[100:320]]
    texts += [texts[3], texts[3], passage[:-1] + "!"]
    return texts


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_against_brute_force(spark, monkeypatch, keep_first, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = repeated_texts(4)
    want = brute_repeats([t.encode() for t in texts], keep_first)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in repeats.remove_repeats(df, keep_first).collect()}
    assert len(found) == len(texts)
    for i, (t, flags) in enumerate(zip(texts, want, strict=True)):
        raw = t.encode()
        kept = bytes(b for b, f in zip(raw, flags, strict=True) if not f)
        runs = sum(1 for k in range(len(flags)) if flags[k] and (k == 0 or not flags[k - 1]))
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), len(raw) - len(kept), runs)
        assert bytes(r.kept) == kept and r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeats_odd_rows(spark):
    df = documents(spark)
    found = repeats.remove_repeats(df, keep_first=False).collect()
    assert len(found) == df.count()
    assert all(r.n_removed == 0 for r in found if r.n_bytes < repeats.LENGTH)
    assert repeats.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("ids", [(None, None), (7, 7), (None, 2**60 + 1)])
def test_repeats_of_rows_without_ids_of_their_own(spark, keep_first, ids):
    """Texts that agree in 24 bits of a hash and in their ids, and a third that repeats part of one of them."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(560)) for _ in range(16_000)]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64(F.col("text").cast("binary")).bitwiseAND(0xFFFFFF).alias("tag"))
    pairs = found.groupBy("tag").agg(F.sort_array(F.collect_list("text")).alias("texts")).filter("size(texts) > 1").collect()
    assert pairs
    for pair in [p.texts[:2] for p in pairs[:2]]:
        third = "z" * 30 + pair[0][100:360] + "y" * 30
        rows = [(ids[0], pair[0]), (ids[1], pair[1]), (2**60 + 3, third), (2**60 + 4, "w" * 150)]
        want = brute_repeats([t.encode() for _, t in rows], keep_first)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(df, keep_first).collect())
        assert got == sorted((len(t), sum(f), bytes(b for b, x in zip(t.encode(), f, strict=True) if not x)) for (_, t), f in zip(rows, want, strict=True))
        assert {r.doc_id for r in repeats.remove_repeats(df, keep_first).collect()} == {i for i, _ in rows}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=repeats.LENGTH, max_size=240).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=5), st.integers(0, 10))
def test_suffix_order(strings, seed):
    strings = strings + [strings[0][:210]]
    previous, later = (np.concatenate(x) for x in repeats.factors(strings, True))
    windows = [s[i : i + repeats.LENGTH] for s in strings for i in range(len(s) - repeats.LENGTH + 1)]
    for i, w in enumerate(windows):
        assert (previous[i] >= repeats.LENGTH) == (w in windows[:i]) and (later[i] >= repeats.LENGTH) == (w in windows[i + 1 :])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**30), min_size=1, max_size=3), st.sampled_from([1, 2, 3]))
def test_longest_previous_factors_against_all_pairs(seeds, letters):
    def word(seed):
        rng = random.Random(seed)
        part = bytes(rng.randrange(letters) for _ in range(rng.randint(1, 9)))
        return (part * 260)[: rng.randint(200, 215)] if rng.random() < 0.6 else bytes(rng.randrange(letters) for _ in range(207))

    strings = [word(x) for x in seeds] + [word(seeds[0])]
    windows = [s[i : i + repeats.LENGTH] for s in strings for i in range(len(s) - repeats.LENGTH + 1)]
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), repeats.LENGTH)
    previous, later = (np.concatenate(x).tolist() for x in repeats.factors(strings, True))
    assert previous == [max((same(w, x) for x in windows[:i]), default=0) for i, w in enumerate(windows)]
    assert later == [max((same(w, x) for x in windows[i + 1 :]), default=0) for i, w in enumerate(windows)]


def test_repeats_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = brute_repeats([(d.text or "").encode() for d in docs], keep_first=False)
    found = {r.doc_id: r for r in QUERIES["op3_suffix_dedup"](spark, sf).collect()}
    assert len(found) == len(docs) and any(map(any, want))
    for d, flags in zip(docs, want, strict=True):
        kept = bytes(b for b, f in zip((d.text or "").encode(), flags, strict=True) if not f)
        runs = sum(1 for k in range(len(flags)) if flags[k] and (k == 0 or not flags[k - 1]))
        r = found[d.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (sum(flags), runs, hashlib.sha256(kept).hexdigest())


# --- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=simhash.RADIUS))
def test_masks_cover_the_radius(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    masks = [m % 2**64 for m in simhash.covering_masks()]
    assert len(masks) == 31 and any(x & m == y & m for m in masks)


def brute_components(prints):
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("block", [256, 2])
def test_near_classes_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)
    rng = random.Random(6)
    prints = []
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.fp: r.label for r in simhash.near_classes(df).collect()}
    want = brute_components(prints)
    groups, other = defaultdict(set), defaultdict(set)
    for p, w in zip(signed, want, strict=True):
        groups[w].add(p)
        other[found.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_simhash_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_fingerprint(d.text) for d in docs]
    want = brute_components(prints)
    found = {r.doc_id: r for r in QUERIES["op4_simhash"](spark, sf).collect()}
    for d, p, w in zip(docs, prints, want, strict=True):
        assert found[d.doc_id].fingerprint == f"{p:016x}" and found[d.doc_id].component_id == docs[w].doc_id


def test_simhash_odd_rows(spark):
    df = documents(spark)
    found = simhash.near_duplicates(df).collect()
    assert len(found) == df.count()
    blank = {r.component_id for r in found if r.fingerprint == "0" * 16}
    assert blank == {0}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.filter("doc_id is null").count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0


def brute_similar(texts):
    """Component numbers under 5-word Jaccard of 0.8 or more, each the first row of its component."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if n == old else n for n in label]
    return label


def edited_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for n in (4, 5, 6, 30, 60, 120, 400):
        words = [word() for _ in range(n)]
        for _ in range(10):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, max(1, n // 30))):
                words[rng.randrange(n)] = word()
    return texts


@pytest.mark.parametrize("block", [256, 2])
def test_similar_texts_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)
    texts = edited_texts(11)
    want = brute_similar(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similar_texts(df).collect()} == dict(enumerate(want))
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == set(want)
    prints = [brute_fingerprint(t) for t in texts]
    assert any(want[i] == want[j] and (prints[i] ^ prints[j]).bit_count() > 4 for i in range(70) for j in range(i))


def test_similar_texts_of_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = brute_similar([d.text for d in docs])
    found = {r.doc_id: r.component_id for r in jaccard.similar_texts(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert found == {d.doc_id: docs[w].doc_id for d, w in zip(docs, want, strict=True)}
    assert len(set(want)) < len(set(brute_components([brute_fingerprint(d.text) for d in docs])))


def test_one_document_of_each_group_stays(spark):
    texts = ["one two three four five six", "another text of some more words", "One two three four five six", None, ""]
    rows = [(1, texts[0], {"a": 1}), (1, texts[1], None), (0, texts[2], None), (None, texts[1], None), (None, texts[3], None), (5, texts[4], None), (1, texts[1], {"b": 2})]
    df = spark.createDataFrame(rows, "doc_id long, text string, label map<string,int>")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, texts[2]), (1, texts[1]), (5, "")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = connected_components(links).collect()
    assert {r.label for r in found} == {0, 1000} and len(found) == 203


# --- decontamination


def item_texts(seed, n=30):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(80)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + "."
    return rng, vocabulary, [" ".join(sentence(rng.randint(3, 12)) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5])
def test_wand_against_full_scores(threshold):
    rng, vocabulary, items = item_texts(7, 150)
    items += ["solitary", "Solitary?", vocabulary[0]]
    whole = decontam.ItemIndex(list(enumerate(items)))
    assert sum(len(x.item_of) for x in whole.classes) > len(items)
    for index in whole.classes:
        for _ in range(60):
            passage = " ".join(rng.choice(vocabulary) for _ in range(60)) + " " + rng.choice(items)
            terms = np.unique(index.hits(whole.numbers(decontam.words(passage)))[1])
            scores = Counter()
            for t in terms.tolist():
                for i, x in zip(index.items[t], index.impacts[t], strict=True):
                    scores[i] += x
            want = {i: pytest.approx(s) for i, s in scores.items() if s >= threshold - 1e-9}
            assert dict(index.search(terms, threshold)) == want


def brute_leaks(texts, items):
    """(text, item) for which some window of twice the item's size class meets the overlaps, by plain lists."""
    split = lambda t: [w for w in "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (t or "").lower()).split(" ") if w]
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    share = lambda ws, there: len(grams(ws) & grams(there)) / len(grams(ws)) if len(ws) >= 5 else float(any(there[i : i + len(ws)] == ws for i in range(len(there))))
    out = set()
    for i, item in enumerate(items):
        whole = split(item)
        if not whole:
            continue
        parts = [p for p in map(split, re.split(r"(?<=[.!?])\s+|\n", item)) if p]
        question, answer = (sum(parts[:-1], []), parts[-1]) if len(parts) > 1 else (whole, whole)
        size = 32
        while size < len(whole):
            size *= 2
        for d, text in enumerate(texts):
            ws = split(text)
            if not set(ws) & set(whole):
                continue
            for start in range(0, max(1, len(ws) - size), size):
                there = ws[start : start + 2 * size]
                said = sum((Counter(answer) & Counter(there)).values()) / len(answer)
                if share(whole, there) >= 0.8 or share(question, there) >= 0.8 and said >= 0.8:
                    out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    """Both ways, with questions beside scattered answers, one-word items and items that are much longer than others."""
    rng, vocabulary, items = item_texts(12, 25)
    items += ["solitary", " ".join(rng.choice(vocabulary) for _ in range(300)) + ".", "What is it? " + " ".join(rng.choice(vocabulary) for _ in range(40)) + "."]
    texts = []
    for item in items:
        ws = item.split()
        filler = lambda k: " ".join("".join(rng.choice("ijklmn") for _ in range(4)) for _ in range(k))
        head, _, tail = item.rpartition(". ")
        mixed = tail.rstrip(".").split()
        rng.shuffle(mixed)
        texts += [f"{filler(rng.randint(0, 90))} {item} {filler(rng.randint(0, 90))}", f"{filler(40)} {head}. {filler(3)} {' '.join(mixed)} {filler(30)}"]
        texts += [" ".join(w if rng.random() > 0.04 else "zz" for w in ws), " ".join(ws[: len(ws) // 2]), f"{head}. {filler(2000)} {tail}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect())
    want = brute_leaks(texts, items)
    assert found == sorted(want) and len(items) <= len(want) < len(texts) * 2
    assert (items.index("solitary") * 5, items.index("solitary")) in want


def test_leaks_are_found_and_others_left(spark):
    rng, vocabulary, items = item_texts(8)
    filler = lambda k: " ".join("".join(rng.choice("ijklmn") for _ in range(4)) for _ in range(k))
    texts = [f"{filler(rng.randint(0, 300))} {item.upper()} {filler(rng.randint(0, 300))}" for item in items]
    texts += [filler(200), " ".join(rng.choice(vocabulary) for _ in range(300)), None, "", items[0][: len(items[0]) // 3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert {(i, i) for i in range(len(items))} <= found
    assert not any(d >= len(items) for d, _ in found)
    kept = {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()}
    assert kept == set(range(len(items), len(texts)))


def test_shards_agree_with_one_index(spark, sf, monkeypatch):
    pairs = lambda: sorted(map(tuple, QUERIES["op5_decontam"](spark, sf).collect()))
    whole = pairs()
    monkeypatch.setattr(decontam, "SHARD_WORDS", 400)
    assert whole == pairs() and whole


def test_leak_query_against_brute_force(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {(docs[d].doc_id, items[i].item_id) for d, i in brute_leaks([d.text for d in docs], [i.text for i in items])}
    found = [(r.doc_id, r.item_id) for r in QUERIES["op5_decontam"](spark, sf).collect()]
    assert set(found) == want and len(found) == len(want) > 0


def test_decontamination_odd_rows(spark):
    df = documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(df, none).count() == 0
    assert decontam.drop_leaks(df, none).count() == df.count()
    bench = spark.createDataFrame([(None, "The same text twice."), (1, "The same text twice.")], "item_id long, text string")
    assert decontam.find_leaks(empty(spark), bench).count() == 0
    assert decontam.find_leaks(df, bench).count() == 6


# --- nearest neighbours


def test_chi_square():
    assert neighbours.chi_square(np.array([0.0, 7.344, 15.507]), 8) == pytest.approx([0, 0.5, 0.95], abs=1e-3)


def test_recall_on_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}
    found = defaultdict(list)
    for r in QUERIES["op9_ann"](spark, sf).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
    assert sorted(found) == sorted(i for i in vectors if i % 20 == 0)
    hits = 0
    for q, got in found.items():
        best = sorted(((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q))[:20]
        assert got == sorted(got, key=lambda x: (-x[1], x[0])) and len(got) == 20
        hits += len({i for i, _ in got} & {i for _, i in best})
    assert hits / (20 * len(found)) >= 0.95


def brute_nearest(vectors, query):
    scores = {i: float(vectors[query] @ v) for i, v in vectors.items() if i != query}
    return sorted(scores, key=lambda i: (-scores[i], i))[:20]


def test_recall_over_several_cells_and_shards(spark, monkeypatch):
    """At sf0.1, where the vectors have no structure, and on clustered ones with a crowd of equal vectors."""
    monkeypatch.setattr(neighbours, "SHARD", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    clustered = np.concatenate([centres[rng.integers(0, 40, 3000)] + 0.2 * rng.standard_normal((3000, 16)), np.repeat(centres[:1], 1000, axis=0)])
    rows = {
        "given": [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()],
        "clustered": [(i, v.tolist()) for i, v in enumerate(clustered)],
    }
    for name, some in rows.items():
        vectors = {i: np.array(v, dtype=float) for i, v in some}
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>")
        found = defaultdict(list)
        for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
            found[r.query_id].append(r.vec_id)
        assert len(found) == sum(i % 20 == 0 for i in vectors) and all(len(x) == 20 for x in found.values()), name
        hits = 0
        for q, got in found.items():
            least = float(vectors[q] @ vectors[brute_nearest(vectors, q)[-1]])
            hits += sum(float(vectors[q] @ vectors[i]) >= least - 1e-9 for i in got)
        assert hits / (20 * len(found)) >= 0.9, name


def test_clustered_vectors_are_not_all_verified():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((100, 64))[rng.integers(0, 100, 8192)] + 0.25 * rng.standard_normal((8192, 64))
    tree = neighbours.ProjectedTree(vectors, np.arange(8192), float(np.sqrt((vectors**2).sum(axis=1).max())))
    found = tree.search(vectors[:100], np.arange(100), np.full(100, -np.inf))
    assert tree.verified / (100 * 8192) < 0.2
    hits = sum(len(set(some.vec_id) & set(brute_nearest(dict(enumerate(vectors)), q))) for q, some in found.groupby("query_id"))
    assert hits / 2000 >= 0.95


def test_neighbours_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 64)
    nan = float("nan")
    rows = [(i, [1.0, 0.0, 0.0], 1) for i in range(100)] + [(100 + i, [0.0, float(i % 7), 1.0], 1) for i in range(60)]
    rows += [(1000, None, 1), (1001, [0.0, 0.0, 0.0], 1), (1002, [nan, 1.0, 0.0], 1), (1003, [None, 1.0, 0.0], 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 1.0], 1), (1007, [float("inf"), 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    found = defaultdict(list)
    for r in neighbours.nearest(df, df.filter("vec_id in (3, 100, 1001, 1002, 1005)")).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert sorted(found) == [3, 100, 1005]
    assert found[3] == [i for i in range(21) if i != 3]
    assert found[1005] == [1006]
    assert neighbours.nearest(df.filter("false"), df.filter("false")).count() == 0
    assert neighbours.nearest(df.filter("vec_id < 3"), df.filter("vec_id < 2")).count() == 4


def test_repeated_query_rows(spark):
    rows = [(i, [1.0, i / 100]) for i in range(60)] + [(100, [1.0, 1.0]), (100, [1.0, 1.0]), (200, [1.0, 0.0]), (200, [-1.0, -9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in neighbours.nearest(df, df.filter("vec_id >= 100")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = lambda q: [i for _, i, _ in found[q]]
    assert {q: [n for n, _, _ in x] for q, x in found.items()} == {q: list(range(1, 21)) for q in (100, 200)}
    assert ids(100) == list(range(59, 39, -1))
    assert ids(200) == list(range(20))  # of -1, -9 and 1, 0 the former is the query
    assert found[200][0][2] == pytest.approx(-1.0)


def test_neighbours_are_searched_for_many_queries_at_once(monkeypatch):
    """The stopping test was taken for one query at a time, over three times each, which made CPU time grow with the pairs."""
    rng = np.random.default_rng(29)
    vectors, calls = rng.standard_normal((3000, 32)), []
    plain = neighbours.chi_square
    monkeypatch.setattr(neighbours, "chi_square", lambda *a: calls.append(1) or plain(*a))
    tree = neighbours.ProjectedTree(vectors, np.arange(3000), float(np.sqrt((vectors**2).sum(axis=1).max())))
    found = tree.search(vectors[:300], np.arange(300), np.full(300, -np.inf))
    assert len(calls) < 300
    hits = 0
    for q, rows in found.groupby("query_id"):
        products = vectors @ vectors[q]
        products[q] = -np.inf
        hits += len(set(np.argsort(-products)[:20]) & set(rows["vec_id"]))
        assert rows["score"].to_numpy() == pytest.approx(products[rows["vec_id"]]) and q not in set(rows["vec_id"])
    assert hits >= 0.9 * 20 * 300
