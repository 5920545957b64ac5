"""Spelling variants, URL rules and the Merkle manifest against plain versions, on odd rows and hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollscope.llm import manifest, spelling, urls
from tests.llm.fixtures import ODD_TEXTS, documents, empty

LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# --- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows, each):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if each and h % each == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    return {(w, *v, root(out, w)) for w, v in out.items()}


def root(out, w):
    while out[w][2]:
        w = out[w][2]
    return w


def found_spelling(df, each):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(df, each).collect()}


def test_spelling_of_words_of_few_letters(spark):
    """Words over three letters, so that most have many near ones and chunks repeat inside a word."""
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(400)]
    rows = [(i, " ".join(rnd.choices(pool, k=60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for each in (0, 7):
        assert found_spelling(df, each) == brute_spelling(rows, each)


def test_spelling_chains_lead_to_their_root(spark):
    words = {"abcde": 3, "abcdf": 6, "abcxf": 12, "abzxf": 24, "ayzxf": 48, "qyzxf": 96}
    rows = [(1, " ".join(w for w, n in words.items() for _ in range(n)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.root for r in spelling.spelling_variants(df, 0).collect()} == {"qyzxf"}
    assert found_spelling(df, 0) == brute_spelling(rows, 0)


def test_spelling_of_a_hot_beginning(spark):
    """Words that share all but the last letters: every pair that is joined differs by one edit, and all of them are found."""
    pool = [f"abcdefgh{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(None, f"{w} {w} {w}") for w in pool] + [(5, "abcdefghaa " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_spelling(df, 0) == brute_spelling(rows, 0)


def test_spelling_of_odd_rows(spark):
    df = documents(spark, [*ODD_TEXTS, "ÀÉÎÕÜ àéîõü × ÷ Straße", "Words words WORDS wordz wordz wordz " * 2])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found_spelling(df, 97) == brute_spelling(rows, 97)
    assert found_spelling(df.withColumns({"word": F.lit(1), "n": F.lit(2), "_id": F.lit(3)}), 97) == brute_spelling(rows, 97)
    assert spelling.spelling_variants(empty(spark)).count() == 0


# --- urls


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group().translate(LOW)
    path = re.match("[^/?#]*([^?#]*)", rest).group(1)
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0])) if fit else None
    return host, path, best[1] + best[2] if best else None, best[0] if best else default


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com./en/", "http://.com/", "http://a..com/x",
    "http://example.com:80/en/", "http://www.example.com/EN/", "http://xexample.com/en/", "http://b.net/es/://c", "http://net#/es/", "http://é.net/fr/\nx", "x://y?://com/",
]


def judged(pages, rules, spark):
    found = urls.judge_urls(pages, urls.rules_table(spark, rules))
    return Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect())


def test_odd_urls(spark):
    rows = [(i if i % 5 else None, u, "h", 1) for i, u in enumerate([*ODD_URLS, *ODD_URLS[-4:], "http://com/" + "x" * 100_000, "http://" + "a." * 20_000 + "com/y"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict int").withColumns({"_key": F.lit(1), "host": F.lit(2)})
    assert judged(pages, urls.RULES, spark) == Counter((i, *brute_url(u, urls.RULES)) for i, u, *_ in rows)
    assert urls.judge_urls(pages.filter("false"), urls.rules_table(spark)).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, urls.rules_table(spark).filter("false"), "block").collect()} == {"block"}


def test_many_nested_rules_and_a_hot_url(spark):
    rnd = random.Random(5)
    label = lambda: rnd.choice(["a", "b", "c", "ab"])
    host = lambda k: ".".join(label() for _ in range(rnd.randint(1, k)))
    path = lambda k: "/" + "".join(label() + "/" for _ in range(rnd.randint(0, k)))
    rules = [(rnd.choice(["allow", "block"]), host(3), path(2)) for _ in range(150)] + [("block", "a", ""), ("allow", None, "/"), ("allow", "a/", "/"), ("allow", "a", "b")]
    rows = [(i + 2**60, f"http://{host(5)}{path(4)}") for i in range(2000)] + [(i % 3, "http://a.b.c/a/b/") for i in range(1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    usable = [r for r in rules if r[1] is not None]
    assert judged(pages, rules, spark) == Counter((i, *brute_url(u, usable)) for i, u in rows)


# --- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, low=False):
    row = [*row[:-1], row[-1].translate(LOW) if low and row[-1] is not None else row[-1]]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_path(levels, i):
    for nodes in levels[:-1]:
        run = i - i % 16
        yield nodes[run:i], nodes[i + 1 : run + 16]
        i //= 16


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))) for s in sources}
    levels = {s: brute_levels([brute_leaf(r) for r in ordered[s]]) for s in sources}
    upper = brute_levels([levels[s][-1][0] for s in sources])
    out = Counter()
    for k, s in enumerate(sources):
        for i, r in enumerate(ordered[s]):
            path = [*brute_path(levels[s], i), *brute_path(upper, k)]
            node = brute_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in path:
                node = digest(*left, node, *right)
            proof = digest(*(x for left, right in path for x in left + right))
            out[r[0], levels[s][0][i], levels[s][-1][0], upper[-1][0], proof, node, node == upper[-1][0]] += 1
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found_manifest(df):
    return Counter(tuple(r) for r in manifest.verified(manifest.dataset_manifest(df)).select(COLUMNS).collect())


def test_manifest_of_a_hot_source(spark):
    """More than one block of leaves, repeated and null ids, and one row that is a third of all."""
    rnd = random.Random(1)
    rows = [(i // 3 if i % 7 else None, rnd.choice(["hot"] * 5 + [None, "b", "é", ""]), None if i % 5 == 0 else "en", i % 4, ["Aa", "bB", None, ""][i % 4]) for i in range(9000)]
    rows += [(7, "hot", "en", 1, "Same Row")] * 4500
    assert found_manifest(spark.createDataFrame(rows, DOCS).repartition(5)) == brute_manifest(rows)


def test_manifest_of_many_sources(spark):
    """Sources enough for a second block above them, ids beyond what a double holds."""
    rows = [(2**60 + i, f"s{i % 4500}", "en", 2, "Ab") for i in range(5000)]
    assert found_manifest(spark.createDataFrame(rows, DOCS)) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_manifest_sizes(spark, n):
    rows = [(i, "s", None, None, "X") for i in range(n)]
    assert found_manifest(spark.createDataFrame(rows, DOCS)) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark):
    df = documents(spark, [*ODD_TEXTS, "Long Text " * 50_000])
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert found_manifest(df) == brute_manifest(rows)
    assert found_manifest(df.withColumns({"leaf": F.lit(1), "group": F.lit("g"), "copies": F.lit(3), "block": F.lit(0)})) == brute_manifest(rows)


def test_a_version_copies_ancestors_only(spark):
    rows = [(i, "s", "en", 1, "Upper") for i in range(5000)]
    found = manifest.dataset_manifest(spark.createDataFrame(rows, DOCS)).collect()
    base = {x for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 for x in r.version}
    for r in found:
        assert len(r.version) == 5  # the leaf, three levels in its block, one above
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            assert not base & set(r.version)
        else:
            assert r.version[0] == r.leaf and r.version[-1] == r.root
