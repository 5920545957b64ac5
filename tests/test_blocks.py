"""Searches in blocks against plain versions, and that their shuffles carry names and answers, not pairs."""

from difflib import SequenceMatcher

import pytest

from rollscope.operators import blocks, similarity
from tests.test_searches import brute_cosine, edits, frame, words



@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abcdefgh", 14), ("aé", 90)])
def test_nearest_edits_against_all_pairs(letters, longest):
    """Also names of over 64 letters, letters counted beyond the bits, letters that no name has."""
    known, asked = words(21, letters, longest, 150), words(22, letters + "z", longest, 40) + ["", "zz"]
    block = blocks.Block(known)
    for q in asked:
        for k in (1, 4, 400):
            rows, found = blocks.nearest_edits(block, q, k)
            assert list(zip(found, block.names[rows], strict=True)) == sorted((edits(q, n), n) for n in known)[:k]


def shuffled(spark):
    """Rows that all shuffles so far have written."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("search", [similarity.edit_knn, similarity.cosine_knn, similarity.closest_match])
def test_shuffles_carry_names_and_answers_only(spark, search):
    """Names of few syllables share grams and segments with most queries; pairs that met on these were shuffled before."""
    known = words(23, ["an", "be", "co", "di", "en", "fu"], 5, 2500, 3)
    asked = known[::3]
    before = shuffled(spark)
    assert len(search(frame(spark, asked), frame(spark, known)).collect()) == len(asked) * (1 if search is similarity.closest_match else 3)
    assert 0 < shuffled(spark) - before < 0.05 * len(asked) * len(known)


def test_closest_match_against_the_standard_library(spark, monkeypatch):
    """Over several blocks of names and of queries; ties go to the later name."""
    monkeypatch.setattr(blocks, "NAMES", 60)
    monkeypatch.setattr(blocks, "QUERIES", 20)
    known = words(24, "abcdé", 12, 200) + ["ab" * 40]
    asked = words(25, "abcdéz", 12, 50) + ["", "zzzz", "ba" * 40]
    for r in similarity.closest_match(frame(spark, asked), frame(spark, known)).collect():
        ratio, name = max((SequenceMatcher(None, n, r.query, autojunk=False).ratio(), n) for n in known)
        assert (r.ratio, r.neighbour) == ((pytest.approx(ratio, abs=1e-12), name) if ratio >= 0.6 else (None, None))


def test_cosine_knn_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "NAMES", 60)
    known, asked = words(26, "abcdefgh", 9, 200, 3), words(27, "abcdefgh", 9, 40, 3)
    got = {(r.query, r["rank"]): r.similarity for r in similarity.cosine_knn(frame(spark, asked), frame(spark, known), 4).collect()}
    want = brute_cosine(asked, known, 4)
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x][1], abs=2e-9) for x in want)
