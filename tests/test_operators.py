"""Operators on micro-fixtures: ties, nulls, first rows, overwrites."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rollscope.operators import classify, corpus, counts, enrich, evaluate, labels, ranking, sampling, similarity


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_argmax_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, 3, 3)], "a int, b int, c int")
    assert labels.modal_label(df, ["a", "b", "c"]).first()["modal"] == "b"


def test_top3_rule(spark):
    data = [(1, 0.1, 0.5, 0.5, 0.1, 0.2), (2, 0.5, 0.25, 0.125, 0.125, 0.0), (3, 0.5, 0.2, 0.2, 0.0, 0.0)]
    df = spark.createDataFrame(data, "i int, a double, b double, c double, d double, e double")
    found = labels.top3_labels(df, list("abcde")).orderBy("i").select("first_lang", "second_lang", "third_lang")
    assert list(map(tuple, found.collect())) == [("b", "b", "e"), ("a", "b", "c"), ("a", "b", "b")]


def test_three_heads(spark):
    df = spark.createDataFrame([(["hindi", "x"], ["hindi", "urdu"], ["urdu", "y", "hindi"])], "a array<string>, b array<string>, c array<string>")
    assert df.select(labels.three_heads(F.col("a"), F.col("b"), F.col("c"))).first()[0] == ["hindi", "urdu", "hindi"]


def test_last_state_keeps_raw_names(spark):
    users = spark.createDataFrame([(1, "Sood", "a"), (2, "sood", "b"), (3, "Sood", "c"), (4, None, "d"), (5, "Xy", "e")], "i int, name string, extra string")
    known = spark.createDataFrame([("sood", 0.5)], "last_name string, delhi double")
    found = enrich.last_state(users, "name", known, order_by="i")
    assert rows(found.select("i", "__last_name", "delhi")) == [(1, "sood", 0.5), (2, "sood", 0.5), (4, None, None), (5, "xy", None)]
    assert enrich.last_state(users, "nope", known) is users


def test_null_keys(spark):
    users = spark.createDataFrame([("x",), (None,)], "name string")
    known = spark.createDataFrame([(None, 1), ("x", 2)], "last_name string, v int")
    assert rows(enrich.join_state_corpus(users, "name", known).select("v")) == [(2,), (None,)]
    assert rows(enrich.join_state_corpus(users, "name", known, null_safe=True).select("v")) == [(1,), (2,)]


def test_state_to_lang(spark):
    dim = spark.createDataFrame([("Delhi", "Hindi, English", 0)], "state string, official_languages string, seq int")
    users = spark.createDataFrame([("delhi",), ("Delhi",), (None,)], "st string")
    assert rows(enrich.state_to_lang(users, "st", dim)) == [("Delhi", "Hindi, English"), ("delhi", None), (None, None)]
    assert enrich.state_to_lang(users, "st", dim, normalize=True).filter("official_languages is not null").count() == 2


def test_overwritten_weights(spark):
    c = spark.createDataFrame([("sood", "d", 8)], "last_name string, state string, count long")
    langs = spark.createDataFrame([("d", "hindi", "urdu", "hindi", "odia")], "state string, first string, second string, third string, fourth string")
    assert rows(corpus.allocate_languages(c, langs)) == [("sood", "hindi", 1.0), ("sood", "odia", 1.0), ("sood", "urdu", 2.0)]
    wide = corpus.build_language_corpus(corpus.allocate_languages(c, langs), ["hindi", "urdu", "odia", "tamil"])
    assert rows(wide) == [("sood", 1.0, 2.0, 1.0, 0.0)]


def test_containment_takes_the_last_match(spark):
    dim = spark.createDataFrame(
        [("Andaman and Nicobar Islands", 0), ("Jammu and Kashmir and Ladakh", 1), ("Dadra and Nagar Haveli and Daman and Diu", 2), ("Uttar Pradesh", 3)],
        "state string, seq int",
    )
    asked = spark.createDataFrame([("daman",), ("andaman",), ("jk",), ("uttar_pradesh",), ("nowhere",)], "state string")
    found = dict(map(tuple, corpus.match_states(asked, dim).collect()))
    assert found == {
        "daman": "Dadra and Nagar Haveli and Daman and Diu", "andaman": "Andaman and Nicobar Islands",
        "jk": "Jammu and Kashmir and Ladakh", "uttar_pradesh": "Uttar Pradesh", "nowhere": None,
    }


def test_counts(spark):
    df = spark.createDataFrame([("x", "s", 2), ("x", "s", 2), ("x", "s", 5), (None, "s", 1)], "last_name string, state string, count long")
    assert rows(counts.cleanup_counts(df)) == [("x", "s", 7)]
    names = spark.createDataFrame([("a", "s")] * 3 + [("b", "s")] * 2, "last_name string, state string")
    assert rows(counts.min_occurrence(names).distinct()) == [("a", "s")]
    whole = counts.name_state_counts(names)
    assert rows(counts.merge_counts(*(counts.name_state_counts(p) for p in names.randomSplit([0.5, 0.5], 1)))) == rows(whole)
    assert rows(counts.popularity_slice(names, 1, "bottom")) == [("b", 2)]
    assert rows(counts.name_profile(whole, "a").select("percent")) == [(100.0,)]
    assert rows(counts.collect_by_name(names, ["state"])) == [("a", ["s"] * 3), ("b", ["s"] * 2)]


def test_female_share(spark):
    df = spark.createDataFrame([("a", "Male"), ("a", "पुरूष"), ("a", "UNREADABLE"), ("a", "Female"), ("b", "UNREADABLE")], "last_name string, sex string")
    assert rows(counts.female_share(df)) == [("a", pytest.approx(1 / 3)), ("b", None)]


def test_clean_names(spark):
    df = spark.createDataFrame([("LNU", "d", "Male"), ("Sood", "wb", "Male"), ("Sood", "d", None), ("Li", "d", "Male"), ("Sood", "d", "Male")], "last_name string, state string, sex string")
    assert counts.clean_names(df).count() == 1


def test_proportions_add_up(spark):
    df = spark.createDataFrame([("a", "s"), ("a", "t"), ("a", "t"), ("b", "u")], "last_name string, state string")
    wide = corpus.build_state_corpus(df, ["s", "t", "u"])
    assert all(abs(r.s + r.t + r.u - 1) < 1e-12 for r in wide.collect())


def test_edit_knn_of_few_names(spark):
    asked = spark.createDataFrame([("abc",), ("b",), (None,), ("zzzzzzzzzz",), ("b",)], "last_name string")
    few = spark.createDataFrame([("ab",), ("b",)], "last_name string")
    assert similarity.edit_knn(asked, few, 3).groupBy("query").count().filter("count <> 2").isEmpty()


def test_lookup_lang_keeps_rows(spark):
    known = spark.createDataFrame([("sood", 3.0, 1.0), ("soot", 1.0, 0.0), ("xyzzy", 0.0, 9.0)], "last_name string, hindi double, urdu double")
    users = spark.createDataFrame([("sood",), ("sood",), (None,)], "name string")
    found = similarity.lookup_lang(users, "name", known, ["hindi", "urdu"], k=2)
    assert rows(found) == [("sood", "hindi"), ("sood", "hindi"), (None, None)]


def test_closest_match(spark):
    known = ["sood", "gowda", "dhingra", "singh", "so"]
    asked = ["sod", "dingra", "qqqq", "gwda"]
    found = dict((r.query, r.neighbour) for r in similarity.closest_match(
        spark.createDataFrame([(x,) for x in asked], "last_name string"), spark.createDataFrame([(x,) for x in known], "last_name string")).collect())
    for a in asked:
        best = max(((SequenceMatcher(None, k, a).ratio(), k) for k in known))
        assert found[a] == (best[1] if best[0] >= 0.6 else None)


def test_naive_bayes(spark):
    train = spark.createDataFrame([("sood", "n"), ("sodi", "n"), ("gowda", "s"), ("gowdru", "s")], "last_name string, label string")
    model = classify.NaiveBayes(train)
    users = spark.createDataFrame([("Sood",), ("sood",), ("gowd",), ("x1",), (None,)], "last_name string")
    found = dict(map(tuple, classify.pred_last_state(users, "last_name", model, 2).collect()))
    assert found == {"sood": ["n", "s"], "gowd": ["s", "n"]}
    langs = classify.predict_lang(users, "last_name", (model, model, model))
    assert langs.count() == 5 and langs.filter("last_name = 'x1'").first()["predicted_lang"] is None


def test_bayes_deals_names_by_their_pairs_with_labels(spark, monkeypatch):
    monkeypatch.setattr(classify, "PAIRS", 2000, raising=False)
    letters = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(4))
    model = classify.NaiveBayes(spark.createDataFrame([(letters(i), "nsew"[i % 4]) for i in range(0, 5000, 7)], "last_name string, label string"))
    asked = spark.createDataFrame([(letters(i),) for i in range(5000)], "last_name string")
    for found, each in ((model.top_k(asked), 1), (model._seen(model._distinct(asked, "last_name")), 4)):
        parts = found.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in parts) <= 5000 * each and max(r["count"] for r in parts) <= 2 * 500 * each
    assert model.top_k(asked).count() == 5000


def test_forest_repeats_however_its_rows_lie(spark):
    names = ["".join(chr(97 + (i * a + b) % 26) for a, b in ((7, 1), (3, 5), (11, 2), (5, 9))) for i in range(300)]
    train = spark.createDataFrame([(x, "nsew"[(i * i // 7) % 4]) for i, x in enumerate(names)], "last_name string, label string")
    test = spark.createDataFrame([(x[::-1],) for x in names], "last_name string")
    grown = [rows(classify.forest_state(df, test, num_trees=3, depth=4)) for df in (train.coalesce(1), train.orderBy(F.desc("last_name")).repartition(30))]
    assert grown[0] == grown[1] and len({r[-1] for r in grown[0]}) > 1


def test_report_against_hand_counts(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    found = {r.label: r for r in evaluate.classification_report(df, "t", "p").collect()}
    assert (found["a"].precision, found["a"].recall, found["a"].support) == (1.0, 0.5, 2)
    assert (found["c"].precision, found["c"].f1) == (0.0, 0.0)
    assert found["macro avg"].recall == pytest.approx(0.5) and found["weighted avg"].recall == pytest.approx(0.5)


def test_pair_accuracy_and_baseline(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], ["a"])], "t array<string>, p array<string>")
    assert evaluate.pair_accuracy(df, "t", "p").first()[0] == pytest.approx(1 / 3)
    assert evaluate.topk_accuracy(df, "t", "p").first()[0] == 0.5
    one = spark.createDataFrame([("x",), ("x",), ("y",)], "l string")
    assert rows(evaluate.constant_baseline(one, "l")) == [("x", pytest.approx(2 / 3))]
    assert rows(evaluate.constant_baseline(one, "l", "y")) == [("y", pytest.approx(1 / 3))]


def test_local_linear_fits_lines_exactly(spark):
    df = spark.createDataFrame([("m", float(i), 2.0 * i + 1) for i in range(20)], "model string, x double, y double")
    assert all(abs(r.fit - (2 * r.x + 1)) < 1e-6 for r in evaluate.local_smooth(df, "x", "y", "model", degree=1).collect())


def test_splits_are_disjoint_and_samples_repeat(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    parts = sampling.split_by_key(df, "k", (0.8, 0.1, 0.1))
    assert parts.count() == 2000 and parts.select("part").distinct().count() == 3
    assert sampling.stratified_split(df, "k", "g", 0.2).filter("part = 1").groupBy("g").count().filter("count not in (133, 134)").isEmpty()
    assert rows(sampling.bootstrap(df, 50, "k")) == rows(sampling.bootstrap(df, 50, "k"))
    assert sampling.bootstrap(df, 50, "k").count() == 50
    assert sampling.balanced_draws(df, "k", "g", 90).count() == 90
    assert sampling.every_nth(df, "k", "g", 100).count() == 21
    weighted = df.withColumn("w", F.when(F.col("g") == 0, 1000.0).otherwise(0.001))
    assert sampling.weighted_sample(weighted, 100, "k", "w").filter("g = 0").count() > 95


def test_hash_rank_is_a_rank(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "a").alias("g"))
    found = ranking.hash_rank(df, ["g"], ranking.hash32("k"), ["k"])
    for g in ("a", None):
        assert sorted(r["rank"] for r in found.filter(F.col("g").eqNullSafe(F.lit(g))).collect()) == list(range(1, 251))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "last_name string, state string")
    assert corpus.build_state_corpus(empty, ["a"]).count() == 0
    assert similarity.edit_knn(empty, empty).count() == 0
    assert similarity.cosine_knn(empty, empty).count() == 0
    assert sampling.sample_per_group(empty, "last_name", "state").count() == 0


def test_closest_match_against_all_pairs(spark, sf):
    from difflib import SequenceMatcher

    from rollscope.plans import tables

    known = counts.name_counts(tables.names(spark, sf)).filter("count >= 3")
    asked = tables.asked_names(tables.counted_names(spark, sf))
    found = {r.query: (r.neighbour, r.ratio) for r in similarity.closest_match(asked, known).collect()}
    names = [r.last_name for r in known.collect()]
    assert len(found) > 20
    for q, got in found.items():
        ratio, best = max((SequenceMatcher(None, n, q).ratio(), n) for n in names)
        assert got == ((best, ratio) if ratio >= similarity.CUTOFF else (None, None))
