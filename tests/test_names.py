"""Row rules on micro-fixtures."""

import pytest
from pyspark.sql import functions as F

from rollscope.functions import names as fn


def values(spark, rows, expression, schema="a string, b string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_fallback(spark):
    rows = [("Asha Sood", None), ("Asha", "Ram Gowda"), ("Asha", "Ram"), (None, None), ("  Asha   Sood ", None)]
    assert values(spark, rows, fn.last_name_fallback("a", "b")) == ["Sood", "Gowda", "LNU", "LNU", "Sood"]


def test_full_name(spark):
    rows = [("Asha K Sood", None), ("Asha", "Ram Gowda"), (None, None), (" ", "Ram Gowda")]
    assert values(spark, rows, fn.full_name("a", "b")) == ["Asha Sood", "Asha Gowda", "FNU LNU", None]


def test_household(spark):
    rows = [("Asha Sood", "Ram Sood"), ("Asha Sood", "Sood Ram"), ("Asha Li", "Ram Li"), ("Sood", "Sood"), (None, "x y")]
    assert values(spark, rows, fn.last_name_household("a", "b")) == ["Sood", None, None, None, None]


def test_shared(spark):
    rows = [("Asha Sood", "Sood Ram"), ("Asha", "Ram"), ("Al Bo", "Bo Al"), (None, "x")]
    assert values(spark, rows, fn.last_name_shared("a", "b")) == ["sood", None, None, None]


@pytest.mark.parametrize("name, kept", [("Sood", True), (" sood ", False), ("O'Brien", False), ("li", False), ("रानी", False), ("x1y", False), ("Ößü", False), ("Öxe", True)])
def test_predictable(spark, name, kept):
    assert values(spark, [(name, "")], fn.is_predictable("a")) == [kept]


def test_normalize_strips_all_white_space(spark):
    assert values(spark, [("  Sood\t\n", "")], fn.normalize_name("a")) == ["sood"]


def test_full_name_filter(spark):
    assert values(spark, [("Asha O'Neil-Das", ""), ("रानी", ""), (None, "")], fn.is_full_name("a")) == [True, False, False]


def test_language_and_state_names(spark):
    assert values(spark, [("Hindi (including Bihari languages)", "")], fn.clean_language("a")) == ["hindi"]
    assert values(spark, [("jk", ""), ("delhi", "")], fn.state_display_name("a")) == ["Jammu and Kashmir", "Delhi"]


def test_sex(spark):
    rows = [("Male", ""), ("पुरूष", ""), ("UNREADABLE", ""), ("Female", ""), (None, "")]
    assert values(spark, rows, fn.sex_code("a")) == [0, 0, None, 1, None]


def test_ngrams_and_codes(spark):
    rows = [("good", ""), ("a", ""), (None, "")]
    assert values(spark, rows, fn.char_ngrams("a", 2)) == [["go", "oo", "od"], [], None]
    vocabulary = F.array(F.lit("so"), F.lit("oo"))
    assert values(spark, rows[:1], fn.ngram_index(fn.char_ngrams("a", 2), vocabulary)) == [[0, 1, 0]]
    assert values(spark, [("ab", ""), ("a?", "")], fn.char_codes("a", "abc")) == [[1, 2], None]
    assert values(spark, [("ab", "")], fn.pad_codes(fn.char_codes("a", "abc"), 4)) == [[1, 2, 0, 0]]
    assert values(spark, [("b?", "")], fn.one_hot_name("a", "abc")) == [[[0, 1, 0], [0, 0, 1]]]


def test_transliteration(spark):
    rows = [('{"a":"x","b":"y"}', ""), ("oops", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(F.explode(fn.parse_transliteration("a"))).count() == 2


def test_top_languages(spark):
    assert values(spark, [("x", None)], fn.top_languages("a", "b")) == [["x"]]
