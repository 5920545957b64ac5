"""Rows that every operator must cope with."""

ODD_TEXTS = [None, "", " \t\n", "a", "a", "é ñ ß", "x" * 5000, "word " * 3000, "The same text twice.", "The same text twice."]


def documents(spark, texts=ODD_TEXTS, extra=True):
    """A documents table of the given texts with null ids and sources, repeated rows and clashing extra columns."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 4}", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "src1", 5, 1, "x"), *rows[-1:]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, label string"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.drop("size", "label")


def empty(spark):
    return documents(spark).filter("false")
