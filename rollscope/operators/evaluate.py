"""Accuracy, reports and slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollscope.sources.shared import kept


def _share(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("int"))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.agg(_share(F.col(truth) == F.col(pred)).alias("accuracy"))


def topk_accuracy(df: DataFrame, truth: str, pred: str, n: int = 3) -> DataFrame:
    """Rows whose first n true labels and predictions have one in common."""
    return df.agg(_share(F.arrays_overlap(F.slice(truth, 1, n), pred)).alias("accuracy"))


def truth_in_topk(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.agg(_share(F.array_contains(pred, F.col(truth))).alias("accuracy"))


def pair_accuracy(df: DataFrame, truth: str, pred: str, n: int = 3) -> DataFrame:
    """Each of the first n true labels is a case."""
    cases = df.select(F.explode(F.slice(truth, 1, n)).alias("t"), pred)
    return cases.agg(_share(F.array_contains(pred, F.col("t"))).alias("accuracy"))


def position_accuracy(df: DataFrame, truth: str, pred: str, names: Sequence[str] = ("first", "second", "third")) -> DataFrame:
    """Accuracy at each place of two lists, and of all places at once, in one pass."""
    same = [F.get(truth, F.lit(i)) == F.get(pred, F.lit(i)) for i in range(len(names))]
    whole = same[0]
    for s in same[1:]:
        whole = whole & s
    return df.agg(*(_share(s).alias(n) for s, n in zip(same, names, strict=True)), _share(whole).alias("all"))


def accuracy_by(df: DataFrame, key: str, hits: Sequence[str]) -> DataFrame:
    """Mean of 0/1 columns a group, in percent."""
    return df.groupBy(key).agg(*((F.avg(c) * 100).alias(c) for c in hits))


def constant_baseline(df: DataFrame, label: str, constant: str | None = None) -> DataFrame:
    """(label, share) of always predicting one label: the given one or the most frequent, ties by label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))  # one row
    rows = counts.filter(F.col(label) == constant) if constant else counts.orderBy(F.desc("n"), label).limit(1)
    return rows.crossJoin(F.broadcast(total)).select(label, (F.col("n") / F.col("total")).alias("share"))


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """One row a true label, one column a prediction."""
    counts = [F.count_if(F.col(pred) == c).alias(c) for c in labels]
    return df.groupBy(F.col(truth).alias("truth")).agg(*counts)


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support) with `macro avg` and `weighted avg` rows; undefined ratios are 0."""
    counts = confusion_counts(df.na.drop(subset=[truth, pred]), truth, pred)
    right = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    by_truth = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(right).alias("hit"))
    by_pred = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = (
        by_truth.join(by_pred, "label", "full_outer")
        .select("label", zero("support").alias("support"), zero("hit").alias("hit"), zero("said").alias("said"))
        .withColumn("precision", ratio(F.col("hit"), F.col("said")))
        .withColumn("recall", ratio(F.col("hit"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .select("label", "precision", "recall", "f1", "support")
    )
    scores = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    macro = each.agg(*(F.avg(c).alias(c) for c in scores), total).withColumn("label", F.lit("macro avg"))
    weighted = each.agg(
        *(ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores), total
    ).withColumn("label", F.lit("weighted avg"))
    return each.unionByName(macro).unionByName(weighted)


def unpivot_models(df: DataFrame, keys: Sequence[str], models: Sequence[str], name: str = "model", value: str = "hit") -> DataFrame:
    return df.unpivot(list(keys), list(models), name, value)


def evaluation_table(predictions: DataFrame, frequencies: DataFrame, truth: DataFrame, key: str = "last_name") -> DataFrame:
    """Predictions with each name's counts and true labels."""
    return predictions.join(frequencies, key).join(truth, key)


def accuracy_slices(df: DataFrame, hit: str, slices: dict[str, Column]) -> DataFrame:
    """(slice, n, accuracy) of overlapping slices, each a condition, in one pass over the rows."""
    tags = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in slices.items())))
    rows = df.select(F.explode(tags).alias("slice"), F.col(hit).alias("hit"))
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


#: A cell of the tree has at most this share of the points that a fit takes in.
CELL = 0.2
MARGIN = 0.005
#: Windows reach this much beyond the last point that they take in, so that it has a weight.
WIDER = 1.001
#: A fit of a degree needs a determinant of more than this times that of equal weights.
SINGULAR = 1e-9


def _grid(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(g, x, n, sy, upto, all): points summed by distinct x, with the number of points up to it and in all."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    grid = rows.groupBy(F.col(by).alias("g"), F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("sy"))
    group = Window.partitionBy("g")
    return grid.withColumns({"upto": F.sum("n").over(group.orderBy("x")), "all": F.sum("n").over(group)})


def _vertices(grid: DataFrame, span: float, cell: float) -> DataFrame:
    """(g, i, v): the borders of the cells of a tree over x, from left to right.

    Cells are halved at their middle point until none has more than span * cell of the points, so the borders between them are
    the middles between two neighbouring points at multiples of a power of two; the outer ones lie a little beyond the data.
    """
    ends = grid.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("all").alias("all"))
    most = F.greatest(F.floor(F.col("all") * span * cell), F.lit(1))
    cells = F.pow(F.lit(2), F.ceil(F.log2(F.col("all") / most) - 1e-9)).cast("long")
    ends = ends.withColumn("cells", F.greatest(cells, F.lit(1)))
    wanted = ends.filter("cells > 1").select("g", "cells", "all", F.explode(F.expr("sequence(1L, cells - 1)")).alias("k"))
    wanted = wanted.select("g", "k", F.greatest(F.expr("all * k div cells"), F.lit(1)).alias("at"))
    wanted = wanted.withColumn("pos", F.explode(F.array("at", F.col("at") + 1)))
    # The point at a position is the x whose points reach from before it to it.
    spans = grid.select("g", "x", (F.col("upto") - F.col("n")).alias("before"), "upto")
    placed = wanted.join(spans, "g").filter("pos > before and pos <= upto")
    inner = placed.groupBy("g", "k").agg(F.avg("x").alias("v")).select("g", "v")
    pad = F.greatest(F.col("hi") - F.col("lo"), F.greatest(F.abs("lo"), F.abs("hi")) * 1e-10 + 1e-30) * MARGIN
    outer = ends.select("g", F.explode(F.array(F.col("lo") - pad, F.col("hi") + pad)).alias("v"))
    return inner.unionByName(outer).distinct().withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("v")))


def _fits(grid: DataFrame, vertices: DataFrame, span: float, degree: int) -> DataFrame:
    """(g, i, v, b0, b1): value and slope at each vertex of a polynomial fitted with tricube weights to the nearest `span` of the points."""
    met = vertices.join(grid, "g").withColumn("d", F.abs(F.col("x") - F.col("v")))
    got = F.sum("n").over(Window.partitionBy("g", "i").orderBy("d").rangeBetween(Window.unboundedPreceding, 0))
    reach = F.min(F.when(F.col("got") >= F.ceil(F.col("all") * span), F.col("d"))).over(Window.partitionBy("g", "i"))
    near = met.withColumn("got", got).withColumn("h", reach).withColumn("h", F.when(F.col("h") > 0, F.col("h") * WIDER).otherwise(1.0)).filter("d < h")
    u = F.col("d") / F.col("h")
    w = F.pow(1 - u * u * u, F.lit(3))
    near = near.withColumns({"w": w * F.col("n"), "wy": w * F.col("sy"), "t": (F.col("x") - F.col("v")) / F.col("h")})
    power = lambda c, k: F.sum(F.col(c) * F.pow("t", F.lit(k)))
    sums = near.groupBy("g", "i", "v", "h").agg(*(power("w", k).alias(f"s{k}") for k in range(5)), *(power("wy", k).alias(f"y{k}") for k in range(3)))
    s0, s1, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "y0", "y1", "y2"))
    flat = y0 / s0
    line = s0 * s2 - s1 * s1
    minor = s2 * s4 - s3 * s3
    whole = s0 * minor - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    curved = whole > SINGULAR * s0 * s0 * s0 if degree > 1 else F.lit(False)
    c0 = (y0 * minor - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / whole
    c1 = (s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / whole
    sloped = line > SINGULAR * s0 * s0
    b0 = F.when(curved, c0).when(sloped, (s2 * y0 - s1 * y1) / line).otherwise(flat)
    b1 = F.when(curved, c1).when(sloped, (s0 * y1 - s1 * y0) / line).otherwise(0.0)
    return sums.select("g", "i", "v", b0.alias("b0"), (b1 / F.col("h")).alias("b1"))


def local_smooth(df: DataFrame, x: str, y: str, by: str, span: float = 0.75, degree: int = 2, cell: float = CELL) -> DataFrame:
    """(by, x, fit): local regression at each distinct x of each group.

    Polynomials of the given degree, 1 or 2, are fitted at the vertices of a tree over x and blended by cubics that have the
    vertices' values and slopes. A group has some ten vertices however many points it has, so the cost is linear in its distinct
    x. Where a window has too few distinct x for the degree, a lower one is fitted. Rows with a null x or y are left out.
    """
    grid = kept(_grid(df, x, y, by))
    fits = _fits(grid, _vertices(grid, span, cell), span, degree)
    after = Window.partitionBy("g").orderBy("i")
    nexts = {f"{c}_r": F.lead(c).over(after) for c in ("v", "b0", "b1")}
    cells = fits.withColumns(nexts).filter("v_r is not null")
    inside = grid.join(cells, "g").filter("x > v and x <= v_r or i = 1 and x <= v")
    h, t = F.col("v_r") - F.col("v"), (F.col("x") - F.col("v")) / (F.col("v_r") - F.col("v"))
    blend = (
        (1 + 2 * t) * (1 - t) * (1 - t) * F.col("b0") + t * (1 - t) * (1 - t) * h * F.col("b1")
        + t * t * (3 - 2 * t) * F.col("b0_r") + t * t * (t - 1) * h * F.col("b1_r")
    )
    return inside.select(F.col("g").alias(by), F.col("x").alias(x), blend.alias("fit"))
