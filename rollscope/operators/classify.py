"""Classifiers over character n-grams: naive Bayes as aggregates, and a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rollscope.functions.names import char_ngrams, is_predictable, normalize_name
from rollscope.operators.labels import three_heads
from rollscope.operators.ranking import has_column, keep_first
from rollscope.sources.shared import kept, stored


#: Pairs of a name and a label in one task on average, and rows of a model that is broadcast, at most.
PAIRS, MODEL_ROWS = 1 << 18, 200_000


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing, kept as two tables in the shared folder, made in one pass over the rows."""

    def __init__(self, rows: DataFrame, name: str = "last_name", label: str = "label", n: int = 2):
        self.n = n
        rows = rows.select(F.col(name).alias("name"), F.col(label).alias("label")).na.drop()
        # An empty gram counts the rows of a label.
        grams = rows.select("label", F.explode(F.concat(F.array(F.lit("")), char_ngrams("name", n))).alias("gram"))
        counts = stored(grams.groupBy("gram", "label").agg(F.count("*").alias("n")), "bayes")
        self.counts = counts.filter("gram <> ''")
        seen = counts.filter("gram = ''").select("label", F.col("n").alias("seen"))
        totals = self.counts.groupBy("label").agg(F.sum("n").alias("total"))
        one_row = self.counts.agg(F.count_distinct("gram").alias("v")).crossJoin(seen.agg(F.sum("seen").alias("all")))
        self.labels = stored(
            seen.join(totals, "label").crossJoin(F.broadcast(one_row))
            .select("label", F.log(F.col("seen") / F.col("all")).alias("prior"), F.log(F.col("total") + F.col("v")).alias("base")),
            "bayes-labels",
        )
        self._near = F.broadcast if self.counts.count() <= MODEL_ROWS else lambda table: table

    def _distinct(self, names: DataFrame, column: str) -> DataFrame:
        """Names and their numbers of grams, in as many parts as their pairs with labels need: by the bytes of names alone too many meet in a task."""
        distinct = kept(names.select(F.col(column).alias("name")).na.drop().distinct())
        parts = max(-(-distinct.count() * self.labels.count() // PAIRS), names.sparkSession.sparkContext.defaultParallelism)
        return distinct.repartition(parts, "name").withColumn("size", F.greatest(F.length("name") - (self.n - 1), F.lit(0)))

    def _seen(self, distinct: DataFrame, how: str = "inner") -> DataFrame:
        """(name, label, gain) of labels that a gram of the name has been seen with; with `left` one without label for other grams."""
        grams = distinct.select("name", F.explode_outer(char_ngrams("name", self.n)).alias("gram"))
        return grams.join(self._near(self.counts), "gram", how).groupBy("name", "label").agg(F.sum(F.log(F.col("n") + 1)).alias("gain"))

    def scores(self, names: DataFrame, column: str = "last_name") -> DataFrame:
        """(name, label, score, log_prob) of distinct names and every label, rounded to six places.

        `log_prob` is the score less the logarithm of the summed exponentials of the name's scores, so that the
        probabilities of a name add up to one. A row for each name and label: `top_k` does without them.
        """
        distinct = self._distinct(names, column)
        every = distinct.crossJoin(self.labels).join(self._seen(distinct), ["name", "label"], "left")
        raw = every.select("name", "label", (F.col("prior") + F.coalesce("gain", F.lit(0.0)) - F.col("size") * F.col("base")).alias("raw"))
        most = raw.groupBy("name").agg(F.max("raw").alias("most"))
        total = raw.join(most, "name").groupBy("name", "most").agg(F.log(F.sum(F.exp(F.col("raw") - F.col("most")))).alias("rest"))
        scored = raw.join(total, "name").withColumn("log_prob", F.col("raw") - F.col("most") - F.col("rest"))
        return scored.select("name", "label", F.round("raw", 6).alias("score"), (F.round("log_prob", 6) + F.lit(0.0)).alias("log_prob"))  # no -0.0

    def top_k(self, names: DataFrame, k: int = 3, column: str = "last_name") -> DataFrame:
        """(name, pred): the k best labels, best first, ties by label.

        A label without a gram of the name scores what its prior and the name's length give, so beside the labels seen with
        one only the k best for that length can be among the k best: names meet the model on grams and these on length.
        Grams, labels and names stay where `_distinct` has dealt the names if the model is small enough to broadcast.
        """
        distinct = self._distinct(names, column)
        score = lambda gain: F.round(F.col("prior") + gain - F.col("size") * F.col("base"), 6)
        first = lambda by: Window.partitionBy(by).orderBy(F.desc("score"), "label")
        entry = F.struct((-F.col("score")).alias("less"), "label")
        sizes = distinct.select("size").distinct().crossJoin(self.labels).withColumn("score", score(F.lit(0.0)))
        lengths = sizes.withColumn("r", F.row_number().over(first("size"))).filter(F.col("r") <= k)
        unseen = F.broadcast(lengths.groupBy("size").agg(F.collect_list(entry).alias("unseen")))  # a row of k entries a length
        size = F.greatest(F.length("name") - (self.n - 1), F.lit(0))
        found = self._seen(distinct, "left").join(self._near(self.labels), "label", "left").withColumn("size", size).withColumn("score", score(F.col("gain")))
        found = found.withColumn("r", F.row_number().over(first("name"))).filter(F.col("r") <= k)
        seen = found.groupBy("name", "size").agg(F.collect_list(F.when(F.col("label").isNotNull(), entry)).alias("seen"))
        # A label seen, but not among the k, scores better than as unseen, so it cannot come in by that.
        other = F.filter("unseen", lambda x: ~F.exists("seen", lambda y: y["label"] == x["label"]))
        best = F.slice(F.array_sort(F.concat("seen", other)), 1, k)
        return seen.join(unseen, "size").select("name", F.transform(best, lambda x: x["label"]).alias("pred"))


def pred_last_state(df: DataFrame, column: str, model: NaiveBayes, k: int = 3, order_by: str | None = None) -> DataFrame:
    """Predictable names, lower-cased and de-duplicated, with `pred_state`, the k likeliest states.

    Names are filtered before they are stripped, so one with outer blanks is dropped. Without the column the input
    is returned as it is.
    """
    if not has_column(df, column):
        return df
    rows = df.filter(is_predictable(column)).withColumn(column, normalize_name(column))
    rows = rows if order_by else rows.withColumn("_at", F.monotonically_increasing_id())
    rows = kept(keep_first(rows, [column], [order_by or "_at"]).drop("_at"))
    found = model.top_k(rows, k, column).select(F.col("name").alias("_name"), F.col("pred").alias("pred_state"))
    return rows.join(found, rows[column] == found["_name"], "left").drop("_name")


def predict_lang(df: DataFrame, column: str, models: tuple[NaiveBayes, NaiveBayes, NaiveBayes]) -> DataFrame:
    """Adds `predicted_lang`, three languages from three models; the rule for repeats is that of `three_heads`.

    Names with other characters than a-z get null.
    """
    if not has_column(df, column):
        return df
    known = df.filter(F.col(column).rlike("^[a-z]+$"))
    heads = None
    for i, model in enumerate(models):
        top = model.top_k(known, 3, column).withColumnRenamed("pred", f"_h{i}")
        heads = top if heads is None else heads.join(top, "name")
    best = heads.select(F.col("name").alias("_name"), three_heads(*(F.col(f"_h{i}") for i in range(3))).alias("predicted_lang"))
    return df.join(best, df[column] == best["_name"], "left").drop("_name")


def frequency_model(df: DataFrame, key: str = "last_name", label: str = "state", k: int = 3) -> DataFrame:
    """(key, pred): the k most frequent labels of a seen name, the best any model can do for it."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), label)
    ranked = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    pairs = F.sort_array(F.collect_list(F.struct("r", F.col(label).alias("label"))))
    return ranked.groupBy(key).agg(F.transform(pairs, lambda x: x["label"]).alias("pred"))


#: Parts that the training rows of a forest are dealt into, or as many as there are cores.
FOREST_PARTS = 24


def forest_state(
    train: DataFrame, test: DataFrame, label: str = "label", num_trees: int = 100, max_df: float = 0.3, min_df: float = 3,
    depth: int = 14, seed: int = 0, column: str = "last_name",
) -> DataFrame:
    """`test` with `pred`, by a random forest with entropy over counts of one- and two-letter strings.

    The vocabulary is fitted on the training names: strings in at most a share `max_df` of them and in `min_df` names or more.
    Trees end at `depth` instead of being grown to pure leaves, which Spark's level-wise growth holds in memory.

    Each part of the training rows sends the statistics of every node of a level, whatever rows it has, so the parts do not
    grow with the rows; draws are made part by part in the order of the rows, so a set number, a sort and
    a vocabulary in order make them repeat on up to FOREST_PARTS cores.
    Rows keep the node they have reached in each tree instead of going down from the root at each level.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, IndexToString, StringIndexer

    def grams(df: DataFrame) -> DataFrame:
        return df.withColumn("_grams", F.concat(char_ngrams(column, 1), char_ngrams(column, 2)))

    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    rows = index.transform(train.na.drop(subset=[column, label]).select(column, label))
    dealt = rows.repartition(max(FOREST_PARTS, train.sparkSession.sparkContext.defaultParallelism), column).sortWithinPartitions(column, label)
    rows = kept(grams(dealt))
    vocabulary = CountVectorizer(inputCol="_grams", outputCol="_x", minDF=min_df, maxDF=max_df).fit(rows).vocabulary
    stages = [
        CountVectorizerModel.from_vocabulary(sorted(vocabulary), inputCol="_grams", outputCol="_x"),
        RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=num_trees, impurity="entropy", maxDepth=depth, seed=seed, cacheNodeIds=True, predictionCol="_p", rawPredictionCol="_raw", probabilityCol="_prob"),
        IndexToString(inputCol="_p", outputCol="pred", labels=index.labels),
    ]
    model = Pipeline(stages=stages).fit(rows)
    return model.transform(grams(test)).drop("_grams", "_x", "_raw", "_prob", "_p", "_y")
