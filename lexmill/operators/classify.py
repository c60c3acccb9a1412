"""Text classification: ML pipelines over cleaned text, naive Bayes counts as aggregations, and reports."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def pipeline(kind: str = "logreg", *, features: int = 1 << 16, C: float = 4.0, rows: int = 1000, smoothing: float = 0.3, max_iter: int = 100, terms: list[str] | None = None) -> Pipeline:
    """tf-idf, of hashed words or, given ``terms``, of these words and word pairs (one column each), into logistic regression (regParam 1 / (C rows): the loss is a mean here) or multinomial naive Bayes."""
    if kind == "logreg":
        model = LogisticRegression(maxIter=max_iter, regParam=1.0 / (C * rows))
    elif kind == "nb":
        model = NaiveBayes(smoothing=smoothing)
    else:
        raise ValueError(f"unknown classifier {kind!r}: logreg, nb")
    stages = [RegexTokenizer(inputCol="clean_text", outputCol="tokens", pattern=" ")]
    if terms is None:
        stages.append(HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features))
    else:
        stages += [NGram(n=2, inputCol="tokens", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(tokens, pairs) AS terms FROM __THIS__")]
        stages.append(CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="counts"))
    return Pipeline(stages=[*stages, IDF(inputCol="counts", outputCol="features"), model])


def prepared(df: DataFrame) -> DataFrame:
    """df with clean_text, rows whose clean text is empty or label null left out."""
    return df.withColumn("clean_text", T.clean_text(F.col("text"))).where((F.length("clean_text") > 0) & F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))


def frequent_terms(data: DataFrame, rows: int, most: int) -> list[str]:
    """The ``most`` most frequent words and word pairs of clean_text that stand in two rows or more and in at most 95 % of
    them, ties settled by term. The list's length is bounded by ``most``, whatever the input."""
    t = F.split("clean_text", " ")
    pairs = F.zip_with(t, F.slice(t, 2, F.greatest(F.lit(0), F.size(t) - 1)), lambda a, b: F.concat(a, F.lit(" "), b))
    terms = data.select(F.monotonically_increasing_id().alias("row"), F.explode(F.filter(F.concat(t, pairs), lambda x: x.isNotNull())).alias("term"))
    counts = terms.groupBy("row", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
    kept = counts.where((F.col("df") >= 2) & (F.col("df") <= 0.95 * rows)).orderBy(F.desc("n"), "term").limit(most)
    return [r[0] for r in kept.select("term").collect()]


def fit(train: DataFrame, kind: str = "logreg", *, most_terms: int | None = None, **options) -> PipelineModel:
    """With ``most_terms`` the features are that many terms at most (``frequent_terms``), none sharing a column."""
    data = prepared(train)
    rows = max(1, data.count())
    if most_terms is not None:
        options["terms"] = frequent_terms(data, rows, most_terms)
    return pipeline(kind, rows=rows, **options).fit(data)


def predict(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """(key, pred, prob_real)."""
    out = model.transform(df.withColumn("clean_text", T.clean_text(F.col("text"))))
    return out.select(key, F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("prob_real"))


def nb_counts(df: DataFrame) -> DataFrame:
    """(label, term, n, p): multinomial counts and smoothed P(term | label), alpha 0.3 over the whole vocabulary."""
    tokens = df.where("label is not null").select("label", F.explode(F.filter(T.words(F.col("text")), T.not_stopword)).alias("term"))
    counts = tokens.groupBy("label", "term").agg(F.count("*").alias("n"))
    types = counts.agg(F.count_distinct("term").alias("v")).scalar()
    totals = F.broadcast(counts.groupBy("label").agg(F.sum("n").alias("total")))  # one row a class
    return counts.join(totals, "label").select("label", "term", "n", ((F.col("n") + 0.3) / (F.col("total") + 0.3 * types)).alias("p"))


def nb_weights(df: DataFrame, alpha: float = 0.3) -> tuple[DataFrame, Column]:
    """(term, w), ln P(term | 1) - ln P(term | 0) of multinomial naive Bayes with smoothing ``alpha``, and the log odds of
    the classes as a scalar. Rows of labels other than 0 and 1 don't count."""
    rows = df.where(F.col("label").isin(0, 1) & F.col("text").isNotNull())
    tokens = rows.select("label", F.explode(F.filter(T.words(F.col("text")), T.not_stopword)).alias("term"))
    side = lambda c: F.sum(F.when(F.col("label") == c, 1).otherwise(0))
    counts = tokens.groupBy("term").agg(side(0).alias("n0"), side(1).alias("n1"))
    total = counts.agg(F.struct(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("*").alias("v"))).scalar()
    p = lambda n, t: F.log((F.col(n) + alpha) / (total[t] + alpha * total["v"]))
    prior = rows.agg((F.log(side(1)) - F.log(side(0))).alias("p")).scalar()
    return counts.select("term", (p("n1", "t1") - p("n0", "t0")).alias("w")), prior


def nb_probabilities(corpus: DataFrame, weights: DataFrame, prior: Column) -> DataFrame:
    """(doc_id, prob_real) of corpus(doc_id, text); words the model doesn't know, and null texts, leave the prior."""
    tokens = corpus.select("doc_id", F.explode_outer(F.filter(T.words(F.col("text")), T.not_stopword)).alias("term"))
    counted = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    score = F.coalesce(F.sum(F.col("n") * F.col("w")), F.lit(0.0)) + F.coalesce(prior, F.lit(0.0))
    return counted.join(weights, "term", "left").groupBy("doc_id").agg((1 / (1 + F.exp(-score))).alias("prob_real"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count("*").alias("n"))


def report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, with rows 'accuracy', 'macro avg' and 'weighted avg'. Computed from the
    confusion matrix, which has a few rows whatever the input."""
    cells = confusion(df.where(F.col(label).isNotNull() & F.col(pred).isNotNull()), label, pred)
    rows = cells.select(F.col(label).alias("c"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("support"), F.lit(0).alias("said"))
    rows = rows.unionAll(cells.select(F.col(pred).alias("c"), F.lit(0), F.lit(0), "n"))
    each = rows.groupBy("c").agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    each = each.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    acc = F.sum("hit") / total
    out = each.select(F.col("c").cast("string").alias("class"), *names, "support")
    out = out.unionAll(each.agg(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), total.alias("support")))
    out = out.unionAll(each.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], total.alias("support")))
    out = out.unionAll(each.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names], total.alias("support")))
    return out.select("class", *[F.round(c, 6).alias(c) for c in names], "support")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): 1 / n scaled to a sum of 2."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    inverse = 1.0 / F.col("n")
    return counts.withColumn("weight", F.round(2 * inverse / F.sum(inverse).over(Window.partitionBy()), 8))


def vocabulary_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(term, side) of the terms of either frame: both, left or right."""
    marks = a.select("term", F.lit(1).alias("m")).unionAll(b.select("term", F.lit(2)))
    return marks.groupBy("term").agg(F.bit_or("m").alias("m")).select("term", F.when(F.col("m") == 3, "both").when(F.col("m") == 1, "left").otherwise("right").alias("side"))


__all__ = ["class_weights", "confusion", "fit", "frequent_terms", "nb_counts", "nb_probabilities", "nb_weights", "pipeline", "predict", "prepared", "report", "vocabulary_overlap"]
