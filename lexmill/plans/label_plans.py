"""Plans of labels, samples, splits, classification and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import classify as K
from lexmill.operators import index as I
from lexmill.operators import sampling
from lexmill.sources import readers
from lexmill.tables import table

from . import sql

MOST_TERMS, MAX_ITER = 50_000, 1000  # the reference's


def unified_records(spark: SparkSession, d: str) -> DataFrame:
    """Both labelled tables under one schema, rows without text left out."""
    a = table(spark, d, "news").select("rec_id", F.coalesce("title", F.lit("")).alias("title"), "text", F.coalesce("subject", F.lit("")).alias("subject"), "label")
    b = table(spark, d, "liar").select("rec_id", F.lit("").alias("title"), F.col("statement").alias("text"), F.coalesce("subject", F.lit("")).alias("subject"), readers.liar_label(F.lower(F.trim("label_str"))).alias("label"))
    return a.unionByName(b).dropna(subset=["text"])


def label_remap(spark: SparkSession, d: str) -> DataFrame:
    """The six statement classes as 0 and 1; unmapped ones are null."""
    return table(spark, d, "liar").select("rec_id", "label_str", readers.liar_label(F.col("label_str")).alias("mapped"))


def class_balance(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("label") == 0, "FAKE").when(F.col("label") == 1, "REAL")
    return table(spark, d, "news").groupBy("label").agg(F.count("*").alias("n")).withColumn("name", name)


def subject_label_crosstab(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "news").where("subject is not null").select(F.lower(F.trim("subject")).alias("subject"), "label")
    return rows.groupBy("subject").pivot("label", [0, 1]).agg(F.count("label")).na.fill(0).select("subject", F.col("0").alias("fake"), F.col("1").alias("real"))


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "liar").groupBy("speaker").agg(F.count("*").alias("n")).where("n >= 10")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 500 records a class, by hashed order."""
    rows = table(spark, d, "news").where("label is not null").select("rec_id", "label")
    return sampling.per_class(rows, "label", "rec_id", 500)


def split_70_15_15(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "news").where("label is not null").select("rec_id", "label")
    return sampling.split(rows, "label", "rec_id")


def split_shares(spark: SparkSession, d: str) -> DataFrame:
    return split_70_15_15(spark, d).groupBy("label", "part").agg(F.count("*").alias("n"))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return K.class_weights(table(spark, d, "news"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Evidence decisions against the records' labels."""
    ev = table(spark, d, "evidence").where("prob_real is not null").select("evid_id", "rec_id", (F.col("prob_real") >= 0.5).cast("int").alias("pred"))
    return ev.join(table(spark, d, "news").where("label is not null").select("rec_id", "label"), "rec_id")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return K.confusion(_judged(spark, d))


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return K.report(_judged(spark, d))


def nb_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.nb_counts(table(spark, d, "news")).withColumn("p", F.round("p", 8))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = sampling.split(table(spark, d, "news").where("label is not null and text is not null").select("rec_id", "text", "label"), "label", "rec_id")
    return rows.where("part = 'train'"), rows.where("part <> 'train'")


def logreg_proba(spark: SparkSession, d: str) -> DataFrame:
    train, held = _labelled(spark, d)
    return K.predict(K.fit(train, "logreg", most_terms=MOST_TERMS, max_iter=MAX_ITER), held, "rec_id")


def nb_proba(spark: SparkSession, d: str) -> DataFrame:
    train, held = _labelled(spark, d)
    return K.predict(K.fit(train, "nb", most_terms=MOST_TERMS), held, "rec_id")


def _title_terms(spark: SparkSession, d: str) -> DataFrame:
    return I.analysed(table(spark, d, "news").select(F.col("rec_id").alias("doc_id"), F.col("title").alias("text"))).select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocabulario").select(F.lower(F.trim("term")).alias("term")).where(F.length("term") > 0).distinct()


def vocabulary_sides(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the titles and of the vocabulary: both or one side, in one aggregation."""
    return K.vocabulary_overlap(_title_terms(spark, d), _vocab(spark, d))


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(spark, d).exceptAll(_title_terms(spark, d))


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _vocab(spark, d).intersect(_title_terms(spark, d))


def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Sum, difference, product, quotient, whole quotient, rest and power of whole numbers."""
    n = F.col("p_size").cast("long")
    return table(spark, d, "part").select(
        "p_partkey", (n + 3).alias("plus"), (n - 9).alias("minus"), (n * 7).alias("times"), F.round(n / 4, 6).alias("quotient"), F.floor(n / 4).alias("whole"), (n % 4).alias("rest"), F.pow(n, F.lit(3)).cast("long").alias("power")
    )


def distinct_subjects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news").select("subject").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        unified_records, label_remap, class_balance, subject_label_crosstab, group_sizes, stratified_sample, split_70_15_15, split_shares, class_weights, confusion_matrix, classification_report, nb_counts, logreg_proba, nb_proba,
        vocabulary_sides, set_difference, set_intersection, distinct_subjects, arithmetic,
    )
}

_MAP = "CASE WHEN {0} IN ('true', 'mostly-true', 'half-true') THEN 1 WHEN {0} IN ('barely-true', 'false', 'pants-fire') THEN 0 END"
_TITLES = f"(SELECT DISTINCT unnest({sql.index_words('title')}) AS term FROM news)"
_VOC = "(SELECT DISTINCT lower(trim(term)) AS term FROM vocabulario WHERE length(trim(term)) > 0)"
_SPLIT = """(SELECT rec_id, label, CASE WHEN r <= floor(n * 70 / 100.0 + 0.5) THEN 'train' WHEN r <= floor(n * 85 / 100.0 + 0.5) THEN 'valid' ELSE 'test' END AS part FROM
  (SELECT rec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(coalesce(CAST(label AS VARCHAR), '') || '-' || CAST(rec_id AS VARCHAR) || '-42'), rec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM news WHERE label IS NOT NULL))"""
_JUDGED = "(SELECT evid_id, rec_id, CASE WHEN prob_real >= 0.5 THEN 1 ELSE 0 END AS pred, label FROM evidence JOIN news USING (rec_id) WHERE prob_real IS NOT NULL AND label IS NOT NULL)"
_CLASS = f"""(SELECT c, sum(hit) AS hit, sum(sup) AS support, sum(said) AS said, sum(hit) / CAST(sum(said) AS DOUBLE) AS precision, sum(hit) / CAST(sum(sup) AS DOUBLE) AS recall FROM
  (SELECT label AS c, CASE WHEN label = pred THEN 1 ELSE 0 END AS hit, 1 AS sup, 0 AS said FROM {_JUDGED} UNION ALL SELECT pred, 0, 0, 1 FROM {_JUDGED}) GROUP BY c)"""
_F1 = f"(SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM {_CLASS})"

ORACLE = {
    "unified_records": f"""SELECT * FROM (SELECT rec_id, coalesce(title, '') AS title, text, coalesce(subject, '') AS subject, label FROM news
      UNION ALL SELECT rec_id, '', statement, coalesce(subject, ''), {_MAP.format('lower(trim(label_str))')} FROM liar) WHERE text IS NOT NULL""",
    "label_remap": f"SELECT rec_id, label_str, {_MAP.format('label_str')} AS mapped FROM liar",
    "class_balance": "SELECT label, count(*) AS n, CASE label WHEN 0 THEN 'FAKE' WHEN 1 THEN 'REAL' END AS name FROM news GROUP BY label",
    "subject_label_crosstab": "SELECT lower(trim(subject)) AS subject, count_if(label = 0)::BIGINT AS fake, count_if(label = 1)::BIGINT AS real FROM news WHERE subject IS NOT NULL GROUP BY 1",
    "group_sizes": "SELECT speaker, count(*) AS n FROM liar GROUP BY speaker HAVING count(*) >= 10",
    "stratified_sample": "SELECT rec_id, label FROM (SELECT rec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(rec_id AS VARCHAR) || '-42'), rec_id) AS r FROM news WHERE label IS NOT NULL) WHERE r <= 500",
    "split_70_15_15": f"SELECT * FROM {_SPLIT}",
    "split_shares": f"SELECT label, part, count(*) AS n FROM {_SPLIT} GROUP BY ALL",
    "class_weights": "SELECT label, n, round(2 * (1.0::DOUBLE / n) / sum(1.0::DOUBLE / n) OVER (), 8) AS weight FROM (SELECT label, count(*) AS n FROM news WHERE label IS NOT NULL GROUP BY label)",
    "confusion_matrix": f"SELECT label, CAST(pred AS INT) AS pred, count(*) AS n FROM {_JUDGED} GROUP BY ALL",
    "classification_report": f"""
      SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM {_F1}
      UNION ALL SELECT 'accuracy', round(sum(hit) / CAST(sum(support) AS DOUBLE), 6), round(sum(hit) / CAST(sum(support) AS DOUBLE), 6), round(sum(hit) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM {_F1}
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM {_F1}
      UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {_F1}""",
    "nb_counts": f"""
      WITH c AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest({sql.index_words('text')}) AS term FROM news WHERE label IS NOT NULL) GROUP BY ALL)
      SELECT label, term, n, round((n + CAST(0.3 AS DOUBLE)) / (sum(n) OVER (PARTITION BY label) + CAST(0.3 AS DOUBLE) * (SELECT count(DISTINCT term) FROM c)), 8) AS p FROM c""",
    "vocabulary_sides": f"SELECT coalesce(a.term, b.term) AS term, CASE WHEN b.term IS NULL THEN 'left' WHEN a.term IS NULL THEN 'right' ELSE 'both' END AS side FROM {_TITLES} a FULL JOIN {_VOC} b ON a.term = b.term",
    "set_difference": f"SELECT * FROM {_VOC} EXCEPT SELECT * FROM {_TITLES}",
    "set_intersection": f"SELECT * FROM {_VOC} INTERSECT SELECT * FROM {_TITLES}",
    "arithmetic": "SELECT p_partkey, CAST(p_size + 3 AS BIGINT) AS plus, CAST(p_size - 9 AS BIGINT) AS minus, CAST(p_size * 7 AS BIGINT) AS times, round(p_size / CAST(4 AS DOUBLE), 6) AS quotient, CAST(p_size // 4 AS BIGINT) AS whole, CAST(p_size % 4 AS BIGINT) AS rest, CAST(pow(p_size, 3) AS BIGINT) AS power FROM part",
    "distinct_subjects": "SELECT DISTINCT subject FROM news",
}
