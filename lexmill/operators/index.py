"""The inverted index as tables: postings, document lengths, term statistics, vocabulary and weights.

A corpus is a frame (doc_id, text); every analyser is a Column expression, so nothing leaves the JVM. Term statistics are
one hash aggregation by term with map-side combine; postings one by (doc_id, term), whose groups lie within a partition
already, so the partial step collapses them before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most ``rows`` rows; it is counted, so ask of cheap frames (queries, vocabularies)."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """A broadcast hint for a frame known to be small; else the planner chooses (sort-merge, AQE skew join)."""
    return F.broadcast(df) if small else df


def spread(df: DataFrame) -> DataFrame:
    """df over one partition a core at least: a small table in one file would give one task the whole work by row. Where
    there are enough partitions nothing is shuffled."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def fixed(column: Column) -> Column:
    """A generator of one row: the planner can't inline the column into what uses it, so it is computed once a row."""
    return F.explode(F.array(column))


def analysed(corpus: DataFrame, *, stop: bool = True) -> DataFrame:
    """(doc_id, tokens). Null texts have no token."""
    tokens = T.words(F.col("text"))
    return corpus.select("doc_id", fixed(F.filter(tokens, T.not_stopword) if stop else tokens).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    return tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_stats(tokens: DataFrame) -> DataFrame:
    """(term, tf, df) from the postings, which the partial aggregation makes within each partition. (Counting within the row
    by array functions was tried: the planner inlines the sorted array into the lambda and sorts it once per element.)"""
    return postings(tokens).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def matching(tokens: DataFrame, terms: DataFrame, *keep: str, small: bool | None = None) -> DataFrame:
    """(doc_id, term, tf, *keep) for the wanted terms only, cut before anything is shuffled. ``small``: whether there are
    few terms, if the caller knows."""
    wanted = terms.select("term").distinct()
    wanted = hinted(wanted, is_small(wanted) if small is None else small)
    each = tokens.select("doc_id", *keep, F.explode("tokens").alias("term")).join(wanted, "term")
    return each.groupBy("doc_id", *keep, "term").agg(F.count("*").alias("tf"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(term, df) with one shuffle by term: a record's distinct terms are found within the row."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def collection_size(corpus: DataFrame) -> Column:
    return corpus.agg(F.count("*").alias("n")).scalar()


def banded(stats: DataFrame, n: Column, min_df: int = 2, max_df_ratio: float = 0.8) -> DataFrame:
    """``low`` below min_df, ``high`` above floor(ratio * n), else ``kept``."""
    top = F.floor(F.lit(max_df_ratio) * n)
    return stats.withColumn("band", F.when(F.col("df") < min_df, "low").when(F.col("df") > top, "high").otherwise("kept"))


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, idx): distinct terms in code point order, idx from 0.

    Terms are numbered within their first three characters, to which the sizes of the smaller beginnings are added, so no
    task sorts them all; only the table of beginnings is summed in one."""
    distinct = terms.select("term", F.substring("term", 1, 3).alias("head")).distinct()
    sizes = distinct.groupBy("head").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("head", F.coalesce(before, F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("head").orderBy("term"))
    return distinct.withColumn("r", local).join(offsets, "head").select("term", (F.col("base") + F.col("r") - 1).cast("long").alias("idx"))


def idf(stats: DataFrame, n: Column) -> DataFrame:
    """ln(n / df), 0 for df = 0."""
    return stats.withColumn("idf", F.when(F.col("df") == 0, 0.0).otherwise(F.log(n / F.col("df"))))


def tfidf(post: DataFrame, idf_table: DataFrame) -> DataFrame:
    """(doc_id, term, weight)."""
    return post.join(idf_table.select("term", "idf"), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))


def grams(tokens: DataFrame) -> DataFrame:
    """tokens with the pairs of neighbours ('a b') added, within the row."""
    pairs = F.zip_with(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return tokens.select("doc_id", fixed(F.concat("tokens", pairs)).alias("tokens"))
