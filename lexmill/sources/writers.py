"""Sinks. ``single`` writes one file, for comparisons only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The preprocessing stages, in order.
STAGES = ("tokens", "stripped", "lowercase", "no_numbers", "no_stopwords", "porter", "snowball", "lemmatized")


def text_lines(df: DataFrame, line: Column, path: str, *, single: bool = False) -> None:
    out = df.select(line.alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def tokens(df: DataFrame, column: str, path: str, *, single: bool = False) -> None:
    """One token a line."""
    text_lines(df.select(F.explode(column).alias("t")), F.col("t"), path, single=single)


def pipe_line(num: Column, title: Column, text: Column) -> Column:
    return F.concat_ws(" | ", num.cast("string"), F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def stages(df: DataFrame, folder: str, prefix: str, *, single: bool = False) -> None:
    """One pipe-record file a stage, from columns title_<stage> and text_<stage>."""
    for stage in STAGES:
        if f"text_{stage}" in df.columns:
            text_lines(df, pipe_line(F.col("num"), F.col(f"title_{stage}"), F.col(f"text_{stage}")), f"{folder}/{prefix}_{stage}.txt", single=single)


def run_line() -> Column:
    """'qid doc_id score' as 007 12 0.1234."""
    return F.format_string("%03d %d %.4f", F.col("qid"), F.col("doc_id"), F.col("score"))


def run_file(run: DataFrame, path: str, *, single: bool = False) -> None:
    text_lines(run, run_line(), path, single=single)


def matrix_lines(post: DataFrame, vocabulary: DataFrame, value: str = "tf") -> DataFrame:
    """(doc_id, line): a number for each term of vocabulary(term, idx), by idx from 0, 0 where post(doc_id, term, value) has
    none. The vocabulary is the small side; a line is as long as it."""
    size = vocabulary.agg(F.count("*")).scalar()
    cells = post.join(F.broadcast(vocabulary), "term").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), F.col(value).cast("string").alias("x")))).alias("m"))
    places = cells.withColumn("places", F.sequence(F.lit(0), (size - 1).cast("int")))
    return places.select("doc_id", F.array_join(F.transform("places", lambda i: F.coalesce(F.col("m")[i], F.lit("0"))), " ").alias("line"))


def dense_matrix(post: DataFrame, vocabulary: DataFrame, path: str, value: str = "tf") -> None:
    """The lines of ``matrix_lines`` in the order of doc_id, as text."""
    matrix_lines(post, vocabulary, value).orderBy("doc_id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def console(rows: list) -> str:
    """Search hits as text lines."""
    return "\n".join(f"{r['rank']:>3}. [{r['score']:.4f}] {r['title']}\n     {r['snippet']}" for r in rows)
