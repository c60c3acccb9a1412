"""Readers. All are lazy and distributed; whole files are only read whole where the format needs it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.tokenize import decode_bytes
from lexmill.operators import sampling

# The statements table's columns, in file order, and its classes as 1 and 0.
LIAR_SCHEMA = "id string, label_str string, statement string, subject string, speaker string, job string, state string, party string, barely_true_n int, false_n int, half_true_n int, mostly_true_n int, pants_on_fire_n int, context string"
LIAR_REAL, LIAR_FAKE = ("true", "mostly-true", "half-true"), ("barely-true", "false", "pants-fire")


def numbered(df: DataFrame) -> DataFrame:
    """df, just read from files, with ``row``: its place from 0 in file order, over files by name. Rows are numbered within
    the stretch of a file that one task reads, to which the sizes of the stretches before are added; only the table of
    stretches (one row a task) is summed in one place."""
    at = ["_file", "_start"]
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*at).orderBy("_at")))
    sizes = rows.groupBy(*at).agg(F.count("*").alias("_n"))
    before = sizes.select(*at, (F.sum("_n").over(Window.orderBy(*at)) - F.col("_n")).alias("_before"))
    return local.join(F.broadcast(before), at).select(*df.columns, (F.col("_r") + F.col("_before") - 1).alias("row"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: value."""
    return spark.read.text(path, wholetext=True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank: value."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where(F.length("value") > 0)


def encoded_text(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(path, value) of files in an encoding other than UTF-8."""
    return spark.read.format("binaryFile").load(path).select("path", decode_bytes(encoding)("content").alias("value"))


def _tagged(spark: SparkSession, path: str) -> DataFrame:
    """(num, body) of records that start with '.I number' at a line's start."""
    files = whole_text(spark, path).select(F.explode(F.split("value", r"(?m)^\.I ")).alias("body"))
    return files.select(F.regexp_extract("body", r"^\s*(\d+)", 1).alias("num"), "body").where(F.col("num") != "").withColumn("num", F.col("num").cast("int"))


def _field(tag: str, *, to_end: bool) -> Column:
    end = r"(?=\n\.)" if not to_end else r"(?=\n\.|$)"
    return T.collapse(F.regexp_extract("body", rf"(?s)\.{tag}\n(.*?){end}", 1))


def tagged_documents(spark: SparkSession, path: str) -> DataFrame:
    """(num, title, text) of .I .T .W records; a missing field is ''."""
    return _tagged(spark, path).select("num", _field("T", to_end=False).alias("title"), _field("W", to_end=False).alias("text"))


def tagged_queries(spark: SparkSession, path: str) -> DataFrame:
    """(num, title, text) of .I .W records; the title is the first 50 characters, with '...' if there are more."""
    text = _field("W", to_end=True)
    return _tagged(spark, path).select("num", text.alias("text")).select("num", T.short_title(F.col("text")).alias("title"), "text")


def pipe_parts(line: Column) -> Column:
    """At most three parts of 'a | b | c'."""
    return F.split(line, r" \| ", 3)


def pipe_records(spark: SparkSession, path: str, *, least: int = 2) -> DataFrame:
    """(num, title, text) of pipe records with at least ``least`` parts; missing ones are ''."""
    parts = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(pipe_parts(F.col("value")).alias("p")).where(F.size("p") >= least)
    at = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    return parts.select(F.trim(at(0)).cast("int").alias("num"), F.trim(at(1)).alias("title"), F.trim(at(2)).alias("text"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): lower case, trimmed, distinct."""
    return lines(spark, path).select(F.lower("value").alias("word")).distinct()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, idx): one term a line, idx its place among the lines that aren't blank."""
    rows = numbered(spark.read.text(path).where(F.length(F.trim("value")) > 0))
    return rows.select(F.trim("value").alias("term"), F.col("row").alias("idx"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id) of white-space separated relevance rows."""
    parts = lines(spark, path).select(F.split("value", r"\s+").alias("p")).where(F.size("p") >= 2)
    return parts.select(F.col("p")[0].cast("int").alias("qid"), F.col("p")[1].cast("int").alias("doc_id"))


def dense_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, values) of one row of numbers a line; row_id is its place in the file."""
    rows = numbered(spark.read.text(path).where(F.length(F.trim("value")) > 0))
    return rows.select(F.col("row").alias("row_id"), F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("values"))


def _required(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in paths if not (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if gone:
        raise FileNotFoundError(f"missing input: {', '.join(gone)}")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def labelled_pair(spark: SparkSession, fake: str, real: str, *, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """(id, title, text, subject, label) of two CSV files; fake 0, real 1. Rows without text drop out; a missing title or
    subject is ''; the id is the row's place among those kept, the fake file's first. With ``sample_size`` at most half of
    it of each class, by hashed order."""
    _required(spark, [fake, real])
    sides = []
    for label, path in ((0, fake), (1, real)):
        rows = numbered(_csv(spark, path).dropna(subset=["text"]))
        col = lambda c, rows=rows: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
        sides.append(rows.select("row", col("title").alias("title"), "text", col("subject").alias("subject"), F.lit(label).alias("label")))
    first = sides[0].agg(F.count("*")).scalar()
    both = sides[0].unionAll(sides[1].withColumn("row", F.col("row") + first))
    out = both.select(F.col("row").cast("string").alias("id"), "title", "text", "subject", "label")
    return out if sample_size is None else sampling.per_class(out, "label", "id", sample_size // 2, seed)


def liar_label(label: Column) -> Column:
    return F.when(label.isin(*LIAR_REAL), 1).when(label.isin(*LIAR_FAKE), 0)


def liar(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(id, title, text, subject, label, split) of headerless TSV files by split; absent splits are left out, and it is an
    error if all are absent."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = {s: p for s, p in files.items() if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)}
    if not there:
        raise FileNotFoundError(f"none of the splits is there: {', '.join(files.values())}")
    out = None
    for split, path in there.items():
        part = spark.read.csv(path, sep="\t", schema=LIAR_SCHEMA, quote="").withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out.select("id", F.lit("").alias("title"), F.col("statement").alias("text"), "subject", liar_label(F.col("label_str")).alias("label"), "split")


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, relevant_subject) of a CSV with a header."""
    return spark.read.csv(path, header=True, schema="query string, relevant_subject string")


def feed(spark: SparkSession, path: str, tag: str = "entry") -> DataFrame:
    """Entries of an Atom or RSS file."""
    return spark.read.format("xml").option("rowTag", tag).load(path)
