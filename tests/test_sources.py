import pytest
from pyspark.sql import functions as F

from lexmill.sources import readers, writers
from lexmill.streaming import index_updates


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_tagged_files(spark, tmp_path):
    docs = put(tmp_path, "docs", ".I 1\n.T\nFirst\n title\n.W\nSome text with .I 9 inside\nmore\n.B\nx\n.I 2\n.T\nOnly title\n.B\ny\n")
    assert rows(readers.tagged_documents(spark, docs), "num") == [(1, "First title", "Some text with .I 9 inside more"), (2, "Only title", "")]
    queries = put(tmp_path, "queries", ".I 1\n.W\n" + "word " * 20 + "\n.A\nme\n.I 2\n.W\nlast one\n")
    got = rows(readers.tagged_queries(spark, queries), "num")
    assert got[0][1] == ("word " * 20)[:50] + "..." and got[1] == (2, "last one", "last one")


def test_pipe_records(spark, tmp_path):
    path = put(tmp_path, "p", "1 | a title | some text | with a bar\n2 | only title |\n3\n\n")
    assert rows(readers.pipe_records(spark, path), "num") == [(1, "a title", "some text | with a bar"), (2, "only title |", "")]
    assert readers.pipe_records(spark, path, least=1).count() == 3
    assert readers.pipe_records(spark, path, least=3).count() == 1


def test_word_lists_and_matrices(spark, tmp_path):
    assert rows(readers.word_list(spark, put(tmp_path, "w", "The\n the \n\nOf\n")), "word") == [("of",), ("the",)]
    assert rows(readers.vocabulary(spark, put(tmp_path, "v", "b\na\n")), "idx") == [("b", 0), ("a", 1)]
    assert rows(readers.judgements(spark, put(tmp_path, "q", "01 0756  0 0\n02 12 0 0\n")), "qid") == [(1, 756), (2, 12)]
    assert readers.dense_matrix(spark, put(tmp_path, "m", "1 0.5\n0 2\n")).orderBy("row_id").first()["values"] == [1.0, 0.5]
    assert readers.whole_text(spark, put(tmp_path, "t", "a\nb")).first()["value"] == "a\nb"
    assert rows(readers.lines(spark, put(tmp_path, "l", " a \n\n b\n")), "value") == [("a",), ("b",)]


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    """Over several stretches of a file, whatever the order of the tasks."""
    path = put(tmp_path, "long", "\n".join(f"{i} {i * 2}" for i in range(5000)) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = rows(readers.dense_matrix(spark, path), "row_id")
        words = rows(readers.vocabulary(spark, path), "idx")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(i, v) for i, v in got] == [(i, [float(i), float(2 * i)]) for i in range(5000)] and words[4321] == ("4321 8642", 4321)


def test_encoded(spark, tmp_path):
    assert readers.encoded_text(spark, put(tmp_path, "e", "zażółć", "latin2"), "latin2").first()["value"] == "zażółć"


def test_labelled_pair(spark, tmp_path):
    fake = put(tmp_path, "f.csv", 'title,text,subject\nA,"two\nlines, ""quoted""",s\nB,,s\n')
    real = put(tmp_path, "r.csv", "text,date\nreal text,2020\n")
    got = rows(readers.labelled_pair(spark, fake, real), "label")
    assert [(t, x, s, y) for _, t, x, s, y in got] == [("A", 'two\nlines, "quoted"', "s", 0), ("", "real text", "", 1)]
    assert [r[0] for r in got] == ["0", "1"]
    many = put(tmp_path, "m.csv", "title,text\n" + "a,same\n" * 10)
    ids = rows(readers.labelled_pair(spark, many, many), "id")
    assert sorted(int(r[0]) for r in ids) == list(range(20)) and all((int(r[0]) >= 10) == (r[4] == 1) for r in ids)
    assert sorted(r[4] for r in readers.labelled_pair(spark, many, many, sample_size=6).collect()) == [0, 0, 0, 1, 1, 1]
    with pytest.raises(FileNotFoundError, match="missing"):
        readers.labelled_pair(spark, fake, str(tmp_path / "none.csv"))


def test_statements(spark, tmp_path):
    line = "1.json\thalf-true\tA claim\tsports\tBob\t\t\t\t1\t2\t3\t4\t5\ta speech\n2.json\todd\tOther\t\t\t\t\t\t\t\t\t\t\t\n"
    path = put(tmp_path, "train.tsv", line)
    got = rows(readers.liar(spark, {"train": path, "test": str(tmp_path / "no.tsv")}), "id")
    assert got == [("1.json", "", "A claim", "sports", 1, "train"), ("2.json", "", "Other", None, None, "train")]
    with pytest.raises(FileNotFoundError):
        readers.liar(spark, {"train": str(tmp_path / "no.tsv")})


def test_other_formats(spark, tmp_path):
    path = put(tmp_path, "feed.xml", "<feed><entry><title>a</title></entry><entry><title>b</title></entry></feed>")
    assert rows(readers.feed(spark, path).select("title"), "title") == [("a",), ("b",)]
    assert rows(readers.evaluation_queries(spark, put(tmp_path, "q.csv", "query,relevant_subject\nx y,news\n")), "query") == [("x y", "news")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, 12, 0.123456, ["b", "a"])], "num int, qid int, doc_id long, score double, toks array<string>")
    writers.run_file(df, str(tmp_path / "run"), single=True)
    assert spark.read.text(str(tmp_path / "run")).first()[0] == "007 12 0.1235"
    writers.tokens(df, "toks", str(tmp_path / "toks"), single=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "toks")).collect()] == ["b", "a"]
    staged = df.select("num", F.lit("T").alias("title_porter"), F.lit(None).cast("string").alias("text_porter"))
    writers.stages(staged, str(tmp_path), "docs")
    assert spark.read.text(str(tmp_path / "docs_porter.txt")).first()[0] == "1 | T | "
    writers.csv(df.drop("toks"), str(tmp_path / "csv"))
    writers.table(df, str(tmp_path / "parquet"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    assert writers.console([{"rank": 1, "score": 0.5, "title": "t", "snippet": "s"}]) == "  1. [0.5000] t\n     s"


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "budget vote budget", "a", "2024-01-01 10:00:00"), (2, "the vote", "b", "2024-01-03 10:00:00")], "doc_id long, text string, source string, at string").select("doc_id", "text", "source", F.to_timestamp("at").alias("loaded_at")).write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_id long, text string, source string, loaded_at timestamp").parquet(source)
    q = index_updates.term_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("terms").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["term"]: (r["tf"], r["df"]) for r in spark.sql("select * from terms").collect()} == {"budget": (2, 1), "vote": (2, 2)}
    q = index_updates.windowed_counts(stream()).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select source, n from windows").collect()[0]["source"] == "a"
    index_updates.append_postings(stream(), str(tmp_path / "post"), str(tmp_path / "chk")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "post")).count() == 3


def test_dense_matrix_round_trip(spark, tmp_path):
    post = spark.createDataFrame([(7, "b", 2), (7, "d", 1), (3, "a", 5)], "doc_id long, term string, tf long")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "term string, idx long")
    path = str(tmp_path / "matrix")
    writers.dense_matrix(post, vocab, path)
    assert [v for _, v in rows(readers.dense_matrix(spark, path), "row_id")] == [[5, 0, 0, 0], [0, 2, 0, 1]]
