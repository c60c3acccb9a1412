import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import evaluation as E
from lexmill.operators import index as I
from lexmill.operators import pipeline as P
from lexmill.operators import retrieval as R

TEXTS = [
    "the senate passed the budget bill today",
    "scientists found water on mars",
    "the budget deficit grew and the senate argued",
    "a cat sat near the river water",
    None,
    "nasa confirms water traces on the moon surface; nasa moon mission",
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, title string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "nasa moon water"), (2, "senate budget budget"), (3, ""), (4, None), (5, "zebra")], "qid int, text string").cache()


def tokens(text):
    import re

    return [w for w in re.findall("[a-z]{2,}", (text or "").lower()) if w not in T.stopwords()]


def brute_bm25(query, k1=1.5, b=0.75):
    docs = [tokens(t) for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, d in enumerate(docs):
        tf = Counter(d)
        hit = [w for w in tokens(query) if w in tf]
        if hit:
            out[i] = sum(idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg)) for w in hit)
    return sorted(((round(s, 6), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


def test_bm25_equals_brute_force(corpus, asked):
    got = R.bm25(corpus, asked, k=3).orderBy("qid", "rank").collect()
    for qid, text in ((1, "nasa moon water"), (2, "senate budget budget")):
        want = brute_bm25(text)[:3]
        mine = [(r["score"], r["doc_id"]) for r in got if r["qid"] == qid]
        assert [d for _, d in mine] == [d for _, d in want]
        assert all(abs(a[0] - b[0]) < 2e-6 for a, b in zip(mine, want))
    assert {r["qid"] for r in got} == {1, 2}
    assert got[0]["doc_id"] == 5 and got[0]["rank"] == 1


def test_tfidf_best_hit_and_order(corpus, asked):
    got = R.tfidf(corpus, asked, min_df=1, k=3).orderBy("qid", "rank").collect()
    first = [r for r in got if r["qid"] == 1]
    assert first[0]["doc_id"] == 5
    assert all(a["score"] >= b["score"] for a, b in zip(first, first[1:]))


def test_cosine(spark, corpus, asked):
    vocab = spark.createDataFrame([("water",), ("senate",), ("budget",), ("nasa",), ("water",)], "term string")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in R.cosine(corpus, asked, vocab, weighting="tf").collect()}
    assert got[(2, 0)] == round(3 / (math.sqrt(2) * math.sqrt(5)), 6)
    assert got[(1, 5)] == round(3 / (math.sqrt(5) * math.sqrt(2)), 6)
    assert (3, 0) not in got and (2, 1) not in got
    weighted = R.cosine(corpus, asked, vocab, k=1).collect()
    assert {r["qid"]: r["doc_id"] for r in weighted} == {1: 5, 2: 0}


def test_dense_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[7] = x[3]
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8)], "doc_id long, embedding array<float>")
    q = v.where("doc_id % 20 = 0 or doc_id >= 900").select(F.col("doc_id").alias("qid"), "embedding")
    got = R.dense(v, q, k=4).orderBy("qid", "rank").collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for qid in range(0, 200, 20):
        s = np.round(u @ u[qid], 6)
        want = sorted(range(200), key=lambda i: (-s[i], i))[:4]
        assert [r["doc_id"] for r in got if r["qid"] == qid] == want
    assert not [r for r in got if r["qid"] >= 900]


def test_hybrid_and_rerank(spark, corpus, asked):
    a = spark.createDataFrame([(1, 1, 10, 4.0), (1, 2, 11, 2.0)], "qid int, rank int, doc_id long, score double")
    b = spark.createDataFrame([(1, 1, 11, 9.0), (1, 2, 12, 1.0)], "qid int, rank int, doc_id long, score double")
    got = [(r["doc_id"], r["score"]) for r in R.hybrid(a, b, k=3).orderBy("rank").collect()]
    assert got == [(10, 0.5), (11, 0.5), (12, 0.0)]
    best = R.rerank(R.bm25(corpus, asked, k=5), corpus, asked, k=1).orderBy("qid").collect()
    assert [(r["qid"], r["doc_id"], r["score"]) for r in best] == [(1, 5, 1.0), (2, 0, 1.0)]


def test_unknown_retriever():
    with pytest.raises(ValueError, match="unknown retriever"):
        R.retriever("nope")


def test_empty_corpus(spark, asked):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.bm25(empty, asked).count() == 0
    assert R.tfidf(empty, asked).count() == 0
    assert I.term_stats(I.analysed(empty)).count() == 0


def test_index_tables(spark, corpus):
    post = {(r["doc_id"], r["term"]): r["tf"] for r in I.postings(I.analysed(corpus)).collect()}
    assert post[(5, "nasa")] == 2 and (0, "the") not in post
    stats = {r["term"]: (r["tf"], r["df"]) for r in I.term_stats(I.analysed(corpus)).collect()}
    assert stats["water"] == (3, 3) and stats["nasa"] == (2, 1)
    bands = {r["term"]: r["band"] for r in I.banded(I.document_frequency(I.analysed(corpus, stop=False)), I.collection_size(corpus), 2, 0.5).collect()}
    assert bands["the"] == "high" and bands["water"] == "kept" and bands["nasa"] == "low"
    vocab = I.vocabulary(spark.createDataFrame([(w,) for w in "pear apple fig apple".split()], "term string")).orderBy("idx").collect()
    assert [(r["term"], r["idx"]) for r in vocab] == [("apple", 0), ("fig", 1), ("pear", 2)]


def test_metrics(spark):
    run = spark.createDataFrame([(1, r, d) for r, d in enumerate([1, 2, 3], 1)] + [(2, r, d) for r, d in enumerate([9, 4, 8], 1)], "qid int, rank int, doc_id long")
    rel = spark.createDataFrame([(1, 1), (1, 3), (2, 4), (2, 7), (2, 6), (3, 5)], "qid int, doc_id long")
    got = {r["qid"]: r for r in E.per_query(run, rel).collect()}
    assert got[1]["ap"] == pytest.approx((1 + 2 / 3) / 2) and got[1]["rr"] == 1
    assert got[1]["p_3"] == pytest.approx(2 / 3) and got[1]["p_5"] == pytest.approx(2 / 5) and got[1]["r_3"] == 1
    assert got[2]["ap"] == pytest.approx(0.5 / 3) and got[2]["rr"] == 0.5 and got[2]["r_3"] == pytest.approx(1 / 3)
    assert got[3]["ap"] == 0 and got[3]["rr"] == 0 and got[3]["ndcg_10"] == 0
    dcg, ideal = 1 + 1 / math.log2(4), 1 + 1 / math.log2(3)
    assert got[1]["ndcg_3"] == pytest.approx(dcg / ideal)
    means = E.evaluate(run, rel).first()
    assert means["mrr"] == pytest.approx(0.5) and means["map"] == pytest.approx((5 / 6 + 1 / 6) / 3, abs=1e-6)
    ci = E.bootstrap(E.per_query(run, rel), "ap", rounds=50).first()
    assert ci["low"] <= ci["mean"] <= ci["high"]


def test_stored_index(spark, corpus, asked, tmp_path):
    path = str(tmp_path / "index")
    index = P.stored_index(corpus.select("doc_id", "text"), path)
    want = [tuple(r) for r in R.bm25(corpus, asked, k=3).orderBy("qid", "rank").collect()]
    assert [tuple(r) for r in P.search_index(index, asked, k=3).orderBy("qid", "rank").collect()] == want
    other = corpus.select("doc_id", F.concat("text", F.lit(" zebra")).alias("text"))
    assert P.fingerprint(other) != P.fingerprint(corpus)
    again = P.search_index(P.stored_index(other, path), asked.where("qid = 5"), k=3)
    assert again.count() == 3


def test_search_and_verify(spark, corpus, asked):
    got = P.search_and_verify(corpus, asked, k=2).orderBy("qid", "rank").collect()
    assert got[0]["doc_id"] == 5 and got[0]["verdict"] == "SUPPORTS" and got[0]["decision"] == "REAL"
    assert got[0]["combined"] == pytest.approx(0.85)
    rel = spark.createDataFrame([(1, 5), (2, 0)], "qid int, doc_id long")
    table = P.evaluate_models(corpus.select("doc_id", "text"), asked, rel, ["bm25", "tfidf"]).collect()
    assert [r["model"] for r in table] == ["bm25", "tfidf"] and table[0]["mrr"] == 1.0


def test_best_rows_with_ties():
    rng = np.random.default_rng(4)
    for n, k in ((1, 3), (5, 5), (40, 5)):
        s, doc = np.round(rng.random((7, n)), 1), rng.permutation(n)
        row, col = R.best_rows(s, doc, k)
        want = [(i, j) for i in range(7) for j in sorted(range(n), key=lambda j: (-s[i, j], doc[j]))[:k]]
        assert list(zip(row.tolist(), col.tolist())) == want
    assert len(R.best_rows(np.empty((2, 0)), np.empty(0, np.int64), 3)[0]) == 0


def test_semantic_and_hybrid(spark, corpus, asked):
    for name in ("semantic", "hybrid"):
        got = R.retriever(name)(corpus.select("doc_id", "text"), asked, k=3).where("qid = 1").orderBy("rank").collect()
        assert got[0]["doc_id"] == 5 and len(got) == 3 and got[0]["score"] >= got[1]["score"]
    assert R.semantic(corpus.select("doc_id", "text"), asked.limit(0)).count() == 0
    assert R.semantic(corpus.select("doc_id", "text").limit(0), asked).count() == 0


def test_fitted_retrievers(spark, corpus, asked, tmp_path):
    texts = corpus.select("doc_id", "text")
    for name in R.RETRIEVERS:
        want = sorted(map(tuple, R.retriever(name)(texts, asked, k=3).collect()))
        for _ in range(2):  # made, then read
            got = P.fit_retriever(name, texts, str(tmp_path))(asked, 3)
            assert sorted(map(tuple, got.collect())) == want, name
    with pytest.raises(ValueError, match="unknown retriever"):
        P.fit_retriever("none", texts, str(tmp_path))


def test_searcher_classifies_hits(spark, corpus, asked):
    labelled = spark.createDataFrame([("nasa found water on the moon", 1), ("aliens stole the election", 0), (None, 1), ("x", None)], "text string, label int")
    searcher = P.Searcher(corpus, labelled=labelled)
    got = searcher.search(asked.where("qid = 1"), k=2).orderBy("rank").collect()
    assert got[0]["doc_id"] == 5 and got[0]["prob_real"] > 0.5 and searcher.history[0]["k"] == 2
    assert all(0 < r["prob_real"] < 1 for r in got)


def test_corpus_texts_are_not_shuffled(spark, asked, tmp_path):
    """No exchange below the hits carries the documents' texts."""
    path = str(tmp_path / "docs")
    spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("water moon "), F.col("id").cast("string")).alias("text"), F.lit("t").alias("title")).repartition(8).write.parquet(path)
    docs = spark.read.option("x", 1).parquet(path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a task a file
    try:
        run = spark.createDataFrame([(1, 1, 5, 1.0), (1, 2, 7, 0.5)], "qid int, rank int, doc_id long, score double")
        small = R.few_rows(asked, 10)
        for df in (R.hits(run, docs, small=small), R.rerank(run, docs.select("doc_id", "text"), asked)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            join = plan[plan.index("BroadcastHashJoin") :]
            scan = join[: join.index("FileScan")]
            assert "RoundRobin" not in scan and "hashpartitioning" not in scan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_metrics_with_totals(spark):
    run = spark.createDataFrame([(1, r, d) for r, d in enumerate([1, 2, 3], 1)], "qid int, rank int, doc_id long")
    rel, totals = spark.createDataFrame([(1, 1)], "qid int, doc_id long"), spark.createDataFrame([(1, 4), (2, 3)], "qid int, n long")
    got = {r["qid"]: r for r in E.per_query(run, rel, totals=totals).collect()}
    assert got[1]["r_3"] == 0.25 and got[1]["ap"] == 0.25 and got[2]["ap"] == 0


def test_command_line(spark, corpus, asked, tmp_path, capsys):
    from lexmill import cli

    path = str(tmp_path / "corpus")
    corpus.write.parquet(path)
    out = cli.main(["--corpus", path, "-q", "nasa moon water", "-k", "2", "--verifier"])
    assert "consensus: SUPPORTS" in out and out.startswith("  1. [1.0000]")
    index = str(tmp_path / "index")
    for more in ([], ["--refit"]):
        assert cli.main(["--corpus", path, "-q", "nasa moon water", "-k", "1", "--index", index, *more]).startswith("  1. [1.0000]")
    asked.where("text is not null").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(1, 5), (2, 0)], "qid int, doc_id long").write.parquet(str(tmp_path / "rel"))
    out = cli.main(["--corpus", path, "--eval", str(tmp_path / "q"), "--qrels", str(tmp_path / "rel"), "--models", "bm25"])
    assert "'mrr': 1.0" in out
    labelled = str(tmp_path / "labelled")
    spark.createDataFrame([("nasa moon water", 1), ("hoax", 0)], "text string, label int").write.parquet(labelled)
    history = str(tmp_path / "history")
    out = cli.main(["--corpus", path, "-q", "nasa moon water", "-k", "1", "-m", "hybrid", "--labelled", labelled, "--history", history, "--verifier"])
    assert "REAL" in out and '"model": "hybrid"' in open(history).read()
    assert "tfidf:" in cli.main(["--corpus", path, "--warm-up", str(tmp_path / "warm")])
    with pytest.raises(SystemExit):
        cli.main(["--corpus", path])
