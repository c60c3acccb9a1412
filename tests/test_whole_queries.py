"""Searches that take all queries, not every twentieth."""

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lexmill.operators import blocks as B
from lexmill.operators import retrieval as R

WHOLE = ["bm25_topk", "search_hits", "cosine_tfidf", "hybrid_topk", "hybrid_semantic", "rerank_lexical", "search_consensus"]


@pytest.mark.parametrize("name", WHOLE)
def test_all_queries_are_searched(spark, data, name):
    """Nearly all queries have a word that documents have; of every residue of 20 there are some."""
    found = {r[0] for r in entry.queries()[name](spark, data).select("qid").distinct().collect()}
    known = {q for q in pq.read_table(f"{data}/queries.parquet")["qid"].to_pylist()}
    assert found <= known and len(found) > len(known) / 2 and {q % 20 for q in found} == set(range(20))


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [(i, " ".join(w for j, w in enumerate(("alpha", "beta", "gamma", "delta", "omega")) if i % (j + 2) == 0 for _ in range(1 + i % 3))) for i in range(300)]
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(7)


def test_queries_alike_are_scored_once(spark, corpus, monkeypatch):
    asked = spark.createDataFrame([(i, ("alpha gamma", "gamma ALPHA unknown", "beta beta", "omega")[i % 4]) for i in range(80)], "qid int, text string")
    run = {}
    for r in R.bm25(corpus, asked, k=5).orderBy("qid", "rank").collect():
        run.setdefault(r["qid"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert sorted(run) == list(range(80)) and all(len(x) == 5 for x in run.values())
    assert all(run[i] == run[i % 2 if i % 4 < 2 else i % 4] for i in range(80)) and run[0] == run[1] != run[2]
    batch = R._bm25(corpus, asked)[1].toArrow().combine_chunks().to_batches()[0]
    assert len(B.alike(batch)[0]) == 3


def test_bounds_leave_out_no_document(spark, corpus, monkeypatch):
    """Once k are found, documents that only have words of low bounds aren't looked at; the result is that of all pairs."""
    asked = spark.createDataFrame([(1, "alpha beta gamma"), (2, "omega delta"), (3, "alpha omega omega"), (4, "gamma")], "qid int, text string")
    monkeypatch.setattr(B, "JOINED_ROWS", 1)
    for search in (R.bm25, lambda *a, **k: R.tfidf(*a, min_df=1, **k), lambda c, q, k: R.cosine(c, q, spark.createDataFrame([("alpha",), ("beta",), ("omega",)], "term string"), k=k)):
        whole = [r for r in search(corpus, asked, k=None).orderBy("qid", "rank").collect() if r["rank"] <= 6]
        assert search(corpus, asked, k=6).orderBy("qid", "rank").collect() == whole


def test_queries_without_an_id(spark, corpus):
    """As in the SQL: BM25 keeps them, the cosines join by the id."""
    asked = spark.createDataFrame([(None, "alpha beta"), (2, "alpha")], "qid int, text string")
    vocabulary = spark.createDataFrame([("alpha",), ("beta",)], "term string")
    ids = lambda run: {r["qid"] for r in run.collect()}
    assert ids(R.bm25(corpus, asked)) == {None, 2}
    assert ids(R.tfidf(corpus, asked)) == ids(R.cosine(corpus, asked, vocabulary, k=10)) == {2}


def rows(run):
    return run.orderBy("qid", "rank").collect()


def test_pools_mixed_in_a_task(spark, corpus):
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "unknown"), (3, None), (4, "gamma alpha omega"), (5, "delta")], "qid int, text string")
    pool = R.pool_size(4)
    assert rows(R.hybrid_topk(corpus, asked, k=4)) == rows(R.hybrid(R.bm25(corpus, asked, k=pool), R.tfidf(corpus, asked, k=pool), k=4))
    assert rows(R.hybrid_search(corpus, asked, k=4)) == rows(R.hybrid(R.bm25(corpus, asked, k=pool), R.semantic(corpus, asked, k=pool), k=4))


@pytest.mark.parametrize("again", [False, True])
def test_pools_reranked_in_a_task(spark, corpus, again):
    asked = [(1, "alpha beta at"), (2, "unknown"), (3, None), (4, "gamma alpha omega other words"), (5, "delta"), (None, "alpha")] + ([(1, "beta nothing")] if again else [])
    asked = spark.createDataFrame(asked, "qid int, text string")
    got = R.bm25_reranked(corpus, asked, k=4, depth=30)
    assert rows(got) == rows(R.rerank(R.bm25(corpus, asked, k=30), corpus, asked, k=4, depth=30)) and got.count() == 12
