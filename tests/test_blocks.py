"""Search by blocks: whole results, and no table of (query, document) pairs on the way."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import blocks as B
from lexmill.operators import retrieval as R
from lexmill.plans import registry

WORDS = ["budget", "senate", "moon", "water", "river", "cat", "mars", "nasa", "bill", "storm", "quota", "ferry"]
VOCABULARY = WORDS[:8]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, 13)
    return [" ".join(rng.choice(WORDS, rng.integers(0, 9), p=share / share.sum())) for _ in range(240)]


@pytest.fixture(scope="module")
def corpus(spark, texts):
    """In seven partitions, of which each is a block."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).cache()


@pytest.fixture(scope="module")
def asked(spark, texts):
    return spark.createDataFrame([(i, texts[i * 7]) for i in range(30)] + [(98, None), (99, "zebra")], "qid int, text string").cache()


def best(scores, k):
    out = sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
    return [(r, d, s) for r, (s, d) in enumerate(out, 1)]


def got(run):
    out = {}
    for r in run.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


def same(mine, want):
    assert [x[:2] for x in mine] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(mine, want))


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


def bm25(texts, query):
    docs = [Counter(t.split()) for t in texts]
    n, avg = len(docs), sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    q = Counter(query.split())
    return {i: sum(c * idf[w] * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * sum(d.values()) / avg)) for w, c in q.items() if w in d) for i, d in enumerate(docs) if set(q) & set(d)}


@pytest.mark.parametrize("k", [3, 20, None])
def test_bm25(corpus, asked, texts, k):
    run = got(R.bm25(corpus, asked, k=k))
    for i in range(30):
        same(run.get(i, []), best(bm25(texts, texts[i * 7]), k))
    assert not {98, 99} & set(run)


def test_bm25_makes_no_pairs(corpus, asked):
    assert exchanges(R.bm25(corpus, asked)) == []


def test_ids_of_text(corpus, asked):
    """Ties go by the text of the id, null ids give no row."""
    named = corpus.select(F.when(F.col("doc_id") != 5, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("doc_id"), "text")
    run = got(R.bm25(named, asked, k=4))
    assert run and all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for rows in run.values() for a, b in zip(rows, rows[1:]))
    assert R.bm25(named, asked, k=None).where("doc_id is null").count() == 0


def test_halves_are_rounded_up():
    assert B.rounded(np.array([0.0390625, -0.0390625, 0.5])).tolist() == [0.039063, -0.039063, 0.5]


def test_tfidf_makes_no_pairs(corpus, asked, texts):
    found = R.tfidf(corpus, asked, k=5)
    assert exchanges(found) == []
    grams = [Counter(w := t.split()) + Counter(f"{a} {b}" for a, b in zip(w, w[1:])) for t in texts]
    n, df = len(grams), Counter(g for d in grams for g in d)
    idf = {g: math.log((1 + n) / (1 + c)) + 1 for g, c in df.items() if 2 <= c <= 0.95 * n}
    vec = [{g: (1 + math.log(c)) * idf[g] for g, c in d.items() if g in idf} for d in grams]
    length = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
    run = got(found)
    for i in range(30):
        q = vec[i * 7]
        want = {d: sum(x * v[g] for g, x in q.items() if g in v) / (length[d] * length[i * 7]) for d, v in enumerate(vec) if q.keys() & v.keys()}
        same(run.get(i, []), best(want, 5))


def cosine(texts, query, weighted):
    docs = [Counter(w for w in t.split() if w in VOCABULARY) for t in texts]
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log(len(docs) / c) if weighted else 1.0 for w, c in df.items()}
    length = lambda d: math.sqrt(sum((c * idf[w]) ** 2 for w, c in d.items()))
    q = Counter(w for w in query.split() if w in VOCABULARY)
    scores = {i: sum(c * d[w] * idf[w] ** 2 for w, c in q.items()) for i, d in enumerate(docs)}
    return {i: s / (length(docs[i]) * length(q)) for i, s in scores.items() if s > 0}


def test_cosine_makes_no_pairs(spark, corpus, asked, texts):
    vocabulary = spark.createDataFrame([(w,) for w in [*VOCABULARY, None]], "term string")
    found = R.cosine(corpus, asked, vocabulary, k=6)
    assert exchanges(found) == []
    run = got(found)
    for i in range(30):
        same(run.get(i, []), best(cosine(texts, texts[i * 7], True), 6))


def test_semantic_makes_no_pairs(corpus, asked, texts):
    found = R.semantic(corpus, asked, k=5)
    assert exchanges(found) == []
    import pandas as pd

    x = np.stack(R.hashed_vectors(pd.Series(texts))).astype(float)
    length = np.linalg.norm(x, axis=1)
    run = got(found)
    for i in range(30):
        if length[i * 7]:
            same(run[i], best({d: x[d] @ x[i * 7] / (length[d] * length[i * 7]) for d in range(len(texts)) if length[d]}, 5))


def test_hybrid_ranks_small_runs(corpus, asked):
    """What is shuffled after the two searches are their k rows a query, without a sort of pairs for either."""
    a, b = R.bm25(corpus, asked, k=5), R.tfidf(corpus, asked, k=5)
    plan = R.hybrid(a, b, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan


def test_rerank_takes_a_text_apart_once(corpus, asked):
    """Words are found below the join with the pairs, not for each pair."""
    plan = R.rerank(R.bm25(corpus, asked, k=5), corpus, asked, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[: plan.index("Join")]


@pytest.mark.parametrize("name", ["search_hits", "run_lines", "search_and_verify", "search_consensus"])
def test_registered_searches_make_no_pairs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert not [x for x in exchanges(df) if "hashpartitioning(qid" in x and "doc_id" in x]


def test_all_pairs_of_cosine_are_ranked_where_they_are_made(spark, corpus, asked, texts):
    """Only the queries are shuffled."""
    found = R.cosine(corpus, asked, spark.createDataFrame([(w,) for w in VOCABULARY], "term string"), weighting="tf")
    assert not [x for x in exchanges(found) if "doc_id" in x and "qid" in x]
    run = got(found)
    for i in range(30):
        same(run.get(i, []), best(cosine(texts, texts[i * 7], False), None))


def test_blocks_are_scored_together(corpus, asked, texts, monkeypatch):
    """The blocks of the seven partitions are one when scored, with the hits of a block at a time."""
    tokens = R.I.analysed(corpus)
    terms = [(w, 1.0 + i / 7) for i, w in enumerate(sorted(WORDS))]
    blocks = B.postings(tokens, terms, len(terms), weight="log")
    batch = R._coded(R.query_terms(asked), terms, F.col("qtf") * F.col("idf")).orderBy("qid").toArrow().combine_chunks().to_batches()[0]
    runs, sizes = [], []
    for rows in (B.JOINED_ROWS, 100, 1):
        monkeypatch.setattr(B, "JOINED_ROWS", rows)
        best, parts = [B.Best(4) for _ in range(batch.num_rows)], list(B.decoded(B.reader(blocks._lexmill_path), B.Postings))
        for x, _ in parts:
            B.add_postings(True)(x, batch, best)
        runs.append([tuple(c.tolist() for c in b.rows()) for b in best])
        sizes.append([n for _, n in parts])
    assert sizes[0] == [7] and sizes[2] == [1] * 7 and 1 < len(sizes[1]) < 7 and sum(sizes[1]) == 7
    assert runs[0] == runs[1] == runs[2]


def test_large_runs_shuffle_ids_not_words(spark, corpus, asked, monkeypatch):
    """Where a run is too large to be broadcast, the queries' words join the pairs after these met their documents, and the
    corpus is cut by a broadcast of ids; the rows are those of a small run."""
    import lexmill.operators.pipeline as P

    docs = corpus.withColumn("title", F.lit("t"))
    search = lambda: P.search_and_verify(docs, asked, k=2, pool=5, classifier=lambda texts: texts.select("doc_id", (F.col("doc_id") / 240).alias("prob_real")))
    rows = lambda df: sorted(map(repr, df.collect()))
    small = rows(R.rerank(R.bm25(corpus, asked, k=5), corpus, asked, k=2)), rows(search())
    monkeypatch.setattr(R, "few_rows", lambda queries, k: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reranked = R.rerank(R.bm25(corpus, asked, k=5), corpus, asked, k=2)
        plan = reranked._jdf.queryExecution().executedPlan().toString()
        assert plan.index("BroadcastHashJoin [qid") < plan.index("SortMergeJoin [doc_id")
        found = search()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [x for x in plan.splitlines() if "BroadcastHashJoin [doc_id" in x and "LeftSemi" in x]
        assert (rows(reranked), rows(found)) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_pairs_are_made_in_tasks_of_bounded_size(spark, corpus, asked, texts, monkeypatch):
    """A task's file doesn't grow with queries times documents; no pair is lost by that."""
    monkeypatch.setattr(B, "TASK_PAIRS", 2 * len(texts), raising=False)
    monkeypatch.setattr(B, "TASK_QUERIES", 1, raising=False)
    found = R.cosine(corpus, asked, spark.createDataFrame([(w,) for w in VOCABULARY], "term string"), weighting="tf")
    assert found.rdd.getNumPartitions() >= sum(bool({*texts[i * 7].split()} & {*VOCABULARY}) for i in range(30)) / 2
    run = got(found)
    for i in range(30):
        same(run.get(i, []), best(cosine(texts, texts[i * 7], False), None))


def test_queries_keep_their_tasks_where_these_are_as_many_as_shuffle_partitions(spark, corpus, asked):
    cores = max(2, spark.sparkContext.defaultParallelism)
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(cores)
    found = R.cosine(corpus, asked, spark.createDataFrame([(w,) for w in VOCABULARY], "term string"), weighting="tf")
    assert found.rdd.getNumPartitions() == cores
