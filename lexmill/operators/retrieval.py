"""Ranked retrieval. Every retriever takes a corpus (doc_id, text) and queries (qid, text) and gives (qid, rank, doc_id,
score), ties by doc_id, by ``blocks``: no table of (query, document) pairs is made. Ids of documents are keys."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import blocks as B
from lexmill.operators import index as I
from lexmill.operators.blocks import best_rows  # noqa: F401
from lexmill.shared import discard, materialize

DIGITS = 6
DIMENSIONS = 128
ID_ROWS = 1_000_000  # ids of documents that may be broadcast


def ranked(scores: DataFrame, k: int | None) -> DataFrame:
    """(qid, rank, doc_id, score) from (qid, doc_id, score); scores are rounded first so that ties are ties."""
    rounded = scores.withColumn("score", F.round("score", DIGITS))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    out = rounded.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k else out).select("qid", "rank", "doc_id", "score")


def query_terms(queries: DataFrame, *, stop: bool = True) -> DataFrame:
    """(qid, term, qtf)."""
    tokens = I.analysed(queries.select(F.col("qid").alias("doc_id"), "text"), stop=stop)
    return I.postings(tokens).select(F.col("doc_id").alias("qid"), "term", F.col("tf").alias("qtf"))


def _coded(asked: DataFrame, terms: list[tuple[str, float]], weight: Column, *, norm: bool = True) -> DataFrame:
    """(qid, terms, weights, qn) of asked(qid, term, qtf) for ``blocks.searched``; the terms as their places in ``terms``."""
    known = asked.sparkSession.createDataFrame([(t, i, w) for i, (t, w) in enumerate(terms)], "term string, code int, idf double")
    rows = asked.join(I.hinted(known, len(terms) <= I.BROADCAST_ROWS), "term").select("qid", "code", weight.alias("qw"))
    qn = F.sqrt(F.sum(F.col("qw") * F.col("qw"))) if norm else F.lit(1.0)
    each = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("code", "qw"))).alias("t"), qn.alias("qn"))
    return each.select("qid", F.col("t.code").alias("terms"), F.col("t.qw").alias("weights"), "qn").where("qn > 0")


def _first(asked: DataFrame, weights: DataFrame) -> tuple[list[tuple[str, float]], int]:
    """The rows of weights(term, idf), those with asked terms first, and how many these are."""
    wanted = {r[0] for r in asked.select("term").distinct().collect()}
    rows = sorted(((r[0], r[1]) for r in weights.collect()), key=lambda r: (r[0] not in wanted, r[0]))
    return rows, sum(t in wanted for t, _ in rows)


def cosine(corpus: DataFrame, queries: DataFrame, vocabulary: DataFrame, *, weighting: str = "tf_idf", k: int | None = None) -> DataFrame:
    """Cosine over a fixed vocabulary (term): raw counts (``tf``) or counts times ln(n / df) of the documents. Pairs with
    no common term, vectors of length 0, and queries without an id give no row. The vocabulary goes to every task."""
    tokens, vocab = I.analysed(corpus, stop=False), vocabulary.select("term").where("term is not null").distinct()
    if weighting == "tf_idf":
        weights = I.idf(B.counted(tokens).join(I.hinted(vocab, I.is_small(vocab)), "term"), F.lit(corpus.count())).select("term", "idf")
    else:
        weights = vocab.select("term", F.lit(1.0).alias("idf"))
    asked = query_terms(queries.where("qid is not null"), stop=False)
    terms, n = _first(asked, weights)
    blocks = B.postings(tokens, terms, n, weight="tf")
    return B.searched(blocks, _coded(asked, terms[:n], F.col("qtf") * F.col("idf")), k, B.add_postings(True), documents=corpus.count() if k is None else 0)


def bm25(corpus: DataFrame, queries: DataFrame, *, k: int | None = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi BM25; a term in more than half of the documents has an idf below 0, which becomes a quarter of the mean idf of
    all terms. Repeated query words count repeatedly. Documents with no query term give no row."""
    blocks, asked, add, decode = _bm25(corpus, queries, k1=k1, b=b)
    return B.searched(blocks, asked, k, add, decode, documents=corpus.count() if k is None else 0)


def _bm25(corpus: DataFrame, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75) -> tuple:
    """(blocks, queries, add, decode) of ``bm25`` for ``blocks``."""
    tokens, n = I.analysed(corpus), corpus.count()
    stats = materialize(B.counted(tokens), "counts")
    raw = stats.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    words, mean = raw.agg(F.sum("tf"), F.avg("raw")).first()
    asked = query_terms(queries)
    wanted = asked.select("term").distinct()
    weights = raw.join(I.hinted(wanted, I.is_small(wanted)), "term").select("term", F.when(F.col("raw") < 0, F.lit(0.25 * (mean or 0.0))).otherwise(F.col("raw")).alias("idf"))
    terms, n_asked = _first(asked, weights)
    discard(stats)
    blocks = B.postings(tokens, terms, n_asked, weight="bm25", norm=False, k1=k1, b=b, avgdl=(words or 0) / max(n, 1) or 1.0)
    return blocks, _coded(asked, terms, F.col("qtf") * F.col("idf"), norm=False), B.add_postings(False), B.Postings


def _weight(tf: str) -> Column:
    return (1 + F.log(F.col(tf))) * F.col("idf")


def tfidf_vocabulary(corpus: DataFrame, *, min_df: int = 2, max_df: float = 0.95, max_features: int = 50_000) -> DataFrame:
    """(term, idf) of ``tfidf_index``."""
    n = corpus.count()
    stats = B.counted(I.analysed(corpus), pairs=True).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return stats.orderBy(F.col("tf").desc(), "term").limit(max_features).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_index(corpus: DataFrame, *, min_df: int = 2, max_df: float = 0.95, max_features: int = 50_000, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary (term, idf), weights (doc_id, term, w) scaled to unit length) of words and word pairs: weight
    (1 + ln tf)(ln((1 + n) / (1 + df)) + 1). The vocabulary, unless given, has the terms with min_df <= df <= max_df n, at
    most max_features of them by collection count."""
    tokens = I.grams(I.analysed(corpus))
    if vocabulary is None:
        vocabulary = tfidf_vocabulary(corpus, min_df=min_df, max_df=max_df, max_features=max_features)
    each = tokens.select("doc_id", F.explode("tokens").alias("term")).join(F.broadcast(vocabulary), "term")  # max_features rows
    post = each.groupBy("doc_id", "term", "idf").agg(F.count("*").alias("tf")).withColumn("w", _weight("tf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return vocabulary, post.select("doc_id", "term", "w", norm.alias("dn"))


def tfidf_search(vocabulary: DataFrame, weights: DataFrame, queries: DataFrame, *, k: int | None = 10) -> DataFrame:
    """Top-k by the dot products of the queries' unit vectors with ``weights``."""
    q = I.grams(I.analysed(queries.select(F.col("qid").alias("doc_id"), "text")))
    asked = I.postings(q).join(F.broadcast(vocabulary), "term").select(F.col("doc_id").alias("qid"), "term", _weight("tf").alias("qw"))
    few = I.is_small(queries.select("qid"))
    qnorms = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = asked.join(weights, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"), F.first("dn").alias("dn"))
    scored = dots.join(I.hinted(qnorms, few), "qid")
    return ranked(scored.select("qid", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score")), k)


def tfidf(corpus: DataFrame, queries: DataFrame, *, k: int | None = 10, **index: float) -> DataFrame:
    """Cosine of sublinear tf-idf over words and word pairs (``tfidf_index``). Documents that share no term of the
    vocabulary with a query, and queries without an id, give no row."""
    blocks, asked, add, decode = _tfidf(corpus, queries, **index)
    return B.searched(blocks, asked, k, add, decode, documents=corpus.count() if k is None else 0)


def _tfidf(corpus: DataFrame, queries: DataFrame, **index: float) -> tuple:
    """(blocks, queries, add, decode) of ``tfidf`` for ``blocks``."""
    queries = queries.where("qid is not null")
    asked = I.postings(I.grams(I.analysed(queries.select(F.col("qid").alias("doc_id"), "text")))).select(F.col("doc_id").alias("qid"), "term", F.col("tf").alias("qtf"))
    terms, n = _first(asked, tfidf_vocabulary(corpus, **index))
    blocks = B.postings(I.analysed(corpus), terms, n, weight="log", pairs=True)
    return blocks, _coded(asked, terms[:n], _weight("qtf")), B.add_postings(True), B.Postings


def dense(vectors: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """Cosine top-k of (qid, embedding) against (doc_id, embedding), as matrix products of a task's queries with one block of
    vectors after the other. Null vectors, and vectors of length 0, give no row."""
    blocks, asked, add, decode = _dense(vectors, queries)
    return B.searched(blocks, asked, k, add, decode)


def _dense(vectors: DataFrame, queries: DataFrame) -> tuple:
    """(blocks, queries, add, decode) of ``dense`` for ``blocks``."""
    blocks = B.vectors(vectors.where("embedding is not null").select(F.col("doc_id").cast("long"), "embedding"))
    return blocks, queries.where("embedding is not null").select("qid", "embedding"), B.add_vectors, B.Vectors


def hashed_vectors(texts: pd.Series) -> pd.Series:
    """Stand-in for a sentence encoder: every word has a vector of signs from its hash, a text the sum of its words'."""
    found = [re.findall(T.WORD, t.lower()) if isinstance(t, str) else [] for t in texts]
    code, words = pd.factorize(np.array([w for ws in found for w in ws] or ["x"], dtype=object))
    signs = np.stack([np.unpackbits(np.frombuffer(hashlib.shake_128(w.encode()).digest(DIMENSIONS // 8), np.uint8)) for w in words]).astype(np.int8) * 2 - 1
    out, at = [], 0
    for ws in found:
        out.append(signs[code[at : at + len(ws)]].sum(0, dtype=np.float32) if ws else np.zeros(DIMENSIONS, np.float32))
        at += len(ws)
    return pd.Series(out)


def encoded(df: DataFrame, key: str, encoder: Callable[[pd.Series], pd.Series] = hashed_vectors) -> DataFrame:
    """(key, embedding) of df[text] by any function of a series of texts."""
    return df.select(key, F.pandas_udf(encoder, "array<float>")(F.coalesce("text", F.lit(""))).alias("embedding"))


def semantic(corpus: DataFrame, queries: DataFrame, *, k: int | None = 10, encoder: Callable[[pd.Series], pd.Series] = hashed_vectors) -> DataFrame:
    """Cosine of encoded texts. Texts without words have a vector of length 0 and give no row."""
    return dense(encoded(corpus, "doc_id", encoder), encoded(queries, "qid", encoder), k=k or 1000)


def min_max(run: DataFrame) -> DataFrame:
    """Scores of each query scaled to [0, 1]; a range under 1e-9 gives zeros."""
    w = Window.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return run.withColumn("score", F.when(high - low < 1e-9, 0.0).otherwise((F.col("score") - low) / (high - low)))


def hybrid(a: DataFrame, b: DataFrame, *, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """alpha a + (1 - alpha) b of two min-max scaled runs, a missing score being 0: a union and one aggregation."""
    parts = min_max(a).select("qid", "doc_id", (F.col("score") * alpha).alias("score")).unionAll(min_max(b).select("qid", "doc_id", (F.col("score") * (1 - alpha)).alias("score")))
    return ranked(parts.groupBy("qid", "doc_id").agg(F.sum("score").alias("score")), k)


def hybrid_topk(corpus: DataFrame, queries: DataFrame, *, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """``hybrid`` of BM25 and tf-idf, each with its pool; no pool leaves the task that makes it."""
    return B.mixed(_bm25(corpus, queries), _tfidf(corpus, queries), alpha=alpha, pool=pool_size(k), k=k)


def pool_size(k: int) -> int:
    return max(5 * k, 50)


def lexical_score(query: Column, text: Column) -> Column:
    """Stand-in for a pair scorer: the share of the query's words that the text has."""
    q = F.array_distinct(T.overlap_words(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, T.overlap_words(text))) / F.size(q))


def few_rows(queries: DataFrame, k: int) -> bool:
    """Whether a run of k rows a query is small enough to be broadcast; only the queries are counted."""
    return I.is_small(queries.select("qid"), max(1, I.BROADCAST_ROWS // max(1, k)))


def few_ids(queries: DataFrame, k: int) -> bool:
    """``few_rows`` for the documents' ids alone."""
    return I.is_small(queries.select("qid"), max(1, ID_ROWS // max(1, k)))


def cut(corpus: DataFrame, run: DataFrame, *, ids: bool) -> DataFrame:
    """The corpus's rows whose document is in the run; with ``ids`` (``few_ids``) no text is shuffled for it."""
    return (I.spread(corpus) if ids else corpus).join(I.hinted(run.select("doc_id").distinct(), ids), "doc_id", "left_semi")


def fetched(run: DataFrame, corpus: DataFrame, *, small: bool, ids: bool = False) -> DataFrame:
    """The run's rows with the corpus's columns. A small run goes to the corpus, whose texts are never shuffled; beyond
    that the corpus is first cut to the run's documents, by a broadcast of their ids if ``ids`` says so (else the planner adds
    a Bloom filter of them where it pays)."""
    if small:
        return I.spread(corpus).join(F.broadcast(run), "doc_id")
    return cut(corpus, run, ids=ids).join(run, "doc_id")


def _word_text(text: Column) -> Column:
    """A text's words between spaces, once a document; what ``lexical_score`` of many queries with it needs."""
    return I.fixed(F.concat(F.lit(" "), F.array_join(T.overlap_words(text), " "), F.lit(" ")))


def _word_share(q: Column, words: Column) -> Column:
    """``lexical_score`` from the query's words and the document's ``_word_text``."""
    found = F.filter(q, lambda w: F.contains(words, F.concat(F.lit(" "), w, F.lit(" "))))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(found) / F.size(q))


def rerank(pool: DataFrame, corpus: DataFrame, queries: DataFrame, *, k: int = 10, depth: int = 100, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """The pool's pairs (at most ``depth`` a query) scored anew by ``scorer(query text, document text)``; the corpus is cut
    to the pool's documents. Any Pandas UDF of two text columns fits as scorer; ``lexical_score`` takes each text apart once."""
    small = few_rows(queries, depth)
    asked, text = F.coalesce("text", F.lit("")), F.coalesce("text", F.lit(""))
    if lexical := scorer is lexical_score:
        asked = I.fixed(T.overlap_words(asked))
    known, late = queries.select("qid", asked.alias("query_text")), lexical and not small and I.is_small(queries.select("qid"))
    pairs = pool.select("qid", "doc_id")
    if not late:
        pairs = pairs.join(I.hinted(known, small), "qid")
    docs = corpus.select("doc_id", "text")
    if lexical:
        docs = cut(docs, pool, ids=small).select("doc_id", _word_text(text).alias("text"))
        full, scorer = docs.join(I.hinted(pairs, small), "doc_id"), _word_share
        if late:  # the pairs are shuffled without the queries' words
            full = full.join(F.broadcast(known), "qid")
    else:
        full = fetched(pairs, docs, small=small)
    return ranked(full.select("qid", "doc_id", scorer(F.col("query_text"), F.coalesce("text", F.lit(""))).alias("score")), k)


def bm25_reranked(corpus: DataFrame, queries: DataFrame, *, k: int = 10, depth: int = 100) -> DataFrame:
    """``rerank`` by ``lexical_score`` of the ``depth`` best of ``bm25``; no pool leaves the task that makes it. Where an id
    stands for more than one query the pool is written and joined to each."""
    if queries.groupBy("qid").count().where("count > 1 and qid is not null").limit(1).count():
        return rerank(bm25(corpus, queries, k=depth), corpus, queries, k=k, depth=depth)
    words = T.overlap_words(F.coalesce("text", F.lit("")))
    asked = queries.where("qid is not null").select("qid", I.fixed(words).alias("words"))
    docs = corpus.select("doc_id", I.fixed(words).alias("words"))
    each = asked.select("qid", F.explode("words").alias("term"))
    known = [r[0] for r in B.counted(docs.select(F.col("words").alias("tokens"))).select("term").join(each.select("term").distinct(), "term", "left_semi").orderBy("term").collect()]
    codes = corpus.sparkSession.createDataFrame(list(zip(known, range(len(known)))), "term string, code int")
    coded = each.join(I.hinted(codes, len(known) <= I.BROADCAST_ROWS), "term", "left").groupBy("qid")
    rows = coded.agg(F.sort_array(F.collect_list("code")).alias("codes"), F.count("*").cast("int").alias("n"))
    return B.reranked(_bm25(corpus, queries), asked.select("qid").join(rows, "qid", "left").select("qid", "codes", F.coalesce("n", F.lit(0)).alias("n")), B.word_blocks(docs, known), pool=depth, k=k)


def hits(run: DataFrame, corpus: DataFrame, *, small: bool = False) -> DataFrame:
    """The run with title (120 characters) and snippet (240 and an ellipsis) of corpus(doc_id, title, text). ``small``:
    whether the run may be broadcast (``few_rows``)."""
    rows = corpus.select("doc_id", F.substring(F.coalesce("title", F.lit("")), 1, 120).alias("title"), T.snippet(F.coalesce("text", F.lit(""))).alias("snippet"))
    return fetched(run, rows, small=small).select("qid", "rank", "doc_id", "title", "snippet", "score")


def hybrid_search(corpus: DataFrame, queries: DataFrame, *, k: int | None = 10, alpha: float = 0.5) -> DataFrame:
    """``hybrid`` of BM25 and ``semantic``, each with its pool."""
    k = k or 10
    return B.mixed(_bm25(corpus, queries), _dense(encoded(corpus, "doc_id"), encoded(queries, "qid")), alpha=alpha, pool=pool_size(k), k=k)


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {"bm25": bm25, "tfidf": tfidf, "semantic": semantic, "hybrid": hybrid_search}


def retriever(name: str) -> Callable[..., DataFrame]:
    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name!r}: {', '.join(sorted(RETRIEVERS))}")
    return RETRIEVERS[name]
