"""Search, verification and evaluation as one lazy plan, and a stored index with a fingerprint of its corpus."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import classify as K
from lexmill.operators import evaluation as E
from lexmill.operators import index as I
from lexmill.operators import retrieval as R
from lexmill.operators import verify as V

# Words that deny.
NEGATION = "(^|[^a-z])(no|not|never|nobody|none|neither|without|isn.t|wasn.t)([^a-z]|$)"


def lexical_stance(claim: Column, evidence: Column) -> tuple[Column, Column]:
    """Stand-in for an inference model: (support, refutation) from the share of the claim's words in the evidence, which
    counts as refutation where one of the two denies and the other doesn't."""
    share = R.lexical_score(claim, evidence)
    apart = F.lower(claim).rlike(NEGATION) != F.lower(evidence).rlike(NEGATION)
    return F.when(apart, 0.0).otherwise(share), F.when(apart, share).otherwise(0.0)


def search_and_verify(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    pool: int = 100,
    model: str = "bm25",
    reranker: Callable[[Column, Column], Column] | None = R.lexical_score,
    stance: Callable[[Column, Column], tuple[Column, Column]] = lexical_stance,
    classifier: Callable[[DataFrame], DataFrame] | None = None,
    probabilities: DataFrame | None = None,
    candidates: DataFrame | None = None,
    threshold: float = 0.6,
) -> DataFrame:
    """All hits of corpus(doc_id, title, text) for queries(qid, text): qid, rank, doc_id, title, snippet, score, prob_real,
    evidence, supports, refutes, verdict, combined, decision, confidence. ``classifier`` gives (doc_id, prob_real) for a
    frame (doc_id, text) and is asked for the hits only; ``probabilities`` (doc_id, prob_real) are ready ones; without
    either, and for documents they don't know, a document counts one half. ``candidates`` (a run, for instance of a stored
    index) take the place of the search. Any Pandas UDF fits as reranker or stance."""
    texts = corpus.select("doc_id", "text")
    depth = max(pool, k) if reranker else k
    if candidates is None and model == "bm25" and reranker is R.lexical_score:
        run = R.bm25_reranked(texts, queries, k=k, depth=depth)
    else:
        found = candidates if candidates is not None else R.retriever(model)(texts, queries, k=depth)
        run = R.rerank(found, texts, queries, k=k, depth=depth, scorer=reranker) if reranker else found.where(F.col("rank") <= k)
    few, ids = R.few_rows(queries, k), R.few_ids(queries, k)
    rows = run.join(I.hinted(queries.select("qid", F.coalesce("text", F.lit("")).alias("claim")), I.is_small(queries.select("qid"))), "qid")
    docs = corpus.select("doc_id", F.substring(F.coalesce("title", F.lit("")), 1, 120).alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    rows = R.fetched(rows, docs, small=few, ids=ids)
    if classifier is not None:
        probabilities = classifier(R.cut(texts, run, ids=ids))
    if probabilities is not None:
        known = probabilities.select("doc_id", "prob_real")
        rows = rows.join(F.broadcast(known) if few and classifier is not None else known, "doc_id", "left").withColumn("prob_real", F.coalesce("prob_real", F.lit(0.5)))
    else:
        rows = rows.withColumn("prob_real", F.lit(0.5))
    rows = rows.withColumn("snippet", T.snippet(F.col("body"))).withColumn("evidence", V.evidence_sentences(F.col("claim"), F.col("body")))
    supports, refutes = stance(F.col("claim"), F.col("evidence"))
    rows = rows.withColumn("supports", supports).withColumn("refutes", refutes).withColumn("verdict", V.verdict(F.col("supports"), F.col("refutes"), threshold))
    rows = rows.withColumn("combined", V.ensemble(F.col("prob_real"), F.col("verdict"), F.col("supports"), F.col("refutes")))
    decided = rows.withColumn("decision", F.when(F.col("combined") >= 0.5, "REAL").when(F.col("combined").isNotNull(), "FAKE")).withColumn("confidence", F.abs(F.col("combined") - 0.5))
    return decided.select("qid", "rank", "doc_id", "title", "snippet", "score", "prob_real", "evidence", "supports", "refutes", "verdict", "combined", "decision", "confidence")


def evaluate_models(corpus: DataFrame, queries: DataFrame, relevant: DataFrame, models: list[str], totals: DataFrame | None = None) -> DataFrame:
    """One row of metrics per retriever, as (model, metrics...)."""
    out = None
    for name in models:
        row = E.evaluate(R.retriever(name)(corpus, queries, k=max(E.CUTS)), relevant, totals=totals).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no model named")
    return out.select("model", *[c for c in out.columns if c != "model"])


def fingerprint(corpus: DataFrame) -> str:
    """A hash of all (doc_id, text), whatever their order."""
    row = corpus.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("doc_id", "text")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    return f"{row['n']}-{row['x'] & (1 << 64) - 1:x}-{row['s']:x}"


@dataclass
class StoredIndex:
    """Postings bucketed by a hash of the term (directories), lengths and statistics of one corpus."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame


def _stored(corpus: DataFrame, path: str, refit: bool, write: Callable[[str], None]) -> None:
    """Calls ``write(path)`` unless what is there was made from this very corpus."""
    spark: SparkSession = corpus.sparkSession
    mark = fingerprint(corpus)
    try:
        same = spark.read.text(f"{path}/fingerprint").first()[0] == mark
    except Exception:  # absent or unreadable: made anew
        same = False
    if refit or not same:
        write(path)
        spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fingerprint")


def stored_vectors(corpus: DataFrame, path: str, *, refit: bool = False, encoder=R.hashed_vectors) -> DataFrame:
    """(doc_id, embedding) at ``path`` if made from this very corpus, else encoded and written there; for ``R.dense``."""
    _stored(corpus, path, refit, lambda p: R.encoded(corpus, "doc_id", encoder).write.mode("overwrite").parquet(f"{p}/vectors"))
    return corpus.sparkSession.read.parquet(f"{path}/vectors")


def stored_tfidf(corpus: DataFrame, path: str, *, refit: bool = False, parts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(vocabulary with idf, unit-length weights (doc_id, term, w)) of ``R.tfidf``'s index, stored the same way."""

    def write(p: str) -> None:
        vocab, post = R.tfidf_index(corpus)
        vocab.write.mode("overwrite").parquet(f"{p}/vocabulary")
        kept = corpus.sparkSession.read.parquet(f"{p}/vocabulary")
        R.tfidf_index(corpus, vocabulary=kept)[1].withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{p}/weights")

    _stored(corpus, path, refit, write)
    read = corpus.sparkSession.read.parquet
    return read(f"{path}/vocabulary"), read(f"{path}/weights").drop("part")


def search_tfidf(index: tuple[DataFrame, DataFrame], queries: DataFrame, *, k: int = 10) -> DataFrame:
    """Top-k over a stored tf-idf index; the same result as ``retrieval.tfidf`` on its corpus."""
    return R.tfidf_search(*index, queries, k=k)


def stored_index(corpus: DataFrame, path: str, *, refit: bool = False, parts: int = 16) -> StoredIndex:
    """The index at ``path`` if it was made from this very corpus, else a new one written there."""
    spark: SparkSession = corpus.sparkSession

    def write(path: str) -> None:
        tokens = I.analysed(corpus)
        post = I.postings(tokens).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
        post.repartition(parts, "part").sortWithinPartitions("part", "term", "doc_id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        tokens.select("doc_id", F.size("tokens").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
        spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/stats")

    _stored(corpus, path, refit, write)
    return StoredIndex(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "lengths", "stats")))


def search_index(index: StoredIndex, queries: DataFrame, *, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 over a stored index; the same result as ``retrieval.bm25`` on its corpus."""
    n = index.lengths.agg(F.count("*")).scalar()
    avgdl = index.lengths.agg(F.avg("dl")).scalar()
    raw = index.stats.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg(F.avg("raw") * 0.25).scalar()
    terms = R.query_terms(queries)
    few = I.is_small(terms)
    asked = terms.join(raw.select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")), "term")
    post = index.postings.join(I.hinted(asked, few), "term").join(index.lengths, "doc_id")
    part = F.col("qtf") * F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return R.ranked(post.groupBy("qid", "doc_id").agg(F.sum(part).alias("score")), k)


def fit_retriever(name: str, corpus: DataFrame, path: str | None = None, *, refit: bool = False) -> Callable[..., DataFrame]:
    """A function (queries, k) -> run of the named retriever over corpus(doc_id, text). With ``path`` its index is the one
    kept there, if made from this very corpus, else made anew; all queries of a frame are searched at once."""
    if path is None or name not in R.RETRIEVERS:
        search = R.retriever(name)
        return lambda queries, k=10: search(corpus, queries, k=k)
    if name == "bm25":
        index = stored_index(corpus, f"{path}/bm25", refit=refit)
        return lambda queries, k=10: search_index(index, queries, k=k)
    if name == "tfidf":
        kept = stored_tfidf(corpus, f"{path}/tfidf", refit=refit)
        return lambda queries, k=10: search_tfidf(kept, queries, k=k)
    vectors = stored_vectors(corpus, f"{path}/vectors", refit=refit)
    near = lambda queries, k=10: R.dense(vectors, R.encoded(queries, "qid"), k=k)
    if name == "semantic":
        return near
    words = fit_retriever("bm25", corpus, path, refit=refit)
    return lambda queries, k=10: R.hybrid(words(queries, R.pool_size(k)), near(queries, R.pool_size(k)), k=k)


class Searcher:
    """A corpus (doc_id, title, text) with a retriever, a classifier and a history of its searches."""

    def __init__(self, corpus: DataFrame, *, model: str = "bm25", index: str | None = None, refit: bool = False, labelled: DataFrame | None = None, classifier: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """``labelled`` (text, label) trains a naive Bayes classifier; ``classifier`` is one ready (see
        ``search_and_verify``)."""
        self.corpus, self.model = corpus, model
        self.find = fit_retriever(model, corpus.select("doc_id", "text"), index, refit=refit)
        if classifier is None and labelled is not None:
            weights, prior = K.nb_weights(labelled)
            classifier = lambda texts: K.nb_probabilities(texts, weights, prior)
        self.classifier = classifier
        self.history: list[dict] = []

    def search(self, queries: DataFrame, *, k: int = 10, pool: int = 100, **options) -> DataFrame:
        """``search_and_verify`` with this searcher's index and classifier."""
        depth = max(pool, k) if options.get("reranker", R.lexical_score) else k
        self.history.append({"model": self.model, "k": k, "options": sorted(options)})
        return search_and_verify(self.corpus, queries, k=k, pool=pool, model=self.model, candidates=self.find(queries, depth), classifier=self.classifier, **options)


def warm_up(corpus: DataFrame, path: str, *, labelled: DataFrame | None = None, models: tuple[str, ...] = ("bm25", "tfidf", "semantic"), refit: bool = False) -> list[tuple[str, float]]:
    """Makes the indexes at ``path`` and runs a search over each; (step, seconds)."""
    spark, took = corpus.sparkSession, []
    asked = spark.createDataFrame([(1, "warm up")], "qid int, text string")
    for model in models:
        began = time.perf_counter()
        Searcher(corpus, model=model, index=path, refit=refit, labelled=labelled).search(asked, k=1).count()
        took.append((model, round(time.perf_counter() - began, 2)))
    return took
