"""Plans of the index, ranked retrieval, evidence and ranking metrics. ``bm25_topk``, ``cosine_tfidf``, ``hybrid_topk``,
``hybrid_semantic``, ``rerank_lexical``, ``search_hits`` and ``search_consensus`` take all queries, the other searches those whose
number is divisible by 20; all are against all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import classify as K
from lexmill.operators import evaluation as E
from lexmill.operators import index as I
from lexmill.operators import pipeline as P
from lexmill.operators import retrieval as R
from lexmill.operators import verify as V
from lexmill.sources import writers
from lexmill.tables import table

from . import sql


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("qid", F.col("query_text").alias("text"))


def twentieth(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).where("qid % 20 = 0")


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocabulario").select(F.lower(F.trim("term")).alias("term")).where(F.length("term") > 0).distinct()


def postings(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(I.analysed(corpus(spark, d)))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.term_stats(I.analysed(corpus(spark, d)))


def vocab_bands(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return I.banded(I.document_frequency(I.analysed(docs, stop=False)), I.collection_size(docs))


def band_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = vocab_bands(spark, d).groupBy("band").agg(F.count("*").alias("terms"))
    total = vocab_bands(spark, d).agg(F.count("*").alias("n")).scalar()
    return rows.withColumn("percent", F.round(100.0 * F.col("terms") / total, 6))


def vocabulary_index(spark: SparkSession, d: str) -> DataFrame:
    """Kept terms with their places in alphabetical order."""
    return I.vocabulary(vocab_bands(spark, d).where("band = 'kept'").select("term"))


def tf_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Counts over the reduced vocabulary."""
    return I.matching(I.analysed(corpus(spark, d), stop=False), vocab(spark, d)).select("doc_id", "term", "tf")


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    post = tf_matrix(spark, d)
    weights = I.idf(post.groupBy("term").agg(F.count("*").alias("df")), I.collection_size(docs))
    return I.tfidf(post, weights).withColumn("weight", F.round("weight", 6))


def matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the dense count matrix over the reduced vocabulary in alphabetical order, of documents with a term."""
    return writers.matrix_lines(tf_matrix(spark, d), I.vocabulary(vocab(spark, d)))


def cosine_tf(spark: SparkSession, d: str) -> DataFrame:
    """Every pair above 0 over the reduced vocabulary, ranked."""
    return R.cosine(corpus(spark, d), twentieth(spark, d), vocab(spark, d), weighting="tf")


def cosine_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return R.cosine(corpus(spark, d), asked(spark, d), vocab(spark, d), k=10)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(corpus(spark, d), asked(spark, d))


def tfidf_sublinear_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.tfidf(corpus(spark, d), twentieth(spark, d))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return R.dense(v.select(F.col("vec_id").alias("doc_id"), "embedding"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid_topk(corpus(spark, d), asked(spark, d))


def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_reranked(corpus(spark, d), asked(spark, d))


def search_hits(spark: SparkSession, d: str) -> DataFrame:
    return R.hits(bm25_topk(spark, d), table(spark, d, "documents"), small=R.few_rows(asked(spark, d), 10))


def run_lines(spark: SparkSession, d: str) -> DataFrame:
    """The run as lines of a run file."""
    return R.bm25(corpus(spark, d), twentieth(spark, d)).select("qid", "rank", writers.run_line().alias("line"))


def evidence_sentences(spark: SparkSession, d: str) -> DataFrame:
    ev, q, n = table(spark, d, "evidence"), table(spark, d, "queries"), table(spark, d, "news")
    rows = ev.select("evid_id", "qid", "rec_id").join(q.select("qid", "query_text"), "qid").join(n.where("text is not null").select("rec_id", "text"), "rec_id")
    return rows.select("evid_id", V.evidence_sentences(F.col("query_text"), F.col("text")).alias("evidence"))


def verify_claims(spark: SparkSession, d: str) -> DataFrame:
    out = V.verify(table(spark, d, "evidence"), "qid")
    return out.withColumn("nei", F.round("nei", 6))


def explain_claims(spark: SparkSession, d: str) -> DataFrame:
    return V.explain(table(spark, d, "evidence"), "qid", "evid_id")


def evidence_consensus(spark: SparkSession, d: str) -> DataFrame:
    return V.consensus(table(spark, d, "evidence"), "qid").withColumn("support_share", F.round("support_share", 6)).withColumn("refute_share", F.round("refute_share", 6))


def ensemble_verdict(spark: SparkSession, d: str) -> DataFrame:
    out = V.decision(table(spark, d, "evidence"))
    return out.select("evid_id", F.round("combined", 6).alias("combined"), "decision", F.round("confidence", 6).alias("confidence"))


def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per query: decisions FAKE and REAL, mean confidence."""
    rows = V.decision(table(spark, d, "evidence")).groupBy("qid")
    return rows.agg(F.sum(F.when(F.col("decision") == "FAKE", 1).otherwise(0)).alias("fake"), F.sum(F.when(F.col("decision") == "REAL", 1).otherwise(0)).alias("real"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def score_softmax(spark: SparkSession, d: str) -> DataFrame:
    """The three probabilities as logits: softmax, argmax, clip."""
    p = F.array("p_supports", "p_refutes", "p_nei")
    rows = table(spark, d, "evidence").where("p_supports is not null and p_refutes is not null and p_nei is not null").select("evid_id", T.softmax(p).alias("s"))
    best = F.element_at(F.array(F.lit("SUPPORTS"), F.lit("REFUTES"), F.lit("NEI")), F.array_position("s", F.array_max("s")).cast("int"))
    return rows.select("evid_id", *[F.round(F.col("s")[i], 6).alias(c) for i, c in enumerate(("s", "r", "n"))], best.alias("best"), F.least(F.floor(F.abs(F.col("s")[0] - 0.5) * 200), F.lit(100)).cast("int").alias("bar"))


def classified(spark: SparkSession, d: str) -> Callable[[DataFrame], DataFrame]:
    """Naive Bayes of the news records, as a function of (doc_id, text)."""
    weights, prior = K.nb_weights(table(spark, d, "news"))
    return lambda texts: K.nb_probabilities(texts, weights, prior)


def nb_document_scores(spark: SparkSession, d: str) -> DataFrame:
    """P(real) of every document by the news records' naive Bayes."""
    return classified(spark, d)(corpus(spark, d)).select("doc_id", F.round("prob_real", 6).alias("prob_real"))


def _searched(spark: SparkSession, d: str, queries: DataFrame) -> DataFrame:
    return P.search_and_verify(table(spark, d, "documents").select("doc_id", "title", "text"), queries, k=5, classifier=classified(spark, d))


def search_and_verify(spark: SparkSession, d: str) -> DataFrame:
    """Search, rerank, class probability, evidence, verdict of every hit."""
    rounded = [F.round(c, 6).alias(c) for c in ("prob_real", "supports", "refutes", "combined", "confidence")]
    return _searched(spark, d, twentieth(spark, d)).select("qid", "rank", "doc_id", "title", "snippet", "score", "evidence", "verdict", "decision", *rounded)


def search_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Verdict counts of a query's hits, and their percentages: whole ones, the neutral one what is left to 100."""
    out = V.consensus(_searched(spark, d, asked(spark, d)).withColumnRenamed("verdict", "fever_verdict"), "qid")
    percent = lambda c: F.floor(100 * F.col(c)).cast("int")
    out = out.select("qid", "supports", "refutes", "nei", "total", "dominant", percent("support_share").alias("percent_s"), percent("refute_share").alias("percent_r"))
    return out.withColumn("percent_n", 100 - F.col("percent_s") - F.col("percent_r"))


def _run(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved records by query, best score first."""
    ev = table(spark, d, "evidence").where("qid is not null and rec_id is not null and score is not null").groupBy("qid", "rec_id").agg(F.max("score").alias("score"))
    return R.ranked(ev.select("qid", F.col("rec_id").alias("doc_id"), "score"), None)


def _relevant(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(qid, doc_id) of the retrieved records that have the query's subject, and (qid, n): all records of that subject."""
    q = table(spark, d, "queries").where("relevant_subject is not null").select("qid", F.lower(F.trim("relevant_subject")).alias("s"))
    n = table(spark, d, "news").where("subject is not null").select(F.col("rec_id").alias("doc_id"), F.lower(F.trim("subject")).alias("s"))
    ev = table(spark, d, "evidence").where("qid is not null and rec_id is not null").select("qid", F.col("rec_id").alias("doc_id")).distinct()
    return ev.join(q, "qid").join(n, ["doc_id", "s"]).select("qid", "doc_id"), q.join(n.groupBy("s").agg(F.count("*").alias("n")), "s").select("qid", "n")


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    relevant, totals = _relevant(spark, d)
    return E.evaluate(_run(spark, d), relevant, totals=totals)


def ir_metrics_by_query(spark: SparkSession, d: str) -> DataFrame:
    relevant, totals = _relevant(spark, d)
    out = E.per_query(_run(spark, d), relevant, totals=totals)
    return out.select("qid", *[F.round(c, 6).alias(c) for c in out.columns if c != "qid"])


def _subject_queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(corpus (doc_id, text, s), queries (qid, text, n)): the titles of the three first records of every subject of ten
    records or more, with the size of the subject."""
    news = table(spark, d, "news").where("text is not null and subject is not null").select(F.col("rec_id").alias("doc_id"), "title", "text", F.lower(F.trim("subject")).alias("s"))
    sizes = news.groupBy("s").agg(F.count("*").alias("n")).where("n >= 10")
    titled = news.where("title is not null").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("doc_id"))).where("r <= 3")
    return news.select("doc_id", "text", "s"), titled.join(sizes, "s").select(F.col("doc_id").alias("qid"), F.col("title").alias("text"), "s", "n")


def _evaluated(model: str) -> Callable[[SparkSession, str], DataFrame]:
    def plan(spark: SparkSession, d: str) -> DataFrame:
        docs, q = _subject_queries(spark, d)
        run = R.retriever(model)(docs.select("doc_id", "text"), q.select("qid", "text"), k=max(E.CUTS))
        relevant = run.join(q.select("qid", "s"), "qid").join(docs.select("doc_id", "s"), ["doc_id", "s"]).select("qid", "doc_id")
        return E.evaluate(run, relevant, totals=q.select("qid", "n"))

    plan.__name__, plan.__doc__ = f"ir_metrics_{model}", f"Metrics of the {model} retriever over titles as queries, a subject's records being relevant."
    return plan


def metric_interval(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank with a bootstrap interval."""
    relevant, totals = _relevant(spark, d)
    return E.bootstrap(E.per_query(_run(spark, d), relevant, totals=totals), "rr")


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.semantic(corpus(spark, d), twentieth(spark, d))


def hybrid_semantic(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid_search(corpus(spark, d), asked(spark, d))


def _first_queries(spark: SparkSession, d: str) -> DataFrame:
    """(qid, s) of at most three queries a subject."""
    q = table(spark, d, "queries").where("relevant_subject is not null").select("qid", F.lower(F.trim("relevant_subject")).alias("s"))
    return q.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("qid"))).where("r <= 3").drop("r")


def subject_relevant(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id): the relevant records of ``subject_truth``'s queries."""
    n = table(spark, d, "news").where("subject is not null").select(F.col("rec_id").alias("doc_id"), F.lower(F.trim("subject")).alias("s"))
    large = n.groupBy("s").agg(F.count("*").alias("relevant")).where("relevant >= 10").select("s")
    return n.join(_first_queries(spark, d).join(large, "s"), "s").select("qid", "doc_id")


def subject_truth(spark: SparkSession, d: str) -> DataFrame:
    """Relevant records by subject for at most three queries a subject, of subjects with ten records or more (sizes only)."""
    n = table(spark, d, "news").where("subject is not null").select("rec_id", F.lower(F.trim("subject")).alias("s"))
    sizes = n.groupBy("s").agg(F.count("*").alias("relevant")).where("relevant >= 10")
    return _first_queries(spark, d).join(sizes, "s").select("qid", F.col("s").alias("subject"), "relevant")


QUERIES = {
    f.__name__: f
    for f in (
        postings, term_stats, vocab_bands, band_shares, vocabulary_index, tf_matrix, matrix_rows, tfidf_weights, cosine_tf, cosine_tfidf, bm25_topk, tfidf_sublinear_topk, dense_topk, hybrid_topk, rerank_lexical, search_hits,
        run_lines, evidence_sentences, verify_claims, explain_claims, evidence_consensus, ensemble_verdict, verdict_summary, score_softmax, search_and_verify, search_consensus, ir_metrics, ir_metrics_by_query, subject_truth, subject_relevant,
        nb_document_scores, semantic_topk, hybrid_semantic, metric_interval, *map(_evaluated, ("bm25", "tfidf", "semantic", "hybrid")),
    )
}

_VOCAB = "(SELECT DISTINCT lower(trim(term)) AS term FROM vocabulario WHERE length(trim(term)) > 0)"
_DOCS, _ASKED = "(SELECT doc_id, text FROM documents)", "(SELECT qid, query_text AS text FROM queries WHERE qid % 20 = 0)"
_ALL = "(SELECT qid, query_text AS text FROM queries)"
_POST = f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.index_words('text')}) AS term FROM documents) GROUP BY ALL)"
_POST_ALL = f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.words('text')}) AS term FROM documents) GROUP BY ALL)"
_Q_ALL = f"(SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({sql.words('query_text')}) AS term FROM queries WHERE qid % 20 = 0) GROUP BY ALL)"
_Q_WHOLE = _Q_ALL.replace(" WHERE qid % 20 = 0", "")
_N = "(SELECT count(*) FROM documents)"
_BANDS = f"""(SELECT term, df, CASE WHEN df < 2 THEN 'low' WHEN df > floor(CAST(0.8 AS DOUBLE) * {_N}) THEN 'high' ELSE 'kept' END AS band FROM (SELECT term, count(*) AS df FROM {_POST_ALL} GROUP BY term))"""


def _ranked(scores: str, k: int | None) -> str:
    cut = f" WHERE rank <= {k}" if k else ""
    return f"SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM (SELECT qid, doc_id, round(score, 6) AS score FROM ({scores}))){cut}"


def _bm25(k: int, docs: str = _DOCS, asked: str = _ASKED) -> str:
    post = f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.index_words('text')}) AS term FROM {docs}) GROUP BY ALL)"
    wanted = f"(SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({sql.index_words('text')}) AS term FROM {asked}) GROUP BY ALL)"
    return _ranked(
        f"""
        WITH post AS {post}, lens AS (SELECT doc_id, len({sql.index_words('text')}) AS dl FROM {docs}), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
        df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post CROSS JOIN n GROUP BY term, n), fl AS (SELECT avg(raw) * 0.25 AS f FROM df),
        idf AS (SELECT term, CASE WHEN raw < 0 THEN f ELSE raw END AS idf FROM df CROSS JOIN fl)
        SELECT qid, p.doc_id, sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM {wanted} q JOIN post p USING (term) JOIN idf USING (term) JOIN lens l ON l.doc_id = p.doc_id CROSS JOIN n GROUP BY qid, p.doc_id""",
        k,
    )


def _tfidf(k: int, docs: str = _DOCS, queries: str = _ASKED) -> str:
    n = f"(SELECT count(*) FROM {docs})"

    def grams(text: str, key: str, source: str) -> str:
        return f"""(SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
            FROM (SELECT {key}, {sql.index_words(text)} AS t FROM {source})) GROUP BY ALL)"""

    return _ranked(
        f"""
        WITH post AS {grams('text', 'doc_id', docs)}, asked AS {grams('text', 'qid', queries)},
        stats AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM post GROUP BY term),
        vocab AS (SELECT term, ln((1.0 + {n}) / (1 + df)) + 1 AS idf FROM stats WHERE df >= 2 AND df <= CAST(0.95 AS DOUBLE) * {n} ORDER BY tf DESC, term LIMIT 50000),
        dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM post JOIN vocab USING (term)), qw AS (SELECT qid, term, (1 + ln(tf)) * idf AS w FROM asked JOIN vocab USING (term)),
        dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id), qn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qw GROUP BY qid),
        dots AS (SELECT qid, doc_id, sum(q.w * d.w) AS dot FROM qw q JOIN dw d USING (term) GROUP BY ALL)
        SELECT qid, doc_id, dot / (dn.n * qn.n) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (qid)""",
        k,
    )


def _cosine(weighted: bool, k: int | None, wanted: str = _Q_ALL) -> str:
    idf = f"(SELECT term, {'ln(CAST(' + _N + ' AS DOUBLE) / count(*))' if weighted else '1.0'} AS idf FROM post GROUP BY term)"
    return _ranked(
        f"""
        WITH post AS (SELECT * FROM {_POST_ALL} JOIN {_VOCAB} USING (term)), idf AS {idf},
        dw AS (SELECT doc_id, term, tf * idf AS w FROM post JOIN idf USING (term)), qw AS (SELECT qid, term, qtf * idf AS w FROM {wanted} JOIN idf USING (term)),
        qall AS (SELECT qid, sqrt(sum(qtf * qtf)) AS n FROM {wanted} JOIN {_VOCAB} USING (term) GROUP BY qid),
        dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY doc_id), qn AS ({'SELECT qid, sqrt(sum(w * w)) AS n FROM qw GROUP BY qid' if weighted else 'SELECT * FROM qall'}),
        dots AS (SELECT qid, doc_id, sum(q.w * d.w) AS dot FROM qw q JOIN dw d USING (term) GROUP BY ALL)
        SELECT qid, doc_id, dot / (dn.n * qn.n) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (qid) WHERE dn.n > 0 AND qn.n > 0 AND dot > 0""",
        k,
    )


def _scaled(run: str) -> str:
    return f"SELECT qid, doc_id, CASE WHEN hi - lo < 1e-9 THEN 0.0 ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM ({run}))"


_VERDICT = "CASE WHEN supports >= 0.6 AND supports >= refutes THEN 'SUPPORTS' WHEN refutes >= 0.6 THEN 'REFUTES' ELSE 'NEI' END"
_DECISION = """(SELECT *, CASE WHEN coalesce(combined, prob_real) >= 0.5 THEN 'REAL' WHEN coalesce(combined, prob_real) IS NOT NULL THEN 'FAKE' END AS decision, abs(coalesce(combined, prob_real) - 0.5) AS confidence FROM (
  SELECT evid_id, qid, prob_real, CASE WHEN fever_verdict IS NULL THEN prob_real ELSE least(greatest(prob_real + 0.35 * CASE fever_verdict WHEN 'SUPPORTS' THEN coalesce(p_supports, 0) WHEN 'REFUTES' THEN -coalesce(p_refutes, 0) ELSE 0 END, 0.0), 1.0) END AS combined0,
    CASE WHEN prob_real IS NULL THEN CASE WHEN fever_verdict IS NULL THEN NULL ELSE 0.0 END ELSE combined0 END AS combined FROM evidence))"""
_RUN = _ranked("SELECT qid, rec_id AS doc_id, max(score) AS score FROM evidence WHERE qid IS NOT NULL AND rec_id IS NOT NULL AND score IS NOT NULL GROUP BY ALL", None)
_REL = """SELECT DISTINCT e.qid, e.rec_id AS doc_id FROM evidence e JOIN queries q ON q.qid = e.qid JOIN news n ON n.rec_id = e.rec_id AND lower(trim(n.subject)) = lower(trim(q.relevant_subject))"""
_CUT = lambda k: f"""coalesce(CAST(sum(CASE WHEN rel = 1 AND rank <= {k} THEN 1 ELSE 0 END) AS DOUBLE), 0) / {k} AS p_{k}, coalesce(CAST(sum(CASE WHEN rel = 1 AND rank <= {k} THEN 1 ELSE 0 END) AS DOUBLE), 0) / n AS r_{k},
  coalesce(sum(CASE WHEN rel = 1 AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END), 0) / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}"""  # noqa: E731
_TOT = "SELECT qid, n FROM queries JOIN (SELECT lower(trim(subject)) AS s, count(*) AS n FROM news WHERE subject IS NOT NULL GROUP BY 1) ON s = lower(trim(relevant_subject))"


def _per_query(run: str, rel: str, tot: str) -> str:
    return f"""
  WITH run AS ({run}), rel AS ({rel}), tot AS ({tot}),
  jud AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS met FROM (SELECT run.*, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM run LEFT JOIN rel USING (qid, doc_id) WHERE rank <= 10))
  SELECT tot.qid, {", ".join(_CUT(k) for k in E.CUTS)}, coalesce(sum(CASE WHEN rel = 1 THEN met / rank ELSE 0 END), 0) / n AS ap, coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0) AS rr
  FROM tot LEFT JOIN jud USING (qid) GROUP BY tot.qid, n"""


_SUBJECTS = "(SELECT rec_id AS doc_id, title, text, lower(trim(subject)) AS s FROM news WHERE text IS NOT NULL AND subject IS NOT NULL)"
_TITLES = f"""(SELECT doc_id AS qid, title AS text, t.s, n FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS r FROM {_SUBJECTS} WHERE title IS NOT NULL) t
  JOIN (SELECT s, count(*) AS n FROM {_SUBJECTS} GROUP BY s HAVING count(*) >= 10) USING (s) WHERE r <= 3)"""
_METRICS = [f"{m}_{k}" for k in E.CUTS for m in ("p", "r", "ndcg")]


def _evaluated_sql(run: str) -> str:
    rel = f"SELECT q.qid, d.doc_id FROM {_TITLES} q JOIN {_SUBJECTS} d ON q.s = d.s"
    return f"SELECT {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)}, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM ({_per_query(run, rel, f'SELECT qid, n FROM {_TITLES}')})"


_NB = f"""(WITH tok AS (SELECT label, unnest({sql.index_words('text')}) AS term FROM news WHERE label IN (0, 1) AND text IS NOT NULL),
  cnt AS (SELECT term, count_if(label = 0) AS n0, count_if(label = 1) AS n1 FROM tok GROUP BY term), all_of AS (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM cnt)
  SELECT term, ln((n1 + CAST(0.3 AS DOUBLE)) / (t1 + CAST(0.3 AS DOUBLE) * v)) - ln((n0 + CAST(0.3 AS DOUBLE)) / (t0 + CAST(0.3 AS DOUBLE) * v)) AS w FROM cnt, all_of)"""
_PROB = f"""(SELECT d.doc_id, 1 / (1 + exp(-(coalesce(s, 0) + (SELECT ln(count_if(label = 1)) - ln(count_if(label = 0)) FROM news WHERE text IS NOT NULL)))) AS prob_real
  FROM documents d LEFT JOIN (SELECT doc_id, sum(tf * w) AS s FROM {_POST} JOIN {_NB} USING (term) GROUP BY doc_id) USING (doc_id))"""


def _search(k: int, asked: str = _ASKED) -> str:
    claim, words = "q.query_text", sql.overlap_words("coalesce(q.query_text, '')")
    pool = _bm25(100, asked=asked)
    rer = _ranked(f"SELECT p.qid, p.doc_id, CASE WHEN len({words}) = 0 THEN 0.0 ELSE len(list_intersect({words}, {sql.overlap_words('coalesce(d.text, chr(32))')})) / CAST(len({words}) AS DOUBLE) END AS score FROM ({pool}) p JOIN queries q USING (qid) JOIN documents d ON d.doc_id = p.doc_id", k)
    ev = sql.overlap_words("evidence")
    no = "regexp_matches(lower({0}), '" + P.NEGATION + "')"
    return f"""
      WITH r AS ({rer}), a AS (SELECT r.*, coalesce({claim}, '') AS claim, substring(coalesce(d.title, ''), 1, 120) AS title, coalesce(d.text, '') AS text, {words} AS w, {sql.sentences("coalesce(d.text, '')")} AS s FROM r JOIN queries q USING (qid) JOIN documents d ON d.doc_id = r.doc_id),
      b AS (SELECT *, list_sort(list_transform(range(1, len(s) + 1), lambda i: {{'o': -len(list_intersect(w, {sql.overlap_words('s[i]')})), 'i': i}})) AS o FROM a),
      c AS (SELECT *, substring(CASE WHEN len(s) = 0 THEN text WHEN len(s) <= 3 THEN array_to_string(s, ' ') WHEN len(w) = 0 THEN array_to_string(s[1:3], ' ') ELSE array_to_string(list_transform(o[1:3], lambda x: s[x.i]), ' ') END, 1, 700) AS evidence FROM b),
      e AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_intersect(w, {ev})) / CAST(len(w) AS DOUBLE) END AS share, {no.format("claim")} <> {no.format("evidence")} AS apart, prob_real FROM c JOIN {_PROB} USING (doc_id)),
      f AS (SELECT *, CASE WHEN apart THEN 0.0 ELSE share END AS supports, CASE WHEN apart THEN share ELSE 0.0 END AS refutes FROM e),
      g AS (SELECT *, {_VERDICT} AS verdict FROM f),
      h AS (SELECT *, least(greatest(prob_real + 0.35 * CASE verdict WHEN 'SUPPORTS' THEN supports WHEN 'REFUTES' THEN -refutes ELSE 0 END, 0.0), 1.0) AS combined FROM g)
      SELECT qid, rank, doc_id, title, trim(substring(text, 1, 240)) || '…' AS snippet, score, evidence, round(prob_real, 6) AS prob_real, round(supports, 6) AS supports, round(refutes, 6) AS refutes, verdict, round(combined, 6) AS combined,
        CASE WHEN combined >= 0.5 THEN 'REAL' ELSE 'FAKE' END AS decision, round(abs(combined - 0.5), 6) AS confidence FROM h"""


ORACLE = {
    "postings": f"SELECT * FROM {_POST}",
    "term_stats": f"SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM {_POST} GROUP BY term",
    "vocab_bands": f"SELECT * FROM {_BANDS}",
    "band_shares": f"SELECT band, count(*) AS terms, round(100.0 * count(*) / (SELECT count(*) FROM {_BANDS}), 6) AS percent FROM {_BANDS} GROUP BY band",
    "vocabulary_index": f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM {_BANDS} WHERE band = 'kept'",
    "tf_matrix": f"SELECT doc_id, term, tf FROM {_POST_ALL} JOIN {_VOCAB} USING (term)",
    "matrix_rows": f"""WITH v AS (SELECT term FROM {_VOCAB}), post AS (SELECT * FROM {_POST_ALL} JOIN {_VOCAB} USING (term)), docs AS (SELECT DISTINCT doc_id FROM post)
      SELECT doc_id, string_agg(CAST(coalesce(tf, 0) AS VARCHAR), ' ' ORDER BY v.term) AS line FROM docs CROSS JOIN v LEFT JOIN post USING (doc_id, term) GROUP BY doc_id""",
    "tfidf_weights": f"WITH post AS (SELECT * FROM {_POST_ALL} JOIN {_VOCAB} USING (term)) SELECT doc_id, term, round(tf * ln(CAST({_N} AS DOUBLE) / count(*) OVER (PARTITION BY term)), 6) AS weight FROM post",
    "cosine_tf": _cosine(False, None),
    "cosine_tfidf": _cosine(True, 10, _Q_WHOLE),
    "bm25_topk": _bm25(10, asked=_ALL),
    "tfidf_sublinear_topk": _tfidf(10),
    "dense_topk": _ranked("SELECT q.vec_id AS qid, e.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0", 10),
    "hybrid_topk": _ranked(f"SELECT qid, doc_id, sum(score) AS score FROM (SELECT qid, doc_id, 0.5 * score AS score FROM ({_scaled(_bm25(50, asked=_ALL))}) UNION ALL SELECT qid, doc_id, 0.5 * score FROM ({_scaled(_tfidf(50, queries=_ALL))})) GROUP BY ALL", 10),
    "rerank_lexical": _ranked(
        f"SELECT p.qid, p.doc_id, CASE WHEN len({sql.overlap_words('q.query_text')}) = 0 THEN 0.0 ELSE len(list_intersect({sql.overlap_words('q.query_text')}, {sql.overlap_words('coalesce(d.text, chr(32))')})) / CAST(len({sql.overlap_words('q.query_text')}) AS DOUBLE) END AS score FROM ({_bm25(100, asked=_ALL)}) p JOIN queries q USING (qid) JOIN documents d ON d.doc_id = p.doc_id", 10
    ),
    "search_hits": f"SELECT qid, rank, doc_id, substring(coalesce(title, ''), 1, 120) AS title, trim(substring(coalesce(text, ''), 1, 240)) || '…' AS snippet, score FROM ({_bm25(10, asked=_ALL)}) JOIN documents USING (doc_id)",
    "run_lines": f"SELECT qid, rank, printf('%03d %d %.4f', qid, doc_id, score + 1e-8) AS line FROM ({_bm25(10)})",
    "evidence_sentences": f"""
      WITH a AS (SELECT evid_id, n.text, {sql.overlap_words("coalesce(query_text, '')")} AS w, {sql.sentences('n.text')} AS s FROM evidence e JOIN queries USING (qid) JOIN news n USING (rec_id) WHERE n.text IS NOT NULL),
      b AS (SELECT *, list_sort(list_transform(range(1, len(s) + 1), lambda i: {{'o': -len(list_intersect(w, {sql.overlap_words('s[i]')})), 'i': i}})) AS o FROM a)
      SELECT evid_id, substring(CASE WHEN len(s) = 0 THEN text WHEN len(s) <= 3 THEN array_to_string(s, ' ') WHEN len(w) = 0 THEN array_to_string(s[1:3], ' ') ELSE array_to_string(list_transform(o[1:3], lambda x: s[x.i]), ' ') END, 1, 700) AS evidence FROM b""",
    "verify_claims": f"SELECT *, {_VERDICT} AS verdict FROM (SELECT qid, coalesce(max(p_supports), 0.0) AS supports, coalesce(max(p_refutes), 0.0) AS refutes, round(coalesce(avg(p_nei), 1.0), 6) AS nei, count(*) AS n_evidence FROM evidence GROUP BY qid)",
    "explain_claims": "SELECT qid, CAST(r AS INT) AS rank, evid_id, strength, substring(evidence_sentence, 1, 300) AS passage FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY strength DESC, evid_id) AS r FROM (SELECT *, greatest(p_supports, p_refutes) AS strength FROM evidence) WHERE strength IS NOT NULL) WHERE r <= 3",
    "evidence_consensus": """SELECT qid, s AS supports, r AS refutes, n AS nei, s + r + n AS total, CASE WHEN s + r + n = 0 THEN 0.0 ELSE round(CAST(s AS DOUBLE) / (s + r + n), 6) END AS support_share, CASE WHEN s + r + n = 0 THEN 0.0 ELSE round(CAST(r AS DOUBLE) / (s + r + n), 6) END AS refute_share,
      CASE WHEN s + r + n = 0 THEN 'NEI' WHEN s >= r AND s >= n THEN 'SUPPORTS' WHEN r >= n THEN 'REFUTES' ELSE 'NEI' END AS dominant
      FROM (SELECT qid, coalesce(count_if(fever_verdict = 'SUPPORTS'), 0)::BIGINT AS s, coalesce(count_if(fever_verdict = 'REFUTES'), 0)::BIGINT AS r, coalesce(count_if(fever_verdict = 'NEI'), 0)::BIGINT AS n FROM evidence GROUP BY qid)""",
    "ensemble_verdict": f"SELECT evid_id, round(combined, 6) AS combined, decision, round(confidence, 6) AS confidence FROM {_DECISION}",
    "verdict_summary": f"SELECT qid, count_if(decision = 'FAKE')::BIGINT AS fake, count_if(decision = 'REAL')::BIGINT AS real, round(avg(confidence), 6) AS mean_confidence FROM {_DECISION} GROUP BY qid",
    "score_softmax": """
      WITH a AS (SELECT evid_id, exp(p_supports - greatest(p_supports, p_refutes, p_nei)) AS a, exp(p_refutes - greatest(p_supports, p_refutes, p_nei)) AS b, exp(p_nei - greatest(p_supports, p_refutes, p_nei)) AS c FROM evidence WHERE p_supports IS NOT NULL AND p_refutes IS NOT NULL AND p_nei IS NOT NULL),
      p AS (SELECT evid_id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM a)
      SELECT evid_id, round(a, 6) AS s, round(b, 6) AS r, round(c, 6) AS n, CASE WHEN a >= b AND a >= c THEN 'SUPPORTS' WHEN b >= c THEN 'REFUTES' ELSE 'NEI' END AS best, CAST(least(floor(abs(a - 0.5) * 200), 100) AS INT) AS bar FROM p""",
    "search_and_verify": _search(5),
    "search_consensus": f"""SELECT qid, s AS supports, r AS refutes, n AS nei, s + r + n AS total, CAST(floor(100 * (s / CAST(s + r + n AS DOUBLE))) AS INT) AS percent_s, CAST(floor(100 * (r / CAST(s + r + n AS DOUBLE))) AS INT) AS percent_r,
      CAST(100 - floor(100 * (s / CAST(s + r + n AS DOUBLE))) - floor(100 * (r / CAST(s + r + n AS DOUBLE))) AS INT) AS percent_n, CASE WHEN s >= r AND s >= n THEN 'SUPPORTS' WHEN r >= n THEN 'REFUTES' ELSE 'NEI' END AS dominant
      FROM (SELECT qid, count_if(verdict = 'SUPPORTS')::BIGINT AS s, count_if(verdict = 'REFUTES')::BIGINT AS r, count_if(verdict = 'NEI')::BIGINT AS n FROM ({_search(5, _ALL)}) GROUP BY qid)""",
    "ir_metrics": f"SELECT {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)}, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM ({_per_query(_RUN, _REL, _TOT)})",
    "ir_metrics_by_query": f"SELECT qid, {', '.join(f'round({m}, 6) AS {m}' for m in [*_METRICS, 'ap', 'rr'])} FROM ({_per_query(_RUN, _REL, _TOT)})",
    "nb_document_scores": f"SELECT doc_id, round(prob_real, 6) AS prob_real FROM {_PROB}",
    "ir_metrics_bm25": _evaluated_sql(_bm25(10, _SUBJECTS, _TITLES)),
    "ir_metrics_tfidf": _evaluated_sql(_tfidf(10, _SUBJECTS, _TITLES)),
    "subject_relevant": """
      WITH n AS (SELECT rec_id AS doc_id, lower(trim(subject)) AS s FROM news WHERE subject IS NOT NULL), big AS (SELECT s FROM n GROUP BY s HAVING count(*) >= 10),
      q AS (SELECT qid, lower(trim(relevant_subject)) AS s, row_number() OVER (PARTITION BY lower(trim(relevant_subject)) ORDER BY qid) AS r FROM queries WHERE relevant_subject IS NOT NULL)
      SELECT qid, doc_id FROM q JOIN big USING (s) JOIN n USING (s) WHERE r <= 3""",
    "subject_truth": """
      WITH s AS (SELECT lower(trim(subject)) AS s, count(*) AS relevant FROM news WHERE subject IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
      q AS (SELECT qid, lower(trim(relevant_subject)) AS s, row_number() OVER (PARTITION BY lower(trim(relevant_subject)) ORDER BY qid) AS r FROM queries WHERE relevant_subject IS NOT NULL)
      SELECT qid, q.s AS subject, relevant FROM q JOIN s USING (s) WHERE r <= 3""",
}
