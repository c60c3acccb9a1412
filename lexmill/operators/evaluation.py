"""Ranking metrics over all queries at once: run(qid, rank, doc_id) and relevant(qid, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def judged(run: DataFrame, relevant: DataFrame, depth: int = max(CUTS)) -> DataFrame:
    """The run down to ``depth`` with rel 1 or 0 and the relevant documents met so far."""
    marks = relevant.select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))
    rows = run.where(F.col("rank") <= depth).join(marks, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return rows.withColumn("met", F.sum("rel").over(Window.partitionBy("qid").orderBy("rank")))


def per_query(run: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = CUTS, totals: DataFrame | None = None) -> DataFrame:
    """P, R and NDCG at each cut, AP and RR per query of ``relevant``. Precision divides by the cut even if fewer were
    retrieved; a query without hits scores 0 everywhere; AP divides by all relevant documents. With ``totals`` (qid, n) the
    queries and their numbers of relevant documents are those, and ``relevant`` need only have the retrieved ones: the
    relevant sets, however large, are never laid out."""
    sums = [F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= k), 1).otherwise(0)).alias(f"h{k}") for k in cuts]
    gains = [F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"g{k}") for k in cuts]
    ap = F.sum(F.when(F.col("rel") == 1, F.col("met") / F.col("rank")).otherwise(0.0)).alias("ap_sum")
    first = F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first")
    got = judged(run, relevant, max(cuts)).groupBy("qid").agg(*sums, *gains, ap, first)
    total = relevant.select("qid", "doc_id").distinct().groupBy("qid").agg(F.count("*").alias("n")) if totals is None else totals.select("qid", "n")
    rows = total.join(got, "qid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [F.col("qid")]
    for k in cuts:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [(zero(f"h{k}") / k).alias(f"p_{k}"), (zero(f"h{k}") / F.col("n")).alias(f"r_{k}"), (zero(f"g{k}") / ideal).alias(f"ndcg_{k}")]
    return rows.select(*out, (zero("ap_sum") / F.col("n")).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def evaluate(run: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = CUTS, totals: DataFrame | None = None) -> DataFrame:
    """One row: the means over queries, as p_k, r_k, ndcg_k, map and mrr."""
    each = per_query(run, relevant, cuts, totals)
    names = [f"{m}_{k}" for k in cuts for m in ("p", "r", "ndcg")]
    return each.agg(*[F.round(F.avg(c), 6).alias(c) for c in names], F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("rr"), 6).alias("mrr"))


def bootstrap(per_query_values: DataFrame, value: str, *, rounds: int = 200, seed: int = 1) -> DataFrame:
    """Mean with a 95 % interval from ``rounds`` Poisson bootstrap samples, in one pass: every row draws its weight in each
    sample from its own hash."""
    u = lambda i: F.pmod(F.xxhash64("qid", i, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    # Poisson(1) by its cumulative probabilities
    weight = lambda i: sum(F.when(u(i) >= p, 1).otherwise(0) for p in (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406))
    each = per_query_values.select("qid", F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("i"))
    means = each.groupBy("i").agg(F.try_divide(F.sum(weight(F.col("i")) * F.col("v")), F.sum(weight(F.col("i")))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
