"""Evidence sentences, verdicts, consensus and the ensemble probability, as plans over scored evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def evidence_sentences(claim: Column, text: Column, *, n: int = 3, max_chars: int = 700) -> Column:
    """The n sentences that share most words with the claim (first ones on ties), joined and cut to max_chars. No sentence:
    the text's start; n or fewer: all; a claim without words: the first n."""
    sents, words = T.sentences(text), T.overlap_words(F.coalesce(claim, F.lit("")))
    scored = F.transform(sents, lambda s, i: F.struct((-F.size(F.array_intersect(words, T.overlap_words(s)))).alias("o"), i.alias("i"), s.alias("s")))
    top = F.transform(F.slice(F.array_sort(scored), 1, n), lambda x: x["s"])
    chosen = F.when(F.size(sents) <= n, sents).when(F.size(words) == 0, F.slice(sents, 1, n)).otherwise(top)
    return F.substring(F.when(F.size(sents) == 0, text).otherwise(F.array_join(chosen, " ")), 1, max_chars)


def verdict(support: Column, refute: Column, threshold: float = 0.6) -> Column:
    return F.when((support >= threshold) & (support >= refute), "SUPPORTS").when(refute >= threshold, "REFUTES").otherwise("NEI")


def verify(evidence: DataFrame, *keys: str, threshold: float = 0.6) -> DataFrame:
    """Per key the largest support and refutation, the mean neutral share and the verdict. Null probabilities don't count;
    a key with none at all is NEI with 0, 0, 1."""
    agg = evidence.groupBy(*keys).agg(F.coalesce(F.max("p_supports"), F.lit(0.0)).alias("supports"), F.coalesce(F.max("p_refutes"), F.lit(0.0)).alias("refutes"), F.coalesce(F.avg("p_nei"), F.lit(1.0)).alias("nei"), F.count("*").alias("n_evidence"))
    return agg.withColumn("verdict", verdict(F.col("supports"), F.col("refutes"), threshold))


def explain(evidence: DataFrame, key: str, order: str, *, k: int = 3, chars: int = 300) -> DataFrame:
    """Per key the k passages that say most either way."""
    strength = F.greatest("p_supports", "p_refutes")
    rows = evidence.where(strength.isNotNull()).withColumn("strength", strength)
    top = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("strength").desc(), order))).where(F.col("rank") <= k)
    return top.select(key, "rank", order, "strength", F.substring("evidence_sentence", 1, chars).alias("passage"))


def ensemble(prob: Column, verdict_col: Column, supports: Column, refutes: Column, weight: float = 0.35) -> Column:
    """The class probability moved by the evidence's signal and kept in [0, 1]; without a verdict it stays."""
    signal = F.when(verdict_col == "SUPPORTS", F.coalesce(supports, F.lit(0.0))).when(verdict_col == "REFUTES", -F.coalesce(refutes, F.lit(0.0))).otherwise(0.0)
    return F.when(verdict_col.isNull(), prob).otherwise(T.clip(prob + weight * signal))


def decision(evidence: DataFrame) -> DataFrame:
    """evidence with combined probability, REAL or FAKE, and confidence (distance from one half)."""
    combined = ensemble(F.col("prob_real"), F.col("fever_verdict"), F.col("p_supports"), F.col("p_refutes"))
    score = F.coalesce(combined, F.col("prob_real"))
    return evidence.withColumn("combined", combined).withColumn("decision", F.when(score >= 0.5, "REAL").when(score.isNotNull(), "FAKE")).withColumn("confidence", F.abs(score - 0.5))


def consensus(evidence: DataFrame, key: str) -> DataFrame:
    """Verdict counts, shares and the dominant one per key; SUPPORTS before REFUTES before NEI on ties."""
    count = lambda v: F.sum(F.when(F.col("fever_verdict") == v, 1).otherwise(0))
    agg = evidence.groupBy(key).agg(count("SUPPORTS").alias("supports"), count("REFUTES").alias("refutes"), count("NEI").alias("nei"))
    total = F.col("supports") + F.col("refutes") + F.col("nei")
    dominant = F.when(total == 0, "NEI").when((F.col("supports") >= F.col("refutes")) & (F.col("supports") >= F.col("nei")), "SUPPORTS").when(F.col("refutes") >= F.col("nei"), "REFUTES").otherwise("NEI")
    share = lambda c: F.when(total == 0, 0.0).otherwise(F.col(c) / total)
    return agg.select(key, "supports", "refutes", "nei", total.alias("total"), share("supports").alias("support_share"), share("refutes").alias("refute_share"), dominant.alias("dominant"))
