"""Deterministic samples and splits by hashed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hashed_order(key: str, seed: int) -> F.Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def per_class(df: DataFrame, label: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` rows of each class, the first by hashed order (kept per partition before the shuffle)."""
    w = Window.partitionBy(label).orderBy(hashed_order(key, seed), key)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).drop("r")


def split(df: DataFrame, label: str, key: str, seed: int = 42, shares: tuple[int, int, int] = (70, 15, 15)) -> DataFrame:
    """Column ``part`` (train, valid, test): exact shares of every class, rounded to whole rows, by hashed order.

    A row's rank in its class is the size of the smaller hash buckets of the class plus its rank in its own bucket, so a
    task sorts one of 4,096 buckets and never a class. A null label is a class of its own."""
    at = F.md5(F.concat_ws("-", F.coalesce(F.col(label).cast("string"), F.lit("")), F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("_at", at).withColumn("_b", F.substring("_at", 1, 3)).withColumn("_class", F.coalesce(F.col(label).cast("string"), F.lit("")))
    sizes = rows.groupBy("_class", "_b").agg(F.count("*").alias("_n"))
    by_class = Window.partitionBy("_class")  # at most 4,096 rows a class
    before = sizes.select("_class", "_b", (F.sum("_n").over(by_class.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_class).alias("_all"))
    local = F.row_number().over(Window.partitionBy("_class", "_b").orderBy("_at", key))
    ranked = rows.withColumn("_r", local).join(before, ["_class", "_b"]).withColumn("_r", F.col("_r") + F.col("_before"))
    upto = lambda share: F.floor(F.col("_all") * share / 100 + 0.5)
    part = F.when(F.col("_r") <= upto(shares[0]), "train").when(F.col("_r") <= upto(shares[0] + shares[1]), "valid").otherwise("test")
    return ranked.withColumn("part", part).select(*df.columns, "part")


def histogram(df: DataFrame, value: F.Column, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """(by..., bin, n): bins from 1, 0 below and bins + 1 from ``high`` on."""
    return df.select(*by, F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
