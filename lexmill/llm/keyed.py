"""Exact quotas by random key without sorting or collecting a whole cell: a histogram of key buckets per cell finds the
bucket in which the quota ends, a second one of that bucket's rows finds the place within it, and only what is left (one
row in about BUCKETS squared) is ranked. Both histograms stay tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 10
BUCKETS = 1 << BITS


def random_key(column: str, seed: int) -> Column:
    return F.xxhash64(F.col(column).cast("string"), F.lit(seed))


def bucket(key: Column, level: int = 0) -> Column:
    """The key's place among BUCKETS even ranges of its values, or at the next level of its bucket's."""
    return F.shiftrightunsigned(key, 64 - BITS * (level + 1)).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _ends(rows: DataFrame, quotas: DataFrame, level: int) -> DataFrame:
    """(cell, last, few): rows of buckets below ``last`` are all taken, ``few`` of bucket ``last``; a cell that its quota
    takes whole has no row beyond its buckets."""
    sizes = rows.groupBy("cell", bucket(F.col("key"), level).alias("b")).agg(F.count("*").alias("here"))
    order = Window.partitionBy("cell").orderBy("b")  # at most BUCKETS rows a cell
    run = sizes.withColumn("sofar", F.sum("here").over(order)).join(quotas, "cell")
    ends = run.where(F.col("sofar") >= F.col("quota")).groupBy("cell").agg(F.min_by(F.struct("b", (F.col("quota") - F.col("sofar") + F.col("here")).alias("few")), "b").alias("e"))
    return quotas.join(ends, "cell", "left").select("cell", F.coalesce("e.b", F.lit(BUCKETS)).alias("last"), F.coalesce("e.few", F.lit(0)).cast("long").alias("few"))


def take(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Of rows(cell, key, rec_id, ...) those with the smallest keys of each cell, as many as quotas(cell, quota) says or
    all there are. ``quotas`` has one row a cell of the stated target table, which is why it may be broadcast."""
    small = F.broadcast(quotas)
    first = rows.join(F.broadcast(_ends(rows, small, 0)), "cell").withColumn("b", bucket(F.col("key")))
    whole, part = first.where("b < last").drop("b", "last", "few"), first.where("b = last and few > 0").drop("b", "last")
    rest = part.select("cell", F.col("few").alias("quota")).distinct()
    inner = part.drop("few")
    second = inner.join(F.broadcast(_ends(inner, rest, 1)), "cell").withColumn("b", bucket(F.col("key"), 1))
    order = Window.partitionBy("cell").orderBy("key", "rec_id")
    ranked = second.where("b = last and few > 0").withColumn("r", F.row_number().over(order)).where("r <= few")
    return whole.unionByName(second.where("b < last").drop("b", "last", "few")).unionByName(ranked.drop("b", "last", "few", "r"))
