"""Problem 1: near-duplicate records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .setjoin import CAP, class_table, compare, expand, incidence, membership, product, settled


def news_rows(news: DataFrame) -> DataFrame:
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("text"))
    return news.where(F.col("text").rlike(r"(?U)\S")).select(F.col("rec_id").alias("key"), F.lit(0).alias("side"), F.lit(0).alias("salt"), text.alias("text"))


def class_pairs(rows: DataFrame, threshold: float, k: int, min_words: int, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(incidence rows, verified class pairs) of rows(key, side, salt, text)."""
    inc = incidence(rows, k=k, min_words=min_words, short=short)
    return inc, compare(product(inc, threshold), inc, threshold)


def near_duplicate_pairs(rows: DataFrame, *, threshold: float = 0.5, k: int = 3, min_words: int = 20, cap: int | None = CAP) -> DataFrame:
    """All pairs (rec_a < rec_b) whose sets of k-word sequences overlap by ``threshold`` or more, exact copies among
    them. Classes of more than ``cap`` copies are listed by pairs with their least record, with ``cap`` None by all pairs
    (see ``setjoin.expand``); ``classes`` has the members either way. Null, blank and short texts have no pair; an empty
    table gives no row; ``key`` must be unique."""
    inc, pairs = class_pairs(rows, threshold, k, min_words)
    return expand(settled(pairs), inc, within=True, cap=cap)


def classes(rows: DataFrame, *, threshold: float = 0.5, k: int = 3, min_words: int = 20) -> DataFrame:
    """(rec_id, class_id, copies, links) of the records of ``near_duplicate_pairs``: the class of exact copies (by their
    sequences), its size, and the number of other classes it is linked with."""
    inc, pairs = class_pairs(rows, threshold, k, min_words)
    return membership(inc, settled(pairs))


def near_duplicate_groups(rows: DataFrame, *, threshold: float = 0.8, k: int = 5, min_words: int = 5, rounds: int = 40, short: bool = False) -> DataFrame:
    """One row per record of ``min_words`` words or more, with ``short`` per record with text: key, group_id (least key of
    its connected group) and n_links (class links plus copies). Near copies need ``min_words`` words at white space; a text
    with fewer (often one in a script without spaces) is grouped with those of the same words only. Groups are found by passing the least label along links and halving label paths; links and labels stay in
    tables of the shared folder."""
    inc, found = class_pairs(rows, threshold, k, min_words, short)
    pairs = settled(found)
    links = materialize(pairs.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).unionAll(pairs.select("rep_b", "rep_a")), "links")
    labels = links.select("u").distinct().select("u", F.col("u").alias("g"))
    spread = old = None
    for _ in range(rounds):
        near = links.join(labels.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("h"))
        low = labels.join(near, "u").select("u", F.least("g", "h").alias("g"), F.col("g").alias("was"))
        jump = low.select(F.col("u").alias("g"), F.col("g").alias("g2"))
        new = materialize(low.join(jump, "g", "left").select("u", F.coalesce("g2", "g").alias("g"), "was"), "labels")
        if old is not None:
            discard(old)
        old = new
        labels, spread = new.select("u", "g"), new.where("g <> was").limit(1).count()
        if not spread:
            break
    if spread:
        raise RuntimeError(f"groups not settled after {rounds} rounds")
    degree = links.groupBy("u").agg(F.count("*").alias("d"))
    classes = class_table(inc).select("cls", "rep", "cnt")
    known = classes.join(labels.withColumnRenamed("u", "rep"), "rep", "left").join(degree.withColumnRenamed("u", "rep"), "rep", "left")
    return inc.select("cls", "key").join(known, "cls").select("key", F.coalesce("g", "rep").alias("group_id"), (F.coalesce("d", F.lit(0)) + F.col("cnt") - 1).alias("n_links"))
