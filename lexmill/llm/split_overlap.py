"""Problem 5: records of evaluation splits that also stand in the training split, by a partitioned suffix array.

The texts of both splits are one concatenation of words. Its suffixes that begin at the rarest places of a record (enough
of them for no pair at the threshold to be missed, see ``setjoin``) are partitioned by their first three words, and each
part is sorted as a suffix array: by the words from there on, refined by prefix doubling down to the text's end. Going
outwards from each suffix, neighbours of the other split are taken as long as the common prefix, which is the least of
the neighbouring ones between, has three words; adjacent ones alone would miss a record that stands in train twice. Each
gives a shared span. The spans of a train and an evaluation text are merged into the covered words of the latter, and
the coverage decides which pairs are compared on the whole texts, which gives the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setjoin import CAP, LEVEL, SUFFIX_ENTRY, SUFFIX_ROW, WIDTH, by_block, column_counts, compare, expand, gather, incidence, matrix_size, membership, need, postings, runs, settled

SALTS = {"news": 0, "liar": 0x5DEECE66D}


def _side() -> F.Column:
    name = F.lower(F.trim("split"))
    return F.when(name == "train", 0).when(name.isin("valid", "test"), 1)


def split_rows(df: DataFrame, text: str, salt: int) -> DataFrame:
    """Rows for the join: train is side 0, valid and test side 1; records of no known split or null text drop out."""
    out = df.select(F.col("rec_id").alias("key"), _side().alias("side"), F.lit(salt).alias("salt"), F.col(text).alias("text"))
    return out.where(F.col("side").isNotNull() & F.col("text").isNotNull())


SPANS = "ca long, cb long, at int, words int, need int"


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers."""
    out = (x == 0).astype(np.int64)
    for shift in range(8, 64, 8):
        out += (x >> np.uint64(shift)) == 0
    return out


def neighbours(g: np.ndarray, levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, equal levels of their common prefix) for suffixes in order, by distance in the array: first the adjacent
    ones, then those one further, as long as the first three words are the same. The common prefix of two suffixes is
    the least of the adjacent ones between them."""
    after = runs(g)
    near = np.r_[equal_bytes(levels[1:] ^ levels[:-1]), 0] if len(g) else np.empty(0, np.int64)
    live = np.flatnonzero(after > 0)
    least, step = near[live], 1
    while len(live):
        yield live, live + step, least
        step += 1
        on = after[live] >= step
        live = live[on]
        least = np.minimum(least[on], near[live + step - 1])


def _suffix_spans(threshold: float):
    def spans(held: list[bytes]) -> Iterator[tuple]:
        g, doc, (rank, half, place, levels), (cls, n, side, length) = gather(held, SUFFIX_ENTRY, SUFFIX_ROW)
        order = np.lexsort((doc, levels, g))
        g, doc, rank, half, place, levels = (x[order] for x in (g, doc, rank, half, place, levels))
        size, who, part = n[doc].astype(np.int64), cls[doc], side[doc]
        left, rest = size - rank, length[doc].astype(np.int64) - place
        out, held_n = [], 0
        for a, b, equal in neighbours(g, levels):
            ok = (part[a] != part[b]) & ((half[a] != half[b]) | (half[a] == 0))
            a, b, equal = a[ok], b[ok], equal[ok]
            least = need(size[a], size[b], threshold)
            ok = np.minimum(left[a], left[b]) >= least - (LEVEL - 1)
            a, b, equal, least = a[ok], b[ok], equal[ok], least[ok]
            if not len(a):
                continue
            swap = part[a] > part[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            shared = np.minimum(np.minimum(rest[a], rest[b]), np.where(equal == 8, 1 << 40, 1 << equal))
            out.append((who[a], who[b], place[b].astype(np.int32), (shared + 2).astype(np.int32), least.astype(np.int32)))
            held_n += len(a)
            if held_n >= 500_000:
                yield tuple(np.concatenate(x) for x in zip(*out))
                out, held_n = [], 0
        if out:
            yield tuple(np.concatenate(x) for x in zip(*out))

    return by_block(spans, ["ca", "cb", "at", "words", "need"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()])


def shared_spans(inc: DataFrame, threshold: float) -> DataFrame:
    """SPANS (ca train class, cb evaluation class): at least ``words`` words from word ``at`` of cb stand in ca."""
    entries = matrix_size(inc)
    blocks = postings(inc, column_counts(inc, entries), threshold, entries, ordered=True)
    return blocks.mapInArrow(_suffix_spans(threshold), SPANS)


def coverage(spans: DataFrame) -> DataFrame:
    """(ca, cb, need, covered): the spans of a pair merged, as the number of three-word places of cb in them."""
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered")),
        lambda m, s: F.struct(F.greatest(m["end"], s["at"] + s["words"] - 2).alias("end"), (m["covered"] + F.greatest(F.lit(0), s["at"] + s["words"] - 2 - F.greatest(m["end"], s["at"]))).alias("covered")),
    )
    each = spans.groupBy("ca", "cb", "at").agg(F.max("words").alias("words"), F.max("need").alias("need"))
    # a record's own places bound the spans of a pair
    listed = each.groupBy("ca", "cb").agg(F.collect_list(F.struct("at", "words")).alias("spans"), F.max("need").alias("need"))
    return listed.select("ca", "cb", "need", merged["covered"].alias("covered"))


def cross_split_pairs(rows: DataFrame, *, threshold: float = 0.5, k: int = 3, min_words: int = 10) -> tuple[DataFrame, DataFrame]:
    """(incidence rows, verified pairs of a train class and an evaluation class with similarity and coverage). Two texts at
    the threshold share LEVEL of their rarest places (or all they must), so their spans cover as many at least."""
    inc = incidence(rows, k=k, min_words=min_words, ordered=True, name="sequences")
    pairs = coverage(shared_spans(inc, threshold)).where(F.col("covered") >= F.least(F.lit(LEVEL), F.col("need"))).select("ca", "cb")
    return inc, compare(pairs, inc, threshold, k=k)


def both_tables(news: DataFrame, liar: DataFrame) -> DataFrame:
    return split_rows(news, "text", SALTS["news"]).unionAll(split_rows(liar, "statement", SALTS["liar"]))


def overlaps(news: DataFrame, liar: DataFrame, *, cap: int | None = CAP) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: one record in train, the other of the same table in valid or test, overlap 0.5 or
    more. Null texts and texts under ten words have no pair; labels don't matter; empty tables give no row. Classes of
    more than ``cap`` copies are listed by pairs with the other class's least key, with ``cap`` None by all pairs
    (``setjoin.expand``); ``classes`` has the members either way."""
    inc, pairs = cross_split_pairs(both_tables(news, liar))
    return expand(settled(pairs), inc, within=False, cap=cap)


def classes(news: DataFrame, liar: DataFrame) -> DataFrame:
    """(rec_id, class_id, copies, links) of the records of ``overlaps``; records of one split side, table and set of
    sequences are a class, linked with the classes of the other side it overlaps with."""
    inc, pairs = cross_split_pairs(both_tables(news, liar))
    return membership(inc, settled(pairs))


def overlapping(news: DataFrame, liar: DataFrame) -> DataFrame:
    """One row per record of valid or test that overlaps with train: rec_id, split, source, label, the labels of all train
    records it overlaps with (train_0, train_1, train_null: how many have each, every copy counted), verdict (``other`` if
    any of them differs from label, else ``same`` if any equals it, else ``missing``), the highest similarity and the
    share of its words in spans shared with the train record that covers most."""
    inc, found = cross_split_pairs(both_tables(news, liar))
    pairs = settled(found)
    facts = news.select("rec_id", "label", "split", "source").unionAll(liar.select("rec_id", "label", "split", "source"))
    labels = [F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("label") == 0, F.col("label") == 1, F.col("label").isNull())]
    names = ["train_0", "train_1", "train_null"]
    # labels are counted per train class, then summed over a class's links: hot classes are never multiplied out
    train = inc.where("side = 0").select("cls", F.col("key").alias("rec_id")).join(facts.select("rec_id", "label"), "rec_id")
    train = train.groupBy(F.col("cls").alias("ca")).agg(*[x.alias(n) for x, n in zip(labels, names)])
    sums = [F.sum(n).alias(n) for n in names]
    linked = pairs.select("ca", "cb", "similarity", "cover_b").join(train, "ca").groupBy("cb").agg(*sums, F.max("similarity").alias("similarity"), F.max("cover_b").alias("cover"))
    size = (F.length("grams") / WIDTH + 2).alias("words")  # three-word sequences in text order
    rows = inc.where("side = 1").select(F.col("key").alias("rec_id"), F.col("cls").alias("cb"), size).join(linked, "cb").join(facts, "rec_id")
    other = ((F.col("label") == 0) & (F.col("train_1") > 0)) | ((F.col("label") == 1) & (F.col("train_0") > 0))
    same = ((F.col("label") == 0) & (F.col("train_0") > 0)) | ((F.col("label") == 1) & (F.col("train_1") > 0))
    verdict = F.when(other, "other").when(same, "same").otherwise("missing")
    share = F.least(F.lit(1.0), F.col("cover") / F.col("words"))
    return rows.select("rec_id", F.lower(F.trim("split")).alias("split"), "source", "label", *names, verdict.alias("verdict"), "similarity", share.alias("covered"))


def report(news: DataFrame, liar: DataFrame) -> DataFrame:
    """One row per split and source of the evaluation records: how many overlap with train, how many of those agree in
    label with all labelled train records they overlap with, differ from any, or lack a label on a side; the labels of both
    sides (the train side counted per overlap); and the mean of the highest similarity and of the covered share."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return overlapping(news, liar).groupBy("split", "source").agg(
        F.count("*").alias("records"),
        count(F.col("verdict") == "same").alias("same_label"),
        count(F.col("verdict") == "other").alias("other_label"),
        count(F.col("verdict") == "missing").alias("label_missing"),
        *[count(c).alias(n) for c, n in ((F.col("label") == 0, "label_0"), (F.col("label") == 1, "label_1"), (F.col("label").isNull(), "label_null"))],
        *[F.sum(n).alias(n) for n in ("train_0", "train_1", "train_null")],
        F.round(F.avg("similarity"), 4).alias("mean_similarity"),
        F.round(F.avg("covered"), 4).alias("mean_covered"),
    )
