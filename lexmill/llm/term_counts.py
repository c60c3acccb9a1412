"""Problem 3: occurrences and records of every term, from compressed record bitmaps.

Every task keeps its terms in a vertical layout: a term's records as a bitmap (a sorted list of differences while
sparse, bits once dense) beside its occurrences. The bitmaps go out in packed blocks by term and range of record ids.
A block from all tasks is merged by union, its document frequencies are the cardinalities; ranges of ids are disjoint,
so their frequencies add up, and no term, however common, is ever held whole by one task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cores, rows

TERM = regex.compile(r"[\p{L}\p{M}]+")
FORMAT = regex.compile(r"\p{Cf}+")
RANGE_BITS = 20
FLUSH = 2_500_000
ARROW_ROWS = 4000
DENSE = 16
COUNTS = "term string, occurrences long, records long"


def terms(text: str | None) -> list[str]:
    """Maximal runs of letters and marks, after NFC, removal of format characters and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = FORMAT.sub("", unicodedata.normalize("NFC", text))
    return TERM.findall(text.lower())


def _varint(x: np.ndarray) -> np.ndarray:
    """Differences in 7-bit groups, lowest first, the last with its high bit clear."""
    size = np.maximum(1, (np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) // 7) + 1)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for j in range(int(size.max(initial=0))):
        on = size > j
        out[at[on] + j] = (x[on] >> (7 * j) & 127) | np.where(size[on] > j + 1, 128, 0)
    return out


def _unvarint(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    out = np.zeros(len(end), np.int64)
    for j in range(int((end - start).max(initial=-1)) + 1):
        on = start + j <= end
        out[on] |= (data[start[on] + j].astype(np.int64) & 127) << (7 * j)
    return out


def pack_bitmaps(names: list[str], card: np.ndarray, occ: np.ndarray, ids: np.ndarray) -> bytes:
    """Terms with their occurrences and record bitmaps; ids of a term are sorted and stand after those of the last."""
    start = np.cumsum(card) - card
    last = ids[start + card - 1] if len(card) else card
    dense = (card > 8) & (last + 1 < card * DENSE)
    first = np.zeros(len(ids), bool)
    first[start] = True
    gap = np.where(first, ids, np.diff(ids, prepend=0))
    sparse = ~np.repeat(dense, card)
    bits = [np.packbits(np.bincount(ids[s : s + n], minlength=0).astype(bool), bitorder="little") for s, n in zip(start[dense], card[dense])]
    parts = [np.frombuffer("\n".join(names).encode(), np.uint8), _varint(card), _varint(occ), np.packbits(dense), _varint(gap[sparse]), _varint(np.array([len(b) for b in bits], np.int64)), np.concatenate([*bits, np.empty(0, np.uint8)])]
    head = np.array([len(names), *(len(p) for p in parts)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(p.tobytes() for p in parts), 1)


def unpack_bitmaps(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    head = np.frombuffer(raw, np.int64, 8)
    at, parts = 64, []
    for size in head[1:]:
        parts.append(np.frombuffer(raw, np.uint8, int(size), at))
        at += int(size)
    names, card, occ = parts[0].tobytes().decode().split("\n"), _unvarint(parts[1]), _unvarint(parts[2])
    dense = np.unpackbits(parts[3], count=int(head[0])).astype(bool)
    gap, lens, bits = _unvarint(parts[4]), _unvarint(parts[5]), parts[6]
    ids = np.empty(int(card.sum()), np.int64)
    start = np.cumsum(card) - card
    is_dense = np.repeat(dense, card)
    n = card[~dense]
    if len(n):
        total = np.cumsum(gap)
        s = np.cumsum(n) - n
        ids[~is_dense] = total - np.repeat(np.r_[0, total[s[1:] - 1]], n)
    off = 0
    for k, size in zip(np.flatnonzero(dense), lens):
        ids[start[k] : start[k] + card[k]] = np.flatnonzero(np.unpackbits(bits[off : off + size], bitorder="little"))
        off += int(size)
    return names, card, occ, ids


class Vertical:
    """A task's terms: codes, and (term, record) with occurrences."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, found: list[list[str]]) -> None:
        flat = [t for ts in found for t in ts]
        if not flat:
            return
        local, uniq = pd.factorize(np.array(flat, dtype=object))
        code = np.fromiter((self.code.setdefault(t, len(self.code)) for t in uniq), np.int64, len(uniq))[local]
        row = np.repeat(np.arange(len(found)), [len(ts) for ts in found])
        pair, occ = np.unique(code * len(found) + row, return_counts=True)
        self.pairs.append((pair // len(found), ids[pair % len(found)], occ))
        self.size += len(pair)

    def flush(self, blocks: int) -> pa.RecordBatch | None:
        if not self.pairs:
            return None
        code, rec, occ = (np.concatenate(x) for x in zip(*self.pairs))
        names = np.array(list(self.code), dtype=object)
        block = np.fromiter((xxhash.xxh3_64_intdigest(t) % blocks for t in self.code), np.int64, len(names))
        span = rec >> RANGE_BITS
        # a range of record ids is part of the block's number: it may lie in any partition
        order = np.lexsort((rec, code, span, block[code]))
        code, rec, occ, span, blk = code[order], rec[order], occ[order], span[order], block[code[order]]
        cut = np.flatnonzero(np.r_[True, (blk[1:] != blk[:-1]) | (span[1:] != span[:-1])])
        out = []
        for s, e in zip(cut, np.r_[cut[1:], len(blk)]):
            c = code[s:e]
            start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            card = np.diff(np.r_[start, len(c)])
            low = rec[s:e] - (span[s] << RANGE_BITS)
            out.append((int(blk[s]), int(span[s]), pack_bitmaps(names[c[start]].tolist(), card, np.add.reduceat(occ[s:e], start), low)))
        self.__init__()
        b, r, x = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(r, pa.int64()), pa.array(x, pa.binary())], names=["block", "span", "bitmaps"])


def _merge(held: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Union of bitmaps: terms, occurrences and cardinalities."""
    parts = [unpack_bitmaps(x) for x in held]
    code, uniq = pd.factorize(np.array([t for p in parts for t in p[0]], dtype=object))
    card, occ, ids = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    member = np.unique((np.repeat(code, card) << RANGE_BITS) | ids) >> RANGE_BITS
    return list(uniq), np.bincount(code, weights=occ, minlength=len(uniq)).astype(np.int64), np.bincount(member, minlength=len(uniq))


def term_counts(df: DataFrame, key: str, text: str, *, vocabulary: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """COUNTS of every term of df[text], each row's id in df[key] (unique, not negative). Null, empty and wordless texts
    have no term; an empty table gives no row. The terms of ``vocabulary`` (term) are added with no count of their own,
    so those that no record has come out with 0."""
    spark = df.sparkSession
    read = df.select(F.col(key).cast("long"), text).where(F.col(text).isNotNull() & F.col(key).isNotNull())
    # two blocks for a task that reads, at least: what a merging task gets doesn't grow with the input
    blocks = blocks or max(4 * cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * read.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Vertical()
        for b in rows(batches, ARROW_ROWS, 1):
            held.add(b.column(0).to_numpy(), [terms(t) for t in b.column(1).to_pylist()])
            if held.size >= FLUSH:
                yield held.flush(blocks)
        if (out := held.flush(blocks)) is not None:
            yield out

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows come sorted: one block and range is held at a time
        now, held = None, []

        def merged() -> pa.RecordBatch:
            names, occ, card = _merge(held)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(occ, pa.int64()), pa.array(card, pa.int64())], names=["term", "occurrences", "records"])

        for b in batches:
            for k, r, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (k, r) != now and held:
                    yield merged()
                    held = []
                now = (k, r)
                held.append(x)
        if held:
            yield merged()

    packed = read.mapInArrow(run, "block int, span long, bitmaps binary")
    sorted_blocks = packed.repartition(max(cores(spark), blocks // 4), "block", "span").sortWithinPartitions("block", "span")
    parts = sorted_blocks.mapInArrow(merge, COUNTS)
    if vocabulary is not None:
        zero = F.lit(0).cast("long")
        wanted = vocabulary.select(F.lower(F.trim("term")).alias("term")).where(F.length("term") > 0).distinct()
        parts = parts.unionByName(wanted.select("term", zero.alias("occurrences"), zero.alias("records")))
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(news: DataFrame, vocabulary: DataFrame, *, rare: int = 2, common_share: float = 0.5) -> DataFrame:
    """(term, occurrences, records, band) of every term of the news texts and of the vocabulary (trimmed, lower case;
    null and blank entries don't count): ``unused`` in no record, ``rare`` in at most ``rare``, ``common`` in more than
    ``common_share`` of the records with text (and more than ``rare``), else ``kept``."""
    counts = term_counts(news, "rec_id", "text", vocabulary=vocabulary)
    with_text = news.agg(F.count("text").alias("n")).scalar()
    band = F.when(F.col("records") == 0, "unused").when(F.col("records") <= rare, "rare").when(F.col("records") > with_text * common_share, "common").otherwise("kept")
    return counts.withColumn("band", band)
