"""Problem 4: the N best items of every group, by skipping row groups on their statistics.

The rows are written once, clustered: range-partitioned and sorted by group, then by falling score. A group of any size
is then a stretch of row groups, over as many files as it needs, and the partitioning by score inside a group spreads a
hot one. The reader opens only the footers first, takes a file's row groups in falling order of their highest score,
keeps the N best of every group met so far, and skips a row group without reading it when its highest score is strictly
below the current N-th score of every group it may contain, by the statistics of its first and last group. What files keep
(N rows a group at most) is merged at the end.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cores, materialize

KEPT = "scheme string, qid long, doc_id long, similitud double"
ROW_GROUP_BYTES = 1 << 20
ROWS_PER_FILE = 1_500_000
SPAN = 256  # qids a row group may range over to be asked for one by one


def clean_runs(runs: DataFrame) -> DataFrame:
    """Usable rows as (scheme, qid, doc_id, similitud): the whole number in qid, similarities above 0 and up to 1. A
    null scheme is a group of its own; rows with no number in qid or null doc_id don't count."""
    # the leading zeros go first, so that no padding can overflow the number
    digits = F.regexp_extract("qid", r"(\d+)", 1)
    usable = F.col("similitud").isNotNull() & ~F.isnan("similitud") & (F.col("similitud") > 0) & (F.col("similitud") <= 1)
    rows = runs.where(usable & F.col("doc_id").isNotNull()).select("scheme", digits.try_cast("long").alias("qid"), "doc_id", "similitud")
    return rows.where(F.col("qid").isNotNull())


def best_of(qid: np.ndarray, doc: np.ndarray, score: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best distinct documents of each group, by score descending and then document."""
    order = np.lexsort((-score, doc, qid, group))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (qid[order][1:] != qid[order][:-1]) | (group[order][1:] != group[order][:-1])]
    order = order[new]
    order = order[np.lexsort((doc[order], -score[order], qid[order], group[order]))]
    new = np.r_[True, (qid[order][1:] != qid[order][:-1]) | (group[order][1:] != group[order][:-1])]
    start = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < n]


def _open(path: str) -> pq.ParquetFile:
    where, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return pq.ParquetFile(where.open_input_file(name))


class Kept:
    """The n best of each group seen so far, as columns; scheme codes stand for the scheme strings."""

    def __init__(self, n: int) -> None:
        self.n, self.codes = n, {}
        self.cols = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)]
        self.nth: dict[tuple[int, int], float] = {}  # the n-th best score of the groups that have n

    def code(self, scheme: str | None) -> int:
        return self.codes.setdefault(scheme, len(self.codes))

    def add(self, t: pa.Table) -> None:
        kinds = t.column("scheme").combine_chunks().dictionary_encode()
        local = np.array([self.code(x) for x in kinds.dictionary.to_pylist()] + [self.code(None)], np.int64)
        code = local[kinds.indices.fill_null(len(local) - 1).to_numpy(zero_copy_only=False)]
        new = [code, t.column("qid").to_numpy(), t.column("doc_id").to_numpy(), t.column("similitud").to_numpy()]
        top = best_of(new[1], new[2], new[3], new[0], self.n)
        cols = [np.concatenate([a, b[top]]) for a, b in zip(self.cols, new)]
        top = best_of(cols[1], cols[2], cols[3], cols[0], self.n)
        self.cols = [c[top] for c in cols]
        # groups stand together, best first: a group with n rows has its n-th at the last of them
        group, qid, score = self.cols[0], self.cols[1], self.cols[3]
        last = np.flatnonzero(np.r_[(group[1:] != group[:-1]) | (qid[1:] != qid[:-1]), True]) if len(qid) else np.empty(0, np.int64)
        full = last[np.diff(np.r_[-1, last]) >= self.n]
        self.nth.update(zip(zip(group[full].tolist(), qid[full].tolist()), score[full].tolist()))

    def below(self, top: float, contained: tuple | None) -> bool:
        """Whether a row group with this highest score can't change any group it may contain: (scheme, first qid, last
        qid), or None if that isn't known. A qid in between that no row has counts as a group without rows, so it keeps
        the row group from being skipped."""
        if contained is None or contained[2] - contained[1] >= SPAN or contained[0] not in self.codes:
            return False
        code = self.codes[contained[0]]
        return all(top < self.nth.get((code, q), -np.inf) for q in range(contained[1], contained[2] + 1))

    def batch(self) -> pa.RecordBatch:
        names = list(self.codes)
        return pa.RecordBatch.from_arrays([pa.array([names[c] for c in self.cols[0]], pa.string()), *(pa.array(c) for c in self.cols[1:])], names=["scheme", "qid", "doc_id", "similitud"])


def _bounds(group: pq.RowGroupMetaData, names: dict[str, int]) -> tuple[float, tuple | None]:
    """A row group's highest score, and its scheme, first and last qid where it holds one scheme."""
    stats = {c: group.column(i).statistics for c, i in names.items()}
    score = stats["similitud"]
    if score is None or not score.has_min_max:
        return np.inf, None
    s, q = stats["scheme"], stats["qid"]
    known = s is not None and q is not None and s.has_min_max and q.has_min_max and not s.null_count and s.min == s.max
    return score.max, ((s.min, q.min, q.max) if known else None)


def read_skipping(path: str, n: int) -> tuple[pa.RecordBatch, int, int]:
    """The n best of each group of one clustered file; row groups read and skipped."""
    file = _open(path)
    meta, kept, read, skipped = file.metadata, Kept(n), 0, 0
    names = {meta.row_group(0).column(i).path_in_schema: i for i in range(meta.num_columns)} if meta.num_row_groups else {}
    heap = []
    for k in range(meta.num_row_groups):
        top, contained = _bounds(meta.row_group(k), names)
        heapq.heappush(heap, (-top, k, contained))
    while heap:
        top, k, contained = heapq.heappop(heap)
        if kept.below(-top, contained):
            skipped += 1
            continue
        kept.add(file.read_row_group(k, columns=list(names)))
        read += 1
    return kept.batch(), read, skipped


def cluster(rows: DataFrame, *, files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """rows (KEPT) as a clustered table in the shared folder."""
    spark = rows.sparkSession
    if files is None:
        files = max(cores(spark), -(-rows.count() // ROWS_PER_FILE))
    keys = [F.col("scheme"), F.col("qid"), F.col("similitud").desc(), F.col("doc_id")]
    laid = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    return materialize(laid, "clustered", **{"compression": "zstd", "parquet.block.size": str(row_group_bytes)})


def top_items(rows: DataFrame, n: int = 5, **layout: int) -> DataFrame:
    """(scheme, qid, pos, doc_id, similitud) of rows(scheme, qid, doc_id, similitud): per group the n documents of the
    highest score, each document once by its highest, ties by the smaller doc_id. Fewer than n documents give fewer
    rows, an empty table none; further columns are ignored."""
    table = cluster(rows.select("scheme", "qid", "doc_id", "similitud"), **layout)
    spark = rows.sparkSession
    paths = sorted(table.inputFiles())
    if not paths:
        return rows.limit(0).select("scheme", "qid", F.lit(1).alias("pos"), "doc_id", "similitud")
    listed = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string").repartitionById(len(paths), F.col("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(1).to_pylist():
                yield read_skipping(path, n)[0]

    kept = listed.mapInArrow(run, KEPT)
    order = Window.partitionBy("scheme", "qid").orderBy(F.col("similitud").desc(), "doc_id")
    # a group lies in one file or in neighbours, and a document of it may be in several: at most n rows a file and group
    once = kept.groupBy("scheme", "qid", "doc_id").agg(F.max("similitud").alias("similitud"))
    return once.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n).select("scheme", "qid", "pos", "doc_id", "similitud")
