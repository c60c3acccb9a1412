"""Scoring of a query set against a corpus without a table of (query, document) pairs.

The corpus becomes blocks of some ten thousand documents in the shared folder: postings by term, or vectors. The queries are
parted among the tasks; a task goes through all blocks and keeps its queries' k best, so only those leave it. What is shuffled
or written is the blocks, the queries and the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.shared import discard, materialize

DIGITS = 6
BLOCK_ROWS = 32_768  # documents a block
GATHERED_BYTES = 64 << 20
QUERY_ROWS = 32_768  # queries a task
KEPT_BYTES = 192 << 20  # decoded blocks that a task keeps while it goes through them again and again
JOINED_ROWS, JOINED_BYTES = 65_536, 32 << 20  # documents, and decoded bytes, that a task scores at once
PRODUCT_BYTES = 16 << 20  # products of queries and a block held at once
PAIR_BYTES = 64 << 20  # pairs that a task holds where all are asked for
TASK_PAIRS, TASK_QUERIES = 1 << 25, 64  # pairs that a task, and so a file, makes then; queries it takes at least, as it reads all blocks
LAID_TERMS = 64  # frequent terms of a block that a task lays out by document
SLACK = 1e-6  # more than what rounding moves


def rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS places, halves away from 0, as SQL has it."""
    return np.copysign(np.floor(np.abs(x) * 10**DIGITS + 0.5) / 10**DIGITS, x)


def sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column and the row of each."""
    return column.flatten(), np.repeat(np.arange(len(column)), sizes(column))


def term_codes(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, code of each token, row of each token)."""
    values, row = flat(tokens)
    found = values.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), row


def pair_codes(code: np.ndarray, row: np.ndarray, terms: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``term_codes`` of the pairs of neighbours within a row ('a b')."""
    same = row[1:] == row[:-1]
    uniq, inverse = np.unique(code[:-1][same] * max(1, len(terms)) + code[1:][same], return_inverse=True)
    a, b = np.divmod(uniq, max(1, len(terms)))
    return pc.binary_join_element_wise(terms.take(pa.array(a)), terms.take(pa.array(b)), " "), inverse.astype(np.int64), row[1:][same]


def counted(tokens: DataFrame, *, pairs: bool = False) -> DataFrame:
    """(term, tf, df) of tokens(doc_id, tokens), with ``pairs`` those of pairs of neighbours too. A document is counted where
    it lies; what is shuffled is a row a term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, code, row = term_codes(b.column(0))
            for t, c, r in [(terms, code, row), *([pair_codes(code, row, terms)] if pairs else [])]:
                n = max(1, len(t))
                tf, df = np.bincount(c, minlength=len(t)), np.bincount(np.unique(r * n + c) % n, minlength=len(t))
                yield pa.RecordBatch.from_arrays([t.cast(pa.string()), pa.array(tf[: len(t)].astype(np.int64)), pa.array(df[: len(t)].astype(np.int64))], names=["term", "tf", "df"])

    each = tokens.select("tokens").mapInArrow(run, "term string, tf long, df long")
    return each.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to about ``size`` rows or GATHERED_BYTES."""
    held, n, held_bytes = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n, held_bytes = n + b.num_rows, held_bytes + b.nbytes
        if n >= size or held_bytes >= GATHERED_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, held_bytes = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def stored(blocks: DataFrame, name: str) -> DataFrame:
    """A block a row, which is a row group of its own."""
    return materialize(blocks, name, **{"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)})


def postings(tokens: DataFrame, terms: list[tuple[str, float]], asked: int, *, weight: str, pairs: bool = False, norm: bool = True, k1: float = 0.0, b: float = 0.0, avgdl: float = 1.0) -> DataFrame:
    """Blocks of tokens(doc_id, tokens): documents, their lengths, and postings by code of the first ``asked`` of ``terms``
    (term, idf), the others counting in the lengths only. ``weight``: ``tf`` or ``log`` ((1 + ln tf) times idf), or ``bm25``
    (whose idf is the query's). Without ``norm`` lengths are 1."""
    context = tokens.sparkSession.sparkContext
    shared = context.broadcast((pa.array([t for t, _ in terms], pa.string()), np.array([w for _, w in terms], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf = shared.value
        for batch in gathered(batches, BLOCK_ROWS):
            found, code, row = term_codes(batch.column(1))
            dl = np.bincount(row, minlength=batch.num_rows)
            sides = [(found, code, row), *([pair_codes(code, row, found)] if pairs else [])]
            keys = []
            for t, c, r in sides:
                at = pc.fill_null(pc.index_in(t.cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                c = at[c]
                keys.append(c[c >= 0] * batch.num_rows + r[c >= 0])
            key, tf = np.unique(np.concatenate(keys), return_counts=True)  # by term, then document
            term, doc = np.divmod(key, batch.num_rows)
            if weight == "bm25":
                w = (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
            else:
                w = (1 + np.log(tf) if weight == "log" else tf) * idf[term]
            dn = np.sqrt(np.bincount(doc, w * w, batch.num_rows)) if norm else np.ones(batch.num_rows)
            end = np.searchsorted(term, asked)
            term, doc, w = term[:end], doc[:end], w[:end]
            used, first = np.unique(term, return_index=True)
            parts = [used.astype(np.int32), np.append(first, end).astype(np.int64), doc.astype(np.int32), w, dn]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["ids", "used", "first", "doc", "w", "dn"])

    kind = dict(tokens.dtypes)["doc_id"]
    return stored(tokens.where("doc_id is not null").select("doc_id", "tokens").mapInArrow(run, f"ids array<{kind}>, used binary, first binary, doc binary, w binary, dn binary"), "postings")


def keys_of(ids: pa.Array) -> np.ndarray:
    """Ids as an array that numpy orders as SQL does."""
    out = ids.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object and len(out) else out


def reader(path: str) -> Iterator[pa.RecordBatch]:
    """The blocks at ``path``, one at a time."""
    where, folder = pyarrow.fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in where.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet"))
    for f in files:
        with where.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=1, use_threads=False)


class Postings:
    """A block of ``postings``, decoded."""

    def __init__(self, b: pa.RecordBatch) -> None:
        read = lambda name, kind: np.frombuffer(b.column(name)[0].as_buffer(), kind)
        self.ids = keys_of(b.column("ids").flatten())
        self.used, self.first, self.doc, self.w, self.dn = read("used", np.int32), read("first", np.int64), read("doc", np.int32).astype(np.intp), read("w", np.float64), read("dn", np.float64)
        self.prepare()

    @classmethod
    def joined(cls, parts: list[Postings]) -> Postings:
        """The blocks as one: a query's cost is by the call as much as by the document."""
        if len(parts) == 1:
            return parts[0]
        x = cls.__new__(cls)
        term = np.concatenate([np.repeat(p.used, np.diff(p.first)) for p in parts])
        order = np.argsort(term, kind="stable")
        base = np.cumsum([0, *(len(p.ids) for p in parts[:-1])])
        x.ids, x.dn = np.concatenate([p.ids for p in parts]), np.concatenate([p.dn for p in parts])
        x.doc, x.w = np.concatenate([p.doc + b for p, b in zip(parts, base)])[order], np.concatenate([p.w for p in parts])[order]
        x.used, first = np.unique(term[order], return_index=True)
        x.first = np.append(first, len(term))
        x.prepare()
        return x

    def prepare(self) -> None:
        self.place = {int(t): i for i, t in enumerate(self.used)}
        self.plain = bool((self.dn == 1).all())
        scaled = self.w if self.plain else self.w / np.where(self.dn[self.doc] > 0, self.dn[self.doc], 1)
        self.most = np.maximum.reduceat(scaled, self.first[:-1]) if len(self.place) else np.empty(0)
        self.below = bool((self.w < 0).any())
        self.scaled, self.kth, self.laid, self.acc = scaled, {}, {}, np.zeros(len(self.ids))
        self.bytes = self.doc.nbytes + self.w.nbytes * (1 if self.plain else 2) + self.dn.nbytes + 16 * len(self.ids)

    def bound(self, terms: np.ndarray, weights: np.ndarray, qn: float, k: int) -> float:
        """What ``k`` documents reach at least, by one of the terms alone; the others add to that, if no weight is below 0."""
        if not len(terms) or weights.min() <= 0 or self.below:
            return -math.inf
        most = 0.0
        for t, w in zip(terms.tolist(), weights.tolist()):
            if (p := self.place.get(t)) is not None:
                if (x := self.kth.get((p, k))) is None:
                    x = self.scaled[self.first[p] : self.first[p + 1]]
                    x = self.kth[p, k] = float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else 0.0
                most = max(most, w * x)
        return most / qn if most > 0 else -math.inf

    def best(self, terms: np.ndarray, weights: np.ndarray, qn: float, least: float, positive: bool) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of those that may reach ``least``, of all with a common term if it is not above 0."""
        places = [(self.place[t], w) for t, w in zip(terms.tolist(), weights.tolist()) if t in self.place]
        if not places:
            return np.empty(0, np.intp), np.empty(0)
        if least > SLACK:
            return self.reaching(places, qn, least - SLACK)
        if len(places) == 1:
            p, w = places[0]
            at = slice(self.first[p], self.first[p + 1])
            doc, dot = self.doc[at], self.w[at] * w
        else:
            at = [slice(self.first[p], self.first[p + 1]) for p, _ in places]
            doc = np.concatenate([self.doc[a] for a in at])
            acc = np.bincount(doc, np.concatenate([self.w[a] * w for a, (_, w) in zip(at, places)]), len(self.ids))
            hit = np.zeros(len(self.ids), bool)
            hit[doc] = True
            doc = np.flatnonzero(hit)
            dot = acc[doc]
        with np.errstate(invalid="ignore"):  # a length of 0
            score = dot / (self.dn[doc] * qn)
        if not positive:
            return doc, score
        keep = score > 0
        return doc[keep], score[keep]

    def reaching(self, places: list[tuple[int, float]], qn: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of those with ``least`` or more. The terms whose bounds together are less can't bring a document
        there, so only documents of the other terms are looked at; the former are looked up for them."""
        bounded = sorted((max(0.0, w * self.most[p]) / qn, p, w) for p, w in places)
        low, few = 0.0, 0
        while few < len(bounded) and low + bounded[few][0] < least:
            low += bounded[few][0]
            few += 1
        lists = [self.doc[self.first[p] : self.first[p + 1]] for _, p, _ in bounded]
        if few == len(bounded):
            return np.empty(0, np.intp), np.empty(0)

        def keep(doc: np.ndarray, dot: np.ndarray) -> np.ndarray:
            return np.flatnonzero(dot >= (least - low) * qn * (1 if self.plain else self.dn[doc]))

        if few == len(bounded) - 1:
            _, p, w = bounded[few]
            dot = self.w[self.first[p] : self.first[p + 1]] * w
            at = keep(lists[few], dot)
            doc, dot = lists[few][at], dot[at]
        else:
            for (_, p, w), doc in zip(bounded[few:], lists[few:]):  # a document is once in a term's list
                self.acc[doc] += self.w[self.first[p] : self.first[p + 1]] * w
            parts = []
            for each in lists[few:]:
                dot = self.acc[each]
                at = keep(each, dot)
                parts.append((each[at], dot[at]))
                self.acc[parts[-1][0]] = -math.inf  # taken
            for each in lists[few:]:
                self.acc[each] = 0
            doc, dot = (np.concatenate(x) for x in zip(*parts))
        for (bound, p, w), each in zip(bounded[:few][::-1], lists[:few][::-1]):
            if not len(doc):
                break
            if len(each) > len(self.ids) // 32 and len(self.laid) < LAID_TERMS and p not in self.laid:
                self.laid[p] = np.zeros(len(self.ids))
                self.laid[p][each] = self.w[self.first[p] : self.first[p + 1]]
            if p in self.laid:
                dot = dot + self.laid[p][doc] * w
            else:
                at = np.minimum(np.searchsorted(each, doc), len(each) - 1)
                dot = dot + np.where(each[at] == doc, self.w[self.first[p] + at] * w, 0.0)
            low -= bound
            at = keep(doc, dot)
            doc, dot = doc[at], dot[at]
        with np.errstate(invalid="ignore"):  # a length of 0
            score = dot / (self.dn[doc] * qn)
        at = np.flatnonzero(score >= least)
        return doc[at], score[at]


def decoded(blocks: Iterable[pa.RecordBatch], decode: Callable) -> Iterator[tuple[Any, int]]:
    """The blocks decoded, those of postings joined to JOINED_ROWS or JOINED_BYTES at most, and how many each is."""
    join = getattr(decode, "joined", None)
    held, n, held_bytes = [], 0, 0
    for b in blocks:
        x = decode(b)
        if held and (join is None or n + len(x.ids) > JOINED_ROWS or held_bytes + x.bytes > JOINED_BYTES):
            yield join(held) if join else held[0], len(held)
            held, n, held_bytes = [], 0, 0
        held.append(x)
        n, held_bytes = n + len(x.ids), held_bytes + x.bytes
    if held:
        yield join(held) if join else held[0], len(held)


def best_rows(scores: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties by ``doc``: only what reaches the k-th score is sorted."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), max(n, 1))
    order = np.lexsort((doc[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(scores)))[row]
    return row[rank < k], col[rank < k]


class Best:
    """A query's k best so far; ``k`` None keeps all."""

    def __init__(self, k: int | None) -> None:
        self.k, self.parts, self.score, self.doc, self.least = k, [], None, None, -math.inf

    def add(self, doc: np.ndarray, score: np.ndarray) -> None:
        if not len(doc):
            return
        if self.k is not None and len(score) > self.k:  # what rounding can't bring among the k best isn't rounded
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k] - SLACK
            doc, score = doc[keep], score[keep]
        score = rounded(score)
        if self.k is None:
            self.parts.append((doc, score))
            return
        if len(score) > self.k:
            keep = best_rows(score[None], doc, self.k)[1]
            doc, score = doc[keep], score[keep]
        if self.score is not None:
            doc, score = np.concatenate([self.doc, doc]), np.concatenate([self.score, score])
        order = np.lexsort((doc, -score))[: self.k]
        self.doc, self.score = doc[order], score[order]
        if len(order) == self.k:
            self.least = float(self.score[-1])

    def rows(self) -> tuple[np.ndarray, np.ndarray] | None:
        if self.parts:
            doc, score = (np.concatenate(x) for x in zip(*self.parts))
            order = np.lexsort((doc, -score))
            return doc[order], score[order]
        return None if self.score is None else (self.doc, self.score)


def results(qids: pa.Array, best: list[Best], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(qid, rank, doc_id, score) of the queries, a batch at a time."""
    held, n = [], 0
    for i, x in enumerate(best):
        if (r := x.rows()) is not None:
            held.append((i, *r))
            n += len(r[0])
        best[i] = None
        if n >= 1 << 17 or i == len(best) - 1 and n:
            sizes = np.array([len(d) for _, d, _ in held])
            at, ends = np.repeat([i for i, *_ in held], sizes), np.cumsum(sizes)
            rank = (np.arange(1, n + 1) - np.repeat(ends - sizes, sizes)).astype(np.int32)
            ids = np.concatenate([d for _, d, _ in held])
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pa.array(rank), pa.array(ids.tolist() if ids.dtype.kind == "U" else ids).cast(kind), pa.array(np.concatenate([s for *_, s in held]))], names=["qid", "rank", "doc_id", "score"])
            held, n = [], 0


def parted(queries: DataFrame, size: int = QUERY_ROWS, by: list[str] | None = None) -> DataFrame:
    """The queries over as many tasks as there are cores, and at most ``size`` each on average. By a hash of ``by``, what is
    asked or else the id: where the rows lie by the id in as many partitions already, Spark drops the exchange and joins small
    partitions to one."""
    cores, n = max(2, queries.sparkSession.sparkContext.defaultParallelism), queries.count()
    return queries.repartition(cores * max(1, math.ceil(n / cores / size)), F.hash(*by or ["qid"]))


def alike(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(the first of the rows that are the same but for the qid, which of them each row is)."""
    parts = []
    for c in batch.columns[1:]:
        if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            values, ends = c.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes(c)).tolist()
            parts.append([values[a:z].tobytes() for a, z in zip([0, *ends], ends)])
        else:
            parts.append(c.to_pylist())
    seen: dict = {}
    which = np.array([seen.setdefault(key, len(seen)) for key in zip(*parts)], np.intp)
    return np.unique(which, return_index=True)[1], which


def pooled(path: str, batch: pa.RecordBatch, k: int, add: Callable, decode: Callable) -> tuple[list[Best], pa.DataType]:
    """The k best of each query of the batch, and the type of the documents' ids; what is asked alike is scored once."""
    first, which = alike(batch)
    batch, kind = batch.take(pa.array(first)), pa.int64()
    best = [Best(k) for _ in first]
    for x, _ in decoded(reader(path), decode):
        kind = id_type(x.ids)
        add(x, batch, best)
    return [best[i] for i in which], kind


def id_type(ids: np.ndarray) -> pa.DataType:
    return pa.string() if ids.dtype.kind == "U" else pa.from_numpy_dtype(ids.dtype)


def searched(blocks: DataFrame, queries: DataFrame, k: int | None, add: Callable, decode: Callable = Postings, *, documents: int = 0) -> DataFrame:
    """(qid, rank, doc_id, score) of queries(qid, ...): ``add(block, batch, best)`` adds a block's hits to the list of
    ``Best``. With ``k`` the blocks are removed when it is done; all pairs (``k`` None, of ``documents`` documents at most) are
    made as they are read, in tasks of TASK_PAIRS."""
    path, row = blocks._lexmill_path, found_row(queries, blocks)
    if k is not None:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches, QUERY_ROWS):
                best, kind = pooled(path, batch, k, add, decode)
                yield from results(batch.column(0), best, kind)

        return kept_run(parted(queries, by=queries.columns[1:]).mapInArrow(search, row), blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, past = [], 0, 0

        def each() -> Iterator:
            nonlocal held, past
            yield from kept
            for x, n in decoded(islice(reader(path), past, None), decode):
                held += x.bytes
                if held <= KEPT_BYTES:
                    kept.append(x)
                    past += n
                yield x

        size = max(1, PAIR_BYTES // (16 * max(1, documents)))
        for joined in gathered(batches, QUERY_ROWS):
            for at in range(0, joined.num_rows, size):
                batch = joined.slice(at, size)
                best, kind = [Best(None) for _ in range(batch.num_rows)], pa.int64()
                for x in each():
                    kind = id_type(x.ids)
                    add(x, batch, best)
                yield from results(batch.column(0), best, kind)

    return parted(queries, min(QUERY_ROWS, max(TASK_QUERIES, TASK_PAIRS // max(1, documents)))).mapInArrow(run, row)


def found_row(queries: DataFrame, blocks: DataFrame) -> str:
    ids = dict(blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return f"qid {dict(queries.dtypes)['qid']}, rank int, doc_id {ids}, score double"


def kept_run(run: DataFrame, *blocks: DataFrame) -> DataFrame:
    """The run made and written; the blocks it was made of are removed."""
    out = materialize(run, "run")
    for b in blocks:
        discard(b)
    return out


def mixed(a: tuple, b: tuple, *, alpha: float, pool: int, k: int) -> DataFrame:
    """The k best by alpha a + (1 - alpha) b, where a and b are the scores of the ``pool`` best of two searches (blocks,
    queries, add, decode), scaled to [0, 1] for each query: both are made in one task, so no pool leaves it."""
    (left, asked_a, add_a, decode_a), (right, asked_b, add_b, decode_b) = a, b
    one = asked_a.toDF("qid", *[f"a{i}" for i in range(1, len(asked_a.columns))])
    two = asked_b.toDF("qid", *[f"b{i}" for i in range(1, len(asked_b.columns))])
    paths, middle = (left._lexmill_path, right._lexmill_path), len(one.columns)

    def scaled(best: Best) -> tuple[np.ndarray, np.ndarray]:
        doc, score = best.rows() or (None, np.empty(0))
        if not len(score):
            return doc, score
        low, high = score.min(), score.max()
        return doc, np.zeros(len(score)) if high - low < 1e-9 else (score - low) / (high - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, QUERY_ROWS):
            names = batch.schema.names
            found, kind = pooled(paths[0], batch.select(names[:middle]), pool, add_a, decode_a)
            other, _ = pooled(paths[1], batch.select([names[0], *names[middle:]]), pool, add_b, decode_b)
            best = []
            for x, y in zip(found, other):
                best.append(Best(k))
                parts = [(doc, score * share) for (doc, score), share in ((scaled(x), alpha), (scaled(y), 1 - alpha)) if len(score)]
                if parts:
                    doc, at = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
                    best[-1].add(doc, np.bincount(at, np.concatenate([s for _, s in parts])))
            yield from results(batch.column(0), best, kind)

    queries = one.join(two, "qid", "full_outer").select(*one.columns, *two.columns[1:])
    return kept_run(parted(queries, by=one.columns[1:]).mapInArrow(run, found_row(queries, left)), left, right)


def word_blocks(words: DataFrame, known: list[str]) -> DataFrame:
    """Blocks of words(doc_id, words): which documents have which of the ``known`` words, as sorted numbers word * documents +
    document; the documents by id."""
    shared = words.sparkSession.sparkContext.broadcast(pa.array(known, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BLOCK_ROWS):
            batch = batch.take(pc.sort_indices(batch.column(0)))
            found, code, row = term_codes(batch.column(1))
            code = pc.fill_null(pc.index_in(found.cast(pa.string()), value_set=shared.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            key = np.unique(code[code >= 0] * batch.num_rows + row[code >= 0])
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([key.tobytes()], pa.binary())], names=["ids", "key"])

    return stored(words.where("doc_id is not null").select("doc_id", "words").mapInArrow(run, f"ids array<{dict(words.dtypes)['doc_id']}>, key binary"), "words")


class Words:
    """A block of ``word_blocks``, decoded."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.ids = keys_of(b.column("ids").flatten())
        self.key = np.frombuffer(b.column("key")[0].as_buffer(), np.int64)
        self.bytes = self.key.nbytes


def word_shares(path: str, codes: pa.Array, of: np.ndarray, pool: list[Best], k: int) -> list[Best]:
    """The pools ranked anew, by the share of the query's ``of`` words that a document has; ``codes`` are its words that may
    be in documents."""
    best = [Best(k) for _ in pool]
    runs = [x.rows() for x in pool]
    at = [i for i, r in enumerate(runs) if r is not None]
    if not at:
        return best
    doc, query = np.concatenate([runs[i][0] for i in at]), np.repeat(at, [len(runs[i][0]) for i in at])
    n, code = sizes(codes), codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(n) - n
    have = np.zeros(len(doc), np.int64)
    for b in reader(path):
        x = Words(b)
        if not len(x.ids) or not len(x.key):
            continue
        place = np.minimum(np.searchsorted(x.ids, doc), len(x.ids) - 1)
        here = np.flatnonzero(x.ids[place] == doc)
        for i in range(int(n.max(initial=0))):
            more = here[n[query[here]] > i]
            key = code[start[query[more]] + i] * len(x.ids) + place[more]
            have[more] += x.key[np.minimum(np.searchsorted(x.key, key), len(x.key) - 1)] == key
    score = have / np.maximum(of[query], 1)
    ends = np.searchsorted(query, np.arange(len(pool) + 1))
    for i in at:
        best[i].add(doc[ends[i] : ends[i + 1]], score[ends[i] : ends[i + 1]])
    return best


def reranked(search: tuple, words: DataFrame, blocks: DataFrame, *, pool: int, k: int) -> DataFrame:
    """The ``pool`` best of a search (blocks, queries, add, decode) ranked by ``word_shares`` with words(qid, codes, n) over
    ``word_blocks``, in the task that finds them."""
    left, asked, add, decode = search
    paths, queries = (left._lexmill_path, blocks._lexmill_path), asked.join(words.select("qid", F.col("codes").alias("_codes"), F.col("n").alias("_n")), "qid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, QUERY_ROWS):
            found, kind = pooled(paths[0], batch.select(batch.schema.names[:-2]), pool, add, decode)
            codes, n = batch.columns[-2:]
            yield from results(batch.column(0), word_shares(paths[1], codes, n.to_numpy(zero_copy_only=False), found, k), kind)

    return kept_run(parted(queries, by=asked.columns[1:]).mapInArrow(run, found_row(queries, left)), left, blocks)


def add_postings(positive: bool) -> Callable:
    """For ``searched`` over ``postings``: queries (qid, terms array<int>, weights array<double>, qn)."""

    def add(x: Postings, batch: pa.RecordBatch, best: list[Best]) -> None:
        terms, weights = batch.column(1), batch.column(2)
        ends = np.cumsum(sizes(terms))
        code, w, qn = terms.flatten().to_numpy(), weights.flatten().to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        for i, (a, z) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            if best[i].k is not None:
                best[i].least = max(best[i].least, x.bound(code[a:z], w[a:z], float(qn[i]), best[i].k))
            doc, score = x.best(code[a:z], w[a:z], float(qn[i]), best[i].least, positive)
            best[i].add(x.ids[doc], score)

    return add


def vectors(table: DataFrame) -> DataFrame:
    """Blocks of table(doc_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, BLOCK_ROWS):
            x = b.column(1).flatten().to_numpy(zero_copy_only=False)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary()), pa.array([x.dtype.str])], names=["ids", "x", "kind"])

    return stored(table.where("doc_id is not null").select("doc_id", "embedding").mapInArrow(run, f"ids array<{dict(table.dtypes)['doc_id']}>, x binary, kind string"), "vectors")


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which have a length."""
    length = np.linalg.norm(x, axis=1)
    return x[length > 0] / length[length > 0, None], length > 0


class Vectors:
    """A block of ``vectors``, decoded: those with a length, scaled to 1."""

    def __init__(self, b: pa.RecordBatch) -> None:
        ids = keys_of(b.column("ids").flatten())
        x = np.frombuffer(b.column("x")[0].as_buffer(), b.column("kind")[0].as_py())
        self.x, ok = unit_rows(x.astype(np.float64).reshape(len(ids), -1))
        self.ids, self.bytes = ids[ok], self.x.nbytes


def add_vectors(x: Vectors, batch: pa.RecordBatch, best: list[Best]) -> None:
    """For ``searched`` over ``vectors``: queries (qid, embedding). Products in single precision, whose error is bounded, leave
    the candidates; these are scored in double precision."""
    n, k, given = len(x.ids), best[0].k, np.flatnonzero(sizes(batch.column(1)))
    if not n or not len(given):
        return
    q = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(given), -1)
    q, ok = unit_rows(q)
    which, low, off = given[ok], x.x.astype(np.float32).T, SLACK + 2.4e-7 * q.shape[1]
    step = max(1, PRODUCT_BYTES // (4 * n))
    for at in range(0, len(which), step):
        part = q[at : at + step]
        s = part.astype(np.float32) @ low
        least = np.array([best[i].least for i in which[at : at + step]])
        if n > k and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(s, n - k, axis=1)[:, n - k] - off)
        row, col = np.nonzero(s >= (least - off).astype(np.float32)[:, None])
        ends = np.searchsorted(row, np.arange(len(part) + 1))
        for i, (a, z) in enumerate(zip(ends[:-1], ends[1:])):
            if z > a:
                best[which[at + i]].add(x.ids[col[a:z]], x.x[col[a:z]] @ part[i])
