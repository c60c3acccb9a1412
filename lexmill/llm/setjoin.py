"""Exact set-similarity join as a blocked sparse product of the document by n-gram incidence matrix.

The plan, in stages that each pass once over compact rows:

1. ``incidence`` turns every text into one row (key, cls, side, n, grams): its distinct k-word sequences as sorted
   40-bit hashes. ``cls`` hashes the whole set (and side), so exact copies are one row of the matrix from here on.
2. ``column_counts`` sums how many rows each column (n-gram) has into counters, over all rows, and keeps a byte of each:
   exact up to 16, then rounded up in steps of an eighth of a doubling. Never below the true count, so a column of
   count 1 pairs with nothing. 4 million counters, more for larger inputs, 32 million (32 MB) at most.
3. ``postings`` orders each row's columns from rare to common and keeps the first n - ceil(t n) + LEVEL of them: two
   sets of overlap t or more share LEVEL columns there (fewer only if they must share fewer at all). Entries travel as
   packed blocks, one per column block, not as rows. A column of more than HOT entries is cut into a triangle of cells;
   where the counters are too full to tell, a second pass over the blocks cuts by the true counts.
4. ``product`` multiplies each column block with its transpose, run by run, drops entries whose remaining columns can't
   reach the size-derived bound, and sums what is left per pair of rows.
5. Pairs with fewer than LEVEL shared columns fall out; the others are compared exactly on their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cores, discard, materialize, mix, rows, sequence_hashes, word_hashes, words

BITS, WIDTH = 40, 5
MASK = np.uint64((1 << BITS) - 1)
COUNTERS_LEAST, COUNTERS_MOST = 1 << 22, 1 << 25
WHOLE = 0x5E17
LEVEL = 3
HOT = 4096
CAP = 64
PAIRS_HELD = 2_000_000
BLOCK_ENTRIES = 1_500_000
FLUSH = 3_000_000
BROADCAST_PAIRS = 500_000
ARROW_ROWS = 5000

INCIDENCE = "key long, cls long, side int, n int, grams binary"


def pack40(h: np.ndarray) -> bytes:
    """Big-endian 5-byte values."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpack40(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 3:] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def whole_text(text: str | None, found: list[str]) -> np.ndarray | None:
    """Three hashes of a text as a whole, by its words or, without any, by its characters; None for a blank text. Together
    they are 64 bits wide, and by one equal hash alone two texts stay under any threshold above a fifth."""
    if not (text and text.strip()):
        return None
    h = xxhash.xxh3_64_intdigest("\0".join(found) if found else "\1" + " ".join(text.split()), WHOLE)
    return mix(np.uint64(h) ^ mix(np.arange(1, 4, dtype=np.uint64))) >> np.uint64(64 - BITS)


def document_sequences(texts: list[str | None], k: int, min_words: int, short: bool = False) -> Iterator[np.ndarray | None]:
    """For each text the hashes of its k-word sequences in order (40 bits), or below ``min_words`` words None; with
    ``short`` those of the whole text."""
    split = [words(t) for t in texts]
    whole = [whole_text(t, w) if short and len(w) < max(k, min_words, 1) else None for t, w in zip(texts, split)]
    split = [w if len(w) >= min_words else [] for w in split]
    flat = word_hashes([w for ws in split for w in ws])
    grams = sequence_hashes(flat, k) >> np.uint64(64 - BITS)
    at = 0
    for ws, one in zip(split, whole):
        if len(ws) < max(k, min_words, 1):
            yield one
        else:
            yield grams[at : at + len(ws) - k + 1]
        at += len(ws)


def incidence(df: DataFrame, *, k: int, min_words: int, ordered: bool = False, short: bool = False, name: str = "incidence") -> DataFrame:
    """df(key long, side int, salt int, text string) -> INCIDENCE. Rows of another ``salt`` never share a column.

    ``ordered`` keeps the sequences in text order with repeats (for suffix order) instead of the sorted distinct ones.
    Null and blank texts, and those under ``min_words`` words, have no row; with ``short`` the latter have one, whose
    class is all texts of the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, ARROW_ROWS, 3):
            found = list(document_sequences(b.column(3).to_pylist(), k, min_words, short))
            at = [i for i, g in enumerate(found) if g is not None]
            if not at:
                continue
            kept = b.take(pa.array(at, pa.int64()))
            sides, salts = kept.column(1).to_pylist(), kept.column(2).to_numpy().astype(np.uint64)
            many = np.array([len(found[i]) for i in at])
            flat = np.concatenate([found[i] for i in at])
            if salts.any():
                salt = np.repeat(salts, many)
                flat = np.where(salt > 0, mix(flat + salt) & MASK, flat)
            # one sort of (row, sequence) gives every row's set
            u = flat | np.repeat(np.arange(len(at), dtype=np.uint64), many) << np.uint64(BITS)
            u.sort()
            u = u[np.r_[True, u[1:] != u[:-1]]]
            n = np.bincount((u >> np.uint64(BITS)).astype(np.int64), minlength=len(at))
            packed, ends = memoryview(pack40(u & MASK)), (WIDTH * np.cumsum(n)).tolist()
            cls = [signed(xxhash.xxh3_64_intdigest(packed[s:e], side)) for s, e, side in zip([0, *ends], ends, sides)]
            data = pack40(flat) if ordered else packed.obj
            offsets = np.r_[0, WIDTH * np.cumsum(many if ordered else n)]
            # a record's sequences are far below the 2 GB that 32-bit offsets of a batch allow (see rows)
            grams = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(cls, pa.int64()), pa.array(sides, pa.int32()), pa.array(n.astype(np.int32)), grams], names=["key", "cls", "side", "n", "grams"])

    made = df.select("key", "side", "salt", "text").mapInArrow(run, INCIDENCE)
    return materialize(made, name, compression="uncompressed")


def _batch_grams(b: pa.RecordBatch, seen: set) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows whose class this task hasn't met: cls, all their sequences, how many each has, n and side."""
    cls, side, n, grams = (b.column(i) for i in range(4))
    fresh = []
    for i, c in enumerate(cls.to_pylist()):
        if c not in seen:
            seen.add(c)
            fresh.append(i)
    take = pa.array(fresh, pa.int64())
    held = grams.take(take).to_pylist()
    flat = unpack40(b"".join(held)) if held else np.empty(0, np.uint64)
    return cls.take(take).to_numpy(), flat, np.array([len(x) // WIDTH for x in held], np.int64), n.take(take).to_numpy(), side.take(take).to_numpy()


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact up to 16, then rounded up in steps of an eighth of a doubling."""
    with np.errstate(divide="ignore"):
        high = 16 + np.ceil(8 * np.log2(np.maximum(counts, 16) / 16.0) - 1e-9)
    return np.where(counts <= 16, counts, np.minimum(high, 255)).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.int64)
    return np.where(c <= 16, c, np.floor(16 * 2.0 ** ((c - 16) / 8) + 1e-6).astype(np.int64))


def counters_for(entries: int) -> int:
    """A power of two, about one counter for sixteen entries, within the bounds."""
    return min(COUNTERS_MOST, max(COUNTERS_LEAST, 1 << max(0, entries // 16).bit_length()))


def matrix_size(inc: DataFrame) -> int:
    """Entries of the matrix, copies included."""
    return inc.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def column_counts(inc: DataFrame, entries: int) -> np.ndarray:
    """``coded`` rows per hashed column, over all rows. Each task sends its counters by ranges of columns, and every range
    is summed by a task of its own, part by part, so neither the number of tasks nor a hot column matters."""
    size = counters_for(entries)
    ranges = min(4096, max(64, 1 << (4 * cores(inc.sparkSession)).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen, held, waiting = np.zeros(size, np.uint32), set(), [], 0
        for b in rows(batches, ARROW_ROWS, 3):
            _, flat, many, n, _ = _batch_grams(b, seen)
            if len(flat) > n.sum():  # sequences in text order have repeats
                flat |= np.repeat(np.arange(len(many), dtype=np.uint64), many) << np.uint64(BITS)
                flat.sort()
                flat = flat[np.r_[True, flat[1:] != flat[:-1]]] & MASK
            held.append((flat % np.uint64(size)).astype(np.int64))
            waiting += len(flat)
            if waiting >= size:
                sums += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
                held, waiting = [], 0
        if seen:
            sums += np.bincount(np.concatenate(held or [np.empty(0, np.int64)]), minlength=size).astype(np.uint32)
            parts = [zstandard.compress(x.tobytes(), 1) for x in sums.reshape(ranges, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array(parts, pa.binary())], names=["r", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zstandard.decompress(part), np.uint32)
                if r in sums:
                    sums[r] += x
                else:
                    sums[r] = x.astype(np.int64)
        if sums:
            parts = [zstandard.compress(coded(x).tobytes(), 1) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], names=["r", "part"])

    at = inc.select("cls", "side", "n", "grams").mapInArrow(count, "r int, part binary")
    tasks = min(ranges, 4 * cores(inc.sparkSession))
    done = at.repartitionById(tasks, F.col("r") % tasks).mapInArrow(merge, "r int, part binary").collect()  # a byte a counter
    out = np.zeros((ranges, size // ranges), np.uint8)
    for r, part in done:
        out[r] = np.frombuffer(zstandard.decompress(part), np.uint8)
    return out.ravel()


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + LEVEL)


def need(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Least overlap of two sets of these sizes at the threshold."""
    return np.maximum(1, np.ceil(threshold / (1 + threshold) * (na.astype(np.int64) + nb) - 1e-9).astype(np.int64))


def _cut(g: np.ndarray, doc: np.ndarray, cls: np.ndarray, count: np.ndarray, hot: int, half: np.ndarray, *rest: np.ndarray) -> tuple:
    """Entries of columns above ``hot`` go to each cell (i, j), i <= j, of their group i, so that every pair of groups
    meets in one cell and no cell holds more than about twice ``hot`` entries. ``half`` is 1 or 2 in a cell of two groups,
    where entries of one half have met elsewhere, else 0."""
    big = count > hot
    if not big.any():
        return (g, doc, half, *rest)
    parts = -(-count[big] // hot)
    own = mix(cls[doc[big]].view(np.uint64)) % parts.astype(np.uint64)
    rep = np.repeat(np.arange(len(parts)), parts)
    other = (np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.uint64)
    lo, hi = np.minimum(own[rep], other), np.maximum(own[rep], other)
    cell = mix(g[big][rep] ^ mix(lo * np.uint64(1 << 32) + hi + np.uint64(1))) & MASK
    side = np.where(lo == hi, 0, np.where(own[rep] == lo, 1, 2)).astype(np.uint8)
    keep = ~big
    return (np.concatenate([g[keep], cell]), np.concatenate([doc[keep], doc[big][rep]]), np.concatenate([half[keep], side]), *(np.concatenate([x[keep], x[big][rep]]) for x in rest))


def pack_block(g: np.ndarray, doc: np.ndarray, cols: list[np.ndarray], tables: list[np.ndarray]) -> bytes:
    """One block of entries sorted by column, with the rows' own values once per row."""
    order = np.argsort(g, kind="stable")
    used, local = np.unique(doc[order], return_inverse=True)
    parts = [np.diff(g[order], prepend=np.uint64(0)).astype(np.uint64), local.astype(np.uint32), *(c[order] for c in cols), *(t[used] for t in tables)]
    head = np.array([len(g), len(used)], np.int64).tobytes()
    # bytes of equal weight stand together, which compresses far better
    body = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in parts)
    return zstandard.compress(head + body, 1)


def unpack_block(data: bytes, cols: list[np.dtype], tables: list[np.dtype]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    raw = zstandard.decompress(data)
    n, m = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for kind, size in [(np.dtype(np.uint64), n), (np.dtype(np.uint32), n), *((np.dtype(c), n) for c in cols), *((np.dtype(t), m) for t in tables)]:
        width = kind.itemsize * int(size)
        out.append(np.frombuffer(raw, np.uint8, width, at).reshape(kind.itemsize, -1).T.copy().view(kind).ravel())
        at += width
    return np.cumsum(out[0], dtype=np.uint64), out[1], out[2 : 2 + len(cols)], out[2 + len(cols) :]


class Blocks:
    """Collects entries over a task and gives them out as packed blocks."""

    def __init__(self, blocks: int) -> None:
        self.blocks, self.held, self.size, self.rows = blocks, [], 0, 0

    def add(self, g: np.ndarray, doc: np.ndarray, cols: list[np.ndarray], tables: list[np.ndarray]) -> None:
        self.held.append((g, doc + self.rows, cols, tables))
        self.size += len(g)
        self.rows += len(tables[0])

    def flush(self) -> pa.RecordBatch | None:
        if not self.size:
            self.held, self.rows = [], 0
            return None
        g, doc = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        cols, tables = ([np.concatenate(x) for x in zip(*(h[i] for h in self.held))] for i in (2, 3))
        block = (mix(g) % np.uint64(self.blocks)).astype(np.int64)
        ids, packed = [], []
        for x in np.unique(block):
            at = np.flatnonzero(block == x)
            ids.append(int(x))
            packed.append(pack_block(g[at], doc[at], [c[at] for c in cols], tables))
        self.held, self.size, self.rows = [], 0, 0
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], names=["block", "entries"])


def text_order_levels(flat: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For the suffixes of ``flat`` that begin at ``place`` and go on to ``end``: eight bytes, most significant first, that
    hash the 1, 2, 4, ... 64 sequences after the first, and then all the rest. Suffixes that agree on the first j bytes
    agree on 2 ** j sequences (all of them for j = 8), so this order is a suffix order by prefix doubling."""
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(flat), 0x9E3779B97F4A7C15, np.uint64)])
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(flat), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(mix(flat) * power[:-1], dtype=np.uint64)]
        out = np.zeros(len(place), np.uint64)
        for j in range(8):
            a = np.minimum(place + (1 << j), end)
            b = np.minimum(place + (2 << j), end) if j < 7 else end
            h = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)) >> np.uint64(56)
            out = out << np.uint64(8) | np.where(b > a, h, np.uint64(0))
    return out


ENTRY, SUFFIX_ENTRY = [np.uint32, np.uint8], [np.uint32, np.uint8, np.uint32, np.uint64]
ROW, SUFFIX_ROW = [np.int64, np.uint32, np.uint8], [np.int64, np.uint32, np.uint8, np.uint32]


def postings(inc: DataFrame, counts: np.ndarray, threshold: float, entries: int, *, ordered: bool = False) -> DataFrame:
    """Packed column blocks (block int, entries binary) of the rare-first prefix of every row: by entry the rank and the
    half of its cell, by row cls, n and side. With ``ordered`` an entry is a suffix: it also has its place in the text and
    its ``text_order_levels``, and a row its length."""
    spark = inc.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    blocks = max(2 * cores(spark), math.ceil(0.45 * entries / BLOCK_ENTRIES))
    full = entries / len(counts)
    hot = int(max(HOT, 16 * full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, out = shared.value, set(), Blocks(blocks)
        for b in rows(batches, ARROW_ROWS, 3):
            cls, flat, many, n, side = _batch_grams(b, seen)
            if not len(flat):
                continue
            start = np.cumsum(many) - many
            doc = np.repeat(np.arange(len(many)), many)
            comb = flat | table[(flat % np.uint64(len(table))).astype(np.int64)].astype(np.uint64) << np.uint64(BITS)
            # row, count and column in one number: one sort orders every row's columns from rare to common
            comb |= doc.astype(np.uint64) << np.uint64(BITS + 8)
            if ordered:
                order = np.argsort(comb)
                comb = comb[order]
                new = np.flatnonzero(np.r_[True, comb[1:] != comb[:-1]])
                place, comb = np.minimum.reduceat(order, new), comb[new]
            else:
                comb.sort()
            doc = (comb >> np.uint64(BITS + 8)).astype(np.int64)
            rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(many)))[doc]
            code = (comb >> np.uint64(BITS)).astype(np.uint8)
            keep = (rank < prefix_size(n, threshold)[doc]) & (code > 1)
            g, doc, rank, code = comb[keep] & MASK, doc[keep], rank[keep].astype(np.uint32), code[keep]
            if not len(g):
                continue
            cols, tables = [rank], [cls, n.astype(np.uint32), side.astype(np.uint8)]
            if ordered:
                place = place[keep]
                cols += [(place - start[doc]).astype(np.uint32), text_order_levels(flat, (start + many)[doc], place)]
                tables.append(many.astype(np.uint32))
            g, doc, half, rank, *cols = _cut(g, doc, cls, decoded(code), hot, np.zeros(len(g), np.uint8), *cols)
            out.add(g, doc, [rank, half, *cols], tables)
            if out.size >= FLUSH and (batch := out.flush()):
                yield batch
        if batch := out.flush():
            yield batch

    kinds, tables = (SUFFIX_ENTRY, SUFFIX_ROW) if ordered else (ENTRY, ROW)

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches):
            out = Blocks(blocks)
            g, doc, (rank, half, *cols), ts = gather(held, kinds, tables)
            _, which, count = np.unique(g, return_inverse=True, return_counts=True)
            g, doc, half, rank, *cols = _cut(g, doc, ts[0], count[which], 2 * HOT, half, rank, *cols)
            out.add(g, doc, [rank, half, *cols], ts)
            yield out.flush()

    schema = "block int, entries binary"
    made = inc.select("cls", "side", "n", "grams").mapInArrow(run, schema).repartitionById(blocks, F.col("block"))
    if 16 * full > HOT:  # the counters are too full to tell a hot column
        made = made.mapInArrow(recut, schema).repartitionById(blocks, F.col("block"))
    return made


def gather(held: list[bytes], cols: list, tables: list) -> tuple:
    """The entries of one block from all tasks, sorted by column, each row's entries once per column."""
    parts = [unpack_block(x, cols, tables) for x in held]
    base = np.cumsum([0, *(len(p[3][0]) for p in parts)])
    g = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1].astype(np.int64) + k for p, k in zip(parts, base)])
    cs, ts = ([np.concatenate(x) for x in zip(*(p[i] for p in parts))] for i in (2, 3))
    return g, doc, cs, ts


def runs(g: np.ndarray) -> np.ndarray:
    """For each entry the number of entries after it in its run of equal columns."""
    if not len(g):
        return np.empty(0, np.int64)
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    end = np.r_[start[1:], len(g)]
    return np.repeat(end, end - start) - np.arange(len(g)) - 1


def run_pairs(g: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one column, by distance within the run, each cut by ``keep`` at once."""
    after = runs(g)
    live = np.flatnonzero(after > 0)
    step = 1
    while len(live):
        a, b = live, live + step
        ok = keep(a, b)
        if ok.any():
            yield a[ok], b[ok]
        step += 1
        live = live[after[live] >= step]


def _product(threshold: float, cross: bool) -> Callable:
    def block_pairs(held: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        g, doc, (rank, half), (cls, n, side) = gather(held, ENTRY, ROW)
        who = cls[doc]
        order = np.lexsort((who, g))
        # copies sent by several tasks are one entry: a column counts once for each pair
        order = order[np.r_[True, (g[order][1:] != g[order][:-1]) | (who[order][1:] != who[order][:-1])]] if len(order) else order
        g, doc, rank, half, who = g[order], doc[order], rank[order], half[order], who[order]
        size, left = n[doc].astype(np.int64), n[doc].astype(np.int64) - rank

        def keep(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = np.minimum(left[a], left[b]) >= need(size[a], size[b], threshold) - (LEVEL - 1)
            ok &= (half[a] != half[b]) | (half[a] == 0)
            return ok & (side[doc[a]] != side[doc[b]]) if cross else ok

        # pairs are numbered by the place of their rows' classes, and summed while they are made
        uniq, number = np.unique(who, return_inverse=True)
        size_of = np.zeros(len(uniq), np.int64)
        size_of[number] = size
        sums, times, held_pairs, held_n = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def settle() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([sums, *held_pairs])
            weight = np.concatenate([times, np.ones(len(every) - len(sums), np.int64)])
            order = np.argsort(every)
            start = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]]) if len(every) else np.empty(0, np.int64)
            return every[order][start], np.add.reduceat(weight[order], start) if len(start) else weight

        def given() -> tuple[np.ndarray, ...]:
            a, b = sums // len(uniq), sums % len(uniq)
            return uniq[a], uniq[b], times.astype(np.int32), need(size_of[a], size_of[b], threshold).astype(np.int32)

        for a, b in run_pairs(g, keep):
            lo, hi = np.minimum(number[a], number[b]), np.maximum(number[a], number[b])
            held_pairs.append(lo * len(uniq) + hi)
            held_n += len(lo)
            if held_n >= PAIRS_HELD:
                sums, times = settle()
                held_pairs, held_n = [], 0
                if len(sums) >= PAIRS_HELD:
                    yield given()
                    sums, times = sums[:0], times[:0]
        sums, times = settle()
        if len(sums):
            yield given()

    return block_pairs


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """All rows of a partition, block by block."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(k, []).append(x)
    for k in sorted(held):
        yield held.pop(k)


def by_block(work: Callable[[list[bytes]], Iterator[tuple]], names: list[str], kinds: list) -> Callable:
    """A mapInArrow function of the work on each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks_of(batches):
            for found in work(held):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds)], names=names)

    return run


def product(inc: DataFrame, threshold: float, *, cross: bool = False) -> DataFrame:
    """Pairs of classes (ca, cb), ca < cb as stored hashes, that share enough rare columns to be worth comparing."""
    entries = matrix_size(inc)
    work = by_block(_product(threshold, cross), ["ca", "cb", "c", "need"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])
    parts = postings(inc, column_counts(inc, entries), threshold, entries).mapInArrow(work, "ca long, cb long, c int, need int")
    summed = parts.groupBy("ca", "cb").agg(F.sum("c").alias("c"), F.max("need").alias("need"))
    return summed.where(F.col("c") >= F.least(F.lit(LEVEL), F.col("need"))).select("ca", "cb")


def class_table(inc: DataFrame) -> DataFrame:
    """One row per class: cls, grams, rep (its least key) and cnt (its copies)."""
    return inc.groupBy("cls").agg(F.first("grams").alias("grams"), F.min("key").alias("rep"), F.count("*").alias("cnt"))


def membership(inc: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rec_id, class_id, copies, links): every record, the least key of its class, the class's records and how many other
    classes it has a pair with in ``pairs``."""
    reps = inc.groupBy("cls").agg(F.min("key").alias("class_id"), F.count("*").alias("copies"))
    links = pairs.select(F.col("ca").alias("cls")).unionAll(pairs.select("cb")).groupBy("cls").agg(F.count("*").alias("links"))
    known = reps.join(links, "cls", "left")
    return inc.select("cls", F.col("key").alias("rec_id")).join(known, "cls").select("rec_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def covered(x: np.ndarray, shared: np.ndarray, k: int) -> int:
    """Words of the sequence x that lie in spans whose k-word sequences are in ``shared``; spans are merged."""
    hit = np.isin(x, shared)
    reach = np.zeros(len(x) + k - 1, bool)
    for j in range(k):
        reach[j : j + len(x)] |= hit
    return int(reach.sum())


def compare(pairs: DataFrame, inc: DataFrame, threshold: float, *, k: int = 3) -> DataFrame:
    """The pairs whose sets really overlap by the threshold: ca, cb, rep_a, cnt_a, rep_b, cnt_b, similarity, and for
    sequences in text order the words of each side inside shared spans (cover_a, cover_b)."""
    pairs = materialize(pairs, "candidates")
    ids = pairs.select(F.col("ca").alias("cls")).unionAll(pairs.select("cb")).distinct()
    if pairs.count() <= BROADCAST_PAIRS:  # else the classes in no pair fall out after the shuffle
        ids = F.broadcast(ids)
    sets = class_table(inc.join(ids, "cls", "left_semi"))
    a = sets.select(F.col("cls").alias("ca"), F.col("grams").alias("ga"), F.col("rep").alias("rep_a"), F.col("cnt").alias("cnt_a"))
    b = sets.select(F.col("cls").alias("cb"), F.col("grams").alias("gb"), F.col("rep").alias("rep_b"), F.col("cnt").alias("cnt_b"))
    joined = pairs.join(a, "ca").join(b, "cb").select("ca", "cb", "rep_a", "cnt_a", "rep_b", "cnt_b", "ga", "gb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sim, ends = [], [], []
            for i, (x, y) in enumerate(zip(batch.column(6).to_pylist(), batch.column(7).to_pylist())):
                x, y = unpack40(x), unpack40(y)
                p, q = np.unique(x), np.unique(y)
                both = np.intersect1d(p, q, assume_unique=True)
                s = len(both) / (len(p) + len(q) - len(both))
                if s >= threshold - 1e-12:
                    keep.append(i)
                    sim.append(s)
                    ends.append((covered(x, both, k), covered(y, both, k)))
            cols = [batch.column(i).take(pa.array(keep, pa.int64())) for i in range(6)]
            ends = [pa.array([e[j] for e in ends], pa.int32()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sim, pa.float64()), *ends], names=["ca", "cb", "rep_a", "cnt_a", "rep_b", "cnt_b", "similarity", "cover_a", "cover_b"])

    out = joined.mapInArrow(run, "ca long, cb long, rep_a long, cnt_a long, rep_b long, cnt_b long, similarity double, cover_a int, cover_b int")
    out._lexmill_candidates = pairs
    return out


def settled(compared: DataFrame) -> DataFrame:
    """The pairs of ``compare`` as a table; their candidates are no longer needed."""
    out = materialize(compared, "pairs")
    discard(compared._lexmill_candidates)
    return out


def expand(pairs: DataFrame, inc: DataFrame, *, within: bool, cap: int | None = CAP) -> DataFrame:
    """Class pairs to pairs of keys (rec_a < rec_b); ``within`` adds the pairs inside a class.

    With ``cap`` None every pair is listed. Else a class of more than ``cap`` copies isn't multiplied out: each of its
    members is listed with the other class's least key (within the class: with its own), and the other's members with
    its least key. Nothing is lost, as ``membership`` has the class of every key, and the output stays linear in the
    copies."""
    many = class_table(inc).where("cnt > 1").select("cls", "rep", "cnt")
    members = inc.select("cls", "key").join(many, "cls")
    ma, mb = (members.select(F.col("cls").alias(c), F.col("key").alias(k)) for c, k in (("ca", "ka"), ("cb", "kb")))
    small = F.lit(True) if cap is None else (F.col("cnt_a") <= cap) & (F.col("cnt_b") <= cap)
    out = pairs.where(small).join(ma, "ca", "left").join(mb, "cb", "left").select(F.coalesce("ka", "rep_a").alias("x"), F.coalesce("kb", "rep_b").alias("y"))
    if cap is not None:
        big = pairs.where(~small)
        left = big.join(ma, "ca", "left").select(F.coalesce("ka", "rep_a").alias("x"), F.col("rep_b").alias("y"))
        right = big.join(mb, "cb", "left").select(F.col("rep_a").alias("x"), F.coalesce("kb", "rep_b").alias("y"))
        out = out.unionAll(left.unionAll(right).distinct())
    if within:
        own = members if cap is None else members.where(F.col("cnt") <= cap)
        other = own.select("cls", F.col("key").alias("y"))
        out = out.unionAll(own.select("cls", F.col("key").alias("x")).join(other, "cls").where("x < y").select("x", "y"))
        if cap is not None:
            out = out.unionAll(members.where((F.col("cnt") > cap) & (F.col("key") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("key").alias("y")))
    return out.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
