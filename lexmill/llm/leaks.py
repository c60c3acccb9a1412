"""Problem 7: evaluation texts inside the training documents, by pigeonhole edit matching.

The symbols of an item are its N distinct four-word sequences in text order; an error is one of them that a document
doesn't have. At a share of one half the error budget is E = N - ceil(N / 2), so an item falls into E + 1 pieces of one
or two neighbouring sequences (four or five words), and a document within the budget has one piece whole. Such exact
piece hits are looked up; the document's sequences that belong to the item, in document order, are then compared with
the item by Myers' bit-parallel distance. A distance within the budget is a leak, and its end is where the passage
ends. Beyond the budget the passages may only be moved about, which the statement of the problem allows: the same
distance to the sequences put into item order decides that, and rejects the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, rows, sequence_hashes, word_hashes, words

K = 4
SHARE = 0.5
FILTER_BITS = 20
BLOCK_BYTES = 32 << 20
ARROW_ROWS = 2000
FOUND = "item_id long, doc_id long, sequences int, shared int, budget int, distance int, moved boolean, end_word int"


def best_distance(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and the symbols up to that stretch's end (the first
    such). Bit-parallel: a column of the dynamic programme is two integers of len(pattern) bits."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


def error_budget(n: int, share: float = SHARE) -> int:
    """The most of n sequences that may be missing while ``share`` of them or more are there."""
    return n - max(1, math.ceil(share * n - 1e-9))


def verify(n: int, places: list[int], budget: int) -> tuple[int, bool, int] | None:
    """(distance, moved, places up to the end) of an item of n sequences and a document that has those at ``places`` (item
    places in document order), or None beyond the budget. A stretch within the budget has n - budget of the item's
    sequences at least; sequences that are all there in another order are within it once put into item order."""
    pattern = list(range(n))
    distance, end = best_distance(pattern, places)
    if distance <= budget:
        return distance, False, end
    return (distance, True, end) if best_distance(pattern, sorted(set(places)))[0] <= budget else None


class Items:
    """The items' sequences, cut into pieces; the index has one key per piece, its first sequence."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = SHARE) -> None:
        self.ids, self.sequences, self.sorted, self.budget = [], [], [], []
        leads, owner, rest = [], [], []
        for key, text in items:
            g = sequence_hashes(word_hashes(words(text)), K)
            distinct, first = np.unique(g, return_index=True)
            if not len(g):
                continue
            symbols = g[np.sort(first)]
            n = len(symbols)
            budget = error_budget(n, share)
            cuts = [n * i // (budget + 1) for i in range(budget + 2)]
            leads += [symbols[a] for a in cuts[:-1]]
            rest += [symbols[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
            owner += [len(self.ids)] * (budget + 1)
            self.ids.append(key)
            self.sequences.append(symbols)
            self.sorted.append((distinct, np.argsort(np.argsort(first))))
            self.budget.append(budget)
        flat = np.array(leads, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.piece, start = np.unique(flat[order], return_index=True)
        self.start = np.r_[start, len(flat)].astype(np.int64)
        self.owner, size = np.array(owner, np.int64)[order], np.array([len(r) for r in rest], np.int64)
        self.more, self.more_at = np.concatenate([*(rest[i] for i in order), np.empty(0, np.uint64)]), np.r_[0, np.cumsum(size[order])]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.piece >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) where a whole piece of the item is in the document."""
        none = (np.empty(0, np.int64),) * 2
        at = np.flatnonzero(self.filter[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.piece):
            return none
        slot = np.minimum(np.searchsorted(self.piece, g[at]), len(self.piece) - 1)
        ok = self.piece[slot] == g[at]
        pair = np.unique(doc[at[ok]] * len(self.piece) + slot[ok])
        d, slot = pair // len(self.piece), pair % len(self.piece)
        n = self.start[slot + 1] - self.start[slot]
        d, piece = np.repeat(d, n), np.repeat(self.start[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
        # the piece's other sequences
        m = self.more_at[piece + 1] - self.more_at[piece]
        if m.any():
            have = np.isin(doc, d)
            there = np.sort(mix(g[have] ^ mix(doc[have].astype(np.uint64))))
            which = np.repeat(np.arange(len(d)), m)
            asked = self.more[np.repeat(self.more_at[piece] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            asked = mix(asked ^ mix(d[which].astype(np.uint64)))
            to = np.minimum(np.searchsorted(there, asked), len(there) - 1)
            whole = np.ones(len(d), bool)
            whole[which[there[to] != asked]] = False
            d, piece = d[whole], piece[whole]
        both = np.unique(d * len(self.ids) + self.owner[piece])
        return both // len(self.ids), both % len(self.ids)

    def places(self, item: int, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where g has sequences of the item, and which."""
        known, rank = self.sorted[item]
        slot = np.minimum(np.searchsorted(known, g), len(known) - 1)
        at = np.flatnonzero(known[slot] == g)
        return at, rank[slot[at]]


def _scan(items_b) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_b.value
        for b in rows(batches, ARROW_ROWS, 1):
            ids = b.column(0).to_pylist()
            split = [words(t) for t in b.column(1).to_pylist()]
            g = sequence_hashes(word_hashes([w for ws in split for w in ws]), K)
            size = np.array([len(ws) for ws in split])
            start = np.cumsum(size) - size
            doc = np.repeat(np.arange(len(split)), size)
            inside = doc[: len(g)] == doc[K - 1 :] if len(g) else np.empty(0, bool)
            d, item = items.candidates(g[inside], doc[: len(g)][inside])
            out = []
            for x, i in zip(d.tolist(), item.tolist()):
                at, places = items.places(i, g[start[x] : start[x] + size[x] - K + 1])
                n, budget = len(items.sequences[i]), items.budget[i]
                found = verify(n, places.tolist(), budget)
                if found:
                    distance, moved, end = found
                    out.append((items.ids[i], ids[x], n, len(set(places.tolist())), budget, distance, moved, int(at[end - 1]) + K if end else 0))
            if out:
                c = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def leaks(documents: DataFrame, items: DataFrame, *, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """FOUND: the items of which a document has at least ``share`` of the distinct four-word sequences. Items under four
    words and null texts have none; empty tables give no row. ``distance`` counts sequences, in document order;
    ``moved`` marks passages that are within the budget only in another order; ``end_word`` is where the best stretch
    ends in the document.

    The items are the broadcast side, at most ``block_bytes`` of text at a time: more items are taken block after block,
    each with a scan of its own whose rows go into the shared folder, so the driver holds one block."""
    spark = documents.sparkSession
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    docs = documents.select("doc_id", "text").where("text is not null")
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        held = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in part.select("item_id", "text").where("text is not null").orderBy("item_id").collect()], share))
        found = docs.mapInArrow(_scan(held), FOUND)
        if blocks > 1:
            found = materialize(found, "leaks")
            held.destroy()
        out = found if out is None else out.unionAll(found)
    return out
