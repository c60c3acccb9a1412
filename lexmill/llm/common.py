"""What the operators share: Arrow helpers, word splitting and sequence hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.shared import clean_up, discard, materialize, shared_dir  # noqa: F401

_NOT_WORD = regex.compile(r"[^\p{L}\p{M}\p{N}\s]+")
_ASCII_DROP = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))
_ASCII_LOWER = bytes(ord(chr(c).lower()) if c < 128 else c for c in range(256))


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over three partitions a core at least, for work that costs far more than moving its rows: a few large files give
    too few tasks. Where there are enough partitions nothing is shuffled."""
    wanted = 3 * cores(df.sparkSession)
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, F.xxhash64(*keys))


def words(text: str | None) -> list[str]:
    """NFKC, lower case, only letters, marks, numbers and white space kept, split at white space. Null has no word."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII_LOWER, _ASCII_DROP).decode().split()
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", text).lower()).split()


def word_hashes(flat: list[str]) -> np.ndarray:
    """64-bit hash of each word; every distinct word is hashed once."""
    if not flat:
        return np.empty(0, np.uint64)
    codes, uniq = pd.factorize(np.array(flat, dtype=object))
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in uniq), np.uint64, len(uniq))[codes]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; len(h) - k + 1 of them (none if fewer words)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[j : len(h) - k + 1 + j] + np.uint64(j + 1))
    return mix(out)


def rows(batches: Iterator[pa.RecordBatch], size: int, text: int | None = None, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``size`` rows and, by the bytes of column ``text``, to about ``most`` bytes (a row at
    least), so that very long texts come few at a time."""
    for b in batches:
        if text is None:
            ends = None
        else:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = min(at + size, b.num_rows)
            if ends is not None:
                before = ends[at - 1] if at else 0
                to = max(at + 1, min(to, int(np.searchsorted(ends, before + most, "right"))))
            yield b.slice(at, to - at)
            at = to
