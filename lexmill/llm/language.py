"""Problem 9: the language of every document and of each segment of a mixed one.

A bidirectional gated recurrent network over bytes (``bytes_gru``) is trained on a bounded sample of labelled documents
and gives every byte of the lower-cased text a probability for each language. Probabilities are pooled over units (sentences, roughly); the best
path over a document's units, with a price for each change, gives stretches, and stretches under the least size fall out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytes_gru import Network
from .common import rows, shared_dir, spread
from .langs import CODES, UNKNOWN, label_code

SAMPLE_PER_LANGUAGE = 400
SAMPLE_CHARS = 1200
STEPS, LANES, WINDOW = 800, 128, 72
LEAST_WORDS, LEAST_CHARS = 15, 40
UNSPACED = frozenset({"ja", "th", "zh"})
# a change of language costs SWITCH; sums of log-probabilities are divided by PER_STEPS, as neighbouring steps tell much the
# same; a stretch's language must lead the next by LEAD a step (two bytes)
SWITCH, PER_STEPS, LEAD = 6.0, 3.0, 0.2
MODEL = "language_1"
# of a training: share of its steps, rate, share of those averaged; texts are cleaned after each
PHASES = ((0.25, 0.01, 0.3), (0.25, 0.006, 0.3), (0.5, 0.006, 0.5))
BATCH_BYTES = 1_500_000
LETTER = regex.compile(r"\p{L}")
WORDS = re.compile(r"[^\W\d_]\S*")  # from a word's first letter on
UNSPACED_SCRIPTS = r"\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}"
# a unit ends after closing punctuation before white space, at line breaks, after full-width stops, and at white space
# beside a script that has none between words (in Thai it stands between sentences)
UNIT_END = regex.compile(rf"[.!?;…।][\"'”“»)\]]*\s+|[。！？][”」』]*|\n+|(?<=[{UNSPACED_SCRIPTS}])[^\S\n]+|[^\S\n]+(?=[{UNSPACED_SCRIPTS}])", regex.V1)
ASCII_END = re.compile(r"[.!?;][\"')\]]*\s+|\n+")
SEGMENTS = "doc_id long, seg_no int, segments int, lang string, confidence double, start int, words int, label string, missing boolean"


def training_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(language, text) of at most ``per_language`` different texts that a label of each language names, the same ones
    whatever the order of rows and however many copies a text has; long texts give their first SAMPLE_CHARS characters.
    This bounded sample only fits the network; every document is then scored as a whole."""
    named = documents.select(label_code(F.col("lang")).alias("code"), F.xxhash64("text").alias("h"), "text").where("code is not null and length(text) > 40")
    order = Window.partitionBy("code").orderBy(F.xxhash64("h", F.lit(9)), "h")
    chosen = named.select("code", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    # at most per_language rows a language
    rows = named.join(F.broadcast(chosen), ["code", "h"]).groupBy("code", "r").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("t"))
    return [(r[0], r[2]) for r in rows.orderBy("code", "r").collect()]


class Windows:
    """Draws training windows: every language equally often, half of them two stretches of two languages."""

    def __init__(self, sample: list[tuple[str, str]], seed: int = 90) -> None:
        self.rng = np.random.default_rng(seed)
        self.texts: list[list[np.ndarray]] = [[] for _ in CODES]
        self.units: list[list[list[bytes]]] = [[] for _ in CODES]
        for code, text in sample:
            at = _unit_starts(text)
            units = [text[a:b].lower().encode("utf-8", "replace") for a, b in zip(at, [*at[1:], len(text)])]
            self.units[CODES.index(code)].append(units)
            self.texts[CODES.index(code)].append(np.frombuffer(b"".join(units), np.uint8))
        self.known = [i for i, t in enumerate(self.texts) if t]

    def stretch(self, size: int) -> tuple[np.ndarray, int]:
        code = self.known[self.rng.integers(len(self.known))]
        text = self.texts[code][self.rng.integers(len(self.texts[code]))]
        at = self.rng.integers(max(1, len(text) - size + 1))
        out = np.full(size, 32, np.uint8)
        piece = text[at : at + size]
        out[: len(piece)] = piece
        return out, code

    def draw(self) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.empty((LANES, WINDOW), np.uint8), np.empty((LANES, WINDOW), np.int64)
        for i in range(LANES):
            cut = int(self.rng.integers(WINDOW // 4, 3 * WINDOW // 4)) if i % 2 else WINDOW
            for a, b in ((0, cut), (cut, WINDOW)):
                if b > a:
                    x[i, a:b], y[i, a:b] = self.stretch(b - a)
        return np.ascontiguousarray(x.T), np.ascontiguousarray(y[:, ::2].T)

    def drop_doubtful(self, net: Network) -> None:
        """Leaves out the texts whose pooled language isn't their label (mislabelled ones), and of the others the units of
        another language (mixed ones), unless a language would lose more than half of its bytes."""
        for code in self.known:
            units = self.units[code]
            flat = np.frombuffer(b"".join(u for us in units for u in us), np.uint8)
            size = np.array([len(u) for us in units for u in us])
            start, many = np.cumsum(size) - size, np.array([len(us) for us in units])
            first = np.cumsum(many) - many
            scores = net.unit_scores(flat, start, len(start), start[first])
            right = np.add.reduceat(scores, first).argmax(1) == code
            best = scores.argmax(1) == code
            kept = [b"".join(u for u, x in zip(us, best[at:]) if x) if ok else b"" for us, at, ok in zip(units, first, right)]
            if 2 * sum(map(len, kept)) >= len(flat):
                self.texts[code] = [np.frombuffer(t, np.uint8) for t in kept if len(t) > 1]


_trained: dict[str, Network] = {}


def sample_digest(sample: list[tuple[str, str]], steps: int) -> str:
    return f"{xxhash.xxh3_64_hexdigest(chr(0).join(f'{c}{chr(1)}{t}' for c, t in sample))}_{steps}"


def fitted(sample: list[tuple[str, str]], steps: int = STEPS) -> Network:
    net, windows = Network(len(CODES)), Windows(sample)
    if windows.known:
        # soon enough that wrong labels aren't learnt by heart, and once more
        for part, rate, averaged in PHASES:
            net.train(windows.draw, int(steps * part), rate, averaged)
            windows.drop_doubtful(net)
    return net


def train(spark: SparkSession, sample: list[tuple[str, str]], steps: int = STEPS) -> Network:
    """The network for a sample: its weights are kept as a table of the shared folder, named by version and sample, so a
    sample is trained on once; and held by the process."""
    name = f"{MODEL}_{sample_digest(sample, steps)}"
    if name in _trained:
        return _trained[name]
    path, net = f"{shared_dir(spark)}/{name}", Network(len(CODES))
    try:
        rows = sorted((r[0], r[1]) for r in spark.read.schema("i int, weights string").parquet(path).collect())  # 17 arrays
    except AnalysisException:
        rows = []
    if len(rows) == len(net.arrays()):
        for p, (_, w) in zip(net.arrays(), rows):
            p[...] = np.frombuffer(base64.b64decode(w), np.float32).reshape(p.shape)
    else:
        net = fitted(sample, steps)
        table = [(i, base64.b64encode(np.ascontiguousarray(p, np.float32).tobytes()).decode()) for i, p in enumerate(net.arrays())]
        spark.createDataFrame(table, "i int, weights string").coalesce(1).write.mode("overwrite").parquet(path)
    _trained.clear()
    _trained[name] = net
    return net


def path(scores: np.ndarray) -> np.ndarray:
    """The best language of each unit, a change of language costing SWITCH; scores (units, languages)."""
    best = scores.argmax(1)
    if (best == best[0]).all():
        return best
    total, came = scores[0], np.zeros(scores.shape, np.int64)
    for i in range(1, len(scores)):
        top = int(total.argmax())
        stay = total >= total[top] - SWITCH
        came[i] = np.where(stay, np.arange(scores.shape[1]), top)
        total = np.where(stay, total, total[top] - SWITCH) + scores[i]
    out = np.empty(len(scores), np.int64)
    out[-1] = total.argmax()
    for i in range(len(scores) - 1, 0, -1):
        out[i - 1] = came[i][out[i]]
    return out


def stretches(best: np.ndarray, scores: np.ndarray, size: list[tuple[int, int, int]], least_words: int, least_chars: int) -> list[list]:
    """[language, first unit, words, characters, steps, score sums] of stretches of the least size or more; a document with
    none keeps its longest, and neighbours of one language that a dropped stretch parted are joined. ``size`` has each
    unit's words, characters and steps."""
    out: list[list] = []
    for i, code in enumerate(best.tolist()):
        if out and out[-1][0] == code:
            s = out[-1]
            s[2:] = s[2] + size[i][0], s[3] + size[i][1], s[4] + size[i][2], s[5] + scores[i]
        else:
            out.append([code, i, *size[i], scores[i].copy()])

    def measure(s: list) -> float:
        """Below 1 for a stretch too small, or whose language leads the next by less than LEAD a step."""
        lead = (s[5][s[0]] - np.delete(s[5], s[0]).max()) * PER_STEPS / max(1, s[4])
        return min(lead / LEAD, s[3] / least_chars if CODES[s[0]] in UNSPACED else s[2] / least_words)

    while len(out) > 1:
        k = min(range(len(out)), key=lambda j: (measure(out[j]), -j))
        if measure(out[k]) >= 1:
            break
        out.pop(k)
        if 0 < k < len(out) and out[k - 1][0] == out[k][0]:
            a, b = out[k - 1], out.pop(k)
            a[2:] = [x + y for x, y in zip(a[2:], b[2:])]
    return out


def _unit_starts(text: str) -> list[int]:
    """The units' first characters."""
    starts = [0, *(m.end() for m in (ASCII_END if text.isascii() else UNIT_END).finditer(text))]
    return starts if starts[-1] < len(text) else starts[:-1]


def _size(piece: str, size: int) -> tuple[int, int, int]:
    """Words with a letter, characters without spaces, and steps of ``size`` bytes."""
    return (len(WORDS.findall(piece)), sum(map(len, piece.split())), size // 2) if len(piece) > 1 else (0, 0, 0)


def _score_texts(net: Network, texts: list[str]) -> list[list[tuple]]:
    """For each text its segments (language, confidence, first character, words)."""
    starts, data, at, places, first = [], [], 0, [], []
    for text in texts:
        units = _unit_starts(text)
        places.append(units)
        first.append(len(starts))
        if text.isascii():
            raw = text.lower().encode()
            starts += [at + u for u in units]
        else:
            pieces = [text[a:b].lower().encode("utf-8", "replace") for a, b in zip(units, [*units[1:], len(text)])]
            raw = b"".join(pieces)
            to = at
            for x in pieces:
                starts.append(to)
                to += len(x)
        data.append(raw)
        at += len(raw)
    out: list[list[tuple]] = []
    if not starts:
        return [[] for _ in texts]
    starts_a, ends = np.array(starts), np.r_[np.array(starts[1:], np.int64), at]
    some = [f for f, units in zip(first, places) if units]
    scores = net.unit_scores(np.frombuffer(b"".join(data), np.uint8), starts_a, len(starts), starts_a[some]) / PER_STEPS
    for text, units, s in zip(texts, places, first):
        if not units:
            out.append([])
            continue
        own = scores[s : s + len(units)]
        best = path(own)
        if (best == best[0]).all():
            found = [[int(best[0]), 0, len(WORDS.findall(text)), 0, 0, own.sum(0)]]
        else:
            sizes = [_size(text[a:b], n) for a, b, n in zip(units, [*units[1:], len(text)], (ends[s : s + len(units)] - starts_a[s : s + len(units)]).tolist())]
            found = stretches(best, own, sizes, LEAST_WORDS, LEAST_CHARS)
        result = []
        for code, i, n_words, _, _, total in found:
            p = np.exp((total - total.max()) / max(1.0, len(own)))
            result.append((CODES[code], float(p[code] / p.sum()), units[i] if result else 0, n_words))
        out.append(result)
    return out


def segments(documents: DataFrame, **training: int) -> DataFrame:
    """SEGMENTS: one row per document and segment in text order, with the language, a confidence in (0, 1], the segment's
    first character and words, and what the document's own label names (null if nothing) or whether it is missing.
    Null and wordless texts have no row; an empty table gives none. Only (doc_id, lang, text) are read."""
    label = F.lower(F.trim("lang"))
    mine = documents.select("doc_id", "text", label_code(F.col("lang")).alias("label"), (F.col("lang").isNull() | label.isin(*UNKNOWN)).alias("missing"))
    weights = documents.sparkSession.sparkContext.broadcast(train(documents.sparkSession, training_sample(documents, **training)))

    def give(net: Network, held: list[tuple]) -> pa.RecordBatch:
        out = []
        at: dict[str, int] = {}
        which = [at.setdefault(h[1], len(at)) for h in held]  # copies are scored once
        scored = _score_texts(net, list(at))
        for (doc, _, label, missing), i in zip(held, which):
            found = scored[i]
            out += [(doc, i, len(found), *f, label, missing) for i, f in enumerate(found, 1)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
        cols = list(zip(*out)) or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, held, size = weights.value, [], 0
        for b in rows(batches, 500, 1):
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if row[1] and LETTER.search(row[1]):
                    held.append(row)
                    size += len(row[1])
                    if size >= BATCH_BYTES:
                        yield give(net, held)
                        held, size = [], 0
        if held:
            yield give(net, held)

    return spread(mine.where("text is not null"), "doc_id", "text").mapInArrow(run, SEGMENTS)


def cases(found: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang) of the documents whose label is missing or wrong and of all with several segments."""
    wrong = F.col("missing") | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.where((F.col("segments") > 1) | wrong).select("doc_id", "seg_no", "lang")
