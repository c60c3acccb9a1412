"""Problem 8: a mix of sources with target shares of its tokens.

Token counts are summed by cell of source, language and kind, and raked (iterative proportional fitting) to the
sources' target tokens and to the collection's shares of languages and kinds, no source's tokens above its cap. A
cell's weight over its tokens is the expected number of times its documents are taken: the whole part for all, the rest
by a random key whose threshold is calibrated on the tokens under it.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import os
import shutil
import tempfile
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, rows
from .keyed import BUCKETS, bucket, random_key
from .langs import label_code

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEED = 80
CELLS_MAX = 100_000
AXES = ("source", "language", "kind")
COUNTED = "doc_id long, source_key string, language string, kind_key string, tokens long"


@lru_cache(2)
def encoding(ranks_path: str, pattern_path: str):
    """The tokenizer of a rank file and the module that has its pattern, once a worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_pattern", pattern_path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship_tokenizer(spark: SparkSession, path: str) -> tuple[str, str]:
    """Sends the driver's rank file and the pattern beside it to all executors, once a context; their names there."""
    mark = "lexmill_" + hashlib.sha256(path.encode()).hexdigest()[:12]
    names = (mark + ".ranks", mark + "_pattern.py")
    context = spark.sparkContext
    sent = getattr(context, "_lexmill_files", set())
    if mark not in sent:
        folder = tempfile.mkdtemp(prefix="lexmill_")  # the driver's own, only until the files are sent
        for source, name in zip((path, os.path.join(os.path.dirname(path), "__init__.py")), names):
            shutil.copy(source, os.path.join(folder, name))
            context.addFile(os.path.join(folder, name))
        context._lexmill_files = sent | {mark}
    return names


def source_key(column: str) -> F.Column:
    return F.lower(F.trim(column))


def token_counts(documents: DataFrame, listed: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """COUNTED for the documents of listed sources; a null text has 0 tokens."""

    shipped = ship_tokenizer(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 2000, 4):
            encode = encoding(*map(SparkFiles.get, shipped)).encode_ordinary
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(4).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), n], names=["doc_id", "source_key", "language", "kind_key", "tokens"])

    language, kind = F.coalesce(label_code(F.col("lang")), F.lit("unknown")), F.coalesce(F.lower(F.trim("kind")), F.lit("unknown"))
    mine = documents.select("doc_id", source_key("source").alias("source_key"), language.alias("language"), kind.alias("kind_key"), "text")
    return mine.where(F.col("source_key").isin(listed)).mapInArrow(run, COUNTED)


def rake(have: dict[tuple, float], targets: list[dict], caps: dict, rounds: int = 1000, tolerance: float = 1e-7) -> tuple[dict[tuple, float], bool]:
    """(weights of the cells {(source, language, kind): tokens}, whether they settled within ``rounds``), by proportional
    fitting to each margin's targets in turn, the sources last; a cell stays within its source's cap of repeats. Margins
    that the caps make unreachable are met as far as they allow: a source whose target is beyond its tokens times its cap
    has every cell at the cap exactly."""
    w, settled = dict(have), False
    for _ in range(rounds):
        before = dict(w)
        for axis in (1, 2, 0):
            sums: dict = {}
            for k, x in w.items():
                sums[k[axis]] = sums.get(k[axis], 0.0) + x
            for k, x in w.items():
                goal = targets[axis].get(k[axis])
                if goal is not None and sums[k[axis]] > 0:
                    w[k] = min(x * goal / sums[k[axis]], have[k] * caps[k[0]])
        # settled once a whole round moves nothing
        if sum(abs(w[k] - before[k]) for k in w) <= tolerance * sum(have.values()):
            settled = True
            break
    # what caps took from a source's cells, its others take up
    for source, goal in targets[0].items():
        mine = [k for k in w if k[0] == source]
        if goal >= sum(have[k] for k in mine) * caps[source]:
            w.update((k, have[k] * caps[source]) for k in mine)
            continue
        for _ in range(len(mine)):
            lack = goal - sum(w[k] for k in mine)
            free = [k for k in mine if w[k] < have[k] * caps[source] * (1 - 1e-12)]
            if lack <= 1e-6 * max(goal, 1) or not free:
                break
            room = sum(w[k] for k in free)
            for k in free:
                w[k] = min(have[k] * caps[source], w[k] + lack * (w[k] / room if room > 0 else 1 / len(free)))
    return w, settled


def weights_of(source_weights: DataFrame) -> list[dict]:
    rows = source_weights.select("source", source_key("source").alias("key"), F.coalesce("target_weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("cap")).where("source is not null")
    return [r.asDict() for r in rows.collect()]  # the stated table of targets


def plan(documents: DataFrame, source_weights: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[dict], dict, list[dict]]:
    """(token counts by document, listed sources with their target tokens, {cell: (tokens, raked weight)}, target tokens of
    each value by axis). Fails where more than CELLS_MAX cells of source, language and kind would come to the driver."""
    wanted = weights_of(source_weights)
    counted = materialize(token_counts(documents, sorted({w["key"] for w in wanted}), tokenizer), "tokens")
    cells = counted.groupBy("source_key", "language", "kind_key").agg(F.sum("tokens").alias("tokens")).limit(CELLS_MAX + 1).collect()
    if len(cells) > CELLS_MAX:
        raise ValueError(f"more than {CELLS_MAX} cells of source, language and kind")
    have = {(r[0], r[1], r[2]): float(r[3]) for r in sorted(cells) if r[3]}
    total = sum(have.values())
    sums: list[dict] = [{}, {}, {}]
    for k, x in have.items():
        for axis in range(3):
            sums[axis][k[axis]] = sums[axis].get(k[axis], 0.0) + x
    caps: dict = {}
    goals: dict = {}
    for w in wanted:
        caps[w["key"]] = max(caps.get(w["key"], 0), w["cap"])
        goals[w["key"]] = goals.get(w["key"], 0.0) + w["weight"] * total
    for w in wanted:
        w["target_tokens"] = w["weight"] * total
    reachable = {s: min(g, sums[0].get(s, 0.0) * caps[s]) for s, g in goals.items()}
    size = sum(reachable.values())
    margins = [{k: x / total * size for k, x in sums[axis].items()} if total else {} for axis in (1, 2)]
    weights, settled = rake(have, [reachable, *margins], caps)
    if not settled:
        warnings.warn("raking stopped before the margins settled; p8_margins shows what is reached", stacklevel=2)
    return counted, wanted, {k: (have[k], x) for k, x in weights.items()}, [goals, *margins]


CELLS = "source_key string, language string, kind_key string, cell int, whole int, part double"


def _copies(counted: DataFrame, cells: dict) -> DataFrame:
    """COUNTED with copies: how often each document is taken. A cell's threshold is the first bucket of keys whose tokens
    would go more than half beyond what is left; the histogram of buckets stays a table."""
    parts = {k: divmod(w / have, 1.0) for k, (have, w) in cells.items()}
    table = counted.sparkSession.createDataFrame([(*k, i, int(whole), part * cells[k][0]) for i, (k, (whole, part)) in enumerate(parts.items())], CELLS)
    # at most CELLS_MAX cells
    at = counted.join(F.broadcast(table), ["source_key", "language", "kind_key"]).withColumn("b", bucket(random_key("doc_id", SEED)))
    sizes = at.groupBy("cell", "part", "b").agg(F.sum("tokens").alias("here"))
    order = Window.partitionBy("cell").orderBy("b")  # at most BUCKETS rows a cell
    run = sizes.withColumn("sofar", F.sum("here").over(order))
    beyond = F.col("part") - F.col("sofar") + F.col("here") < F.col("here") / 2
    cuts = run.groupBy("cell").agg(F.coalesce(F.min(F.when(beyond, F.col("b"))), F.lit(BUCKETS)).alias("cut"))
    extra = F.when(F.col("b") < F.col("cut"), 1).otherwise(0)
    return at.join(F.broadcast(cuts), "cell").select("doc_id", "source_key", "language", "kind_key", "tokens", (F.col("whole") + extra).alias("copies"))


def mix(documents: DataFrame, source_weights: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source_key, tokens, copies) of the documents taken, copies being 1 up to the source's cap. Documents of
    no listed source, and texts without tokens, aren't taken."""
    counted, _, cells, _ = plan(documents, source_weights, tokenizer)
    return _copies(counted, cells).where("copies > 0 and tokens > 0").select("doc_id", "source_key", "tokens", "copies")


REPORT = "source string, target_weight double, max_repeats int, tokens long, taken long, short boolean, reached_share double"


def report(documents: DataFrame, source_weights: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """REPORT, a row per listed source: its tokens, those of the mix, its reached share, and whether it falls short: the
    mix repeats all of its documents up to its cap and still has fewer tokens of it than its target."""
    counted, wanted, cells, _ = plan(documents, source_weights, tokenizer)
    spark = documents.sparkSession
    taken = _copies(counted, cells).groupBy("source_key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"))
    have = counted.groupBy("source_key").agg(F.sum("tokens").alias("tokens"))
    goal = spark.createDataFrame([(w["source"], w["key"], float(w["weight"]), int(w["cap"]), float(w["target_tokens"])) for w in wanted], "source string, source_key string, target_weight double, max_repeats int, target_tokens double")
    joined = goal.join(have, "source_key", "left").join(taken, "source_key", "left")
    full = joined.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("taken", F.coalesce("taken", F.lit(0)))
    short = (F.col("taken") >= F.col("tokens") * F.col("max_repeats")) & (F.col("taken") < F.col("target_tokens"))
    total = taken.agg(F.sum("taken").alias("t")).scalar()
    return full.select("source", "target_weight", "max_repeats", "tokens", "taken", short.alias("short"), F.round(F.col("taken") / total, 6).alias("reached_share"))


def margins(documents: DataFrame, source_weights: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(axis, value, target_share, reached_share): what the mix has of each source, language and kind."""
    counted, _, cells, goals = plan(documents, source_weights, tokenizer)
    spark = documents.sparkSession
    wanted = [(name, value, x / (sum(goal.values()) or 1.0)) for name, goal in zip(AXES, goals) for value, x in goal.items()]
    table = spark.createDataFrame(wanted, "axis string, value string, target_share double")
    each = _copies(counted, cells).select(F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(c).alias("value")) for n, c in zip(AXES, ("source_key", "language", "kind_key"))])).alias("m"), (F.col("tokens") * F.col("copies")).alias("t"))
    taken = each.groupBy("m.axis", "m.value").agg(F.sum("t").alias("taken"))
    total = taken.where("axis = 'source'").agg(F.sum("taken")).scalar()
    return table.join(taken, ["axis", "value"], "left").select("axis", "value", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce("taken", F.lit(0)) / total, 6).alias("reached_share"))


def short_sources(documents: DataFrame, source_weights: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source) of the sources that fall short in the mix (``report``)."""
    return report(documents, source_weights, tokenizer).where("short").select("source")
