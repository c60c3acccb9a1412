"""Problem 6: a sample that follows target shares of categories.

The targets are a table of subject by label. Its fractional quotas become integers by controlled rounding: a flow from
subjects over cells to labels, every cell, subject total, label total and the whole within one of its fractional value.
Then each cell gives exactly its quota of records, those with the smallest random keys.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .keyed import random_key, take

SEED = 20


class Network:
    """Maximum flow by shortest augmenting paths, over a network of the size of the target table."""

    def __init__(self, nodes: int) -> None:
        self.to, self.cap, self.out = [], [], [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            came: dict[int, int] = {source: -1}
            queue = deque([source])
            while queue and sink not in came:
                x = queue.popleft()
                for e in self.out[x]:
                    if self.cap[e] > 0 and self.to[e] not in came:
                        came[self.to[e]] = e
                        queue.append(self.to[e])
            if sink not in came:
                return total
            path, x = [], sink
            while came[x] >= 0:
                path.append(came[x])
                x = self.to[came[x] ^ 1]
            step = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= step
                self.cap[e ^ 1] += step
            total += step


def _floor(x: float) -> int:
    return math.floor(x + 1e-9)


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def controlled_rounding(cells: dict[tuple, float]) -> dict[tuple, int]:
    """Integers for the fractional table {(row, column): value}: each cell, row total, column total and the grand total
    is its value rounded down or up (whole values stay). Such a table always exists; the flow finds one."""
    rows, cols = sorted({k[0] for k in cells}, key=repr), sorted({k[1] for k in cells}, key=repr)
    r_of, c_of = ({v: i for i, v in enumerate(x)} for x in (rows, cols))
    # nodes: 0 source, 1 sink, 2 and 3 those of the lower bounds, then rows, then columns
    net, base = Network(4 + len(rows) + len(cols)), 4 + len(rows)
    owed: dict[int, int] = {}

    def bounded(a: int, b: int, value: float) -> tuple[int, int]:
        low = _floor(value)
        owed[b], owed[a] = owed.get(b, 0) + low, owed.get(a, 0) - low
        return net.edge(a, b, _ceil(value) - low), low

    edges = {k: bounded(4 + r_of[k[0]], base + c_of[k[1]], v) for k, v in cells.items()}
    for r in rows:
        bounded(0, 4 + r_of[r], sum(v for k, v in cells.items() if k[0] == r))
    for c in cols:
        bounded(base + c_of[c], 1, sum(v for k, v in cells.items() if k[1] == c))
    bounded(1, 0, sum(cells.values()))
    need = 0
    for node, x in owed.items():
        if x > 0:
            net.edge(2, node, x)
            need += x
        elif x < 0:
            net.edge(node, 3, -x)
    if net.run(2, 3) != need:
        raise ArithmeticError("no rounding within the bounds")
    return {k: low + net.cap[e ^ 1] for k, (e, low) in edges.items()}


def letters(column: str) -> F.Column:
    return F.lower(F.regexp_replace(column, r"[^\p{L}]", ""))


def usable_records(news: DataFrame) -> DataFrame:
    """(id, rec_id, subject_key, label, key): records with text and subject that aren't blank and a label, one per id
    (the last loaded, then the largest rec_id). A null id is a record of its own."""
    there = news.where(F.col("text").rlike(r"(?U)\S") & F.col("subject").rlike(r"(?U)\S") & F.col("label").isNotNull())
    rows = there.select(F.coalesce("id", F.concat(F.lit("\0"), F.col("rec_id"))).alias("id"), "rec_id", letters("subject").alias("subject_key"), "label", "loaded_at")
    last = F.max_by(F.struct("rec_id", "subject_key", "label"), F.struct("loaded_at", "rec_id")).alias("r")
    one = rows.groupBy("id").agg(last).select("id", "r.*")
    return one.withColumn("key", random_key("id", SEED))


def plan(news: DataFrame, targets: DataFrame, share: float = 0.2) -> tuple[DataFrame, list[dict], dict[int, int]]:
    """(usable records with their cell, one report row per target, quota by cell). The targets are the small, stated side:
    per cell one count comes to the driver."""
    wanted = [r.asDict() for r in targets.select("subject", letters("subject").alias("subject_key"), "label", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("min_rows", F.lit(0)).alias("min_rows")).collect()]
    keys = sorted({(w["subject_key"] or "", -1 if w["label"] is None else w["label"]) for w in wanted})
    cell_of = {k: i for i, k in enumerate(keys)}
    spark = news.sparkSession
    usable = materialize(usable_records(news), "usable")
    table = spark.createDataFrame([(*k, i) for k, i in cell_of.items()], "subject_key string, label int, cell int")
    rows = usable.join(F.broadcast(table), ["subject_key", "label"])
    n = int(math.floor(usable.count() * share + 1e-9))
    counted = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # one row a target
    have = {i: counted.get(i, 0) for i in cell_of.values()}
    asked = {k: 0.0 for k in keys}
    least = {k: 0 for k in keys}
    for w in wanted:
        k = (w["subject_key"] or "", -1 if w["label"] is None else w["label"])
        w["cell"], w["target_rows"] = cell_of[k], w["target_share"] * n
        asked[k] += w["target_rows"]
        least[k] = max(least[k], w["min_rows"])
    goal = {k: min(float(have[cell_of[k]]), max(asked[k], float(least[k]))) for k in keys}
    quota = controlled_rounding(goal) if goal else {}
    return rows, wanted, {cell_of[k]: q for k, q in quota.items()}


def drawn(rows: DataFrame, quota: dict[int, int]) -> DataFrame:
    """The sample of ``plan``'s rows: in each cell exactly its quota."""
    table = rows.sparkSession.createDataFrame(list(quota.items()), "cell int, quota long")
    return take(rows, table.where("quota > 0"))


REPORT = "subject string, label int, target_share double, min_rows int, target_rows double, available long, quota long, reached long, short boolean"


def report(news: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: the rows asked for, usable records, quota after rounding, the rows the sample really has, and
    whether it falls short: it took every usable record of the category and still has fewer than asked for or than the
    minimum. A target nobody can meet (unknown subject, null label) reaches 0; so do all of an empty news table."""
    rows, wanted, quota = plan(news, targets)
    spark = news.sparkSession
    reached = drawn(rows, quota).groupBy("cell").agg(F.count("*").alias("reached"))
    have = rows.groupBy("cell").agg(F.count("*").alias("available"))
    names = ["subject", "label", "target_share", "min_rows", "target_rows", "cell"]
    table = spark.createDataFrame([(*(w[c] for c in names), quota[w["cell"]]) for w in wanted], "subject string, label int, target_share double, min_rows int, target_rows double, cell int, quota long")
    both = table.join(F.broadcast(have), "cell", "left").join(F.broadcast(reached), "cell", "left")  # a row a target
    full = both.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("reached", F.coalesce("reached", F.lit(0)))
    short = (F.col("reached") >= F.col("available")) & ((F.col("reached") < F.col("target_rows")) | (F.col("reached") < F.col("min_rows")))
    return full.withColumn("short", short).select(*[f.split()[0] for f in REPORT.split(", ")])


def sample(news: DataFrame, targets: DataFrame) -> DataFrame:
    """(rec_id, id, subject_key, label) of the sample: in each cell exactly its quota of usable records."""
    rows, _, quota = plan(news, targets)
    return drawn(rows, quota).select("rec_id", "id", "subject_key", "label")
