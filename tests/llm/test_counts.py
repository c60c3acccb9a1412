"""Term counts and top items against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexmill.llm import term_counts as C
from lexmill.llm import top_items as I


def test_term_rule():
    assert C.terms("Don't re-use Café x2 zu​sammen ไทย") == ["don", "t", "re", "use", "café", "x", "zusammen", "ไทย"]
    assert C.terms(None) == [] and C.terms("12 — 34") == []


@pytest.mark.parametrize("seed", range(4))
def test_bitmaps_round_trip(seed):
    rng = np.random.default_rng(seed)
    card = rng.integers(1, 200, 60)
    ids = [np.sort(rng.choice(1 << (8 if i % 3 else 20), n, replace=False)) for i, n in enumerate(card)]
    occ = card + rng.integers(0, 1000, 60)
    names, c, o, x = C.unpack_bitmaps(C.pack_bitmaps([f"t{i}" for i in range(60)], card, occ, np.concatenate(ids)))
    assert names == [f"t{i}" for i in range(60)]
    assert (c == card).all() and (o == occ).all() and (x == np.concatenate(ids)).all()


def test_counts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(0)
    vocab = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    rows = [(i * 700_000, " ".join(["the"] + rng.choices(vocab, k=rng.randrange(0, 30))), "clash") for i in range(200)] + [(7, None, None), (8, "", None), (9, "12 ?", None)]
    df = spark.createDataFrame(rows, "rec_id long, text string, term string").repartition(5)
    monkeypatch.setattr(C, "FLUSH", 500)
    words = spark.createDataFrame([(1, " Au "), (2, "zebra"), (3, None), (4, " "), (5, "zebra")], "idx int, term string")
    got = {r["term"]: r for r in C.marked(df, words).collect()}
    occ, docs = Counter(), Counter()
    for _, t, _ in rows:
        found = C.terms(t)
        occ.update(found)
        docs.update(set(found))
    assert {t: (r["occurrences"], r["records"]) for t, r in got.items() if r["records"]} == {t: (occ[t], docs[t]) for t in occ}
    assert got["zebra"]["band"] == "unused" and got["the"]["band"] == "common" and set(got) == {*occ, "zebra"}
    assert all(r["band"] == "rare" for t, r in got.items() if 0 < docs[t] <= 2)
    assert C.marked(df.limit(0), words.limit(0)).count() == 0


def brute_top(rows, n):
    best = defaultdict(dict)
    for s, q, d, x in rows:
        best[(s, q)][d] = max(x, best[(s, q)].get(d, 0))
    out = []
    for (s, q), docs in best.items():
        order = sorted(docs, key=lambda d: (-docs[d], d))[:n]
        out += [(s, q, i, d, docs[d]) for i, d in enumerate(order, 1)]
    return sorted(out, key=repr)


def test_top_items_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["tf", "tf_idf", None]), 1 if rng.random() < 0.4 else rng.randrange(200), rng.randrange(300), round(rng.random(), 2)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "scheme string, qid long, doc_id long, similitud double").withColumn("pos", F.lit("clash"))
    for files in (1, 7):
        got = I.top_items(df, 5, files=files, row_group_bytes=4096)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top(rows, 5)


def test_row_groups_are_skipped(spark, tmp_path):
    rows = spark.range(300_000).select(F.lit("tf").alias("scheme"), (F.col("id") % 3).alias("qid"), F.col("id").alias("doc_id"), (F.rand(1)).alias("similitud"))
    path = I.cluster(rows, files=1, row_group_bytes=1 << 16).inputFiles()[0]
    assert pq.ParquetFile(path.replace("file://", "")).metadata.num_row_groups > 5
    kept, read, skipped = I.read_skipping(path, 5)
    assert kept.num_rows == 15 and skipped > read


def test_row_groups_of_several_groups():
    """Skipped only when every group that may be in it has n better items."""
    kept = I.Kept(2)
    kept.add(pa.table({"scheme": ["tf"] * 5, "qid": pa.array([1, 1, 2, 2, 4]), "doc_id": pa.array(range(5)), "similitud": [0.9, 0.8, 0.7, 0.6, 0.9]}))
    assert kept.below(0.5, ("tf", 1, 2)) and not kept.below(0.6, ("tf", 1, 2)) and kept.below(0.7, ("tf", 1, 1))
    assert not kept.below(0.1, ("tf", 1, 4)) and not kept.below(0.1, ("other", 1, 1)) and not kept.below(0.1, None)


def test_clean_runs(spark):
    rows = [("Q007", 1, 0.5, "tf"), ("7", 1, 0.9, "tf"), (" 07 ", 2, 0.9, "tf"), ("x", 1, 0.5, "tf"), (None, 1, 0.5, "tf"), ("7", 3, float("nan"), "tf"), ("7", 4, None, "tf"), ("7", 5, 1.5, "tf"), ("7", 6, 0.0, "tf"), ("7", None, 0.3, "tf"), ("9" * 30, 1, 0.3, "tf")]
    df = spark.createDataFrame(rows, "qid string, doc_id long, similitud double, scheme string")
    got = I.top_items(I.clean_runs(df)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("tf", 7, 1, 1, 0.9), ("tf", 7, 2, 2, 0.9)]
    assert I.top_items(I.clean_runs(df.limit(0))).count() == 0
