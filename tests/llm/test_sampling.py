"""Controlled rounding, quotas, raking and mixes."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import keyed, mixing, proportions


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 3)), st.floats(0, 50), max_size=20))
def test_controlled_rounding(cells):
    got = proportions.controlled_rounding(cells)
    near = lambda whole, value: proportions._floor(value) <= whole <= proportions._ceil(value)
    assert all(near(got[k], v) for k, v in cells.items())
    for axis in (0, 1):
        for key in {k[axis] for k in cells}:
            assert near(sum(v for k, v in got.items() if k[axis] == key), sum(v for k, v in cells.items() if k[axis] == key))
    assert near(sum(got.values()), sum(cells.values()))


def test_quota_is_exact(spark):
    rows = spark.range(30_000).select(F.col("id").alias("rec_id"), (F.col("id") % 3).cast("int").alias("cell"), F.lit("x").alias("quota"), keyed.random_key("id", 1).alias("key"))
    quotas = spark.createDataFrame([(0, 0), (1, 1234), (2, 20_000), (5, 3)], "cell int, quota long")
    got = keyed.take(rows, quotas)
    assert {r["cell"]: r["count"] for r in got.groupBy("cell").count().collect()} == {1: 1234, 2: 10_000}
    best = [r["key"] & ((1 << 64) - 1) for r in rows.where("cell = 1").collect()]
    assert sorted(r["key"] & ((1 << 64) - 1) for r in got.where("cell = 1").collect()) == sorted(best)[:1234]


@pytest.fixture(scope="module")
def news(spark):
    rows = []
    for i in range(1000):
        subject = "Big one" if i % 3 else "small"
        rows.append((i, str(i), f"text {i}", subject if i % 2 else f" {subject.upper()}/", i % 2, f"2024-01-01 00:00:{i % 60:02d}"))
    rows += [(2000, "1", "later copy", "small", 0, "2025-01-01 00:00:00"), (2001, "x", None, "small", 1, None), (2002, "y", "\n ", "small", 1, None), (2003, "z", "t", " ", 1, None), (2004, "w", "t", "small", None, None), (2005, None, "t", "rare", 1, None), (2006, None, "t", "rare", 1, None)]
    df = spark.createDataFrame(rows, "rec_id long, id string, text string, subject string, label int, at string")
    return df.withColumn("loaded_at", F.to_timestamp("at")).withColumn("cell", F.lit("clash")).withColumn("key", F.lit("clash"))


def test_sample(spark, news):
    targets = spark.createDataFrame([("big-one", 0, 0.4, 1), ("big-one", 1, 0.3, 1), ("SMALL", 0, 0.2, 1), ("SMALL", 1, 0.05, 30), ("rare", 1, 0.01, 5), ("none", 1, 0.04, 1), (None, None, None, None)], "subject string, label int, target_share double, min_rows int")
    report = {(r["subject"], r["label"]): r for r in proportions.report(news, targets).collect()}
    assert report[("rare", 1)]["available"] == 2 and report[("rare", 1)]["short"] and report[("rare", 1)]["quota"] == 2
    assert report[("none", 1)]["short"] and not report[("big-one", 0)]["short"]
    assert report[("SMALL", 1)]["quota"] == 30  # its minimum
    got = proportions.sample(news, targets)
    assert got.count() == got.select("id").distinct().count() or got.where("subject_key = 'rare'").count() == 2
    counts = {(r["subject_key"], r["label"]): r["count"] for r in got.groupBy("subject_key", "label").count().collect()}
    for (subject, label), r in report.items():
        if r["quota"]:
            assert counts[("".join(c for c in subject.lower() if c.isalpha()), label)] == r["quota"]
    assert sorted(x["rec_id"] for x in got.collect()) == sorted(x["rec_id"] for x in proportions.sample(news.repartition(3), targets).collect())
    one = proportions.usable_records(news).where("id = '1'").collect()
    assert [r["rec_id"] for r in one] == [2000]


def test_sample_of_nothing(spark, news):
    targets = spark.createDataFrame([("a", 1, 1.0, 1)], "subject string, label int, target_share double, min_rows int")
    assert proportions.sample(news.limit(0), targets).count() == 0
    assert proportions.report(news.limit(0), targets).collect()[0]["short"]
    assert proportions.report(news, targets.limit(0)).count() == 0


def test_raking_meets_margins():
    have = {(s, la, k): 10.0 + i for i, (s, la, k) in enumerate((s, la, k) for s in "abc" for la in ("en", "fr") for k in "xy")}
    total = sum(have.values())
    share = lambda axis: {v: sum(x for k, x in have.items() if k[axis] == v) / total for v in {k[axis] for k in have}}
    goal = {"a": 0.5 * total, "b": 0.3 * total, "c": 0.2 * total}
    w, settled = mixing.rake(have, [goal, *({v: x * total for v, x in share(a).items()} for a in (1, 2))], dict.fromkeys("abc", 9))
    assert settled and not mixing.rake(have, [goal, {"en": total * 0.9, "fr": total * 0.1}, {}], dict.fromkeys("abc", 1), rounds=1)[1]
    for s, x in goal.items():
        assert sum(v for k, v in w.items() if k[0] == s) == pytest.approx(x)
    for axis in (1, 2):
        for v, x in share(axis).items():
            assert sum(y for k, y in w.items() if k[axis] == v) == pytest.approx(x * total, rel=1e-6)


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer files")
def test_mix(spark):
    rows = [(i, f"some words number {i} " * 20, "en" if i % 4 else "fr", ("Wire ", "small", "huge", "unlisted", None)[i % 5], "k", "clash") for i in range(2000)] + [(9000, None, "en", "wire", None, None), (9001, "", None, "huge", "k", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string, tokens string")
    weights = spark.createDataFrame([("wire", 0.2, 1), ("Small", 0.7, 2), ("huge", 0.1, 1), ("absent", 0.0, 3)], "source string, target_weight double, max_repeats int")
    assert [r["source"] for r in mixing.short_sources(docs, weights).collect()] == ["Small"]
    report = {r["source"]: r for r in mixing.report(docs, weights).collect()}
    total = sum(r["tokens"] for r in report.values())
    assert report["Small"]["taken"] == 2 * report["Small"]["tokens"]
    assert report["wire"]["taken"] == pytest.approx(0.2 * total, rel=0.02) and report["huge"]["taken"] == pytest.approx(0.1 * total, rel=0.02)
    assert report["absent"]["taken"] == 0
    shares = {(r["axis"], r["value"]): (r["target_share"], r["reached_share"]) for r in mixing.margins(docs, weights).collect()}
    assert shares["source", "small"][0] == 0.7 and shares["language", "fr"][1] == pytest.approx(shares["language", "fr"][0], rel=0.1)
    got = mixing.mix(docs, weights)
    top = {r["source_key"]: r["m"] for r in got.groupBy("source_key").agg(F.max("copies").alias("m")).collect()}
    assert top == {"wire": 1, "small": 2, "huge": 1}
    assert mixing.mix(docs.limit(0), weights).count() == 0
    assert mixing.short_sources(docs.limit(0), weights).count() == 0
    encode = mixing.encoding(mixing.TOKENIZER, os.path.join(os.path.dirname(mixing.TOKENIZER), "__init__.py"))
    assert encode.decode(encode.encode_ordinary("naïve 東京 test")) == "naïve 東京 test"
