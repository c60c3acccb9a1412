import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import language as L
from lexmill.llm.bytes_gru import Network
from lexmill.llm.langs import label_code


def test_gradients():
    rng = np.random.default_rng(0)
    net = Network(5)
    for p in net.arrays():
        p *= 3
    x, y = rng.integers(0, 255, (14, 4)).astype(np.uint8), rng.integers(0, 5, (7, 4))
    _, gs = net.loss_and_gradients(x, y)
    for n, (p, g) in enumerate(zip(net.arrays(), gs)):
        for _ in range(3):
            i = tuple(int(rng.integers(0, s)) for s in p.shape)
            if n in (0, 4):
                t = int(rng.integers(14))
                i = (int(x[t, rng.integers(4)]) + 256 * (t % 2), i[1])
            old = p[i]
            p[i] = old + 5e-3
            up = net.loss_and_gradients(x, y, False)[0]
            p[i] = old - 5e-3
            down = net.loss_and_gradients(x, y, False)[0]
            p[i] = old
            assert (up - down) / 1e-2 == pytest.approx(g[i], abs=2e-4)


def test_scores_do_not_depend_on_the_batch():
    net = Network(4)
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(32, 120, n).astype(np.uint8) for n in (700, 90, 512))
    alone = net.unit_scores(a, np.array([0, 300]), 2)
    again = net.unit_scores(np.concatenate([b, a, c]), np.array([0, 90, 390, 790]), 4, np.array([0, 90, 790]))
    assert again[1:3] == pytest.approx(alone, rel=1e-5)
    other = net.unit_scores(np.concatenate([c, a]), np.array([0, 512, 812]), 3, np.array([0, 512]))
    assert other[1:] == pytest.approx(alone, rel=1e-5) and other[0] == pytest.approx(again[3], rel=1e-5)
    # with no weights each position scores ln(1/4), and counts once
    net.c[:] = 0
    for d in (net.ahead, net.back):
        d.V[:] = 0
    assert net.unit_scores(np.concatenate([b, a]), np.array([0, 40, 90]), 3, np.array([0, 90]))[:, 0] == pytest.approx(-np.log(4) * np.array([20, 25, 350]), rel=1e-5)


def test_labels(spark):
    rows = {"en": "en", " EN ": "en", "en-US": "en", "eng": "en", "English": "en", "fr_FR": "fr", "nl": None, "": None, None: None, "und": None, "Chinese": "zh"}
    df = spark.createDataFrame([(k,) for k in rows], "x string")
    assert [r[0] for r in df.select(label_code(F.col("x"))).collect()] == list(rows.values())


def test_path_and_stretches():
    en, fr = L.CODES.index("en"), L.CODES.index("fr")
    s = np.full((6, len(L.CODES)), -20.0)
    s[:, en] = [-1, -1, -1, -9, -1, -1]
    s[:, fr] = [-9, -9, -9, -8, -9, -9]
    assert set(L.path(s)) == {en}
    size = [(20, 99, 50), (3, 20, 10), (20, 99, 50), (40, 200, 60), (5, 30, 15), (16, 80, 40)]
    best = np.array([en, fr, en, fr, en, fr])
    clear = np.full((6, len(L.CODES)), -90.0)
    clear[np.arange(6), best] = -1
    got = [(x[0], x[2]) for x in L.stretches(best, clear, size, 15, 40)]
    assert got == [(en, 40), (fr, 56)]
    assert len(L.stretches(best[:2], clear, [(3, 9, 5), (2, 9, 5)], 15, 40)) == 1
    doubtful = np.where(clear == -1, -1.0, -3.0)  # no language leads clearly: the longest stretch stays
    assert len(L.stretches(best, doubtful, size, 15, 40)) == 1


@pytest.fixture(scope="module")
def documents(spark):
    en = "the council of the town closed the old bridge and the people were angry about it. "
    de = "der alte Bürgermeister hat die Brücke geschlossen und die Leute waren sehr böse darüber. "
    ru = "старый совет города закрыл мост и люди были очень недовольны этим решением вчера. "
    rows = [(i, (en, de, ru)[i % 3] * (1 + i % 3), ("en", "German", "rus")[i % 3]) for i in range(90)]
    rows += [(900, en * 2 + "\n\n" + ru * 2, "en"), (901, en, "de"), (902, de, None), (903, en, "unknown"), (904, None, "en"), (905, "12 — 34", None), (906, "", None), (907, en.upper(), "EN")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit("clash")).withColumn("missing", F.lit(7))


def test_segments_and_cases(documents):
    found = L.segments(documents).cache()
    rows = found.collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {*range(90), 900, 901, 902, 903, 907}
    assert all(by[i][0]["lang"] == ("en", "de", "ru")[i % 3] and len(by[i]) == 1 for i in range(90))
    assert [r["lang"] for r in sorted(by[900], key=lambda r: r["seg_no"])] == ["en", "ru"]
    assert all(0 < r["confidence"] <= 1 for r in rows)
    got = sorted(tuple(r) for r in L.cases(found).collect())
    assert got == [(900, 1, "en"), (900, 2, "ru"), (901, 1, "en"), (902, 1, "de"), (903, 1, "en")]
    found.unpersist()


def test_sample_counts_a_text_once(documents, spark):
    copies = spark.range(500).select((F.col("id") + 5000).alias("doc_id"), F.lit("one wrongly labelled text that many copies have, over and over").alias("text"), F.lit("de").alias("lang"))
    got = L.training_sample(documents.select("doc_id", "text", "lang").unionByName(copies), 10)
    assert sum("over and over" in t for _, t in got) == 1 and len(set(got)) == len(got)
    assert got == L.training_sample(documents.select("doc_id", "text", "lang").unionByName(copies).repartition(5), 10)


def test_weights_are_kept(documents, spark, monkeypatch):
    sample = L.training_sample(documents.select("doc_id", "text", "lang"))
    L._trained.clear()
    net = L.train(spark, sample, 4)
    L._trained.clear()
    monkeypatch.setattr(L, "fitted", None)  # not trained again
    again = L.train(spark, sample, 4)
    assert all((a == b).all() for a, b in zip(net.arrays(), again.arrays()))


def test_units():
    text = "คนไทยอยู่บ้าน อากาศดี The bridge is old. No!\nЯ 東京 x"
    starts = L._unit_starts(text)
    assert [text[a:b] for a, b in zip(starts, [*starts[1:], None])] == ["คนไทยอยู่บ้าน ", "อากาศดี ", "The bridge is old. ", "No!\n", "Я ", "東京 ", "x"]
    assert L._unit_starts("a. b") == [0, 3] and L._unit_starts("a. ") == [0] and L._unit_starts("") == []


def test_no_documents(documents):
    assert L.cases(L.segments(documents.limit(0))).count() == 0
