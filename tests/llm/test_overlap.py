"""Near-duplicates, cross-split overlap and leaks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import common, leaks, near_duplicates, queries, setjoin, split_overlap
from lexmill.llm.common import words

WORDS = [f"w{i}" for i in range(400)]


def variants(rng, base):
    """Edits, insertions, cuts and moves of a text."""
    w = base.split()
    kind = rng.randrange(5)
    if kind == 0:
        return base
    if kind == 1:
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
    elif kind == 2:
        at = rng.randrange(len(w))
        w[at:at] = rng.choices(WORDS, k=rng.randrange(1, 10))
    elif kind == 3:
        w = w[: len(w) * 2 // 3]
    else:
        at = rng.randrange(len(w))
        w = w[at:] + w[:at]
    return " ".join(w)


def collection(seed, n=160):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = " ".join(rng.choices(WORDS, k=rng.randrange(20, 70)))
        out += [variants(rng, base) for _ in range(rng.randrange(1, 5))]
    out = out[:n]
    boiler = " ".join(WORDS[:30])
    out += [boiler + " " + " ".join(rng.choices(WORDS, k=12)) for _ in range(12)]
    rng.shuffle(out)
    return out


def sequences(text, k, least):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= max(least, k) else set()


def overlaps(rows, k, least, threshold, ok=lambda a, b: True):
    sets = {key: sequences(t, k, least) for key, t in rows if t}
    keys = sorted(key for key, s in sets.items() if s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if ok(a, b) and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def pairs(df):
    return {(r["rec_a"], r["rec_b"]) for r in df.collect()}


def news(spark, texts, **more):
    rows = [(i, None, t, "train", "s", 1) for i, t in enumerate(texts)] + [(9000, "t", None, "test", "s", 1), (9001, None, "", "test", "s", 1), (9002, None, "  \n ", None, None, None), (9003, "a", "too short", "valid", "s", 0)]
    return spark.createDataFrame(rows, "rec_id long, title string, text string, split string, source string, label int").withColumn("key", F.lit("clash")).withColumn("cls", F.lit(1.5))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = collection(seed)
    got = near_duplicates.near_duplicate_pairs(near_duplicates.news_rows(news(spark, texts).repartition(5)))
    want = overlaps([(i, " " + t) for i, t in enumerate(texts)], 3, 20, 0.5)
    assert pairs(got) == want and got.count() == len(want) and len(want) > 60


def test_hot_columns_and_copies(spark, monkeypatch):
    """Columns above the block size are cut into cells, classes of very many copies are listed by a star."""
    monkeypatch.setattr(setjoin, "HOT", 16)
    texts = collection(5, 100) + ["same words " + " ".join(WORDS[:25])] * 90
    rng = random.Random(3)
    near = [" ".join(WORDS[100:125] + rng.choices(WORDS, k=2)) for _ in range(60)]
    inc_rows = near_duplicates.news_rows(news(spark, texts + near))
    got = pairs(near_duplicates.near_duplicate_pairs(inc_rows))
    every = list(enumerate(texts + near))
    first = len(texts) - 90
    copies = set(range(first, first + 90))
    want = {p for p in overlaps(every, 3, 20, 0.5) if not (p[0] in copies and p[1] in copies)}
    assert got - want == {(first, i) for i in range(first + 1, first + 90)} and want <= got


def test_groups(spark):
    base = " ".join(WORDS[:60])
    near = base.replace("w30 ", "x ")
    far = " ".join(WORDS[200:260])
    got = {r["key"]: (r["group_id"], r["n_links"]) for r in near_duplicates.near_duplicate_groups(near_duplicates.news_rows(news(spark, [base, far, near, base])), threshold=0.8).collect()}
    assert got == {0: (0, 2), 3: (0, 2), 2: (0, 1), 1: (1, 0)}


def test_short_texts_have_groups(spark, tmp_path):
    """Texts under five words have rows in p1_groups, exact copies among them one group."""
    base = " ".join(WORDS[:60])
    texts = [base, "市议会周二批准了新的预算。", "Vote now!", "市议会周二批准了新的预算", "vote  NOW", "市议会周三批准了新的预算。", "!!!", "?!", " !!!", base.replace("w30 ", "x ")]
    news(spark, texts).drop("key", "cls").write.parquet(str(tmp_path / "news.parquet"))
    got = {r["key"]: (r["group_id"], r["n_links"]) for r in queries.p1_groups(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1), 9: (0, 1), 1: (1, 1), 3: (1, 1), 2: (2, 1), 4: (2, 1), 5: (5, 0), 6: (6, 1), 8: (6, 1), 7: (7, 0), 9003: (9003, 0)}


def test_empty_tables(spark):
    none = news(spark, []).limit(0)
    liar = none.select("rec_id", F.col("text").alias("statement"), "split", "source", "label")
    assert near_duplicates.near_duplicate_pairs(near_duplicates.news_rows(none)).count() == 0
    assert near_duplicates.near_duplicate_groups(near_duplicates.news_rows(none)).count() == 0
    assert split_overlap.overlaps(none, liar).count() == 0
    assert split_overlap.report(none, liar).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(docs, items).count() == 0


def test_split_overlap_equals_brute_force(spark):
    texts = collection(7)
    rng = random.Random(1)
    split = {i: rng.choice(["train", "Train ", "valid", "test", "other", None]) for i in range(len(texts))}
    rows = [(i, t, split[i], f"s{i % 2}", i % 2) for i, t in enumerate(texts)]
    schema = "rec_id long, text string, split string, source string, label int"
    n = spark.createDataFrame(rows + [(8000, None, "train", None, None)], schema)
    other = spark.createDataFrame([(10_000 + i, t, "test", "z", None) for i, t, *_ in rows[:20]], schema).withColumnRenamed("text", "statement")
    side = {i: {"train": 0, "valid": 1, "test": 1}.get((s or "").strip().lower()) for i, s in split.items()}
    want = overlaps(list(enumerate(texts)), 3, 10, 0.5, lambda a, b: side[a] is not None and side[b] is not None and side[a] != side[b])
    got = split_overlap.overlaps(n, other)
    assert pairs(got) == want and got.count() == len(want) and len(want) > 20
    report = split_overlap.report(n, other).collect()
    evaluated = {x for p in want for x in p if side[x] == 1}
    assert sum(r["records"] for r in report) == len(evaluated)
    assert all(r["same_label"] + r["other_label"] + r["label_missing"] == r["records"] for r in report)


def test_overlap_labels_of_all_train_records(spark):
    """Every train record an evaluation record overlaps with counts: copies and less similar classes too."""
    base = " ".join(WORDS[:40])
    near = base.replace("w39", "x")
    lone, part = " ".join(WORDS[100:130]), " ".join(WORDS[100:115] + WORDS[200:205])
    rows = [(1, base, "train", "s", 1), (2, base, "train", "s", 0), (3, base, "test", "s", 1), (4, " ".join(WORDS[300:330]), "train", "s", None), (5, " ".join(WORDS[300:330]), "train", "s", 1), (6, " ".join(WORDS[300:330]), "test", "s", 1), (7, near, "valid", "s", None), (8, lone, "train", "t", 1), (9, lone, "valid", "t", 1), (10, lone + " y", "train", "t", 0), (11, part, "valid", "t", 0)]
    schema = "rec_id long, text string, split string, source string, label int"
    n = spark.createDataFrame(rows, schema)
    liar = spark.createDataFrame([], schema).withColumnRenamed("text", "statement")
    got = {r["rec_id"]: (r["label"], r["train_0"], r["train_1"], r["train_null"], r["verdict"], round(r["covered"], 3)) for r in split_overlap.overlapping(n, liar).collect()}
    assert got == {3: (1, 1, 1, 0, "other", 1), 6: (1, 0, 1, 1, "same", 1), 7: (None, 1, 1, 0, "missing", 0.975), 9: (1, 1, 1, 0, "other", 1)}
    report = {(r["split"], r["source"]): r for r in split_overlap.report(n, liar).collect()}
    test = report["test", "s"]
    assert (test["records"], test["same_label"], test["other_label"], test["label_missing"]) == (2, 1, 1, 0)
    assert (test["label_1"], test["train_0"], test["train_1"], test["train_null"], test["mean_covered"]) == (2, 1, 2, 1, 1)


def test_classes_complete_the_star(spark, tmp_path):
    """The pairs of hot classes that p5_found leaves out follow from p5_classes."""
    text = " ".join(WORDS[:30])
    n = spark.createDataFrame([(i, None, text, "train" if i < 70 else "test", "s", 1) for i in range(73)], "rec_id long, title string, text string, split string, source string, label int")
    n.write.parquet(str(tmp_path / "news.parquet"))
    n.limit(0).withColumnRenamed("text", "statement").write.parquet(str(tmp_path / "liar.parquet"))
    got = {r["rec_id"]: tuple(r)[1:] for r in queries.QUERIES["p5_classes"](spark, str(tmp_path)).collect()}
    assert got == {i: (0, 70, 1) if i < 70 else (70, 3, 1) for i in range(73)}
    every = pairs(split_overlap.overlaps(n, n.limit(0).withColumnRenamed("text", "statement"), cap=None))
    assert every == {(a, b) for a in range(70) for b in range(70, 73)}
    assert pairs(queries.p5_found(spark, str(tmp_path))) == {(a, b) for a, b in every if a == 0 or b == 70}


def test_suffix_order_and_common_prefixes():
    """The order is a suffix order, and the common prefix of two suffixes is never told longer than by a chance in 256."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 60, dtype=np.uint64)
    texts = [np.r_[base[i : i + 40], rng.integers(0, 1 << 40, 3, dtype=np.uint64)] for i in range(20)]
    flat = np.concatenate(texts)
    many = np.array([len(t) for t in texts])
    start = np.cumsum(many) - many
    place = np.arange(len(flat))
    end = np.repeat(start + many, many)
    levels = setjoin.text_order_levels(flat, end, place)
    order = np.lexsort((levels, flat))
    seen = wrong = 0
    for a, b, equal in split_overlap.neighbours(flat[order], levels[order]):
        for x, y, e in zip(order[a], order[b], equal):
            p, q = flat[x : end[x]], flat[y : end[y]]
            m = min(len(p), len(q))
            true = int(np.argmin(np.r_[p[:m] == q[:m], False]))
            told = min(m, 1 << e) if e < 8 else m
            seen += 1
            wrong += not (told <= true and (true < 2 * told or told == m))
    assert seen > 3000 and wrong < 0.02 * seen


def test_full_counters_are_cut_by_true_counts(spark, monkeypatch):
    """With far too few counters every column looks hot; the rows are the same."""
    monkeypatch.setattr(setjoin, "COUNTERS_LEAST", 64)
    monkeypatch.setattr(setjoin, "COUNTERS_MOST", 64)
    monkeypatch.setattr(setjoin, "HOT", 4)
    texts = collection(8, 80)
    got = near_duplicates.near_duplicate_pairs(near_duplicates.news_rows(news(spark, texts)))
    assert pairs(got) == overlaps([(i, " " + t) for i, t in enumerate(texts)], 3, 20, 0.5)


def test_codes_never_fall_below_the_count():
    x = np.r_[np.arange(3000), [10**6, 10**9]]
    back = setjoin.decoded(setjoin.coded(x))
    assert (back >= x).all() and (back[:17] == x[:17]).all() and (back <= 1.1 * x + 1).all()


def test_every_pair_without_a_cap(spark):
    text = " ".join(WORDS[:30])
    got = pairs(near_duplicates.near_duplicate_pairs(near_duplicates.news_rows(news(spark, [text] * 70)), cap=None))
    assert got == {(a, b) for b in range(70) for a in range(b)}


def test_tables_are_removed(spark):
    import os

    df = common.materialize(spark.range(3), "removed")
    path = df._lexmill_path.removeprefix("file://")
    assert os.path.isdir(path)
    common.discard(df)
    assert not os.path.isdir(path)


def edit_distance(pattern, text):
    """Least distance of the pattern to any stretch, and where the first such ends."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, w in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != w)))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j)
    return best


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(300):
        p = rng.choices("abcd", k=rng.randrange(1, 90))
        t = rng.choices("abcd", k=rng.randrange(0, 90))
        assert leaks.best_distance(p, t) == edit_distance(p, t)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(3, 60)))) for i in range(40)] + [(100, None), (101, ""), (102, items_text(rng))]
    docs = []
    for i in range(300):
        base = rng.choice(items)[1] or ""
        w = base.split()
        cut = w[: rng.randrange(len(w) + 1)] if w else []
        if i % 3 == 0:
            at = rng.randrange(len(cut) + 1)
            cut = cut[at:] + ["moved"] + cut[:at]
        docs.append((i, " ".join(rng.choices(WORDS, k=20) + cut + rng.choices(WORDS, k=20))))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    spark_docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    spark_items = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = set()
    for i, t in items:
        grams = sequences(t or "", 4, 4)
        for d, text in docs:
            if grams and text and 2 * len(grams & sequences(text, 4, 4)) >= len(grams):
                want.add((i, d))
    for size in (leaks.BLOCK_BYTES, 2000):  # one block of items, and several
        rows = leaks.leaks(spark_docs.repartition(3), spark_items, block_bytes=size).collect()
        assert {(r["item_id"], r["doc_id"]) for r in rows} == want and len(rows) == len(want)
    assert len(want) > 50


def test_distance_rejects_piece_hits():
    """A whole piece alone is a candidate and no leak; passages moved about are one."""
    item = [f"w{i}" for i in range(30)]
    held = leaks.Items([(7, " ".join(item))])
    n, budget = 27, 13
    assert [len(x) for x in held.sequences] == [n] and held.budget == [budget] and leaks.error_budget(1) == 0 and leaks.error_budget(2) == 1

    def both(doc):
        g = leaks.sequence_hashes(leaks.word_hashes(doc), 4)
        hit = list(held.candidates(g, np.zeros(len(g), np.int64))[1])
        return hit, leaks.verify(n, held.places(0, g)[1].tolist(), budget)

    assert both(["x"] * 9 + item[8:20] + ["y"] * 9) == ([0], None)  # 9 of 27
    assert both(item[:17] + ["y"]) == ([0], (13, False, 14))  # 14 of 27
    assert both(item[:16] + ["y"]) == ([0], None)  # 13
    hit, found = both(item[20:] + ["z"] + item[10:20] + ["z"] + item[:10])
    assert hit == [0] and found[1] and found[0] > budget  # 4 + 7 + 7, in another order
    assert both(item[20:] + ["z"] + item[10:17])[1] is None
    assert both(["q"] * 40) == ([], None)


def items_text(rng):
    return "same words same words same words same words " * 3


def test_packed_blocks_round_trip():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 1 << 40, 500, dtype=np.uint64)
    g[:50] = g[50]
    doc = rng.integers(0, 60, 500)
    rank = rng.integers(0, 99, 500).astype(np.uint32)
    cls = rng.integers(-(1 << 62), 1 << 62, 60)
    a, b, (r,), (c,) = setjoin.unpack_block(setjoin.pack_block(g, doc, [rank], [cls]), [np.uint32], [np.int64])
    assert sorted(zip(a.tolist(), c[b].tolist(), r.tolist())) == sorted(zip(g.tolist(), cls[doc].tolist(), rank.tolist()))
    assert (setjoin.unpack40(setjoin.pack40(g)) == g).all()


def test_words():
    assert words("Ｈｅｌｌｏ, it’s 3.5​ km — नमस्ते!") == ["hello", "its", "35", "km", "नमस्ते"]
    assert words("It's A-B\tc") == ["its", "ab", "c"] and words(None) == [] and words("?!") == []
