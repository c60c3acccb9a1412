import pytest

from lexmill.operators import corpus as C

TEXTS = ["the old man saw the old house and the young man saw the new house", "a big man and other animals of the old house", None, ""]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t, "s" + str(i % 2)) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_concordance(corpus):
    got = rows(C.concordance(corpus, "man", width=2), "doc_id", "pos")
    assert got == [(0, 2, "the old", "man", "saw the"), (0, 10, "the young", "man", "saw the"), (1, 1, "big", "man", "and other")]
    assert C.concordance(corpus, "man", lines=1).count() == 1


def test_contexts(corpus):
    assert rows(C.common_contexts(corpus, ["old", "young"]), "left_word") == [("the", "man")]
    assert ("young", 1) in rows(C.similar(corpus, "old"), "term")
    assert ("new", 1) in rows(C.similar(corpus, "old"), "term")


def test_bigrams_and_model(corpus):
    pairs = {(a, b): n for a, b, n in rows(C.bigrams(corpus), "a")}
    assert pairs[("the", "old")] == 3 and pairs[("man", "saw")] == 2
    model = C.ngram_model(corpus)
    p = {(r["a"], r["b"]): r["p"] for r in model.collect()}
    assert p[("the", "old")] == pytest.approx(3 / 5)
    assert C.generate(model, "young", 4) == ["young", "man", "saw", "the"]
    assert C.generate(model, "zebra", 4) == ["zebra"]


def test_collocations(corpus):
    got = rows(C.collocations(corpus), "a", "b")
    assert [(a, b, n) for a, b, n, _ in got] == [("man", "saw", 2), ("old", "house", 2)]


def test_patterns(corpus):
    assert rows(C.token_pattern(corpus, ["the", "[a-z]*", "man"]), "pos") == [(0, 0, "the old man"), (0, 8, "the young man")]
    assert rows(C.hypernyms(corpus), "hyponym") == [("man", "animals", 1)]


def test_frequencies(corpus):
    got = rows(C.conditional_frequency(corpus, "source", ["man", "old", "zebra"]), "source")
    assert got == [("s0", 2, 2, 0), ("s1", 1, 1, 0)]
    d = C.diversity(corpus).first()
    assert d["tokens"] == 24 and d["types"] == 12
    assert ("ou", 2) in rows(C.vowel_sequences(corpus), "seq")


def test_positions(corpus):
    got = {(r["stem"], r["doc_id"]): r["places"] for r in C.inverted_positions(corpus).collect()}
    assert got[("the", 0)] == [0, 4, 8, 12]
    assert rows(C.dispersion(corpus, ["man"]), "doc_id", "pos") == [(0, 2, "man"), (0, 10, "man"), (1, 1, "man")]


def test_stem_lines(corpus):
    from lexmill.functions import stem as S

    got = rows(C.stem_lines(corpus, "houses", S.word_udf(S.porter), width=12), "doc_id", "pos")
    assert [(r[0], r[1]) for r in got] == [(0, 6), (0, 14), (1, 8)]
    assert got[0][2] == " saw the old"[-12:] and got[0][3] == "house and the young"[:12] and all(len(r[2]) == len(r[3]) == 12 for r in got)


def test_drawn_continuations(corpus):
    model = C.ngram_model(corpus)
    one, again = C.generate(model, "the", 8, seed=3), C.generate(model, "the", 8, seed=3)
    assert one == again and one[0] == "the" and len({tuple(C.generate(model, "the", 8, seed=s)) for s in range(6)}) > 1
