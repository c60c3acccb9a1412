import pytest
from pyspark.sql import functions as F

from lexmill.functions import stem as S
from lexmill.functions import text as T
from lexmill.functions import tokenize as K


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""),
        ("", ""),
        ("The Quick brown FOX", "quick brown fox"),
        ("See http://a.example/x?y=1 and www.b.example twice", "see twice"),
        ("LONDON (Reuters) - Markets fell", "markets fell"),
        ("By Ann Lee | Reuters stocks rose", "ann lee reuters stocks rose"),
        ("Café 42 naïve", "caf na ve"),
        ("a b cd", "cd"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, T.clean_text) == want


def test_clean_text_is_idempotent(spark):
    once = one(spark, "The 3 Senators — voted, quickly! (AP) www.x.example", T.clean_text)
    assert one(spark, once, T.clean_text) == once
    assert one(spark, "a1b2", lambda c: T.normalise(c, remove_digits=True)) == "a b"


def test_stopwords_are_sparks_own():
    words = T.stopwords()
    assert len(words) == 181 and "the" in words and "don't" in words


def test_token_rules(spark):
    assert one(spark, "it’s!", T.strip_punctuation) == "its"
    assert one(spark, "Budget of 1999, the budgets", T.words) == ["budget", "of", "the", "budgets"]
    assert one(spark, None, T.words) == []
    assert one(spark, "a  b\tc", T.split_words) == ["a", "b", "c"]
    assert one(spark, "", T.split_words) == []


def test_sentences(spark):
    got = one(spark, "This is the first sentence. Short. And here comes\nthe third sentence! ", T.sentences)
    assert got == ["This is the first sentence.", "And here comes the third sentence!"]


def test_positions_in_strings(spark):
    assert one(spark, "abcabc", lambda c: T.find(c, "bc")) == 1
    assert one(spark, "abcabc", lambda c: T.rfind(c, "bc")) == 4
    assert one(spark, "abcabc", lambda c: T.rfind(c, "x")) == -1
    assert one(spark, "head START body END tail", lambda c: T.between(c, "START", "END")) == "START body "
    assert one(spark, "nothing here", lambda c: T.between(c, "START", "END")) == "nothing here"


def test_html(spark):
    page = "<html><style>p{}</style><script>var x;</script><p>Tom &amp; Ann<br>&lt;3</p><!-- no --></html>"
    assert one(spark, page, T.html_to_text) == "Tom & Ann <3"
    assert one(spark, "<a href='x'>", T.html_escape) == "&lt;a href=&#x27;x&#x27;&gt;"
    assert K.html_text("<p>a &amp; b</p>") == "a & b"


def test_segmentation(spark):
    row = spark.createDataFrame([("doyouseethekitty", "010010010010000")], "t string, m string")
    got = row.select(T.segment(F.col("t"), F.col("m")).alias("w"), T.segment_cost(F.col("t"), F.col("m")).alias("c")).first()
    assert got["w"] == ["do", "you", "see", "the", "kitty"]
    assert got["c"] == 5 + sum(len(w) + 1 for w in got["w"])


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.0, 1.0])], "a array<double>, b array<double>")
    got = row.select(T.dot(F.col("a"), F.col("b")).alias("d"), T.softmax(F.col("a")).alias("s"), T.clip(F.lit(1.5)).alias("k")).first()
    assert got["d"] == 3.5 and abs(sum(got["s"]) - 1) < 1e-12 and got["k"] == 1.0


def test_tokenizers(spark):
    assert K.treebank("I don't (really) know...") == ["I", "do", "n't", "(", "really", ")", "know", "..."]
    assert K.treebank("L.E. paid 3.14") == ["L.E.", "paid", "3.14"]
    df = spark.createDataFrame([("A well-known, well-known $3.5 fact...",)], "x string")
    got = df.select([c.alias(n) for n, c in K.token_counts(F.col("x")).items()]).first()
    assert got["n_split"] == 5 and got["n_resplit"] == 5 and got["n_hyphenated"] == 6


def test_python_text_udfs(spark):
    df = spark.createDataFrame([("é",), (None,)], "x string")
    assert [r[0] for r in df.select(K.char_name("x")).collect()] == ["LATIN SMALL LETTER E WITH ACUTE", None]
    assert df.select(K.decode_bytes("latin2")(F.lit(b"\xb1"))).first()[0] == "ą"
    assert df.select(K.wrap(F.lit("word " * 30))).first()[0].count("\n") == 2


# the examples of the published Porter algorithm
PORTER = "caresses:caress ponies:poni cats:cat feed:feed plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit operator:oper hopefulness:hope triplicate:triplic formative:form electrical:electr goodness:good revival:reviv adoption:adopt bowdlerize:bowdler probate:probat cease:ceas roll:roll"


@pytest.mark.parametrize("pair", PORTER.split())
def test_porter(pair):
    word, stem = pair.split(":")
    assert S.porter(word) == stem


@pytest.mark.parametrize("pair", "generously:generous skies:sky dying:die news:news proceed:proceed knightly:knight consistency:consist kneel:kneel cries:cri ties:tie gas:gas this:this".split())
def test_snowball(pair):
    word, stem = pair.split(":")
    assert S.snowball(word) == stem


@pytest.mark.parametrize("pair", "maximum:maxim presumably:presum multiply:multiply provision:provid owed:ow saying:say crying:cry".split())
def test_lancaster(pair):
    word, stem = pair.split(":")
    assert S.lancaster(word) == stem


def test_lemma_and_udfs(spark):
    assert [S.lemma(w) for w in ("women", "cities", "boxes", "bus", "news")] == ["woman", "city", "box", "bus", "new"]
    assert [S.verb_lemma(w) for w in ("was", "running", "agreed", "stopped", "making")] == ["be", "run", "agre", "stop", "make"]
    df = spark.createDataFrame([("cats",), (None,), ("cats",)], "w string")
    assert [r[0] for r in df.select(S.word_udf(S.porter)("w")).collect()] == ["cat", None, "cat"]
    assert df.select(S.text_udf(S.porter)(F.lit("cats falling  down"))).first()[0] == "cat fall down"


def test_segmentation_of_a_long_title(spark, tmp_path):
    from lexmill.plans import text_plans

    title = " ".join(["word"] * 2100)
    spark.createDataFrame([(1, title)], "rec_id long, title string").write.parquet(str(tmp_path / "news.parquet"))
    assert text_plans.segmentation(spark, str(tmp_path)).collect()[0]["words"] == title
