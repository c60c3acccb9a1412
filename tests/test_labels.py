import pytest
from pyspark.sql import functions as F

from lexmill.operators import classify as K
from lexmill.operators import sampling
from lexmill.plans import label_plans

FIT = K.fit


def test_sample_and_split(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit("x").alias("r"))
    got = sampling.per_class(df.drop("r"), "label", "k", 100)
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {0: 100, 1: 100}
    assert sorted(r["k"] for r in got.collect()) == sorted(r["k"] for r in sampling.per_class(df.drop("r").repartition(7), "label", "k", 100).collect())
    parts = sampling.split(df, "label", "k")
    share = {r["part"]: r["count"] / 3000 for r in parts.groupBy("part").count().collect()}
    assert share == {"train": 0.7, "valid": 0.15, "test": 0.15}
    by_class = {(r["label"], r["part"]): r["count"] for r in parts.groupBy("label", "part").count().collect()}
    assert by_class == {(0, "train"): 1400, (0, "valid"): 300, (0, "test"): 300, (1, "train"): 700, (1, "valid"): 150, (1, "test"): 150}
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, sampling.split(df.repartition(5), "label", "k").collect()))


def test_report(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 2 + [(0, 1)] * 2 + [(None, 1)], "label int, pred int")
    got = {r["class"]: r for r in K.report(df).collect()}
    assert got["1"]["precision"] == 0.6 and got["1"]["recall"] == 0.75 and got["1"]["support"] == 4
    assert got["accuracy"]["f1"] == 0.625
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 0.5) / 2)
    assert {(r["label"], r["pred"]): r["n"] for r in K.confusion(df).collect()}[(1, 1)] == 3
    weights = {r["label"]: r["weight"] for r in K.class_weights(spark.createDataFrame([(0,)] * 3 + [(1,)] + [(None,)], "label int")).collect()}
    assert weights == {0: 0.5, 1: 1.5}


@pytest.mark.parametrize("kind", ["logreg", "nb"])
def test_classifier(spark, kind, tmp_path):
    real, fake = "council votes budget report minister", "shocking secret aliens miracle cure"
    rows = [(i, f"{real if i % 2 else fake} number{i}", i % 2, "extra") for i in range(40)] + [(90, None, 1, None), (91, "", 0, None), (92, real, None, None)]
    df = spark.createDataFrame(rows, "k long, text string, label int, clashing string")
    model = K.fit(df, kind, features=256)
    got = {r["k"]: r for r in K.predict(model, df, "k").collect()}
    assert len(got) == 43 and all(got[i]["pred"] == i % 2 for i in range(40))
    assert got[92]["prob_real"] > 0.5
    model.write().overwrite().save(str(tmp_path / "m"))
    again = K.PipelineModel.load(str(tmp_path / "m"))
    assert {r["k"]: r["pred"] for r in K.predict(again, df, "k").collect()} == {k: r["pred"] for k, r in got.items()}


def test_unknown_classifier():
    with pytest.raises(ValueError):
        K.pipeline("svm")


def test_naive_bayes_counts(spark):
    df = spark.createDataFrame([("cat cat dog", 0), ("dog bird", 1), (None, 1), ("cat", None)], "text string, label int")
    got = {(r["label"], r["term"]): (r["n"], r["p"]) for r in K.nb_counts(df).collect()}
    assert got[(0, "cat")][0] == 2 and got[(0, "cat")][1] == pytest.approx(2.3 / (3 + 0.9))
    assert (1, "cat") not in got


@pytest.mark.parametrize("name", ["logreg_proba", "nb_proba"])
def test_terms_share_no_column(spark, monkeypatch, name):
    """The registered classifiers have a column for each word and pair, and as many iterations as the reference."""
    fits = []
    monkeypatch.setattr(label_plans.K, "fit", lambda train, kind, **options: fits.append((kind, dict(options))) or FIT(train, kind, **options))
    monkeypatch.setattr(label_plans, "table", lambda *_: spark.createDataFrame([(i, f"{'council votes' if i % 2 else 'aliens cure'} n{i}", i % 2) for i in range(60)], "rec_id long, text string, label int"))
    assert label_plans.QUERIES[name](spark, "").count() > 0
    kind, options = fits[0]
    assert options["most_terms"] == 50_000 and (kind == "nb" or options["max_iter"] == 1000)


def test_frequent_terms(spark):
    data = spark.createDataFrame([("budget vote budget",), ("budget vote",), ("cure",), ("cure all",), ("alone",)], "clean_text string")
    assert K.frequent_terms(data, 5, 10) == ["budget", "budget vote", "cure", "vote"]
    assert K.frequent_terms(data, 5, 2) == ["budget", "budget vote"]
    assert K.frequent_terms(data, 2, 10) == []
