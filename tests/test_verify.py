import pytest
from pyspark.sql import functions as F

from lexmill.operators import verify as V

COLS = "qid int, evid_id long, prob_real double, fever_verdict string, p_supports double, p_refutes double, p_nei double, evidence_sentence string, extra string"


@pytest.fixture(scope="module")
def evidence(spark):
    rows = [
        (1, 1, 0.5, "SUPPORTS", 0.9, 0.1, 0.0, "a" * 400, "x"),
        (1, 2, 0.4, "REFUTES", 0.2, 0.7, 0.1, "b", None),
        (2, 3, 0.9, "REFUTES", 0.6, 0.6, 0.2, "c", None),
        (3, 4, 0.3, "NEI", 0.1, 0.2, 0.7, None, None),
        (4, 5, 0.2, None, None, None, None, "d", None),
        (5, 6, 0.9, "SUPPORTS", 0.95, 0.0, 0.05, "e", None),
    ]
    return spark.createDataFrame(rows, COLS).cache()


def test_verify(evidence):
    got = {r["qid"]: r for r in V.verify(evidence, "qid").collect()}
    assert got[1]["verdict"] == "SUPPORTS" and got[1]["supports"] == 0.9 and got[1]["nei"] == pytest.approx(0.05)
    assert got[2]["verdict"] == "SUPPORTS"  # a tie is support
    assert got[3]["verdict"] == "NEI"
    assert (got[4]["verdict"], got[4]["supports"], got[4]["refutes"], got[4]["nei"]) == ("NEI", 0.0, 0.0, 1.0)


def test_explain(evidence):
    got = V.explain(evidence, "qid", "evid_id", k=1).orderBy("qid").collect()
    assert [(r["qid"], r["evid_id"]) for r in got] == [(1, 1), (2, 3), (3, 4), (5, 6)]
    assert len(got[0]["passage"]) == 300


def test_ensemble_and_decision(evidence):
    got = {r["evid_id"]: r for r in V.decision(evidence).collect()}
    assert got[1]["combined"] == pytest.approx(0.5 + 0.35 * 0.9) and got[1]["decision"] == "REAL"
    assert got[2]["combined"] == pytest.approx(0.4 - 0.35 * 0.7) and got[2]["decision"] == "FAKE"
    assert got[4]["combined"] == 0.3 and got[5]["combined"] == 0.2
    assert got[6]["combined"] == 1.0 and got[6]["confidence"] == 0.5


def test_consensus(evidence):
    got = {r["qid"]: r for r in V.consensus(evidence, "qid").collect()}
    assert got[1]["dominant"] == "SUPPORTS" and got[1]["support_share"] == 0.5
    assert got[4]["dominant"] == "NEI" and got[4]["total"] == 0 and got[4]["support_share"] == 0.0
    assert got[2]["dominant"] == "REFUTES"


@pytest.mark.parametrize(
    "claim, text, want",
    [
        ("river water", "too short", "too short"),
        ("river water", "One sentence about the river. ", "One sentence about the river."),
        ("", "First sentence is right here. Second sentence is right here. Third sentence is right here. Fourth one is here.", "First sentence is right here. Second sentence is right here. Third sentence is right here."),
        ("fourth water", "First sentence is right here. Second sentence is right here. Third sentence is right here. Fourth water sentence here.", "Fourth water sentence here. First sentence is right here. Second sentence is right here."),
    ],
)
def test_evidence_sentences(spark, claim, text, want):
    df = spark.createDataFrame([(claim, text)], "c string, t string")
    assert df.select(V.evidence_sentences(F.col("c"), F.col("t"))).first()[0] == want
