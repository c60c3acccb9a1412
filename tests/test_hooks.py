from lexmill.operators import hooks


def test_models_plug_in(spark):
    df = spark.createDataFrame([(1, "abc", "x" * 900), (2, None, None)], "k int, claim string, evidence string")
    got = hooks.map_texts(df, "k", "claim", lambda: lambda ts: [float(len(t)) for t in ts], "double")
    assert {r["k"]: r["value"] for r in got.collect()} == {1: 3.0, 2: 0.0}
    vectors = hooks.map_texts(df, "k", "claim", lambda: lambda ts: [[1.0, float(len(t))] for t in ts], "array<float>")
    assert {r["k"]: r["value"] for r in vectors.collect()} == {1: [1.0, 3.0], 2: [1.0, 0.0]}
    pairs = hooks.map_pairs(df, ["k"], "claim", "evidence", lambda: lambda ps: [(len(e) / 1000, len(c) / 10, 0.0) for e, c in ps])
    assert {r["k"]: (r["p_supports"], r["p_refutes"]) for r in pairs.collect()} == {1: (0.8, 0.3), 2: (0.0, 0.0)}
