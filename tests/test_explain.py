from breaklens.operators.explain import top_features


def test_top_features_by_absolute_contribution(spark):
    rows = [("b1", "x", 0.5), ("b1", "y", -2.0), ("b1", "z", 1.0), ("b2", "x", 0.0)]
    got = {r.break_id: [tuple(f) for f in r.top_features] for r in top_features(
        spark.createDataFrame(rows, "break_id string, feature string, contribution double"), n=2).collect()}
    assert got == {"b1": [("y", -2.0), ("z", 1.0)], "b2": [("x", 0.0)]}
