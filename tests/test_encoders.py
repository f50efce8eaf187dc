"""Encoders in versions, and group features within a scope."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from breaklens import constants as C
from breaklens.operators import encoders as ENC
from breaklens.operators import features as FT
from breaklens.operators import training as TRN
from breaklens.operators.scoring import score_breaks


def _codes(df):
    return {(r["feature"], r["value"]): r["code"] for r in df.collect()}


def test_codes_stay_and_new_values_follow(spark, tmp_dir):
    first = spark.createDataFrame([("m", "t1"), ("c", None), ("m", "t1")], "entity_id string, team_code string")
    later = spark.createDataFrame([("a", "t0"), ("z", "t1"), (None, None), ("c", "t0")],
                                  "entity_id string, team_code string")
    old = ENC.fit_encoders(first)
    assert _codes(old) == {("entity_id", "c"): 0, ("entity_id", "m"): 1,
                           ("team_code", "__MISSING__"): 0, ("team_code", "t1"): 1}
    ENC.save_encoders(old, f"{tmp_dir}/v1")
    grown = ENC.extend_encoders(ENC.load_encoders(spark, f"{tmp_dir}/v1"), later)
    assert _codes(grown) == _codes(old) | {("entity_id", "__MISSING__"): 2, ("entity_id", "a"): 3,
                                           ("entity_id", "z"): 4, ("team_code", "t0"): 2}
    assert _codes(ENC.extend_encoders(grown, later)) == _codes(grown)
    # a feature that the older version lacks begins at 0; no known column, nothing to do
    named = ENC.extend_encoders(old, later.withColumn("rec_name", F.lit("r")))
    assert _codes(named)[("rec_name", "r")] == 0
    assert ENC.extend_encoders(old, spark.range(2)) is old and ENC.fit_encoders(spark.range(2)) is None
    coded = ENC.apply_encoders(later, old).collect()
    assert sorted((r["entity_id"] or "", r["entity_id_enc"], r["team_code_enc"]) for r in coded) == [
        ("", -1.0, 0.0), ("a", -1.0, -1.0), ("c", 0.0, -1.0), ("z", -1.0, 1.0)]
    with pytest.raises(AnalysisException):
        ENC.save_encoders(grown, f"{tmp_dir}/v1")
    assert ENC.load_encoders(spark, f"{tmp_dir}/none") is None


def _report(spark, n=240):
    rng = np.random.default_rng(3)
    rows = [(f"b{i}", ["CEQ", "LnD", "OTC", None][i % 4], f"e{rng.integers(6)}", f"t{rng.integers(3)}",
             f"r{rng.integers(3)}", f"c{rng.integers(9)}" if i % 7 else None, float(rng.integers(-3, 4)),
             float(rng.integers(0, 30))) for i in range(n)]
    return spark.createDataFrame(rows, "break_id string, asset_class string, entity_id string, team_code string, "
                                       "rec_name string, counterparty string, break_amount_gbp double, "
                                       "break_age_days double")


def test_scope_equals_reports_of_their_own(spark):
    df = _report(spark)
    whole = FT.materialize(FT.build_feature_matrix(df, scope=["asset_class"]), "scoped")
    plain = FT.build_feature_matrix(df).toPandas().set_index("break_id")
    for ac in ("CEQ", "LnD", "OTC"):
        alone = FT.build_feature_matrix(df.where(F.col("asset_class") == ac)).toPandas().set_index("break_id")
        got = whole.where(F.col("asset_class") == ac).toPandas().set_index("break_id")
        assert len(got) == 60
        for f in C.ALL_FEATURES:
            a, b = alone[f].sort_index(), got[f].sort_index()
            assert ((a == b) | (a.isna() & b.isna())).all(), (ac, f)
        assert (got["prior_break_same_cpty"].fillna(0) < plain.loc[got.index, "prior_break_same_cpty"].fillna(1)).any()
    none = whole.where("asset_class is null").toPandas()
    assert none["entity_id_enc"].isna().all() and (none["rolling_7d_break_count"] == 1.0).all()


def test_a_model_scores_with_its_own_codes(spark, tmp_dir):
    """The label hangs on the entity alone; new entities that sort before the old ones must not shift the codes."""
    n = 400
    seen = spark.range(n).select(
        F.concat(F.lit("b"), "id").alias("break_id"), F.lit("CEQ").alias("asset_class"),
        F.when(F.col("id") % 2 == 0, "m").otherwise("p").alias("entity_id"),
        *[F.lit(0.0).alias(f) for f in C.ALL_FEATURES if f != "entity_id_enc"],
        (F.col("id") % 2).cast("int").alias("label"))
    codes = ENC.fit_encoders(seen)
    train = ENC.apply_encoders(seen, codes)
    split = TRN.stratified_split(TRN.with_class_weight(train)[0])
    model = TRN.fit_pipeline(split, max_iter=5)
    TRN.save_model(model, {"cv_mean_auc_roc": 0.9}, tmp_dir, "CEQ", "v1", publish=True, encoders=codes)
    assert _codes(TRN.model_encoders(spark, tmp_dir, "CEQ")) == _codes(codes)
    assert TRN.model_encoders(spark, tmp_dir, "OTC") is None
    # as the report alone would code them: a=0, b=1, m=2, p=3
    report = train.drop("label").withColumn("entity_id_enc", F.when(F.col("entity_id") == "m", 2.0).otherwise(3.0))
    scored = score_breaks(report, tmp_dir, n_trees=5)
    assert scored.columns == [*report.columns, "false_break_prob", "risk_tier"]
    mean = {r["entity_id"]: r["p"] for r in scored.groupBy("entity_id").agg(F.avg("false_break_prob").alias("p")).collect()}
    assert mean["m"] < 0.3 and mean["p"] > 0.7
