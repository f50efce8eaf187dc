"""The feature graph: only what is asked for, and what it is made of, is computed."""

import pytest

from breaklens import constants as C
from breaklens.operators import features as FT
from breaklens.operators import labels as LB
from breaklens.plans import scoring_plan as SP
from breaklens.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_needed_follows_features_and_statistics():
    assert FT.needed(["is_month_end_week"]) == ({"is_month_end_week"}, set())
    features, stats = FT.needed(["is_statistical_outlier"])
    assert features == {"is_statistical_outlier", "mad_score", "break_amount_gbp"} and stats == {"mad"}
    features, stats = FT.needed(LB.RULE_FEATURES)
    assert stats == {"mad", "counterparty"} and "dq_score" not in features and "amount_percentile" not in features
    assert FT.needed(C.ALL_FEATURES) == (set(C.ALL_FEATURES), set(FT.STATISTICS))
    with pytest.raises(ValueError):
        FT.needed(["no_such_feature"])


def test_a_part_equals_the_same_part_of_the_whole(spark):
    rows = SP.report(Fixtures(spark, SF))
    rows = FT.materialize(rows, "report")
    whole = FT.materialize(FT.build_feature_matrix(rows), "whole")
    parts = [["rolling_7d_break_count"], ["amount_percentile"], ["team_code_enc"], ["prior_break_same_cpty"],
             ["offsetting_break_exists", "segment_median_age"], ["is_statistical_outlier"], ["segment_median_age"],
             ["governance_completeness_score", "break_direction_enc"]]
    for part in parts:
        got = FT.build_feature_matrix(rows, keep_input=["break_id"], only=part)
        assert got.columns == ["break_id", *[c for c in C.ALL_FEATURES if c in part]]
        want = whole.select(got.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, part


def test_one_statistic_takes_one_aggregate_and_no_table(spark):
    rows = spark.createDataFrame([("b1", "e1", 3.0), ("b2", "e1", 9.0), ("b3", None, 1.0)],
                                 "break_id string, entity_id string, break_age_days double")
    got = FT.build_feature_matrix(rows, keep_input=["break_id"], only=["rolling_7d_break_count"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and "parquet" not in plan
    assert {r[0]: r[1] for r in got.collect()} == {"b1": 1.0, "b2": 1.0, "b3": 1.0}
