import datetime as dt

from breaklens import constants as C
from breaklens.operators import dq as DQ

SCHEMA = ("break_id string, asset_class string, owner string, approver string, status string, "
          "break_age_days int, break_amount_gbp double")


def _perfect(i="B1", ac="CEQ"):
    return (i, ac, "alice", "bob", "Open", 5, 100.0)


def test_perfect_row_scores_one(spark):
    r = DQ.compute_dq_scores(spark.createDataFrame([_perfect()], SCHEMA)).first()
    assert abs(r["dq_score"] - 1.0) < 1e-9
    for c in DQ.COMPONENTS:
        assert r[c] == 1.0


def test_components_penalise(spark):
    rows = [_perfect("B1"), ("B2", "LnD", None, "bob", "Open", 5, 100.0),
            ("B3", "LnD", "  ", "bob", "Open", 5, 100.0), ("B4", "XXX", "a", "b", "c", 5, 0.0),
            ("B5", "CEQ", "a", "b", "c", 0, 1.0), ("B5", "CEQ", "a", "b", "c", 3650, 1.0)]
    out = {(r["break_id"], r["break_age_days"]): r for r in
           DQ.compute_dq_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[("B2", 5)]["dq_governance_ok"] == 0.0 and out[("B2", 5)]["dq_score"] <= 0.70 + 1e-9
    assert out[("B3", 5)]["dq_governance_ok"] == 0.0          # blank counts as missing
    assert out[("B4", 5)]["dq_asset_class_valid"] == 0.0 and out[("B4", 5)]["dq_amount_nonzero"] == 0.0
    assert out[("B5", 0)]["dq_age_valid"] == 0.0 and out[("B5", 3650)]["dq_age_valid"] == 0.0
    assert out[("B5", 0)]["dq_no_duplicate"] == 0.0 and out[("B5", 3650)]["dq_no_duplicate"] == 0.0
    assert all(0.0 <= r["dq_score"] <= 1.0 for r in out.values())


def test_age_from_dates_when_column_absent(spark):
    df = spark.createDataFrame([("B1", dt.date(2026, 1, 1), dt.date(2026, 1, 11))],
                               "break_id string, break_open_date date, report_date date")
    assert DQ.compute_dq_scores(df).first()["dq_age_valid"] == 1.0


def test_weights_sum_to_one():
    assert abs(sum(C.DQ_WEIGHTS.values()) - 1.0) < 1e-12


def test_summary_has_overall_and_classes(spark):
    rows = [_perfect("B1", "CEQ"), ("B2", "LnD", None, "b", "c", 5, 1.0), ("B3", None, "a", "b", "c", 5, 1.0)]
    s = {r["asset_class"]: r for r in DQ.dq_summary(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(s) == {"CEQ", "LnD", "OVERALL"}
    assert s["OVERALL"]["rows"] == 3 and 0.0 <= s["OVERALL"]["mean_dq_score"] <= 1.0


def test_summary_of_empty_input(spark):
    s = DQ.dq_summary(spark.createDataFrame([], SCHEMA)).collect()
    assert len(s) == 1 and s[0]["asset_class"] == "OVERALL" and s[0]["rows"] == 0
