import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from breaklens import constants as C
from breaklens.operators import features as FT
from breaklens.operators import labels as LB


def _frame(spark, n=50, seed=42):
    rng = np.random.default_rng(seed)
    rd = dt.date(2026, 3, 27)
    rows = []
    for i in range(n):
        ac = ["CEQ", "LnD", "MTN", "OTC"][i % 4]
        rows.append(dict(
            break_id=f"B{i}", asset_class=ac, entity_id=None if i % 11 == 0 else f"E{i % 3}",
            team_code=f"T{i % 2}", rec_name=f"R{i % 2}", source_system=["TLM", "DUCO", "X"][i % 3],
            break_open_date=rd - dt.timedelta(days=int(rng.integers(0, 40))), report_date=rd,
            last_activity_date=rd - dt.timedelta(days=int(rng.integers(0, 5))),
            break_amount_gbp=float(np.round(rng.normal(0, 1000), 2)) if i % 13 else None,
            net_amount_gbp=float(rng.normal()), gross_amount_gbp=float(rng.normal()),
            break_direction=["Dr", "Cr", "DR"][i % 3], owner=None if i % 5 == 0 else "o",
            approver="a", status="s", counterparty=None if i % 7 == 0 else f"C{i % 4}",
            coupon_payment_proximity=float(i % 5), div_ex_date_proximity=float(i % 6),
            csa_margin_call_flag=i % 2))
    return spark.createDataFrame(pd.DataFrame(rows)), pd.DataFrame(rows)


def test_42_features_in_order(spark):
    df, _ = _frame(spark)
    out = FT.build_feature_matrix(df, keep_input=False)
    assert out.columns == C.ALL_FEATURES and len(C.ALL_FEATURES) == 42
    assert out.count() == 50


def test_asset_specific_features_null_elsewhere(spark):
    df, _ = _frame(spark)
    out = FT.build_feature_matrix(df).select("asset_class", *C.ASSET_SPECIFIC_FEATURES).collect()
    own = {"CEQ": C.CEQ_FEATURES, "LnD": C.LND_FEATURES, "MTN": C.MTN_FEATURES, "OTC": C.OTC_FEATURES}
    for r in out:
        for cls, feats in own.items():
            if r["asset_class"] != cls:
                assert all(r[f] is None for f in feats)
    assert all(r["collateral_type_enc"] == -1.0 for r in out if r["asset_class"] == "LnD")


def test_group_features_equal_pandas(spark):
    df, pdf = _frame(spark)
    out = FT.build_feature_matrix(df).toPandas().set_index("break_id")
    p = pdf.set_index("break_id")
    # W02 average-rank percentile within class
    exp_pct = p.groupby("asset_class")["break_amount_gbp"].rank(pct=True)
    assert np.allclose(out.loc[exp_pct.index, "amount_percentile"].astype(float), exp_pct, equal_nan=True)
    # W03 same-counterparty count
    exp_c = p.groupby("counterparty")["counterparty"].transform("count") - 1
    assert np.allclose(out.loc[p.index, "prior_break_same_cpty"].astype(float), exp_c, equal_nan=True)
    # W05 MAD score per (entity, team, rec, class)
    keys = ["entity_id", "team_code", "rec_name", "asset_class"]
    a = p["break_amount_gbp"].abs()
    med = a.groupby([p[k] for k in keys]).transform("median")
    mad = (a - med).abs().groupby([p[k] for k in keys]).transform("median")
    exp_mad = ((a - med) / (mad + 1e-9)).abs()
    assert np.allclose(out.loc[p.index, "mad_score"].astype(float), exp_mad, equal_nan=True)
    # W08 stateless codes (sorted, null -> __MISSING__)
    codes = pd.Categorical(p["entity_id"].fillna("__MISSING__")).codes
    assert np.array_equal(out.loc[p.index, "entity_id_enc"].astype(int).to_numpy(), codes)
    # W07 recent count per entity, default 1
    age = (p["report_date"] - p["break_open_date"]).apply(lambda d: d.days)
    cnt = p[age <= 7].groupby("entity_id").size()
    exp_r7 = p["entity_id"].map(cnt).fillna(1)
    assert np.allclose(out.loc[p.index, "rolling_7d_break_count"], exp_r7)


def test_offsetting_counterparty(spark):
    rows = [("A", "C1", 10.0), ("B", "C1", -10.4), ("C", "C2", 5.0), ("D", None, 0.0), ("E", "C3", None)]
    df = spark.createDataFrame(rows, "break_id string, counterparty string, break_amount_gbp double")
    out = {r["break_id"]: r["offsetting_break_exists"] for r in FT.build_feature_matrix(df).collect()}
    assert out == {"A": 1.0, "B": 1.0, "C": 0.0, "D": 0.0, "E": 1.0}


def _base(**kw):
    row = dict(break_id="X", asset_class="CEQ", break_age_days=50.0, rolling_7d_autoclose_rate=0.1,
               coupon_payment_proximity=None, div_ex_date_proximity=None,
               governance_completeness_score=0.5, offsetting_break_exists=False,
               is_statistical_outlier=False, csa_margin_call_flag=False)
    row.update(kw)
    return row


SCH = ("break_id string, asset_class string, break_age_days double, rolling_7d_autoclose_rate double, "
       "coupon_payment_proximity double, div_ex_date_proximity double, governance_completeness_score double, "
       "offsetting_break_exists boolean, is_statistical_outlier boolean, csa_margin_call_flag boolean")


def _label(spark, **kw):
    r = LB.label_breaks(spark.createDataFrame([_base(**kw)], SCH)).first()
    return r["pseudo_label"], r["label_confidence"], r["label_rule"]


def test_each_rule(spark):
    assert _label(spark) == (None, None, None)
    assert _label(spark, rolling_7d_autoclose_rate=0.9) == (1, 0.85, "R01")
    assert _label(spark, offsetting_break_exists=True) == (1, 0.90, "R02")
    assert _label(spark, is_statistical_outlier=True, break_age_days=2.0) == (1, 0.75, "R03")
    assert _label(spark, is_statistical_outlier=True, break_age_days=30.0)[0] is None
    assert _label(spark, asset_class="OTC", csa_margin_call_flag=True, break_age_days=1.0) == (1, 0.80, "R04")
    assert _label(spark, asset_class="CEQ", csa_margin_call_flag=True, break_age_days=1.0)[0] is None
    assert _label(spark, asset_class="MTN", coupon_payment_proximity=2.0, break_age_days=2.0) == (1, 0.80, "R05")
    assert _label(spark, asset_class="CEQ", div_ex_date_proximity=1.0, break_age_days=2.0) == (1, 0.80, "R06")
    assert _label(spark, governance_completeness_score=1.0, break_age_days=120.0) == (0, 0.70, "R07")
    # precedence: R01 beats R02
    assert _label(spark, rolling_7d_autoclose_rate=0.9, offsetting_break_exists=True)[2] == "R01"


def test_missing_columns_never_match(spark):
    df = spark.createDataFrame([("X", "OTC")], "break_id string, asset_class string")
    r = LB.label_breaks(df).first()
    assert r["pseudo_label"] is None


def test_training_filter_and_summary(spark):
    rows = [_base(break_id="a", rolling_7d_autoclose_rate=0.9),
            _base(break_id="b", governance_completeness_score=1.0, break_age_days=120.0),
            _base(break_id="c")]
    df = LB.label_breaks(spark.createDataFrame(rows, SCH))
    assert {r["break_id"] for r in LB.get_training_set(df).collect()} == {"a"}
    assert {r["break_id"] for r in LB.get_training_set(df, 0.70).collect()} == {"a", "b"}
    s = LB.label_summary(df).first()
    assert (s["total"], s["false_break"], s["genuine"], s["unlabelled"], s["labelled_pct"]) == (3, 1, 1, 1, 66.7)
