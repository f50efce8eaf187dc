import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from breaklens.operators import metrics as MT
from breaklens.operators import tiers as TR


def test_tier_boundaries(spark):
    df = spark.createDataFrame([(0.81,), (0.80,), (0.5,), (0.49,), (None,), (float("nan"),)], "false_break_prob double")
    got = [r["risk_tier"] for r in TR.assign_risk_tiers(df).collect()]
    assert got == ["Suppress", "Review", "Review", "Escalate", "Unscored", "Unscored"]


def test_retier_only_listed_classes(spark):
    df = spark.createDataFrame([("CEQ", 0.75, "Review"), ("LnD", 0.75, "Review"), ("CEQ", None, "Unscored")],
                               "asset_class string, false_break_prob double, risk_tier string")
    got = [r["risk_tier"] for r in TR.update_risk_tiers(df, asset_thresholds={"CEQ": 0.7}).collect()]
    assert got == ["Suppress", "Review", "Unscored"]


def test_suppression_stats(spark):
    df = spark.createDataFrame([("Suppress", -10.5), ("Suppress", 2.0), ("Review", 1.0), ("Escalate", 1.0)],
                               "risk_tier string, break_amount_gbp double")
    s = TR.suppression_stats(df).first()
    assert (s["total"], s["suppressed"], s["suppressed_pct"], s["value_suppressed"]) == (4, 2, 50.0, 12.5)


def _brute(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    order = sorted(set(p), reverse=True)
    ap, P = 0.0, len(pos)
    for s in order:
        tp = sum(1 for yi, pi in zip(y, p) if pi >= s and yi == 1)
        fp = sum(1 for yi, pi in zip(y, p) if pi >= s and yi == 0)
        new = sum(1 for yi, pi in zip(y, p) if pi == s and yi == 1)
        ap += new / P * tp / (tp + fp)
    return auc, ap


def test_metrics_match_definitions(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300).tolist()
    p = np.round(rng.random(300) * 0.5 + np.array(y) * 0.3, 2).tolist()  # ties on purpose
    pdf = pd.DataFrame({"break_id": [f"b{i:03d}" for i in range(300)], "label": y, "false_break_prob": p,
                        "asset_class": "CEQ"})
    ev = MT.evaluate(spark.createDataFrame(pdf)).first()
    auc, ap = _brute(y, p)
    assert abs(ev["auc_roc"] - round(auc, 4)) < 1e-9
    assert abs(ev["average_precision"] - round(ap, 4)) < 1e-9
    k = max(1, int(300 * 0.10))
    top = pdf.sort_values(["false_break_prob", "break_id", "label"], ascending=[False, True, True]).head(k)
    assert abs(ev["precision_at_10pct"] - round(top["label"].mean(), 4)) < 1e-9
    pred = (pdf.false_break_prob >= 0.5).astype(int)
    tp = int(((pred == 1) & (pdf.label == 1)).sum()); fp = int(((pred == 1) & (pdf.label == 0)).sum())
    fn = int(((pred == 0) & (pdf.label == 1)).sum())
    assert (ev["tp"], ev["fp"], ev["fn"]) == (tp, fp, fn)
    assert abs(ev["f1"] - round(2 * tp / (2 * tp + fp + fn), 4)) < 1e-9


def test_single_class_gives_zero_auc(spark):
    df = spark.createDataFrame([("a", 1, 0.3, "X"), ("b", 1, 0.9, "X")],
                               "break_id string, label int, false_break_prob double, asset_class string")
    ev = MT.evaluate(df).first()
    assert ev["auc_roc"] == 0.0 and ev["average_precision"] == 0.0


def test_precision_at_top_with_heavy_ties(spark):
    from breaklens.operators.metrics import precision_at_top
    rows = [(f"b{i:03d}", ["A", "B", None][i % 3], 0.9 if i % 4 else 0.1 * (i % 7), i % 2) for i in range(300)]
    got = {r.asset_class: (r.precision_at_10pct, r.k) for r in precision_at_top(
        spark.createDataFrame(rows, "break_id string, asset_class string, false_break_prob double, label int")).collect()}
    for c in ("A", "B", None):
        mine = sorted((-p, b, y) for b, cls, p, y in rows if cls == c)
        k = max(1, len(mine) // 10)
        assert got[c] == (sum(y for *_, y in mine[:k]) / k, k)
