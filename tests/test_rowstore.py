"""Kept rows: numbered once, looked up by number, never moved whole."""

import pytest
from pyspark.sql import functions as F

from breaklens import constants as C
from breaklens import session as S
from breaklens.operators import anomaly as AN
from breaklens.operators import dq as DQ
from breaklens.operators import features as FT
from breaklens.operators import rowstore as RS
from breaklens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _moves(df):
    """Exchanges of rows by a key in the plan (broadcasts don't count)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def _report(spark):
    """Breaks with ids and counterparties that come often, once or not at all."""
    rows = [(None if i % 7 == 0 else f"b{i % 30}", None if i % 11 == 0 else "CEQ" if i % 2 else "OTC", f"E{i % 3}", f"T{i % 2}", "R",
             None if i % 13 == 0 else "hot" if i % 3 else f"c{i}", None if i % 10 == 0 else float(i % 17) - 8.0, i * 100 if i % 10 == 0 else None)
            for i in range(1, 91)]
    return spark.createDataFrame(rows, "break_id string, asset_class string, entity_id string, team_code string, rec_name string, "
                                 "counterparty string, break_amount_gbp double, break_amount_pence long") \
        .withColumns({"report_date": F.lit("2024-03-29").cast("date"), "break_open_date": F.lit("2024-03-01").cast("date")})


def test_rows_meet_what_is_found_for_them_in_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(RS, "CHUNK", 300)  # three chunks a task
    rows = RS.keep_rows(spark.range(5000).withColumn("v", F.col("id") * 2).repartition(7), "t")
    assert rows.select(RS.ROW).distinct().count() == 5000
    assert max(r["count"] for r in rows.groupBy(RS.PART).count().collect()) <= 1200 and rows.select(RS.PART).distinct().count() == 8
    found = rows.where("id % 3 = 0").select(RS.ROW, (F.col("v") + 1).alias("w"))
    found = spark.createDataFrame(found.collect(), found.schema)  # lies in no buckets
    settings = {"autoBroadcastJoinThreshold": "-1", "requireAllClusterKeysForCoPartition": "false"}
    with RS._settings(spark, **settings):
        own, same = RS._dealt(rows, found)
        assert _moves(rows.join(own, same, "left")) == 1  # only what was found is dealt out
        got = RS.attach(rows, found, "t")
        flagged = RS.mark(rows, found, "hit", "t")
        assert flagged.where("hit").count() == 1667 and flagged.count() == 5000
        assert _moves(flagged) == 0
        assert "Join" not in flagged.select("v")._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert {(r.id, r.v, r.w) for r in got.collect()} == {(i, 2 * i, None if i % 3 else 2 * i + 1) for i in range(5000)}


def test_repeated_and_null_ids_are_told_for_kept_rows(spark):
    for df in (_report(spark), _report(spark).limit(8)):  # of eight rows, one has no id
        cols = df.columns + DQ.COMPONENTS + ["dq_score"]
        got = DQ.compute_dq_scores(RS.keep_rows(df, "t")).select(cols)
        want = DQ.compute_dq_scores(df).select(cols)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_matrix_is_read_without_moving_its_rows(spark):
    df = _report(spark)
    got = FT.build_feature_matrix(df, keep_input=["break_id", "counterparty"])
    assert _moves(got) == 0
    rows = df.toPandas()
    amount = rows["break_amount_gbp"].fillna(rows["break_amount_pence"] / 100)
    rank = amount.groupby(rows["asset_class"]).rank(pct=True)
    others = rows.groupby("counterparty")["entity_id"].transform("count") - 1
    nets = amount.groupby(rows["counterparty"]).transform("sum").abs().lt(1.0) & rows["counterparty"].notna()
    plain = lambda v: None if v is None or v != v else round(float(v), 9)
    want = sorted(str((i, c, *map(plain, v))) for i, c, *v in zip(
        rows["break_id"].where(rows["break_id"].notna(), None), rows["counterparty"].where(rows["counterparty"].notna(), None),
        amount, rank, others, nets * 1.0))
    told = got.select("break_id", "counterparty", "break_amount_gbp", "amount_percentile", "prior_break_same_cpty",
                      "offsetting_break_exists").collect()
    assert sorted(str((r[0], r[1], *map(plain, r[2:]))) for r in told) == want


@pytest.mark.parametrize("name", ["x_feature_matrix", "m02_median_impute", "m03_anomaly_fallback", "k03_score_breaks"])
def test_no_table_of_all_features_is_written(spark, name):
    before = set(S._SCRATCH)
    out = QUERIES[name](spark, SF)
    n = out.count()
    assert n == QUERIES["a10_dq_summary"](spark, SF).where("asset_class = 'OVERALL'").first()["rows"]
    read = [spark.read.parquet(p).columns for p in set(S._SCRATCH) - before if S.path_exists(spark, p)]
    assert read and not [c for c in read if {"abs_amount_log", "days_overdue_vs_sla", "is_quarter_end"} & set(c)]
    assert not [c for c in read if len(set(c) & set(C.ALL_FEATURES)) > 12]


def test_sketches_of_many_tasks_stay_small(spark):
    # each task sends one sketch per feature and group: its size, not the rows, decides what is shuffled
    df = spark.range(120_000).select(F.rand(5).alias("v"))
    sketch = df.repartition(4).groupBy().agg(F.percentile_approx("v", [0.5 - AN.NEAR, 0.5 + AN.NEAR], AN.SKETCH))
    lo, hi = sketch.first()[0]
    assert lo <= df.approxQuantile("v", [0.5], 0.0)[0] <= hi and AN.SKETCH <= 1000 and AN.NEAR * AN.SKETCH >= 3 - 1e-9


def test_a_forest_does_not_depend_on_the_order_of_rows_of_one_id(spark):
    rows = [("same", "CEQ", float(i), float(i * i % 31)) for i in range(40)]
    both = [AN.fit_forest(spark.createDataFrame(r, "break_id string, asset_class string, a double, b double").coalesce(1), ["a", "b"], n_trees=6, psi=8)
            .sort_values(["tree", "node"]).to_numpy().tolist() for r in (rows, rows[::-1])]
    assert both[0] and both[0] == both[1]
