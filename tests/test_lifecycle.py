import datetime as dt

import pytest
from pyspark.sql import functions as F

from breaklens.operators import lifecycle as L
from breaklens.operators import reports as R


def _cash(spark):
    rows = [("2025-12-01", " T1 ", "EQ", "100.5"), ("2025-12-02", "T1", "EQ", "-50"),
            ("2025-12-02", "T1", "EQ", "bad"), ("2025-12-05", "T2", "FX", "10"),
            ("2026-03-01", "T3", "FX", "1"), ("not a date", "T4", "FX", "1")]
    return spark.createDataFrame(rows, "BREAK_DATE string, TRADE_ID string, PRODUCT string, BREAK string")


def _mi(spark):
    rows = [("2025-12-03", "T1", "Sophis vs FTP - ETD PnL", None, 10),
            ("2025-12-01", "T1", "FOBO Rec-Equities", "J1", 5),
            ("2025-12-01", "T1", "Zeta Rec - X", None, 5),
            ("2025-12-04", "T1", "FOBO Rec-Equities", None, 5),
            ("2025-12-06", "T2", "Custom\tSystem rec", None, 200),
            ("2025-12-06", "T2", "Other Thing", None, 3)]
    return spark.createDataFrame(rows, "`Date` string, `TRADE REF` string, `Rec Name (as per Rec Cube)` string, "
                                       "`Journals Posted` string, `Age Days` int")


def test_schema_check_raises_before_any_job(spark):
    with pytest.raises(ValueError):
        L.standardize_cash(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError):
        L.standardize_mi(spark.createDataFrame([("d", "t")], "`Date` string, `TRADE REF` string"))


def test_standardise_strips_and_coerces(spark):
    c = L.standardize_cash(_cash(spark)).collect()
    assert {r["TRADE_ID"] for r in c} == {"T1", "T2", "T3", "T4"}
    amounts = sorted(r["BREAK"] for r in c)
    assert 0.0 in amounts and 100.5 in amounts  # "bad" -> 0
    assert sum(r["Date"] is None for r in c) == 1


def test_full_lifecycle(spark):
    out = L.run_lifecycle(_cash(spark), _mi(spark)).orderBy("BreakChainID").collect()
    assert [r["BreakChainID"] for r in out] == [0, 1]          # EQ|T1, FX|T2 (T3 outside window)
    t1, t2 = out
    assert t1["Trade"] == "T1" and t1["Days_Active"] == 2 and t1["Total_Breaks"] == 3
    assert t1["Total_Amount"] == 50.5 and t1["Is_Recurring"]
    # same date: precedence rank 1 (FOBO) before unknown (999); FOBO seen again later -> once
    assert t1["Rec_Flow"] == "FOBO Rec-Equities → Zeta Rec - X → Sophis vs FTP - ETD PnL"
    assert t1["Root_Rec"] == "FOBO Rec-Equities" and t1["Root_System"] == "FOBO"
    assert t1["Journal_Used"] and t1["False_Closure"]
    # age cap drops the 200-day row; fallback root system = text before first whitespace
    assert t2["Root_Rec"] == "Other Thing" and t2["Root_System"] == "Other"
    assert not t2["Journal_Used"] and not t2["False_Closure"] and not t2["Is_Recurring"]


def test_pipe_inside_ids_does_not_merge_chains(spark):
    rows = [("2025-12-01", "b", "a|", "1"), ("2025-12-01", "|b", "a", "1")]
    cash = L.standardize_cash(spark.createDataFrame(rows, "BREAK_DATE string, TRADE_ID string, PRODUCT string, BREAK string"))
    s = L.build_chain_summary(cash).collect()
    assert len(s) == 2 and sorted(r["BreakChainID"] for r in s) == [0, 1]


def test_reports(spark):
    summ = L.run_lifecycle(_cash(spark), _mi(spark))
    k = R.p1_kpis(summ).first()
    assert k["total_chains"] == 2 and k["false_closure"] == 1 and k["false_closure_pct"] == 50.0
    top = R.root_system_top(summ).collect()
    assert {r["Root_System"] for r in top} == {"FOBO", "Other"}
    full = {r["Root_System"]: r for r in R.root_system_full(summ).collect()}
    assert full["FOBO"]["FC_Rate"] == 100.0 and full["Other"]["FC_Rate"] == 0.0
    tf = R.top_false_closures(summ).collect()
    assert [r["Trade"] for r in tf] == ["T1"]
    h = R.days_active_hist(summ).collect()
    assert sum(r["chains"] for r in h) == 1
    assert R.display_projection(summ).columns[0] == "Trade"


def test_empty_kpis_have_null_percentages(spark):
    summ = L.run_lifecycle(_cash(spark), _mi(spark), start="2030-01-01", end="2030-02-01")
    k = R.p1_kpis(summ).first()
    assert k["total_chains"] == 0 and k["false_closure_pct"] is None


def test_money_sums_keep_fractions_of_a_penny(spark):
    rows = [("2024-01-02", "T1", "P", v) for v in ("0.004", "0.004", "0.004", "abc", None, "Infinity")]
    cash = L.standardize_cash(spark.createDataFrame(rows, "BREAK_DATE string, TRADE_ID string, PRODUCT string, BREAK string"))
    assert L.build_chain_summary(cash).first()["Total_Amount"] == 0.012
