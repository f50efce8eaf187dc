import datetime as dt
import os

from pyspark.sql import functions as F

from breaklens.operators import feedback as FB
from breaklens.sources import store as ST
from breaklens.sources import uploads as UP
from breaklens.sources.csv import load_mi_report, read_csv

CSV = """BreakID,AssetClass,EntityID,ReportDate,break_open_date,BreakAmount,NetAmount,Owner, Extra Col
B1,CEQ,E1,2026-03-27,2026-03-20,12345,100,alice,x
B2,LnD,E2,27/03/2026,20/03/2026,-500,NA,,y
B3,OTC,E1,not-a-date,,N/A,0,bob,z
"""


def _write(tmp_dir, name, text):
    p = os.path.join(tmp_dir, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_aliases_na_and_dates(spark, tmp_dir):
    p = _write(tmp_dir, "a.csv", CSV)
    df = load_mi_report(spark, p)
    assert {"break_id", "asset_class", "entity_id", "report_date", "break_amount_pence", "owner",
            "extra col"} <= set(df.columns)
    rows = {r["break_id"]: r for r in df.collect()}
    assert rows["B1"]["report_date"] == dt.date(2026, 3, 27)
    assert rows["B2"]["report_date"] == dt.date(2026, 3, 27)      # day-first
    assert rows["B3"]["report_date"] is None and rows["B3"]["break_amount_pence"] is None
    assert rows["B2"]["owner"] is None and rows["B2"]["net_amount_pence"] is None


def test_missing_break_id_raises(spark, tmp_dir):
    p = _write(tmp_dir, "bad.csv", "col_a,col_b\n1,2\n")
    try:
        load_mi_report(spark, p)
        assert False, "expected ValueError"
    except ValueError:
        pass


def test_prepare_for_ingest(spark, tmp_dir):
    df = UP.prepare_for_ingest(load_mi_report(spark, _write(tmp_dir, "a.csv", CSV)), "h" * 64)
    r = {x["break_id"]: x for x in df.collect()}
    assert r["B1"]["break_amount_gbp"] == 123.45 and r["B1"]["report_month"] == "2026-03"
    assert r["B1"]["upload_hash"] == "h" * 64 and r["B1"]["risk_tier"] is None
    assert r["B1"]["break_amount_pence"] == "12345"  # original kept


def test_directory_ingest_is_idempotent(spark, tmp_dir):
    up = os.path.join(tmp_dir, "up"); os.makedirs(up)
    _write(up, "a.csv", CSV)
    _write(up, "b.csv", CSV)  # same bytes -> same hash
    cache, log = os.path.join(tmp_dir, "cache"), os.path.join(tmp_dir, "log")
    first = UP.ingest_directory(spark, up, cache, log)
    assert first is not None and first.select("upload_hash").distinct().count() == 1
    assert UP.ingest_directory(spark, up, cache, log) is None
    assert UP.read_upload_log(spark, log).count() >= 1


def test_snapshot_ingest_upsert_and_write_back(spark, tmp_dir):
    old = spark.createDataFrame([("B1", "CEQ", 1.0), ("B2", "LnD", 2.0)],
                                "break_id string, asset_class string, break_amount_gbp double")
    new = spark.createDataFrame([("B2", "OTC", 5.0), ("B3", "MTN", 3.0), ("B3", "MTN", 4.0)],
                                "break_id string, asset_class string, break_amount_gbp double")
    rep = {r["break_id"]: r for r in ST.ingest(None, new, "replace").collect()}
    assert set(rep) == {"B2", "B3"} and rep["B3"]["break_amount_gbp"] == 4.0
    app = {r["break_id"]: r for r in ST.ingest(old, new, "append").collect()}
    assert set(app) == {"B1", "B2", "B3"} and app["B2"]["asset_class"] == "OTC"
    assert len(ST.ingest(old, new).columns) == 35
    upd = spark.createDataFrame([("B1", 0.9)], "break_id string, dq_score double")
    wb = {r["break_id"]: r["dq_score"] for r in ST.write_back(ST.ingest(old, new, "append"), upd,
                                                                ["dq_score"]).collect()}
    assert wb == {"B1": 0.9, "B2": None, "B3": None}
    root = os.path.join(tmp_dir, "breaks")
    ST.write_snapshot(ST.ingest(old, new, "append"), root)
    ST.write_snapshot(ST.ingest(None, new, "replace"), root)
    cur = ST.load_snapshot(spark, root)
    assert cur.count() == 2 and cur.where(F.col("asset_class") == "OTC").count() == 1
    ST.csv_export(cur, os.path.join(tmp_dir, "out_csv"))
    assert read_csv(spark, os.path.join(tmp_dir, "out_csv")).count() == 2


def test_feedback_counts_gate_and_flags(spark):
    rows = [("B1", 1, "CEQ"), ("B1", 0, "CEQ"), ("B2", 1, None), ("B3", 0, "LnD")]
    fb = FB.prepare_feedback(spark.createDataFrame(rows, "break_id string, analyst_label int, asset_class string"))
    assert fb.where(F.col("override_flag")).count() == 0 and fb.select("feedback_id").distinct().count() == 4
    counts = {r["asset_class"]: (r["genuine"], r["false_break"], r["total"]) for r in FB.feedback_counts(fb).collect()}
    assert counts["TOTAL"] == (2, 2, 4) and counts["CEQ"] == (1, 1, 2) and counts[None] == (0, 1, 1)
    assert FB.feedback_for_retraining(fb, min_labels=2).count() == 2
    flagged = {r["break_id"]: r["already_had_feedback"] for r in FB.flag_existing(fb.where("break_id != 'B1'"),
                                                                                   fb.where("break_id = 'B2'")).collect()}
    assert flagged == {"B2": True, "B3": False}
    empty = FB.feedback_counts(fb.limit(0)).collect()
    assert [(r["asset_class"], r["total"]) for r in empty] == [("TOTAL", 0)]


def test_unfinished_cache_folder_is_written_anew(spark, tmp_dir):
    from breaklens.sources.uploads import load_or_cache
    path = os.path.join(tmp_dir, "r.csv")
    with open(path, "w") as f:
        f.write("break_id,asset_class\n" + "".join(f"B{i},CEQ\n" for i in range(10)))
    cache = os.path.join(tmp_dir, "cache")
    spark.createDataFrame([("B0", "CEQ")], "break_id string, asset_class string").write.parquet(os.path.join(cache, "h"))
    os.remove(os.path.join(cache, "h", "_SUCCESS"))
    assert load_or_cache(spark, path, "h", cache).count() == 10


def test_same_content_twice_is_loaded_once(spark, tmp_dir):
    from breaklens.sources.uploads import ingest_directory, read_upload_log
    up = os.path.join(tmp_dir, "up")
    os.makedirs(up)
    for n in ("a.csv", "b.csv"):
        with open(os.path.join(up, n), "w") as f:
            f.write("break_id,asset_class\nB1,CEQ\nB2,LnD\n")
    log = os.path.join(tmp_dir, "log")
    assert ingest_directory(spark, up, os.path.join(tmp_dir, "cache"), log).count() == 2
    assert read_upload_log(spark, log).count() == 1
    assert ingest_directory(spark, up, os.path.join(tmp_dir, "cache"), log) is None


def test_feedback_of_one_time_is_sorted_by_many_tasks(spark):
    at = F.lit("2026-01-02").cast("timestamp_ntz")
    fb = spark.range(20000).select(F.col("id").cast("string").alias("break_id"), F.lit(1).alias("analyst_label"),
                                   at.alias("feedback_timestamp"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        loaded = FB.load_feedback(fb)
        sizes = [r["count"] for r in loaded.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(sizes) == 20000 and max(sizes) < 10000


def test_the_gate_does_not_deal_feedback_out_by_class(spark):
    fb = spark.range(1000).select(F.col("id").cast("string").alias("break_id"),
                                  F.when(F.col("id") > 10, "CEQ").when(F.col("id") > 3, "OTC").alias("asset_class"))
    passed = FB.feedback_for_retraining(fb, min_labels=100)
    assert passed.count() == 989
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(asset_class" not in plan


def test_the_newest_rows_of_an_upload_are_those_of_the_whole_prepared_rows(spark):
    rows = [("a", "2026-01-31", 100, 7, None), ("a", "2026-02-01", 50, 9, 1.0), ("b", "2026-01-01", None, 3, None),
            ("b", "2026-01-01", 5, 2, None), ("b", "2026-01-01", 5, 4, 0.5), (None, None, -1, 1, None), (None, None, -2, 8, 2.0)]
    given = spark.createDataFrame(rows, "break_id string, report_date string, break_amount_pence bigint, net_amount_pence bigint, "
                                        "mad_score double").withColumn("upload_hash", F.concat(F.lit("h"), "net_amount_pence"))
    typed = given.withColumn("report_date", F.col("report_date").cast("date"))
    fractions = typed.withColumn("break_amount_pence", F.col("break_amount_pence") + 0.5)
    for df in (typed, given, fractions, typed.drop("report_date"), typed.drop("break_amount_pence")):
        for upload_hash in ("x" * 64, None):
            want = ST.ingest(None, UP.prepare_for_ingest(df, upload_hash), "replace")
            for parts in (None, 3):
                got = UP.newest_prepared(df, upload_hash, parts)
                assert got.dtypes == want.dtypes and got.count() == 3
                assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # what is the same in all rows or follows from other columns isn't moved with them
    plan = UP.newest_prepared(typed, "x" * 64, 3)._jdf.queryExecution().executedPlan().toString()
    moved = plan[plan.index("Exchange hashpartitioning"):]
    assert "net_amount_gbp" in moved and "mad_score" in moved
    assert not any(c in moved for c in ("report_month", "risk_tier", "break_amount_gbp"))
