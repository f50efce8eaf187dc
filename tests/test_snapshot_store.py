"""Written snapshots: appended deltas, compaction, write-back, lookups."""

import os

import pytest
from pyspark.sql import functions as F

from breaklens.operators import dq as DQ
from breaklens.sources import store as ST

SCHEMA = "break_id string, asset_class string, status string, owner string, report_month string, line int"


def rows(spark, *given):
    return spark.createDataFrame([(i, a, s, "o", "2026-03", n) for i, a, s, n in given], SCHEMA)


def read(df):
    return {r.break_id: r.status for r in df.collect()}


def test_appends_are_merged_on_read_and_leave_the_base_alone(spark, tmp_dir):
    root = os.path.join(tmp_dir, "snap")
    assert ST.load_snapshot(spark, root).count() == 0
    ST.append_upload(rows(spark, ("a", "CEQ", "old", 1), ("b", "OTC", "old", 2), (None, "OTC", "old", 3)), root)
    base = sorted(os.listdir(os.path.join(root, "v=1")))
    # in file order the last line of an id counts, whatever it says
    ST.append_upload(rows(spark, ("b", "OTC", "z first", 1), ("b", "OTC", "a last", 2), ("c", "CEQ", "new", 3)), root,
                     F.col("line"))
    assert read(ST.load_snapshot(spark, root)) == {"a": "old", "b": "a last", "c": "new", None: "old"}
    # equal ordinals: the row itself decides; a later delta wins over an earlier one; null is an id
    ST.append_upload(rows(spark, ("c", "CEQ", "x", 1), ("c", "CEQ", "y", 1), (None, "MTN", "newer", 9)), root, F.col("line"))
    want = {"a": "old", "b": "a last", "c": "y", None: "newer"}
    assert read(ST.load_snapshot(spark, root)) == want
    assert sorted(os.listdir(os.path.join(root, "v=1"))) == base
    assert sorted(n for n in os.listdir(root)) == ["d=1-1", "d=1-2", "v=1"]
    assert ST.compact(spark, root).endswith("v=2") and ST.compact(spark, root) is None
    assert read(ST.load_snapshot(spark, root)) == want


def test_an_unfinished_delta_does_not_count(spark, tmp_dir):
    root = os.path.join(tmp_dir, "snap")
    ST.append_upload(rows(spark, ("a", "CEQ", "old", 1)), root)
    path = ST.append_upload(rows(spark, ("a", "CEQ", "new", 1)), root)
    os.remove(os.path.join(path, "_SUCCESS"))
    assert read(ST.load_snapshot(spark, root)) == {"a": "old"}


def test_update_writes_a_version_that_reads_back(spark, tmp_dir):
    root = os.path.join(tmp_dir, "snap")
    ST.append_upload(rows(spark, ("a", "CEQ", "s", 1), ("b", "OTC", "s", 1)), root)
    got = ST.update_snapshot(spark, root, lambda cur: cur.where("break_id = 'b'").select(
        "break_id", F.lit(0.25).alias("dq_score")), ["dq_score"])
    assert {r.break_id: r.dq_score for r in got.collect()} == {"a": None, "b": 0.25}
    assert os.path.exists(os.path.join(root, "v=2", "_SUCCESS"))


def test_queries_and_lookup(spark, tmp_dir):
    root = os.path.join(tmp_dir, "snap")
    ST.append_upload(rows(spark, *((f"b{i}", ["CEQ", "OTC", "MTN"][i % 3], "s", i) for i in range(30))), root)
    snap = ST.load_snapshot(spark, root)
    assert ST.query_breaks(snap).count() == 30 and ST.query_breaks(snap, [], []).count() == 30
    assert ST.query_breaks(snap, ["CEQ", "OTC"]).count() == 20 and ST.query_breaks(snap, limit=7).count() == 7
    assert ST.query_breaks(snap, risk_tiers=["Review"]).count() == 0
    assert ST.query_breaks(snap, ["MTN"], columns=["break_id"]).columns == ["break_id"]
    with pytest.raises(ValueError):
        ST.query_breaks(snap, columns=["nope"])
    one = ST.break_by_id(snap, "b7")
    assert [r.break_id for r in one.collect()] == ["b7"] and ST.break_by_id(snap, "no").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(break_id,b7)" in plan and "Exchange" not in plan


def test_the_key_filter_of_a_file_is_sized_by_its_keys(spark, tmp_dir):
    root = os.path.join(tmp_dir, "snap")
    ST.write_snapshot(ST.ingest(None, rows(spark, ("a", "CEQ", "s", 1), ("b", "OTC", "s", 2))), root)
    sizes = [os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(root) for n in names if n.endswith(".parquet")]
    assert sizes and max(sizes) < 200_000  # an unsized filter takes 1 MB


def test_scores_are_dealt_out_once_and_null_ids_are_one_group(spark):
    given = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("", 3.0), (None, 4.0), (None, 5.0), ("b", 6.0)], "break_id string, v double")
    scored = DQ.compute_dq_scores(given)
    assert {(r.v, r.dq_no_duplicate) for r in scored.collect()} == {(1.0, 0.0), (2.0, 0.0), (3.0, 1.0), (4.0, 0.0), (5.0, 0.0), (6.0, 1.0)}
    by_hand = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in by_hand}
    try:
        for k, v in by_hand.items():
            spark.conf.set(k, v)
        table = given.withColumn("dq_score", F.lit(None).cast("double"))
        plan = ST.write_back(table, scored.select("break_id", "dq_score"), ["dq_score"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 3  # the table, the scored rows and the counts, each once


def without_broadcasts(spark, make):
    """Text of the plan of ``make()`` as joins and exchanges stand before runtime."""
    by_hand = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in by_hand}
    try:
        for k, v in by_hand.items():
            spark.conf.set(k, v)
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scores(cur):
    return DQ.compute_dq_scores(cur.drop("dq_score"), stored=True).select("break_id", "dq_score")


def test_a_bucketed_version_is_written_back_without_moving_rows(spark, tmp_dir):
    root, plain = os.path.join(tmp_dir, "a snap"), os.path.join(tmp_dir, "plain")
    given = rows(spark, *((f"b{i % 40}", ["CEQ", "no"][i % 2], "s", i) for i in range(60)), (None, "OTC", "s", 1), ("", "OTC", " ", 2))
    given = given.withColumn("report_month", F.when(F.col("line") % 7 > 0, F.concat(F.lit("2026-0"), F.col("line") % 7)))
    ST.write_snapshot(ST.ingest(None, given, parts=3), root, buckets=3)
    ST.write_snapshot(ST.ingest(None, given), plain)
    current = ST.load_snapshot(spark, root)
    plan = without_broadcasts(spark, lambda: ST.write_back(current, scores(current), ["dq_score"], bucketed=True).repartition(3, "break_id"))
    assert "ShuffledHashJoin" in plan and "Exchange hashpartitioning" not in plan
    got = ST.update_snapshot(spark, root, scores, ["dq_score"])
    want = ST.update_snapshot(spark, plain, lambda cur: DQ.compute_dq_scores(cur.drop("dq_score")).select("break_id", "dq_score"),
                              ["dq_score"])
    assert got.schema == want.schema and len(got.collect()) == 42
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    names = [n for at, _, files in os.walk(os.path.join(root, "v=2")) for n in files if n.endswith(".parquet")]
    assert {n.split("_")[1][:5] for n in names} == {"00000", "00001", "00002"}
    # another session, which has no buckets, reads the same rows; deltas still count
    assert spark.read.schema(ST.BREAKS_SCHEMA).parquet(os.path.join(root, "v=2")).count() == 42
    ST.append_upload(rows(spark, ("b1", "CEQ", "newer", 1), (None, "OTC", "newer", 1)), root)
    again = ST.update_snapshot(spark, root, scores, ["dq_score"])
    assert sorted(r.status for r in again.collect() if r.break_id in (None, "b1")) == ["newer", "newer"] and again.count() == 42
    assert [r.break_id for r in ST.break_by_id(got, "b7").collect()] == ["b7"]


def test_rows_for_buckets_are_dealt_out_once_and_sorted_after_it(spark):
    given = rows(spark, ("a", "CEQ", "s", 1), ("a", "CEQ", "t", 2))
    plan = without_broadcasts(spark, lambda: ST.ingest(None, given, parts=5).repartition(5, "break_id"))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [break_id") == 1
    assert read(ST.ingest(None, given, parts=5)) == {"a": "t"}


def test_stored_scores_equal_those_of_any_rows(spark):
    given = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("", 3.0), (None, 4.0), (None, 5.0), ("b", 6.0)], "break_id string, v double")
    for df in (given, given.where("v <> 4"), given.where("break_id IS NOT NULL")):
        assert sorted(map(str, DQ.compute_dq_scores(df, stored=True).collect())) == sorted(map(str, DQ.compute_dq_scores(df).collect()))


def test_buckets_grow_with_the_files_read(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(ST, "BUCKET_BYTES", 2000)
    counts = []
    for n in (2_000, 20_000):
        path = os.path.join(tmp_dir, f"of {n}")
        spark.range(n).selectExpr("uuid() AS break_id").coalesce(1).write.parquet(path)
        counts.append(ST.bucket_count(spark.read.parquet(path).where("break_id <> ''")))
    assert counts[0] > 20 and 8 < counts[1] / counts[0] < 12
    assert ST.bucket_count(spark.range(5)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_key_filter_of_a_few_keys_takes_a_few_bytes(spark, tmp_dir):
    root = os.path.join(tmp_dir, "snap")
    ST.append_upload(rows(spark, ("a", "CEQ", "s", 1)), root)
    ST.append_upload(rows(spark, ("b", "OTC", "s", 2)), root)
    sizes = [os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(root) for n in names if n.endswith(".parquet")]
    assert len(sizes) == 2 and max(sizes) < 30_000  # of 64 KB, the least of five sizes
