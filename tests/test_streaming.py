import os

from pyspark.sql import functions as F

from breaklens.sources import store as ST
from breaklens.streaming.uploads_stream import start_upload_ingest

COLS = ["BreakID", "AssetClass", "ReportDate", "BreakAmount"]


def _write(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        f.write(",".join(COLS) + "\n" + "\n".join(rows) + "\n")


def test_stream_ingests_each_file_once(spark, tmp_dir):
    up = os.path.join(tmp_dir, "uploads"); os.makedirs(up)
    snap, log, ck = (os.path.join(tmp_dir, x) for x in ("breaks", "log", "ckpt"))
    _write(up, "a.csv", ["B1,CEQ,2026-03-27,100", "B2,LnD,2026-03-27,200"])
    start_upload_ingest(spark, up, snap, log, ck, COLS).awaitTermination()
    s1 = ST.load_snapshot(spark, snap)
    assert s1.count() == 2 and s1.where(F.col("break_amount_gbp") == 1.0).count() == 1
    # a later upload updates B2 and adds B3; the first file is not read again
    _write(up, "b.csv", ["B2,OTC,2026-04-30,250", "B3,MTN,2026-04-30,300"])
    start_upload_ingest(spark, up, snap, log, ck, COLS).awaitTermination()
    s2 = {r["break_id"]: r for r in ST.load_snapshot(spark, snap).collect()}
    assert set(s2) == {"B1", "B2", "B3"} and s2["B2"]["asset_class"] == "OTC"
    assert s2["B2"]["report_month"] == "2026-04" and s2["B1"]["upload_hash"] != s2["B3"]["upload_hash"]
    # nothing new: no new snapshot version, log unchanged
    n_log = ST.read_table(spark, log, ST.UPLOAD_LOG_SCHEMA).count()
    start_upload_ingest(spark, up, snap, log, ck, COLS).awaitTermination()
    assert ST.read_table(spark, log, ST.UPLOAD_LOG_SCHEMA).count() == n_log == 2


def test_renamed_copies_and_replayed_batches_count_once(spark, tmp_dir):
    up = os.path.join(tmp_dir, "uploads"); os.makedirs(up)
    snap, log = (os.path.join(tmp_dir, x) for x in ("breaks", "log"))
    _write(up, "a.csv", ["B1,CEQ,2026-03-27,100", "B2,LnD,2026-03-27,200"])
    _write(up, "a copy+1.csv", ["B1,CEQ,2026-03-27,100", "B2,LnD,2026-03-27,200"])
    start_upload_ingest(spark, up, snap, log, os.path.join(tmp_dir, "c1"), COLS).awaitTermination()
    start_upload_ingest(spark, up, snap, log, os.path.join(tmp_dir, "c2"), COLS).awaitTermination()  # all files again
    entries = ST.read_table(spark, log, ST.UPLOAD_LOG_SCHEMA).collect()
    assert len(entries) == 1 and entries[0].row_count == 2
    assert ST.load_snapshot(spark, snap).count() == 2 and os.listdir(snap) == ["v=1"]
