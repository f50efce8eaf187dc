import csv
import random

import pytest

from breaklens.sources.csv import csv_records, read_csv


def write(folder, name, rows, newline="\n"):
    with open(folder / name, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(["break_id", "note", "desk"])
        w.writerows(rows)


def rows_of(n, rng):
    words = ["a", 'say "x"', "line\nbreak", ",", 'end"', "", "\n\n", "ü", '"', "x,\"\n\",y", " plain text "]
    return [[str(i), "".join(rng.choice(words) for _ in range(rng.randint(0, 5))), rng.choice(words) + "z"] for i in range(n)]


@pytest.fixture()
def small_splits(spark):
    """Splits far shorter than some records."""
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_breaks_across_splits(spark, tmp_path, small_splits, newline):
    rng = random.Random(6)
    want = rows_of(60, rng) + [["long", "many\nlines\n" * 60, "d"]] + rows_of(20, rng)
    write(tmp_path, "a.csv", want[:50], newline)
    write(tmp_path, "b.csv", want[50:], newline)
    got = csv_records(spark, str(tmp_path))
    assert got.columns == ["break_id", "note", "desk"]
    assert sorted((r.break_id, r.note or "", r.desk) for r in got.collect()) == sorted(map(tuple, want))


def test_quote_inside_a_plain_field_is_a_character(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('break_id,note\n1,5" pipe\n2,"two\nlines"\n\n3,b"c"\n4\n5,"q ""x"", y"\n')
    got = sorted((r.break_id, r.note) for r in csv_records(spark, str(tmp_path)).collect())
    assert got == [("1", '5" pipe'), ("2", "two\nlines"), ("3", 'b"c"'), ("4", None), ("5", 'q "x", y')]


def test_empty_header_only_and_given_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("break_id,note\n")
    assert csv_records(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text('x,y\n1,"NA"\n2,"a\nb"')
    got = read_csv(spark, str(tmp_path), ["k", "v"])
    assert sorted((r.k, r.v) for r in got.collect()) == [("1", None), ("2", "a\nb")]
