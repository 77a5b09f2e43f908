"""CSV files with line breaks in quoted values, read by several tasks."""

from __future__ import annotations

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.sources import records, tables

SPLIT, OPEN = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    before = {key: spark.conf.get(key) for key in (SPLIT, OPEN)}
    spark.conf.set(SPLIT, 700)
    spark.conf.set(OPEN, 10)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def inside_by_letter(line, inside):
    """The same by one letter at a time."""
    fresh, at = not inside, 0
    while at < len(line):
        letter = line[at]
        if inside:
            if letter == '"':
                if line[at + 1 : at + 2] == '"':
                    at += 1
                else:
                    inside = False
        elif letter == '"' and fresh:
            inside = True
        fresh = not inside and letter == ","
        at += 1
    return inside


@settings(max_examples=500, deadline=None)
@given(st.text('a,"', max_size=14), st.booleans())
def test_state_at_the_end_of_a_line(line, inside):
    assert records.ends_inside(line, inside) == inside_by_letter(line, inside)


def value(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice('ab,\n"\r x') for _ in range(rng.randrange(12)))
    if kind < 0.5:
        return 'line one\n\nline, "two"\r\nline three' * rng.randint(1, 60 if kind < 0.32 else 4)
    return str(rng.randrange(10**6))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(7)
    rows = [[str(i), value(rng), value(rng), "z"] for i in range(1200)]
    for k in range(3):
        text = io.StringIO(newline="")
        out = csv.writer(text, lineterminator=end)
        out.writerow(["id", "first, with\nbreak", "second", "last"])
        out.writerows(rows[k::3])
        (tmp_path / f"{k}.csv").write_bytes(text.getvalue().encode())
    df = tables.read_csv(spark, f"{tmp_path}/*.csv")
    assert df.columns == ["id", "first, with\nbreak", "second", "last", "corrupt_record"]
    want = {tuple(x or None for x in row) for row in rows}
    got = [tuple(x or None for x in row) for row in df.collect()]
    assert len(got) == len(rows) and {r[:4] for r in got} == want
    assert all(r[4] is None for r in got)
    tasks = records.lines_of(spark, f"{tmp_path}/*.csv").rdd.getNumPartitions()
    assert tasks > 30


def test_stray_quotes_unfit_fields_and_short_records(spark, tmp_path, small_splits):
    """As Spark's reader, which takes one task a file, understands them."""
    good = ['1,"a\nb",5\n', '2,5" pipe,6\n', '3,"x ""y""\n\n,z",x\n', '4,"q"r,7\n', "5,only\n",
            '6,a,1,more\n', '7,"",8\n', "8,,9\n"]
    (tmp_path / "t.csv").write_text("id,name,number\n" + "".join(good * 60))
    rows, rejects = tables.load_csv(spark, f"{tmp_path}/t.csv", "id int, name string, number int")
    reader = spark.read.options(
        header=True, quote='"', escape='"', multiLine=True, nullValue=tables.ABSENT, emptyValue="",
        columnNameOfCorruptRecord="corrupt_record", mode="PERMISSIVE",
    )
    plain = reader.schema("id string, name string, number string, corrupt_record string")
    plain = plain.csv(f"{tmp_path}/t.csv").collect()
    assert len(plain) == 480
    want = sorted((int(r.id), r.name, int(r.number) if r.number not in (None, "x") else None) for r in plain)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)
    assert rejects.count() == 60 * 3


def test_a_file_without_breaks_is_read_by_lines(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text("a,b\n" + '1,"x, y"\n' * 900)
    df = tables.read_csv(spark, f"{tmp_path}/t.csv")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan and df.rdd.getNumPartitions() > 5
    assert df.filter("b = 'x, y'").count() == 900


def test_no_file_content(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,"b\nc"\n')
    assert tables.read_csv(spark, f"{tmp_path}/t.csv").collect() == []
    (tmp_path / "u.csv").write_text('a,b\n1,"open\nnever closed')
    assert [tuple(r)[:2] for r in tables.read_csv(spark, f"{tmp_path}/u.csv").collect()] == [
        ("1", "open\nnever closed")
    ]


def test_split_settings_are_put_back(spark):
    before = spark.conf.get(records.MIN_SPLITS, None)
    with pytest.raises(ZeroDivisionError), records.fixed_splits(spark):
        assert spark.conf.get(records.MIN_SPLITS)
        1 / 0
    assert spark.conf.get(records.MIN_SPLITS, None) == before
