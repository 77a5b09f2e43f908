"""Column expressions against plain Python."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import dates, measures, text
from shelfmark.operators import clean

NAMES = [
    "esch-sur-alzette", "the hague", "LUXEMBOURG CITY", "o'neil", "3d printer", "'t hart",
    "nation_3", "chloé MÜLLER", "a-b c.d", "", " two  blanks ", "iDEAL", "x1y2z",
]


def test_title_case_starts_a_word_after_every_non_letter(spark):
    df = spark.createDataFrame([(n,) for n in [*NAMES, None]], "name string")
    rows = df.select("name", text.title_case(F.col("name")).alias("title")).collect()
    assert [r.title for r in rows] == [n.title() for n in NAMES] + [None]


def test_title_case_on_random_text(spark):
    random.seed(7)
    letters = "abXYZéÉøŁ019 -_'.,/\t"
    texts = ["".join(random.choices(letters, k=random.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", text.title_case(F.col("t")).alias("title")).collect():
        assert row.title == row.t.title(), repr(row.t)


EMAILS = {
    "a.bgmail.com": "a.b@gmail.com",
    "A.B@GMAIL.COM": "a.b@gmail.com",
    "a.b@host": None,
    "a.bexample.org": None,
    None: None,
    "gmail.comgmail.com": "@gmail.com@gmail.com",
    "  A.Boutlook.com\t": "a.b@outlook.com",
    "nodots": None,
    "a@b@c.de": None,
    "a@b.c@d": "a@b.c@d",
    # the first host in list order wins, not the first in the text
    "x.yahoo.com.gmail.com": "x.yahoo.com.@gmail.com",
    "": None,
}


def test_repair_emails(spark):
    df = spark.createDataFrame([(e,) for e in EMAILS], "email string")
    rows = clean.repair_emails(df).collect()
    assert {r.email_original: r.email for r in rows} == EMAILS


def test_week_of_year_counts_sunday_weeks_from_january_first(spark):
    first, last = date(2021, 1, 1), date(2025, 12, 31)
    days = [first + timedelta(i) for i in range((last - first).days + 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r.w for r in df.select(dates.week_of_year(F.col("d")).alias("w")).collect()]
    expected, week = [], 0
    for day in days:
        if (day.month, day.day) == (1, 1):
            week = 1
        elif day.weekday() == 6:
            week += 1
        expected.append(week)
    assert got == expected


@pytest.mark.parametrize(
    "part, whole, expected", [(1, 8, 12.5), (1, 3, 33.33), (-1, 8, -12.5), (1, 0, None)]
)
def test_percent_rounds_half_up_and_guards_zero(spark, part, whole, expected):
    df = spark.createDataFrame([(part, whole)], "part int, whole int")
    row = df.select(measures.percent(F.col("part"), F.col("whole")).alias("p")).first()
    assert row.p == expected


def test_mean_is_exact_and_ignores_null(spark):
    df = spark.createDataFrame([("0.10",), ("0.20",), (None,)], "v string")
    row = df.select(F.col("v").cast("decimal(10,2)").alias("v")).agg(measures.mean("v")).first()
    assert row[0] == 0.3 / 2


def test_mean_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "v int")
    assert df.agg(measures.mean("v")).first()[0] is None
