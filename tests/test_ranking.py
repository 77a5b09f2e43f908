"""Distributed positions against Spark's own single-task windows and numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import ranking


def values(spark, rows, hot=False):
    value = (F.col("id") * 7919 % 1009).cast("int")
    if hot:  # a third of the rows hold one value
        value = F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(value)
    return spark.range(rows).repartition(5).withColumn("value", value)


@pytest.mark.parametrize("rows", [1, 3, 5, 7, 1000, 1501])
@pytest.mark.parametrize("hot", [False, True])
def test_ntile_equals_the_global_window(spark, rows, hot):
    df = values(spark, rows, hot)
    order = [F.col("value").desc(), F.col("id").asc()]
    mine = {r.id: r.t for r in ranking.ntile(df, order, 5, "t").collect()}
    window = F.ntile(5).over(Window.orderBy(*order))
    assert mine == {r.id: r.t for r in df.withColumn("t", window).collect()}


def test_row_numbers_are_a_permutation_in_order(spark):
    df = ranking.row_numbers(
        values(spark, 2000, hot=True), [F.col("value").asc(), F.col("id").asc()], "n", "all"
    )
    got = sorted((r.n, r.value, r.id, r.all) for r in df.collect())
    assert [g[0] for g in got] == list(range(1, 2001))
    assert [g[1:3] for g in got] == sorted(g[1:3] for g in got)
    assert {g[3] for g in got} == {2000}


@pytest.mark.parametrize("rows", [1, 2, 4, 999, 1000])
@pytest.mark.parametrize("hot", [False, True])
def test_exact_percentiles(spark, rows, hot):
    df = values(spark, rows, hot).withColumn("value", F.col("value").cast("decimal(10,2)"))
    with_gap = df.unionByName(df.limit(1).withColumn("value", F.lit(None).cast("decimal(10,2)")))
    asked = {"low": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = ranking.exact_percentiles(with_gap, "value", asked).first().asDict()
    data = [float(r.value) for r in df.collect()]
    for name, p in asked.items():
        assert got[name] == pytest.approx(np.percentile(data, 100 * p), abs=1e-9)


def test_percentiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([(None,)], "value int")
    assert ranking.exact_percentiles(df, "value", {"median": 0.5}).first().median is None
