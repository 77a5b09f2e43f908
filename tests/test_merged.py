"""Tiles by several metrics, mergeable counts and quantiles, chains, exact shares, buckets."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shelfmark.catalog import QUESTIONS, tables_of
from shelfmark.operators import clean, distinct, ranking, sketches, star
from shelfmark.plans import customers
from shelfmark.sources import buckets
from shelfmark.sources.shared import settle

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain_ntile(rows, order, tiles):
    """Tile of each row of an ordered list."""
    ordered = sorted(rows, key=order)
    small, extra = divmod(len(rows), tiles)
    found, at = {}, 0
    for tile in range(1, tiles + 1):
        size = small + (tile <= extra)
        for row in ordered[at : at + size]:
            found[row[0]] = tile
        at += size
    return found


@pytest.mark.parametrize("size, tiles, kinds", [(0, 5, 3), (1, 5, 1), (3, 5, 2), (5, 5, 5), (97, 5, 4),
                                                (200, 7, 1), (333, 10, 400), (64, 1, 3)])
def test_tiles_by_several_metrics(spark, size, tiles, kinds):
    rng = random.Random(size)
    rows = [
        (i, rng.choice([None, *range(kinds)]), Decimal(rng.randrange(kinds * 3)) / 4)
        for i in rng.sample(range(10_000), size)
    ]
    df = settle(spark.createDataFrame(rows, "k long, a int, b decimal(10,2)"), "tiles")
    metrics = {"ta": ranking.Metric("a"), "tb": ranking.Metric("b", largest_first=True),
               "tc": ranking.Metric("a", largest_first=True)}
    got = {r.k: (r.ta, r.tb, r.tc) for r in ranking.ntiles(df, metrics, "k", tiles).collect()}
    up = plain_ntile(rows, lambda r: (r[1] is not None, r[1] or 0, r[0]), tiles)
    money = plain_ntile(rows, lambda r: (-r[2], r[0]), tiles)
    down = plain_ntile(rows, lambda r: (r[1] is None, -(r[1] or 0), r[0]), tiles)
    assert got == {r[0]: (up[r[0]], money[r[0]], down[r[0]]) for r in rows}


def test_customers_of_rfm_do_not_shuffle_after_their_aggregate(spark):
    plan = plan_of(customers.rfm(tables_of(spark, SF).shop.fact))
    assert "Exchange" not in plan and "Window" not in plan


def test_distinct_counts_by_bitmaps(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y"]), rng.choice([1, 2, 3]), rng.choice([None, *range(90_000)])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a string, b int, id long")
    numbers = distinct.dense_numbers(df, "id")
    ids = sorted({r[2] for r in rows if r[2] is not None})
    assert {r.id: r.id_number for r in numbers.collect()} == {x: i for i, x in enumerate(ids, 1)}
    fine = distinct.bitmaps(df.join(numbers, "id", "left"), distinct.NUMBER, "a", "b")
    found = {(r.a, r.b): r.n for r in distinct.count(fine, "n", "a", "b").collect()}
    want = defaultdict(set)
    for a, b, i in rows:
        if i is not None:
            want[(a, b)].add(i)
            want[a].add(i)
    assert found == {k: len(v) for k, v in want.items() if isinstance(k, tuple)}
    coarse = distinct.count(distinct.merge(fine, "a"), "n", "a")
    assert {r.a: r.n for r in coarse.collect()} == {k: len(v) for k, v in want.items() if isinstance(k, str)}


def test_numbers_beyond_one_bitmap_row(spark):
    df = spark.range(7, 200_000, 7).withColumn("g", F.lit(1))
    found = distinct.bitmaps(df, "id", "g")
    assert found.count() == 7
    assert distinct.count(found, "n", "g").first().n == len(range(7, 200_000, 7))


def test_quantiles_of_merged_sketches(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 7).alias("g"), (F.col("id") % 50).alias("h"),
        F.when(F.col("id") % 11 != 0, F.pow(F.rand(3), 3)).alias("v"),
    )
    df = settle(df, "values")
    shares = {"low": 0.1, "median": 0.5, "high": 0.99}
    for k in (100, 800):
        fine = settle(sketches.sketch(df, "v", "g", "h", k=k), "fine")
        found = settle(sketches.quantiles(sketches.merge(fine, "g"), shares), "found")
        assert {r.g: r.n for r in found.collect()} == {
            r.g: r.n for r in df.groupBy("g").agg(F.count("v").alias("n")).collect()
        }
        off = sketches.off_by(df, "v", found, "g", shares).collect()
        assert max(r[name] for r in off for name in shares) < 3 * sketches.rank_error(k)
    assert sketches.rank_error(800) < sketches.rank_error(100) / 4
    assert "rangepartitioning" not in plan_of(sketches.quantiles(sketches.sketch(df, "v", "g"), shares))


def test_a_sketch_of_no_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    found = {r.g: r.m for r in sketches.quantiles(sketches.sketch(df, "v", "g"), {"m": 0.5}).collect()}
    assert found == {"a": None, "b": 2.0}


def mapped(spark, pairs):
    return spark.createDataFrame(pairs, "old string, new string")


@pytest.mark.parametrize("length", [1, 2, 3, 8, 9, 100])
def test_chains_end_at_their_last_id(spark, length):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(length)] + [("x", "c0"), ("y", "z"), ("s", "s"), ("y", "z")]
    random.Random(length).shuffle(pairs)
    got = {r.old: r.new for r in clean.follow(mapped(spark, pairs), "old", "new").collect()}
    assert got == {**{f"c{i}": f"c{length}" for i in range(length)}, "x": f"c{length}", "y": "z"}


@pytest.mark.parametrize("length", [2, 3, 7])
def test_circles_are_errors(spark, length):
    pairs = [(f"c{i}", f"c{(i + 1) % length}") for i in range(length)] + [("x", "c0"), ("a", "b")]
    with pytest.raises(clean.Cycle):
        clean.follow(mapped(spark, pairs), "old", "new")


def test_two_new_ids_are_an_error_and_none_are_none(spark):
    with pytest.raises(ValueError, match="a is mapped"):
        clean.follow(mapped(spark, [("a", "b"), ("a", "c")]), "old", "new")
    assert clean.follow(mapped(spark, []), "old", "new").count() == 0


def plain_shares(amount, parts):
    """Cents by largest remainders; equal ones by line id."""
    whole = sum(p for _, p in parts if p is not None)
    if amount is None or whole <= 0:
        return {line: None for line, _ in parts}
    exact = {line: Fraction(amount * (p or 0), whole) for line, p in parts}
    low = {line: x.numerator // x.denominator for line, x in exact.items()}
    order = sorted(parts, key=lambda r: (low[r[0]] - exact[r[0]], r[0]))
    for line, _ in order[: amount - sum(low.values())]:
        low[line] += 1
    return low


@pytest.mark.parametrize("limit", [0, 5, 1000])
def test_shares_add_up_to_the_cent(spark, limit):
    rng = random.Random(3)
    rows, want = [], {}
    for order in range(60):
        amount = rng.choice([None, 0, 1, 7, 100, 999, rng.randrange(10**6)])
        kind = rng.random()
        parts = [
            (order * 100 + i, 500 if kind < 0.3 else rng.choice([None, 0, rng.randrange(10**5)]))
            for i in range(rng.randint(1, 40))
        ]
        if kind > 0.9:
            parts.append((order * 100 + 99, -300))
        want |= plain_shares(amount, parts)
        rows += [(order, line, None if amount is None else Decimal(amount) / 100,
                  None if p is None else Decimal(p) / 100) for line, p in parts]
    df = spark.createDataFrame(rows, "o long, l long, amount decimal(10,2), part decimal(10,2)")
    found = star.allocate_exactly(df, "amount", "part", "o", "l", "share", lines_in_a_task=limit)
    got = {r.l: None if r.share is None else int(r.share * 100) for r in found.collect()}
    assert got == want


def test_the_fact_with_exact_shipping(spark):
    shop = tables_of(spark, SF).shop
    fact = star.build_fact_sales(
        shop.order_details, shop.orders, shop.customers, shop.products, shop.regions, exact_shipping=True
    )
    assert fact.columns == star.FACT_COLUMNS and fact.count() == shop.fact.count()
    paid = fact.groupBy("order_id").agg(F.sum("shipping_cost").alias("given")).join(shop.placed_orders, "order_id")
    assert paid.filter("given <> shipping_cost").count() == 0


def test_bucketed_join_does_not_shuffle_the_fact(spark):
    rows = [(i % 40 if i % 3 else 7, i) for i in range(3000)]
    fact = spark.createDataFrame(rows, "p long, v long")
    goods = spark.createDataFrame([(i, f"name {i}") for i in range(35)], "p long, name string")
    kept = buckets.write_bucketed(fact, "p", 4, "sold")
    dimension = buckets.write_dimension(goods, "p", 4, "goods")
    assert [r.p for r in kept.hot_keys.collect()] == [7]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        joined = kept.join(spark, dimension)
        got = joined.collect()
        plan = plan_of(joined)
    finally:
        spark.conf.set(threshold, before)
    want = Counter((p, v, f"name {p}") for p, v in rows if p < 35)
    assert Counter((r.p, r.v, r.name) for r in got) == want
    assert "Bucketed: true" in plan
    assert not re.search(r"Exchange hashpartitioning", plan.split("== Initial Plan ==")[-1])
    buckets.drop(spark, kept.cool, dimension)


def test_positions_are_the_order_of_the_lists(spark):
    tables = tables_of(spark, SF)
    for name in (n for n in QUESTIONS if n.startswith("srt01_")):
        listed = [r[0] for r in QUESTIONS[name.removeprefix("srt01_")](tables).collect()]
        placed = sorted(QUESTIONS[name](tables).collect(), key=lambda r: r.position)
        assert [r.position for r in placed] == list(range(1, len(listed) + 1))
        assert [r[0] for r in placed] == listed, name
