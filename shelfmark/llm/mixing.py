"""Mixing sources to target weights, by DataFrame operations alone.

Documents are the leaves' tokens of a tree domain - language - source. A budget goes
down the tree: a node's children share it by their weights, and a child that cannot use
its share (its tokens times ``epochs``) leaves the rest to its siblings by their weights.
A node never gets more than its children can use, so a shortage is made up among
siblings before it reaches an ancestor. What lies under a weight of 0 cannot be used.
Shares are whole tokens and add up exactly. Weights may be whole numbers, fractions or
decimals; a level's are made whole by their common denominator, so none is rounded.

A leaf takes whole epochs while its budget holds them, and of the next epoch the prefix
of its documents, in an order seeded for that epoch, whose tokens stay within the rest.
The prefix needs no sort of a leaf: the order's first ``BUCKET_DIGITS`` hex digits are a
bucket, buckets are summed before the shuffle, and only the bucket in which the budget
ends is sorted. The first document that crosses the rest ends the prefix, so a leaf, of any
size, takes less than its budget by up to that document's tokens.

Defined cases: a null text has no tokens and, like any document without tokens, fits
while its prefix does; a null language or source is the node 'none'; repeated rows are
documents of their own and tied, so all of them are taken or none; an empty table gives
no rows; a node without a named weight has weight 1, one of weight 0 gets nothing.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import lcm
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources.shared import settle

WORD = r"[^\x20\x09-\x0D]+"
SEED = 7
EPOCHS = 2
#: Part of all tokens that is asked for.
BUDGET_PERCENT = 80
BUCKET_DIGITS = 3
DOMAINS = 4
WEIGHTS = {
    "domain": {"d0": 2, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 2},
}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """d0 to d3 by the number at the end of a source's name, d0 without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    number = F.coalesce(number.try_cast("int"), F.lit(0))
    return F.concat(F.lit("d"), (number % DOMAINS).cast("string"))


def leaf_of_row() -> dict[str, Column]:
    """The levels of the leaf that a document (lang, source) is in."""
    return {
        "domain": domain_of(F.col("source")),
        "lang": F.coalesce("lang", F.lit("none")),
        "source": F.coalesce("source", F.lit("none")),
    }


def whole_weights(weights: dict[str, dict]) -> dict[str, dict]:
    """Each level's weights times their common denominator; None is the weight of others."""
    found = {}
    for level in LEVELS:
        named = {None: 1, **weights.get(level, {})}
        exact = {name: Fraction(str(weight)) for name, weight in named.items()}
        common = lcm(*(x.denominator for x in exact.values()))
        found[level] = {name: int(x * common) for name, x in exact.items()}
        if any(not 0 <= x < 10**10 for x in found[level].values()):
            raise ValueError(f"weights of {level} are negative or too far apart: {named}")
    return found


def weight_of(level: str, weights: dict[str, dict[str | None, int]]) -> Column:
    """The whole weight of a row's node."""
    named = F.lit(weights[level][None]).cast("decimal(10,0)")
    for value, weight in weights[level].items():
        if value is None:
            continue
        named = F.when(F.col(level) == value, F.lit(weight).cast("decimal(10,0)")).otherwise(named)
    return named


def share(children: DataFrame, parents: list[str], level: str, weights: dict) -> DataFrame:
    """``children`` (.., room, budget of the parent) with their own budget."""
    within = Window.partitionBy(*parents)
    order = within.orderBy(F.expr("cast(room as double) / greatest(cast(weight as double), 0.5)"), level)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = "decimal(20,0)"
    rows = children.withColumn("weight", weight_of(level, weights))
    rows = rows.withColumn("room", F.expr("if(weight = 0, 0, room)").cast(wide))
    rows = (
        rows.withColumn("used", F.coalesce(F.sum("room").over(earlier), F.lit(0)).cast(wide))
        .withColumn("weights_on", F.sum("weight").over(on).cast("decimal(14,0)"))
        .withColumn("full", F.expr("room * weights_on <= (budget - used) * weight"))
        .withColumn("open_weight", F.expr("if(full, 0, weight)").cast("decimal(14,0)"))
        .withColumn("left", F.expr("budget")
                    - F.sum(F.expr("if(full, room, 0)")).over(within).cast(wide))
        .withColumn("left", F.col("left").cast(wide))
        .withColumn("open_weights", F.sum("open_weight").over(within).cast("decimal(14,0)"))
        .withColumn("upto", F.sum("open_weight").over(upto).cast("decimal(14,0)"))
    )
    own = F.expr(
        "if(full, room, (left * upto) div open_weights - (left * (upto - open_weight)) div open_weights)"
    )
    return rows.withColumn("budget", own.cast(wide))


def budgets(leaves: DataFrame, percent: int, epochs: int, weights: dict) -> DataFrame:
    """``leaves`` (levels, supply) with the budget of each, from the root down."""
    weights = whole_weights(weights)
    can = reduce(and_, (weight_of(level, weights) > 0 for level in LEVELS))
    room = F.sum(F.when(can, F.col("supply")).otherwise(0)).cast("decimal(20,0)") * epochs
    total = leaves.agg(
        F.expr(f"(coalesce(sum(supply), 0) * least({percent}, {100 * epochs})) div 100")
        .cast("decimal(20,0)").alias("budget")
    )
    nodes, parents = total, []
    for level in LEVELS:
        keys = [*parents, level]
        children = leaves.groupBy(*keys).agg(room.alias("room"))
        children = children.join(nodes, parents) if parents else children.join(F.broadcast(total))
        nodes = share(children, parents, level, weights).select(*keys, "budget")
        parents = keys
    return leaves.join(nodes, list(LEVELS))


def choose(
    docs: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED,
    weights: dict = WEIGHTS,
) -> DataFrame:
    """How often each row of ``docs`` (doc_id, text, lang, source) is taken.

    doc_id, domain, lang, source, n_tokens, leaf_budget, copies (0 for those left out).
    """
    own = settle(
        docs.select(
            "doc_id", *(value.alias(level) for level, value in leaf_of_row().items()),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
        ), "mixing_documents",
    )
    keys = list(LEVELS)
    leaves = own.groupBy(*keys).agg(F.sum("n_tokens").alias("supply"))
    leaves = budgets(settle(leaves, "mixing_leaves"), percent, epochs, weights)
    leaves = settle(
        leaves.select(
            *keys, F.col("budget").cast("long").alias("leaf_budget"),
            F.expr("if(supply = 0, 0, budget div supply)").cast("long").alias("epochs"),
            F.expr("if(supply = 0, 0, budget % supply)").cast("long").alias("rest"),
        ), "mixing_budgets",
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "epochs", F.coalesce("doc_id", F.lit(-1))))
    placed = own.join(leaves, keys).withColumn("at", order)
    placed = placed.withColumn("bucket", F.substring("at", 1, BUCKET_DIGITS))
    sums = placed.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums = sums.withColumn("bucket_end", F.sum("tokens").over(upto))
    sums = settle(sums.withColumn("bucket_start", F.col("bucket_end") - F.col("tokens")), "mixing_buckets")
    ends = sums.join(leaves.select(*keys, "rest"), keys)
    last = ends.filter("bucket_start <= rest and rest < bucket_end").select(
        *keys, F.col("bucket").alias("last_bucket"), "bucket_start"
    )
    # a leaf whose rest reaches its end would have another whole epoch, so a bucket always ends it
    placed = placed.join(last, keys, "left")
    inside = placed.filter("bucket = last_bucket")
    whole = placed.filter("last_bucket is null or bucket <> last_bucket").withColumn(
        "taken", F.expr("bucket < last_bucket and last_bucket is not null")
    )
    running = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("at"))
    inside = inside.withColumn("taken", F.col("bucket_start") + running <= F.col("rest"))
    return whole.unionByName(inside).select(
        "doc_id", *keys, "n_tokens", "leaf_budget",
        (F.col("epochs") + F.coalesce("taken", F.lit(False)).cast("long")).alias("copies"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``choose`` takes, each as often as it says.

    A leaf's rows of one id are tied, so id and leaf tell what is taken.
    """
    copies = choose(docs, **options).filter("copies > 0")
    copies = copies.select(
        F.col("doc_id").alias("taken_id"), *(F.col(x).alias(f"taken_{x}") for x in LEVELS), "copies"
    ).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("taken_id"))
    for level, value in leaf_of_row().items():
        same &= value == F.col(f"taken_{level}")
    taken = docs.join(settle(copies, "mixing_taken"), same)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("time")
    return taken.select(*docs.columns, times).drop("time")


def oracle(
    percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: dict = WEIGHTS
) -> str:
    """The same choice as DuckDB SQL."""

    whole = whole_weights(weights)

    def case(level: str) -> str:
        named = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in whole[level].items() if k)
        return f"CASE {named} ELSE {whole[level][None]} END" if named else str(whole[level][None])

    can = " AND ".join(f"{case(level)} > 0" for level in LEVELS)

    steps, parents = [], []
    for level in LEVELS:
        keys = ", ".join([*parents, level])
        of = f"PARTITION BY {', '.join(parents)}" if parents else ""
        source = f"JOIN n_{parents[-1]} USING ({', '.join(parents)})" if parents else ", total"
        steps.append(f"""
c_{level} AS (SELECT *, CASE WHEN weight = 0 THEN 0 ELSE room0 END AS room FROM (
  SELECT {keys}, room0, budget, {case(level)} AS weight
  FROM (SELECT {keys}, sum(CASE WHEN {can} THEN supply ELSE 0 END)::HUGEINT * {epochs} AS room0 FROM leaf GROUP BY {keys}) {source})),
u_{level} AS (SELECT *,
  coalesce(sum(room) OVER ({of} ORDER BY room0::DOUBLE / greatest(weight, 0.5), {level}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
  (sum(weight) OVER ({of} ORDER BY room0::DOUBLE / greatest(weight, 0.5), {level}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weights_on FROM c_{level}),
f_{level} AS (SELECT *, room * weights_on <= (budget - used) * weight AS full_up FROM u_{level}),
g_{level} AS (SELECT *, CASE WHEN full_up THEN 0 ELSE weight END AS open_weight,
  budget - (sum(CASE WHEN full_up THEN room ELSE 0 END) OVER ({of}))::HUGEINT AS remaining,
  (sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ({of}))::HUGEINT AS open_weights,
  (sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ({of}
    ORDER BY room0::DOUBLE / greatest(weight, 0.5), {level}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::HUGEINT AS upto FROM f_{level}),
n_{level} AS (SELECT {keys}, (CASE WHEN full_up THEN room ELSE
  (remaining * upto) // open_weights - (remaining * (upto - open_weight)) // open_weights
  END)::HUGEINT AS budget FROM g_{level})""")
        parents.append(level)
    return f"""
WITH own AS (SELECT doc_id,
  'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0)
    % {DOMAINS}) AS domain,
  coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM own GROUP BY ALL),
total AS (SELECT (coalesce(sum(supply), 0)::HUGEINT * least({percent}, {100 * epochs})) // 100 AS budget
  FROM leaf),{",".join(steps)},
final AS (SELECT domain, lang, source, supply, budget::BIGINT AS leaf_budget,
  CASE WHEN supply = 0 THEN 0 ELSE (budget // supply)::BIGINT END AS epochs,
  CASE WHEN supply = 0 THEN 0 ELSE (budget % supply)::BIGINT END AS rest
  FROM leaf JOIN n_source USING (domain, lang, source)),
ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{seed}:' || epochs || ':' || coalesce(doc_id, -1))) AS upto
  FROM own JOIN final USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget,
  epochs + CASE WHEN upto <= rest AND supply > 0 THEN 1 ELSE 0 END AS copies
FROM ordered"""
