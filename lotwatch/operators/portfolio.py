"""What the collector spends, waits for, lacks and plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.times import ZONE, month_start

#: Fixed value: a parcel up to this amount is free of duty.
DUTY_FREE = 200.0


def monthly_budget(purchases: DataFrame, amount: str, at: str, budget: Column, zone: str = ZONE) -> DataFrame:
    """Per local month (by its UTC start): spent, count, and what of the budget is left (null without a budget)."""
    m = purchases.groupBy(month_start(F.col(at), zone).alias("month_start")).agg(F.round(F.sum(amount), 2).alias("spent"), F.count(amount).alias("purchases"))
    return m.withColumn("available", F.round(budget - F.col("spent"), 2))


def shipment(purchases: DataFrame, keys: Sequence[str], amount: str, shipped: Column, limit: float = DUTY_FREE) -> DataFrame:
    """The pile that waits: pieces, their sum, the room below the duty-free limit and whether it is exceeded."""
    pile = purchases.filter(~shipped).groupBy(*keys).agg(F.count(F.lit(1)).alias("pending"), F.round(F.sum(amount), 2).alias("pending_amount"))
    return pile.withColumn("headroom", F.round(limit - F.col("pending_amount"), 2)).withColumn("exceeded", F.col("pending_amount") > limit)


def coverage(wanted: DataFrame, searched: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per `by`: wanted keys, those that a search covers, and the rest. `by` are columns of wanted."""
    hit = searched.select(*keys).distinct().withColumn("_hit", F.lit(1))
    x = wanted.select(*dict.fromkeys([*by, *keys])).distinct().join(hit, list(keys), "left")
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("covered")).withColumn("uncovered", F.col("wanted") - F.col("covered"))


def greedy_plan(candidates: DataFrame, group: Sequence[str], rank: str, cost: str, key: str, budget: int) -> DataFrame:
    """Walk each group's candidates in rank order and take each that still fits; one that doesn't is skipped.

    That isn't a running sum, so the walk is a fold, over the rows that it can take at all: once a row of a cost doesn't
    fit, no later one of that cost does, so of a cost c only the first budget div c rows count. Rows without cost always
    fit and stay out of the fold. Costs are whole units; a negative one fails, and one that is null is skipped.
    """
    least = F.col(cost).cast("long")
    rows = candidates.withColumn("_cost", F.when(least < 0, F.raise_error(F.lit("greedy_plan: a cost is negative"))).otherwise(least))
    free = rows.filter((F.col("_cost") == 0) & F.lit(budget >= 0)).select(*group, key)
    alike = Window.partitionBy(*group, "_cost").orderBy(rank, key)
    # The first condition follows from the second; a constant lets Spark prune before it shuffles.
    few = rows.filter("_cost > 0").withColumn("_rn", F.row_number().over(alike)).filter((F.col("_rn") <= budget) & (F.col("_rn") <= F.expr(f"{budget}L div _cost")))
    few = few.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(rank, key)))
    listed = few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rn", F.col("_cost").alias("cost"), F.col(key).alias("key")))).alias("xs"))
    empty = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<{dict(candidates.dtypes)[key]}>").alias("taken"))
    step = lambda a, x: F.when(x["cost"] <= a["left"], F.struct((a["left"] - x["cost"]).alias("left"), F.array_append(a["taken"], x["key"]).alias("taken"))).otherwise(a)
    return listed.withColumn("plan", F.aggregate("xs", empty, step)).select(*group, F.explode("plan.taken").alias(key)).unionByName(free)


def quotas(ranked: DataFrame, kind: str, limits: dict[str, int], *order: Column | str) -> DataFrame:
    """The best rows of each kind, at most its quota; kinds without a quota give none."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    rn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return ranked.withColumn("place", rn).filter(F.col("place") <= F.element_at(limit, F.col(kind)))
