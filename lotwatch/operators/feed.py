"""Feeds of opportunities: gates, diversity, clusters of equal content, price drops, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a fall of this share of the old price matters.
MATERIAL_DROP = 0.08


def snooze_active(decision: Column, until: Column, now: Column) -> Column:
    return F.coalesce((decision == "snoozed") & (until > now), F.lit(False))


def feed_gate(decision: Column, snoozed: Column, material_drop: Column, section: Column) -> Column:
    """What may show: not dismissed or purchased, snoozed only after a material drop, secondary only if followed."""
    d = F.coalesce(decision, F.lit(""))
    return ~d.isin("dismissed", "purchased") & (~snoozed | material_drop) & ((F.coalesce(section, F.lit("main")) != "secondary") | (d == "following"))


def price_drop(price: Column, before: Column) -> Column:
    """Struct of amount, ratio and material; null where the price didn't fall."""
    fell = before.isNotNull() & price.isNotNull() & (before > 0) & (price < before)
    ratio = (before - price) / before
    return F.when(fell, F.struct(F.round(before - price, 2).alias("amount"), F.round(ratio, 4).alias("ratio"), (ratio >= MATERIAL_DROP).alias("material")))


def diversify(df: DataFrame, group: Sequence[str], title: str, variant: str, prefer: str, *order: Column | str) -> DataFrame:
    """Best copy of each title, then at most one more that differs in variant, preferred ones first; the rest hidden.

    Adds `shown` (1 first copy, 2 second copy, 0 hidden) and `hidden` (hidden copies of the title). Rows without a
    title are all shown. `prefer` is a boolean column that goes first among second copies unless the first has it.
    """
    keys = [*group, title]
    best = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_first", F.row_number().over(best) == 1)
    whole = Window.partitionBy(*keys)
    x = x.withColumn("_v", F.max(F.when(F.col("_first"), F.struct(F.col(variant).alias("v"), F.col(prefer).alias("p")))).over(whole))
    other = ~F.col("_first") & ~F.col(variant).eqNullSafe(F.col("_v.v"))
    second = Window.partitionBy(*keys, "_other").orderBy(F.when(F.col("_v.p"), False).otherwise(F.col(prefer)).desc(), *order)
    x = x.withColumn("_other", other).withColumn("_second", F.col("_other") & (F.row_number().over(second) == 1))
    untitled = F.col(title).isNull() | (F.col(title) == "")
    x = x.withColumn("shown", F.when(untitled | F.col("_first"), 1).when(F.col("_second"), 2).otherwise(0))
    return x.withColumn("hidden", F.sum(F.when(F.col("shown") == 0, 1).otherwise(0)).over(whole)).drop("_first", "_v", "_other", "_second")


def content_fingerprint(source: Column, title: Column, price: Column, seller: Column) -> Column:
    """One value for listings of one content; null where source, title or price is missing."""
    return F.when(source.isNotNull() & (F.coalesce(title, F.lit("")) != "") & price.isNotNull(), F.concat_ws("\x1f", source, title, F.format_string("%.2f", price.cast("double")), F.lower(F.coalesce(seller, F.lit("")))))


def content_clusters(df: DataFrame, fingerprint: Column, position: str) -> DataFrame:
    """Adds `cluster`, the first position of a content; rows without a fingerprint are clusters of one."""
    key = F.coalesce(fingerprint, F.concat(F.lit("\x1e"), F.col(position).cast("string")))
    return df.withColumn("_fp", key).withColumn("cluster", F.min(position).over(Window.partitionBy("_fp"))).drop("_fp")


def cluster_decision(members: DataFrame, decisions: DataFrame, member: str, cluster: str = "cluster") -> DataFrame:
    """The newest decision on any member of each cluster."""
    newest = F.max_by(F.struct("decision", "updated_at"), F.struct("updated_at", member))
    return members.select(cluster, member).join(decisions, member).groupBy(cluster).agg(newest.alias("d")).select(cluster, "d.*")


def capped_then_sorted(df: DataFrame, cap: int, rank: Sequence[Column], drop: str, score: str, key: str) -> DataFrame:
    """The feed's order: the `cap` best by rank, and only among these material drops first, then score.

    A drop that doesn't make the cap by its rank doesn't surface. Adds `place` from 1. At most `cap` rows are windowed.
    """
    top = df.orderBy(*rank, key).limit(cap)
    w = Window.orderBy(F.col(drop).desc(), F.col(score).desc(), *rank, key)
    return top.withColumn("place", F.row_number().over(w))


def top_picks(df: DataFrame, title: str, position: str, n: int) -> DataFrame:
    """n rows, one of each title first, then others, each in the order of position."""
    again = F.row_number().over(Window.partitionBy(title).orderBy(position)) > 1
    return df.withColumn("_again", again).orderBy("_again", position).limit(n).drop("_again")
