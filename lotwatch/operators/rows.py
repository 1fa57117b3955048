"""Row selection with ties that are part of the contract: first wins, best wins, ranked unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.folding import let, normalize


def first_wins(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in this order; the order must end in something unique to be repeatable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: Sequence[str], n: int, *order: Column | str, rank: str | None = None) -> DataFrame:
    """At most n rows per key; with `rank` their places from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def current_over_cached(current: DataFrame, cached: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """All keys of both, the current row where there is one."""
    both = current.withColumn("_age", F.lit(0)).unionByName(cached.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return first_wins(both, keys, "_age", *order).drop("_age")


def two_tier(left: DataFrame, right: DataFrame, by_id: Sequence[str], by_name: Sequence[str], take: Sequence[str], name: str = "found_by") -> DataFrame:
    """Left join by ids, and by names for the rows that ids don't find; `take` are the right side's columns.

    Both lookups keep the first of several rows of a key, in order of the taken columns.
    """
    ids = first_wins(right, by_id, *take).select(*by_id, F.struct(*take).alias("_by_id"))
    names = first_wins(right, by_name, *take).select(*by_name, F.struct(*take).alias("_by_name"))
    out = left.join(ids, list(by_id), "left").join(names, list(by_name), "left")
    hit = F.coalesce("_by_id", "_by_name")
    out = out.withColumn(name, F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_name").isNotNull(), "name"))
    return out.withColumns({c: hit[c] for c in take}).drop("_by_id", "_by_name")


def urgency_rank(label: Column) -> Column:
    """0 for what closes at once, 1 today, 2 soon, 3 for the rest."""
    return let(normalize(label), lambda t: F.when(F.contains(t, F.lit("inminente")), 0).when(F.contains(t, F.lit("hoy")), 1).when(F.contains(t, F.lit("pronto")), 2).otherwise(3))


def spanish(text: Column) -> Column:
    """Text that sorts and compares as a Spanish reader does: n before ñ before o, accents and case only where letters are equal."""
    return F.collate(text, "es")


def match_order(following: Column, watched: Column, urgency: Column, closing: Column, score: Column, title: Column, unique: Column) -> list[Column]:
    """The order of matches: followed, watched, by urgency, closing first (undated last), score, title; `unique` makes it total."""
    yes = lambda c: F.coalesce(c, F.lit(False)).desc()
    return [yes(following), yes(watched), urgency_rank(urgency), closing.asc_nulls_last(), F.coalesce(score, F.lit(0)).desc(), spanish(F.coalesce(title, F.lit(""))), unique]
