"""Franchises: what of a saga is owned, on the shelf and among its jewels, and what to get next, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, PHYSICAL = "none", ("physical", "both")


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(0).cast("int")


def work_states(releases: DataFrame, works: DataFrame) -> DataFrame:
    """franchise, work, denominator (released and not left out) and covered (by an owned release)."""
    owned = releases.select("franchise", F.explode("work_ids").alias("work"), (F.coalesce("ownership", F.lit(NONE)) != NONE).alias("_owned")).groupBy("franchise", "work").agg(F.bool_or("_owned").alias("_owned"))
    counts = (F.col("status") == "released") & ~F.coalesce("excluded", F.lit(False))
    return works.select("franchise", "work", F.coalesce(counts, F.lit(False)).alias("denominator")).join(owned, ["franchise", "work"], "left").select("franchise", "work", "denominator", F.coalesce("_owned", F.lit(False)).alias("covered"))


def next_platforms(releases: DataFrame, states: DataFrame, owned_platforms: DataFrame) -> DataFrame:
    """For each franchise the platform, not owned yet, with most works that would be new; of several the one released on first."""
    first = releases.groupBy("franchise", "platform").agg(F.min("place").alias("_place"))
    open_ = releases.join(owned_platforms.select("platform").distinct(), "platform", "left_anti").select("franchise", "platform", F.explode("work_ids").alias("work")).distinct()
    new = open_.join(states.filter("denominator AND NOT covered").select("franchise", "work"), ["franchise", "work"], "left_semi").groupBy("franchise", "platform").agg(F.count(F.lit(1)).alias("new_works"))
    best = F.max_by(F.struct("platform", "new_works"), F.struct("new_works", -F.col("_place")))
    return new.join(first, ["franchise", "platform"]).groupBy("franchise").agg(best.alias("_platform"))


def composed(releases: DataFrame, works: DataFrame, editions: DataFrame, hardware: DataFrame, tracked: DataFrame, owned_platforms: DataFrame) -> DataFrame:
    """A row for each franchise with a release or a work: the three ratios and the next action.

    releases: franchise, release, platform, year, primary, crown, ownership, work_ids, place; works: franchise, work, status,
    excluded; editions: franchise, item, crown; hardware: franchise, item; tracked: item, owned. Saga: works covered by an
    owned release; shelf: primary releases owned as things; jewels: crown editions, crown releases and hardware that are
    tracked as owned. Next: the platform that brings most new works, else the oldest primary release that isn't owned as a
    thing (unknown years last), else nothing. Several rows of one tracked item count as owned if one is.
    """
    states = work_states(releases, works)
    on_shelf = F.coalesce(F.col("ownership").isin(*PHYSICAL), F.lit(False))
    owned = tracked.groupBy("item").agg(F.bool_or(F.coalesce("owned", F.lit(False))).alias("_owned"))
    jewels = editions.filter("crown").select("franchise", "item").unionAll(releases.filter("crown").select("franchise", F.col("release").alias("item"))).unionAll(hardware.select("franchise", "item"))
    jewels = jewels.join(owned, "item", "left").withColumn("_owned", F.coalesce("_owned", F.lit(False)))
    # One row a fact, each marked by the ratio that it counts for: one grouping instead of three joined ones.
    fact = lambda df, kind, good: df.select("franchise", F.lit(kind).alias("_kind"), good.alias("_good"))
    facts = fact(states.filter("denominator"), "saga", F.col("covered")).unionAll(fact(releases.filter("primary"), "shelf", on_shelf)).unionAll(fact(jewels, "jewels", F.col("_owned")))
    every = releases.select("franchise").unionAll(works.select("franchise")).select("franchise", F.lit("").alias("_kind"), F.lit(False).alias("_good"))
    count = lambda kind, good: F.count_if((F.col("_kind") == kind) & (F.col("_good") | F.lit(not good)))
    ratios = facts.unionAll(every.distinct()).groupBy("franchise").agg(F.bool_or(F.col("_kind") == "").alias("_known"), *[count(k, g).alias(f"{k}_{n}") for k in ("saga", "shelf", "jewels") for g, n in ((True, "owned"), (False, "total"))])
    missing = releases.filter("primary").filter(~on_shelf).groupBy("franchise").agg(F.min_by("release", F.struct(F.col("year").isNull(), "year", "place")).alias("_release"))
    x = ratios.filter("_known").join(next_platforms(releases, states, owned_platforms), "franchise", "left").join(missing, "franchise", "left")
    kind = F.when(F.col("_platform").isNotNull(), "platform").when(F.col("_release").isNotNull(), "release")
    shares = [c for k in ("saga", "shelf", "jewels") for c in (F.col(f"{k}_owned"), F.col(f"{k}_total"), percent(F.col(f"{k}_owned"), F.col(f"{k}_total")).alias(f"{k}_percent"))]
    return x.select("franchise", *shares, kind.alias("next_kind"), F.coalesce("_platform.platform", F.col("_release")).alias("next_id"), F.coalesce("_platform.new_works", F.lit(0)).alias("new_works"))
