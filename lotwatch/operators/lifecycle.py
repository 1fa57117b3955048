"""Keyed state over runs: opportunities, leases, slots, notices, in batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lifecycle_from_history(seen: DataFrame, keys: Sequence[str], run: str, last_run: Column) -> DataFrame:
    """first_seen, last_seen, seen_count (runs) and active (seen in the last run) for each key."""
    return seen.groupBy(*keys).agg(F.min(run).alias("first_seen"), F.max(run).alias("last_seen"), F.countDistinct(run).alias("seen_count")).withColumn("active", F.col("last_seen") == last_run)


def update_lifecycle(state: DataFrame, seen: DataFrame, authoritative: DataFrame, keys: Sequence[str], group: str, observed_at: Column) -> DataFrame:
    """State after a run, with `event`: new, seen, back, removed, kept or gone.

    A key that the run didn't see is removed only if its group was covered completely; otherwise it is kept.
    state: keys, group, first_seen, last_seen, seen_count, active.
    """
    known = state.select(*keys, F.struct(group, "first_seen", "last_seen", "seen_count", "active").alias("_k"))
    now = seen.select(*keys, F.col(group).alias("_now")).distinct()
    proof = authoritative.select(F.col(group).alias("_g")).distinct().withColumn("_proof", F.lit(True))
    x = known.join(now, list(keys), "full").withColumn("_g", F.coalesce(F.col("_now"), F.col(f"_k.{group}"))).join(proof, "_g", "left")
    here = F.col("_now").isNotNull()
    event = (
        F.when(here & F.col("_k").isNull(), "new").when(here & F.col("_k.active"), "seen").when(here, "back")
        .when(~F.col("_k.active"), "gone").when(F.col("_proof"), "removed").otherwise("kept")
    )
    return x.withColumn("event", event).select(
        *keys, F.col("_g").alias(group), F.coalesce(F.col("_k.first_seen"), observed_at).alias("first_seen"), F.when(here, observed_at).otherwise(F.col("_k.last_seen")).alias("last_seen"),
        (F.coalesce(F.col("_k.seen_count"), F.lit(0)) + here.cast("int")).alias("seen_count"), F.col("event").isin("new", "seen", "back", "kept").alias("active"), "event",
    )


def lease_status(status: Column, requested: Column, heartbeat: Column, now: Column, pending_minutes: int = 10, running_minutes: int = 30) -> Column:
    """pending or running become failed when nothing was heard for too long, to the microsecond."""
    quiet = lambda at, m: F.coalesce(F.unix_micros(now) - F.unix_micros(at) > 60_000_000 * m, F.lit(False))
    return F.when((status == "pending") & quiet(requested, pending_minutes), "failed").when((status == "running") & quiet(F.coalesce(heartbeat, requested), running_minutes), "failed").otherwise(status)


def snapshot_status(generated: Column, now: Column, hours: int = 36, ahead_minutes: int = 5) -> Column:
    """current, stale, or unavailable where there is no time or one in the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(generated)
    return F.when(age.isNull() | (age < -60 * ahead_minutes), "unavailable").when(age > 3600 * hours, "stale").otherwise("current")


def due_slots(slots: DataFrame, done: DataFrame, now: Column, key: str = "slot", at: str = "slot_at") -> DataFrame:
    """Overdue slots that nothing has fulfilled, with `state`: the latest is due, older ones are skipped."""
    open_ = slots.filter(F.col(at) <= now).join(done.select(key), key, "left_anti")
    return open_.withColumn("state", F.when(F.row_number().over(Window.partitionBy(F.to_date(at)).orderBy(F.col(at).desc())) == 1, "due").otherwise("skipped"))


def backoff_seconds(attempts: Column, steps: Sequence[int] = (60, 300, 900, 3600)) -> Column:
    """The wait before the next attempt; the last step stays."""
    return F.element_at(F.array(*map(F.lit, steps)), F.least(F.greatest(attempts, F.lit(1)), F.lit(len(steps))).cast("int"))


def outbox_id(kind: Column, run: Column, ids: Column) -> Column:
    """One id for a kind, a run and a set of items, in whatever order they come."""
    return F.sha1(F.concat_ws("\x00", F.concat(F.array(kind, run), F.array_sort(ids))).cast("binary"))


def verification_state(availability: Column, flagged: Column, source_checks: Column, verified_at: Column, price_changed_at: Column, now: Column, hours: int = 24) -> Column:
    """Struct of state and reason: ended, verified, expired (stale or price-changed), available by the source, else pending.

    A verification by the owner lasts so many hours and ends when the price changes after it.
    """
    changed = F.coalesce(price_changed_at > verified_at, F.lit(False))
    live = F.unix_timestamp(now) - F.unix_timestamp(verified_at) < 3600 * hours
    by_source = F.coalesce(source_checks & (availability == "available") & ~F.coalesce(flagged, F.lit(False)), F.lit(False))
    ended = F.coalesce(availability == "ended", F.lit(False))
    state = F.when(ended, "ended").when(verified_at.isNotNull() & live & ~changed, "verified").when(verified_at.isNotNull(), "expired").when(by_source, "available").otherwise("pending")
    return F.struct(state.alias("state"), F.when(state == "expired", F.when(changed, "price-changed").otherwise("stale")).otherwise("").alias("reason"))


def detail_usable(fetched_at: Column, cached_price: Column, price: Column, now: Column, hours: int = 24) -> Column:
    """May a cached page be used: read within so many hours, at the price that the listing has now?"""
    young = F.unix_timestamp(now) - F.unix_timestamp(fetched_at) < 3600 * hours
    return F.coalesce(young, F.lit(False)) & cached_price.eqNullSafe(price)
