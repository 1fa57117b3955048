"""The lifecycle of opportunities as a stream of sightings: first and last seen, on how many days, and when one is gone.

Each micro-batch is grouped by key and merged with the state table that the one before it left, all keys at once and
without Python; a batch that is run again reads that same table, so a restart goes on where it stopped. A key that isn't
seen for GONE_HOURS of event time is gone, when the watermark, `delay` behind the latest sighting, has passed that time.
Sightings may be late by up to `delay`; later ones are left out by the watermark. Days are counted once however often and
in whatever order a day's sightings come: of the days that may still be added to, state keeps which were seen.

The last change of a key is the same for any division of the sightings into micro-batches; only how often a key goes and
comes back in between depends on how far apart the sightings lie.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GONE_HOURS, DELAY_DAYS = 48, 2
HOUR_MS, DAY_MS = 3_600_000, 86_400_000


@dataclass(frozen=True)
class Changes:
    """A stream of sightings (keys and a time) and the rules for what changes with them."""

    sightings: DataFrame
    keys: Sequence[str]
    at: str
    gone_hours: int
    delay_days: int

    def merged(self, state: DataFrame | None, batch: DataFrame) -> DataFrame:
        """The state after a micro-batch: keys, first_seen, last_seen, seen_days, active, days, with the batch's own event (null if it has none) and gone."""
        keys, at, latest = list(self.keys), F.col(self.at), None
        if state is not None:
            latest = state.agg(F.unix_millis(F.max("last_seen"))).first()[0]
        if latest is not None:
            batch = batch.filter(F.unix_micros(at) > (latest - self.delay_days * DAY_MS) * 1000)
        own = batch.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.collect_set(F.unix_date(F.to_date(at))).alias("new_days"))
        if state is not None:
            own = own.unionByName(state.select(*keys, "first_seen", "last_seen", "seen_days", "active", "days"), allowMissingColumns=True)
        else:
            own = own.withColumns({"seen_days": F.lit(None).cast("bigint"), "active": F.lit(None).cast("boolean"), "days": F.lit(None).cast("array<int>")})
        # A key has at most one row of the state and one of the batch: max() takes what either has.
        x = own.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), *[F.max(c).alias(c) for c in ("last_seen", "new_days", "seen_days", "active", "days")])
        newest = max((m for m in (latest, batch.agg(F.unix_millis(F.max(at))).first()[0]) if m is not None), default=0)
        none = F.array().cast("array<int>")
        old, new = F.coalesce("days", none), F.coalesce("new_days", none)
        event = F.when(F.col("new_days").isNotNull(), F.when(F.col("seen_days").isNull(), "new").when(F.col("active"), "seen").otherwise("back"))
        over = F.unix_millis("last_seen") + self.gone_hours * HOUR_MS <= newest - self.delay_days * DAY_MS
        gone = (F.col("new_days").isNotNull() | F.col("active")) & over
        every = F.array_union(old, new)
        return x.select(
            *keys, "first_seen", "last_seen", (F.coalesce("seen_days", F.lit(0)) + F.size(F.array_except(new, old))).cast("bigint").alias("seen_days"), (F.col("new_days").isNotNull() | F.col("active")).alias("active"),
            every.alias("days"), F.array_max(every).alias("_last"), event.alias("event"), gone.alias("gone"),
        ).withColumns({"active": F.col("active") & ~F.col("gone"), "days": F.filter("days", lambda d: d >= F.col("_last") - self.delay_days - 1)}).drop("_last")


def lifecycle_changes(sightings: DataFrame, keys: Sequence[str], at: str, gone_hours: int = GONE_HOURS, delay_days: int = DELAY_DAYS) -> Changes:
    """Changes by a stream of sightings: keys, event, first_seen, last_seen, seen_days and active. Rows without a time are left out."""
    return Changes(sightings.select(*keys, at).filter(F.col(at).isNotNull()), keys, at, gone_hours, delay_days)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, where the cluster's tasks and the driver see the same files; a local one where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="lotwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(changes: Changes, out: str, checkpoint: str) -> None:
    """Write the changes of all that has arrived below `out`, a folder for each micro-batch, and stop.

    The state after each batch is a table beside the checkpoint; that of the last two is kept.
    """
    spark, keys = changes.sightings.sparkSession, list(changes.keys)
    table = lambda batch: f"{checkpoint}-table/{batch}"

    def write(sightings: DataFrame, batch: int) -> None:
        state = sightings.sparkSession.read.parquet(table(batch - 1)) if batch else None
        merged = changes.merged(state, sightings)
        merged.write.mode("overwrite").parquet(table(batch))
        after = sightings.sparkSession.read.schema(merged.schema).parquet(table(batch))
        change = lambda event, active: after.select(*keys, event.alias("event"), "first_seen", "last_seen", "seen_days", F.lit(active).alias("active"))
        each = change(F.col("event"), True).filter("event IS NOT NULL").unionByName(change(F.when(F.col("gone"), "gone"), False).filter("event IS NOT NULL"))
        each.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if batch > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(table(batch - 2))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    query = changes.sightings.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def last_changes(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Each key's state after its last change; of a batch's changes a timer's comes after a sighting's."""
    order = F.struct("batch", (F.col("event") == "gone").cast("int"))
    changes = spark.read.parquet(out)
    return changes.groupBy(*keys).agg(F.max_by(F.struct("first_seen", "last_seen", "seen_days", "active"), order).alias("s")).select(*keys, "s.*")


def replayed(sightings: DataFrame, keys: Sequence[str], at: str, slices: int = 4, gone_hours: int = GONE_HOURS, delay_days: int = DELAY_DAYS) -> DataFrame:
    """The state after a table of sightings arrived in this many slices of time, one micro-batch or more each."""
    spark = sightings.sparkSession
    arrivals, out, checkpoint = (shared_folder(spark, f"lifecycle-{x}") for x in ("arrivals", "changes", "state"))
    timed = sightings.select(*keys, at)
    bounds = timed.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    if bounds["low"] is None:
        return timed.select(*keys, *[F.lit(None).cast(t).alias(n) for n, t in (("first_seen", "timestamp"), ("last_seen", "timestamp"), ("seen_days", "bigint"), ("active", "boolean"))]).limit(0)
    step = (bounds["high"] - bounds["low"]) / slices
    for k in range(slices):
        low, high = bounds["low"] + k * step, bounds["low"] + (k + 1) * step
        inside = (F.col(at) >= F.lit(low)) & ((F.col(at) < F.lit(high)) if k < slices - 1 else F.lit(True))
        timed.filter(inside).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(timed.schema).parquet(arrivals)
        run_available(lifecycle_changes(stream, keys, at, gone_hours, delay_days), out, checkpoint)
    return last_changes(spark, out, keys)
