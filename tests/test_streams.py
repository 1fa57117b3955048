"""The lifecycle stream against the whole history, and over restarts."""

import datetime as dt

from pyspark.sql import functions as F

from lotwatch.streaming import lifecycle

START = dt.datetime(2026, 1, 1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def plain(sightings, gone_hours, delay_days):
    """The state after all sightings, from the whole history."""
    watermark = max(t for _, t in sightings) - dt.timedelta(days=delay_days)
    out = []
    for key in sorted({k for k, _ in sightings}):
        own = [t for k, t in sightings if k == key]
        out.append((key, min(own), max(own), len({t.date() for t in own}), max(own) + dt.timedelta(hours=gone_hours) > watermark))
    return out


def sample():
    """Keys seen daily, once, with long gaps, and twice a day; out of order by up to a day."""
    times = []
    for day in range(30):
        times += [("daily", 24.0 * day + 5), ("twice", 24.0 * day + 1), ("twice", 24.0 * day + 20)]
        if day % 10 == 0:
            times.append(("rare", 24.0 * day + 3.5))
    times += [("once", 7.25), ("late", 24.0 * 29)]
    return [(k, START + dt.timedelta(hours=h)) for k, h in times]


def test_any_slices_give_the_state_of_the_whole_history(spark):
    sightings = sample()
    df = spark.createDataFrame(sightings, "key string, at timestamp").repartition(3)
    for slices in (1, 4):
        assert rows_of(lifecycle.replayed(df, ["key"], "at", slices)) == plain(sightings, 48, 2)


def test_restart_from_the_checkpoint(spark):
    arrivals, out, checkpoint = (lifecycle.shared_folder(spark, x) for x in ("a", "o", "c"))
    sightings = sample()
    half = START + dt.timedelta(days=5)
    events = []
    for part in ([x for x in sightings if x[1] < half], [x for x in sightings if x[1] >= half]):
        spark.createDataFrame(part, "key string, at timestamp").write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema("key string, at timestamp").parquet(arrivals)
        lifecycle.run_available(lifecycle.lifecycle_changes(stream, ["key"], "at"), out, checkpoint)
        events.append({(r["key"], r["event"]) for r in spark.read.parquet(out).collect()})
    assert ("once", "gone") in events[0] and ("rare", "gone") in events[0] and ("rare", "back") not in events[0] and ("daily", "gone") not in events[1]
    assert ("rare", "back") in events[1] and ("late", "new") in events[1]
    assert rows_of(lifecycle.last_changes(spark, out, ["key"])) == plain(sightings, 48, 2)
    # Nothing new has arrived: nothing changes.
    stream = spark.readStream.schema("key string, at timestamp").parquet(arrivals)
    lifecycle.run_available(lifecycle.lifecycle_changes(stream, ["key"], "at"), out, checkpoint)
    assert rows_of(lifecycle.last_changes(spark, out, ["key"])) == plain(sightings, 48, 2)


def test_nulls_and_no_sightings(spark):
    df = spark.createDataFrame([(None, START), ("a", None), (None, START + dt.timedelta(days=1))], "key string, at timestamp")
    assert [tuple(r)[0:1] + tuple(r)[3:] for r in lifecycle.replayed(df, ["key"], "at", 1).collect()] == [(None, 2, True)]
    assert lifecycle.replayed(df.filter(F.lit(False)), ["key"], "at").collect() == []


def test_state_is_merged_for_all_keys_at_once(spark):
    """A micro-batch meets the state in plain aggregations; a sighting behind the watermark is left out, and one batch can end a key."""
    at = lambda *days: spark.createDataFrame([(k, START + dt.timedelta(days=d)) for k, d in days], "key string, at timestamp")
    changes = lifecycle.lifecycle_changes(at(), ["key"], "at")
    first = changes.merged(None, at(("a", 0), ("b", 9), ("b", 9.5))).localCheckpoint()
    assert {r["key"]: (r["event"], r["gone"], r["active"], r["seen_days"]) for r in first.collect()} == {"a": ("new", True, False, 1), "b": ("new", False, True, 1)}
    second = changes.merged(first, at(("a", 9), ("b", 3), ("c", 8)))
    assert {r["key"]: (r["event"], r["active"], r["seen_days"]) for r in second.collect()} == {"a": ("back", True, 2), "b": (None, True, 1), "c": ("new", True, 1)}
    plan = second._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
