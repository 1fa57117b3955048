"""State that a stream keeps, beside the SQL that computes it from the whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.plans.base import Tables, query
from lotwatch.streaming import lifecycle


@query(
    "str02_lifecycle_stream",
    f"""WITH m AS (SELECT epoch_ms(max(ts)) - {lifecycle.DELAY_DAYS * 86_400_000} AS watermark FROM events)
    SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT ts::DATE) AS seen_days, epoch_ms(max(ts)) + {lifecycle.GONE_HOURS * 3_600_000} > any_value(watermark) AS active FROM events, m GROUP BY user_id, event_type""",
)
def str02(t: Tables) -> DataFrame:
    """Events as sightings of what a user does, replayed in slices through the stateful stream."""
    sightings = t.events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return lifecycle.replayed(sightings, ["user_id", "event_type"], "ts")
