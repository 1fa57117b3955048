"""Brands as franchises, and matches in a reader's order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.operators import franchise, rows
from lotwatch.plans.base import Tables, query
from lotwatch.plans.markets import LISTING, listings

_OWNED_TYPES = ("PROMO", "SMALL", "ECONOMY")


@query(
    "join32_franchises",
    f"""WITH r AS (SELECT p_brand AS f, 'r' || p_partkey AS id, p_type || CASE WHEN p_size % 4 = 0 THEN ' 2' ELSE '' END AS platform, CASE WHEN p_size % 7 > 0 THEN 1960 + p_size END AS year, p_size % 2 = 0 AS prim, p_partkey % 11 = 0 AS crown,
      ['none', 'physical', 'digital', 'none', 'both', 'none', 'none', 'none', 'none'][1 + p_partkey % 9] AS own, [p_name, p_name || ' ' || p_size % 6] AS works, p_partkey AS place FROM part),
    w AS (SELECT f, work, min(place) AS k FROM (SELECT f, unnest(works) AS work, place FROM r) GROUP BY ALL), rw AS (SELECT DISTINCT f, platform, unnest(works) AS work FROM r),
    c AS (SELECT f, work, bool_or(own <> 'none') AS covered FROM (SELECT f, unnest(works) AS work, own FROM r) GROUP BY f, work),
    s AS (SELECT f, work, k % 5 > 0 AND k % 13 > 0 AS denominator, covered FROM w JOIN c USING (f, work)),
    j AS (SELECT 'Brand#' || (1 + s_nationkey) AS f, s_suppkey % 3 = 0 AS owned FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT f, place % 2 = 0 FROM r WHERE crown UNION ALL SELECT 'Brand#' || (1 + n_nationkey), false FROM nation),
    p AS (SELECT f, platform, count(*) AS n, min(place) AS place FROM (SELECT rw.f, rw.platform, rw.work FROM rw JOIN s USING (f, work) WHERE denominator AND NOT covered AND platform NOT IN {_OWNED_TYPES}) JOIN (SELECT f, platform, min(place) AS place FROM r GROUP BY ALL) USING (f, platform) GROUP BY f, platform),
    bp AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, place) = 1), br AS (SELECT f, id FROM r WHERE prim AND own NOT IN ('physical', 'both') QUALIFY row_number() OVER (PARTITION BY f ORDER BY year NULLS LAST, place) = 1),
    a AS (SELECT f, (SELECT count(*) FROM s WHERE s.f = x.f AND denominator AND covered) AS so, (SELECT count(*) FROM s WHERE s.f = x.f AND denominator) AS st, (SELECT count(*) FROM r WHERE r.f = x.f AND prim AND own IN ('physical', 'both')) AS ho, (SELECT count(*) FROM r WHERE r.f = x.f AND prim) AS ht,
      (SELECT count(*) FROM j WHERE j.f = x.f AND owned) AS jo, (SELECT count(*) FROM j WHERE j.f = x.f) AS jt FROM (SELECT DISTINCT f FROM r) x)
    SELECT f AS franchise, so AS saga_owned, st AS saga_total, CASE WHEN st > 0 THEN floor(100.0 * so / st + 0.5) ELSE 0 END::INTEGER AS saga_percent, ho AS shelf_owned, ht AS shelf_total, CASE WHEN ht > 0 THEN floor(100.0 * ho / ht + 0.5) ELSE 0 END::INTEGER AS shelf_percent,
      jo AS jewels_owned, jt AS jewels_total, CASE WHEN jt > 0 THEN floor(100.0 * jo / jt + 0.5) ELSE 0 END::INTEGER AS jewels_percent, CASE WHEN platform IS NOT NULL THEN 'platform' WHEN id IS NOT NULL THEN 'release' END AS next_kind, coalesce(platform, id) AS next_id, coalesce(n, 0) AS new_works
    FROM a LEFT JOIN bp USING (f) LEFT JOIN br USING (f)""",
)
def join32(t: Tables) -> DataFrame:
    """Parts as releases of their brand, their names as its works, suppliers as editions, a nation as hardware."""
    k, n = F.col("p_partkey"), F.col("p_size")
    ownership = F.element_at(F.array(*map(F.lit, ("none", "physical", "digital", "none", "both", "none", "none", "none", "none"))), (1 + k % 9).cast("int"))
    releases = t.part.select(
        F.col("p_brand").alias("franchise"), F.concat(F.lit("r"), k.cast("string")).alias("release"), F.concat("p_type", F.when(n % 4 == 0, " 2").otherwise("")).alias("platform"), F.when(n % 7 > 0, 1960 + n).alias("year"), (n % 2 == 0).alias("primary"),
        (k % 11 == 0).alias("crown"), ownership.alias("ownership"), F.array("p_name", F.concat_ws(" ", "p_name", (n % 6).cast("string"))).alias("work_ids"), k.alias("place"),
    )
    works = releases.select("franchise", F.explode("work_ids").alias("work"), "place").groupBy("franchise", "work").agg(F.min("place").alias("k")).select("franchise", "work", F.when(F.col("k") % 5 > 0, "released").otherwise("announced").alias("status"), (F.col("k") % 13 == 0).alias("excluded"))
    brand = lambda c: F.concat(F.lit("Brand#"), (1 + F.col(c)).cast("string")).alias("franchise")
    editions = t.supplier.select(brand("s_nationkey"), F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("item"), (F.col("s_suppkey") % 2 == 0).alias("crown"))
    hardware = t.nation.select(brand("n_nationkey"), F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("item"))
    tracked = t.supplier.select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("item"), (F.col("s_suppkey") % 3 == 0).alias("owned")).unionAll(releases.select(F.col("release").alias("item"), (F.col("place") % 2 == 0).alias("owned")))
    platforms = t.part.select(F.col("p_type").alias("platform")).distinct().filter(F.col("platform").isin(*_OWNED_TYPES))
    return franchise.composed(releases, works, editions, hardware, tracked, platforms)


@query(
    "srt12_match_order",
    f"""WITH {LISTING} SELECT listing_id, row_number() OVER (PARTITION BY search ORDER BY flag = 'R' DESC, status = 'F' DESC, CASE size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, CASE WHEN size % 5 > 0 THEN seen_at END NULLS LAST, size DESC, title, listing_id)::INTEGER AS place FROM l""",
)
def srt12(t: Tables) -> DataFrame:
    """Each search's matches in a reader's order; titles as a Spanish reader sorts them."""
    size = F.col("size")
    urgency = F.when(size % 4 == 0, "Cierre inminente").when(size % 4 == 1, "Cierra HOY").when(size % 4 == 2, "pronto").otherwise("")
    order = rows.match_order(F.col("flag") == "R", F.col("status") == "F", urgency, F.when(size % 5 > 0, F.col("seen_at")), size, F.col("title"), F.col("listing_id"))
    return listings(t).select("listing_id", F.row_number().over(Window.partitionBy("search").orderBy(*order)).alias("place"))
