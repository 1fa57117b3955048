"""Valuation of the stand-in listings in three passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.operators import pricing
from lotwatch.plans.base import Tables, query
from lotwatch.plans.markets import LISTING, listings

NOW = "2026-01-01"

_BAND = "CASE WHEN ratio IS NULL THEN NULL WHEN ratio <= 0.75 THEN 'ganga' WHEN ratio <= 0.9 THEN 'buena' WHEN ratio <= 1.1 THEN 'razonable' WHEN ratio <= 1.3 THEN 'premium' ELSE 'caro' END"
_SQL = f"""WITH {LISTING}, m AS (SELECT listing_id AS i, search, title, CASE WHEN size % 3 = 0 THEN 'console' WHEN size % 3 = 1 THEN 'game' ELSE 'accessory' END AS kind, CASE WHEN source_id % 2 = 0 THEN 'game' ELSE '' END AS expected,
    CASE WHEN listing_id % 7 = 0 THEN 'lot' WHEN listing_id % 7 = 1 THEN '' WHEN size % 2 = 0 THEN 'cib' ELSE 'loose' END AS shape, price, CASE WHEN listing_id % 5 > 0 THEN shipping END AS shipping, listing_id % 7 = 0 AS lot, CASE WHEN listing_id % 14 = 0 THEN 1 + size % 9 END AS pieces,
    CASE WHEN listing_id % 21 = 0 THEN 5000.0 END AS per_piece, CASE WHEN listing_id % 3 = 0 THEN 20.0 ELSE 0.0 END AS extra, 30000.0 AS target, size FROM l),
  c AS (SELECT *, CASE WHEN shape IN ('cib', 'loose') THEN shape ELSE '' END AS completeness FROM m),
  r AS (SELECT p_brand AS search, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'cib' ELSE 'loose' END AS completeness, 20000.0 + p_retailprice AS value, ['ebay-sold', 'retail', 'editorial'][1 + p_partkey % 3] AS source, p_partkey % 4 > 0 AS independent, p_partkey % 5 = 0 AS stale, p_partkey % 10 / 10.0 AS conf FROM part WHERE p_partkey % 6 = 0),
  br AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY search, title, completeness ORDER BY NOT independent, stale, CASE source WHEN 'ebay-sold' THEN 0 WHEN 'retail' THEN 2 ELSE 5 END, conf DESC, value) = 1),
  pr AS (SELECT search, title, completeness, round(median(round(price + extra + 1e-9, 2)) + 1e-9, 2) AS pvalue FROM c WHERE completeness <> '' AND price > 0 AND (expected = '' OR kind = expected) GROUP BY ALL HAVING count(*) >= 4),
  lp AS (SELECT search, round(median(round(price / pieces + 1e-9, 2)) + 1e-9, 2) AS piece FROM c WHERE pieces > 0 GROUP BY search HAVING count(*) >= 4),
  j AS (SELECT c.*, br.value AS bvalue, br.source AS bsource, br.independent AS bind, br.stale AS bstale, br.conf AS bconf, pvalue, piece, br.value IS NOT NULL AND (expected = '' OR kind = expected) AS usable FROM c LEFT JOIN br USING (search, title, completeness) LEFT JOIN pr USING (search, title, completeness) LEFT JOIN lp USING (search)),
  d AS (SELECT *, CASE WHEN lot THEN CASE WHEN pieces > 0 THEN 'lot' ELSE 'none' END WHEN completeness = '' THEN 'none' WHEN usable AND (pvalue IS NULL OR (bind AND NOT bstale AND bsource IN ('ebay-sold', 'retail'))) THEN 'curated' WHEN pvalue IS NOT NULL THEN 'peers' WHEN usable THEN 'curated' ELSE 'none' END AS way FROM j),
  b AS (SELECT *, CASE way WHEN 'lot' THEN CASE WHEN per_piece IS NOT NULL THEN round(pieces * per_piece + 1e-9, 2) ELSE round(piece * pieces + 1e-9, 2) END WHEN 'curated' THEN bvalue WHEN 'peers' THEN pvalue END AS value FROM d),
  q AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN way = 'lot' THEN CASE WHEN per_piece IS NOT NULL THEN 'lot-ceiling' ELSE 'peer-listings' END WHEN way = 'curated' THEN bsource ELSE 'peer-listings' END AS source, round(price + coalesce(shipping, 0) + extra + 1e-9, 2) / value AS ratio FROM b),
  f AS (SELECT *, {_BAND} AS band1, CASE WHEN shipping IS NOT NULL THEN round(price + shipping + extra + 1e-9, 2) <= target WHEN round(price + extra + 1e-9, 2) > target THEN false END AS meets1 FROM q),
  k AS (SELECT *, i % 4 > 0 AND (coalesce(band1 IN ('ganga', 'buena'), false) OR coalesce(meets1, false)) AS cheap FROM f),
  a AS (SELECT *, cheap AND row_number() OVER (PARTITION BY search, cheap ORDER BY coalesce(ratio, 9.0), i) <= 12 AS asked FROM k),
  e AS (SELECT *, asked AND i % 6 > 0 AS read FROM a), g AS (SELECT *, CASE WHEN read AND i % 2 = 0 THEN 30.0 ELSE 0.0 END AS taxes FROM e),
  h AS (SELECT * EXCLUDE (ratio), round(price + coalesce(shipping, 0) + taxes + extra + 1e-9, 2) / value AS ratio FROM g),
  n AS (SELECT *, {_BAND} AS price_band, list_filter([CASE WHEN i % 4 > 0 AND NOT read THEN 'details' END, CASE WHEN read AND i % 5 = 1 THEN 'returns' END, CASE WHEN read AND i % 3 = 1 THEN 'photos' END, CASE WHEN kind = 'console' AND ratio > 0 AND ratio < 0.3 THEN 'identity' END, CASE WHEN lot AND pieces IS NULL THEN 'lot-quantity' END,
      CASE WHEN source = 'peer-listings' OR (way = 'curated' AND (NOT bind OR bstale)) THEN 'benchmark' END, CASE WHEN shipping IS NULL THEN 'shipping' END, CASE WHEN NOT (read AND i % 7 > 2) THEN 'availability' END], lambda z: z IS NOT NULL) AS blocks FROM h)
  SELECT i AS listing_id, source, value, round(ratio + 1e-9, 6) AS ratio, coalesce(price_band, 'sin-referencia') AS price_band, read, CASE WHEN lot AND pieces IS NULL THEN 'sin-referencia' WHEN price_band IN ('ganga', 'buena') AND list_has_any(blocks, ['returns', 'photos']) THEN 'razonable'
    WHEN price_band = 'ganga' AND len(blocks) > 0 THEN 'buena' ELSE coalesce(price_band, 'sin-referencia') END AS band, array_to_string(list_sort(blocks), ',') AS blockers FROM n"""


@query("val02_valued_listings", _SQL)
def val02(t: Tables) -> DataFrame:
    """Listings of brands as searches: benchmarks by title and completeness, lots by the piece, and twelve pages read of each search."""
    i, size = F.col("listing_id"), F.col("size")
    no = F.lit(None)
    x = listings(t).select(
        i.alias("listing"), "search", "title", F.when(size % 3 == 0, "console").when(size % 3 == 1, "game").otherwise("accessory").alias("kind"), F.lit(True).alias("kind_sure"), F.when(F.col("source_id") % 2 == 0, "game").otherwise("").alias("expected"),
        F.when(i % 7 <= 1, "").when(size % 2 == 0, "cib").otherwise("loose").alias("completeness"), no.cast("string").alias("objective_id"), F.lit("").alias("objective_status"), "price", F.when(i % 5 > 0, F.col("shipping")).alias("shipping"), F.lit("").alias("region"), (i % 7 == 0).alias("lot"),
        F.when(i % 14 == 0, 1 + size % 9).alias("pieces"), F.lit(False).alias("filler"), F.lit(False).alias("variable_price"), F.when(i % 21 == 0, 5000.0).alias("per_piece"), no.cast("int").alias("games"), no.cast("double").alias("game_value"),
        F.when(i % 3 == 0, F.array(F.lit("controller"))).otherwise(F.array().cast("array<string>")).alias("missing"), F.lit(30000.0).alias("target"), F.lit(0.9).alias("confidence"), F.lit(False).alias("tested"), F.lit(False).alias("untested"), F.lit(0).alias("unverified"), F.lit(True).alias("seller_known"),
        (i % 4 > 0).alias("has_details"),
    )
    k = F.col("p_partkey")
    references = t.part.filter(k % 6 == 0).select(
        F.col("p_brand").alias("search"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "cib").otherwise("loose").alias("completeness"), (20000.0 + F.col("p_retailprice")).alias("value"),
        F.element_at(F.array(*map(F.lit, ("ebay-sold", "retail", "editorial"))), (1 + k % 3).cast("int")).alias("source"), F.lit(NOW).alias("observed_at"), (k % 4 > 0).alias("independent"), (k % 5 == 0).alias("stale"), F.lit("").alias("region"), (k % 10 / 10.0).alias("confidence"),
    )
    evidence = F.struct(F.array().cast("array<string>").alias("missing"), F.array().cast(pricing.valuation.DEFECTS).alias("defects"), F.when(i % 5 == 1, False).alias("returns_accepted"), F.when(i % 3 == 1, 1).otherwise(8).alias("images"), F.when(i % 2 == 0, 30.0).alias("taxes"), (i % 7 > 2).alias("available")).cast(pricing.EVIDENCE)
    pages = listings(t).filter(i % 6 > 0).select(i.alias("listing")).distinct().select("listing", F.col("listing").alias("listing_id")).select("listing", evidence.alias("evidence"))
    v = pricing.valued(x, references, pages, NOW)
    blockers = F.array_join(F.array_sort(F.transform("v.blockers", lambda b: b["key"])), ",")
    return v.select(F.col("listing").alias("listing_id"), F.col("b.source").alias("source"), F.col("b.value").alias("value"), F.round(F.col("p.ratio") + 1e-9, 6).alias("ratio"), F.col("v.price_band").alias("price_band"), "read", F.col("v.band").alias("band"), blockers.alias("blockers"))
