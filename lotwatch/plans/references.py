"""Catalog references on stand-ins: brands as consoles with stored prices, parts as games with a price range, suppliers as searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.operators import references as R
from lotwatch.plans.base import Tables, query

# A supplier stands for a console: prices by its balance, some missing, some copied from the guide.
_C = """c AS (SELECT 's' || s_suppkey AS entity, s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN round(s_acctbal, 2) END AS guide, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_acctbal > 0 THEN round(s_acctbal, 2) END WHEN s_suppkey % 3 = 1 THEN 50.0 + s_suppkey END AS sold,
  CASE WHEN s_suppkey % 4 = 0 THEN 100.0 + s_suppkey END AS cib, CASE WHEN s_suppkey % 5 = 0 THEN 20.0 + s_suppkey END AS shop FROM supplier)"""
_REFS = f"""WITH {_C}, r AS (SELECT entity, 'pricecharting' AS source, guide::DOUBLE AS value, 'loose' AS completeness, 0.8::DOUBLE AS confidence, true AS independent FROM c WHERE guide IS NOT NULL
  UNION ALL SELECT entity, 'ebay-sold', sold, 'loose', CASE WHEN p THEN 0.35 ELSE 0.9 END, NOT p FROM (SELECT *, k % 6 = 1 OR coalesce(abs(sold - guide) < 0.01, false) AS p FROM c) WHERE sold IS NOT NULL
  UNION ALL SELECT entity, 'pricecharting', cib, 'cib', 0.8, true FROM c WHERE cib IS NOT NULL UNION ALL SELECT entity, 'retail', shop, 'loose', 0.6, true FROM c WHERE shop IS NOT NULL)"""


def _consoles(t: Tables) -> DataFrame:
    k, balance = F.col("s_suppkey"), F.col("s_acctbal").cast("string")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    sources = F.struct(none.alias("precioPriceChart"), F.when(k % 6 == 1, "Proxy de la guía").alias("precioEbaySold"), none.alias("precioCIB"), none.alias("precioGameStop"))
    entry = t.supplier.select(
        F.concat(F.lit("s"), text(k)).alias("id"), balance.alias("precioPriceChart"), F.when(k % 3 == 0, balance).when(k % 3 == 1, text(50.0 + k)).otherwise("n/d").alias("precioEbaySold"), F.when(k % 4 == 0, text(100.0 + k)).alias("precioCIB"),
        F.when(k % 5 == 0, text(20.0 + k)).alias("precioGameStop"), F.struct(F.lit("2026-01-01").alias("verificadoEn"), sources.alias("fuentes")).alias("precioNotas"),
    )
    return R.console_references(entry)


def _games(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return R.game_references(t.part.select(
        F.col("p_brand").alias("console"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("game"), F.lit("1").alias("low"), F.when(n % 4 > 0, F.col("p_retailprice")).alias("mid"), F.lit("x").alias("high"), F.when(n % 3 == 0, "visto 2026-01-02, tienda").alias("notes")
    ))


@query("math21_catalog_references", _REFS + " SELECT * FROM r")
def math21(t: Tables) -> DataFrame:
    return _consoles(t).select("entity", "source", "value", "completeness", "confidence", "independent")


@query("math22_game_references", "SELECT p_brand AS console, 'g' || p_partkey AS game, round(p_retailprice, 2) AS value, CASE WHEN p_size % 3 = 0 THEN '2026-01-02' ELSE '' END AS observed_at, CASE WHEN p_size % 3 = 0 THEN 0.6 ELSE 0.45 END::DOUBLE AS confidence FROM part WHERE p_size % 4 > 0")
def math22(t: Tables) -> DataFrame:
    return _games(t).select("console", "game", "value", "observed_at", "confidence")


@query(
    "join15_entity_references",
    _REFS + """, s AS (SELECT o_orderkey AS search, CASE o_orderkey % 3 WHEN 0 THEN 'console' WHEN 1 THEN 'game' ELSE '' END AS entity_type, o_custkey AS k FROM orders),
    g AS (SELECT p_brand AS console, 'g' || p_partkey AS game, round(p_retailprice, 2) AS value FROM part WHERE p_size % 4 > 0)
    SELECT search, source, value, completeness FROM s JOIN r ON entity_type = 'console' AND entity = 's' || k % 20 UNION ALL SELECT search, 'retail', value, 'loose' FROM s JOIN g ON entity_type = 'game' AND console = 'Brand#' || (1 + k % 25) AND game = 'g' || k % 200""",
)
def join15(t: Tables) -> DataFrame:
    """Orders as searches that point to a console, to a game of a console, or to nothing."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 3 == 0, "console").when(k % 3 == 1, "game").otherwise("")
    entity = F.when(k % 3 == 0, F.concat(F.lit("s"), (c % 20).cast("string"))).otherwise(F.concat(F.lit("g"), (c % 200).cast("string")))
    searches = t.orders.select(k.alias("search"), kind.alias("entity_type"), entity.alias("entity"), F.concat(F.lit("Brand#"), (1 + c % 25).cast("string")).alias("console"))
    return R.entity_references(searches, _consoles(t), _games(t)).select("search", "source", "value", "completeness")


@query("strf35_search_queries", "SELECT p_partkey, p_name || '|' || p_type || CASE WHEN p_size % 2 = 0 THEN '|extra ' || p_size ELSE '' END AS queries FROM part")
def strf35(t: Tables) -> DataFrame:
    more = F.array(F.upper("p_name"), F.concat(F.lit("  "), F.col("p_type")), F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("extra \t "), F.col("p_size").cast("string"))), F.lower("p_type"))
    return t.part.select("p_partkey", F.array_join(R.search_queries(F.col("p_name"), more), "|").alias("queries"))


@query("val13_sold_links", "SELECT p_partkey, 'https://www.ebay.com/sch/i.html?_nkw=' || replace(p_name, ' ', '+') || '+%26+' || replace(p_type, ' ', '+') || '&_sacat=0&LH_Sold=1&LH_Complete=1' AS url FROM part")
def val13(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.sold_link(F.concat_ws("  & ", "p_name", "p_type")).alias("url"))


@query(
    "prj19_expected_kinds",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 IN (0, 1) THEN '' WHEN s_suppkey % 3 = 0 THEN 'console' WHEN s_suppkey % 3 = 1 THEN 'game' WHEN s_suppkey % 4 = 2 THEN 'console' ELSE '' END AS expected, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN 'cib' ELSE 'loose' END AS compared,
      s_suppkey % 7 > 0 AND s_suppkey % 3 <> 0 AS target, CASE s_suppkey % 3 WHEN 0 THEN 'UYU' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency FROM supplier""",
)
def prj19(t: Tables) -> DataFrame:
    """What suppliers as searches accept, are compared with, and may be held against."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("lot", "discovery", "console", "game"))), (1 + k % 4).cast("int"))
    entity = F.when(k % 3 == 0, "console").when(k % 3 == 1, "game").otherwise("")
    name = F.when(k % 3 == 0, " $u ").when(k % 3 == 1, "dólares").otherwise("eur")
    return t.supplier.select("s_suppkey", R.expected_kind(kind, entity).alias("expected"), R.objective_completeness(F.when(k % 2 == 0, "game-cib").otherwise("console-loose"), F.when(k % 5 == 0, "incomplete")).alias("compared"), R.target_applies(F.lit("game"), k % 7 == 0, entity).alias("target"), R.currency(name).alias("currency"))
