"""Intents and targets on stand-ins: brands as consoles, parts as games, suppliers as searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.operators import intents
from lotwatch.plans.base import Tables, query

# A supplier's search by its key: type by the remainder of 5, entity by that of 3; a line is a match by the line's part.
_S = """s AS (SELECT s_suppkey AS search, ['game', 'lot', 'discovery', 'console', 'game'][1 + s_suppkey % 5] AS search_type, CASE s_suppkey % 3 WHEN 0 THEN 'console' WHEN 1 THEN 'game' ELSE '' END AS entity_type, 'Brand#' || (1 + s_nationkey) AS console,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Brand#' || (1 + s_nationkey) WHEN s_suppkey % 3 = 1 THEN 'g' || s_suppkey ELSE '' END AS entity FROM supplier)"""
_W = """w AS (SELECT DISTINCT p_brand AS console, 'g' || p_partkey AS game FROM part WHERE p_partkey % 4 = 0 UNION SELECT p_brand, unnest(['g' || p_partkey, 'r' || p_partkey]) FROM part WHERE p_size % 5 = 0 AND p_brand IN ('Brand#3', 'Brand#7'))"""
_T = "t AS (SELECT DISTINCT l_suppkey AS search, p_brand AS target_console, 'g' || p_partkey AS target_game FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 7 > 0)"


def _searches(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    brand = F.concat(F.lit("Brand#"), (1 + F.col("s_nationkey")).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("game", "lot", "discovery", "console", "game"))), (1 + k % 5).cast("int"))
    entity = F.when(k % 3 == 0, brand).when(k % 3 == 1, F.concat(F.lit("g"), k.cast("string"))).otherwise("")
    return t.supplier.select(k.alias("search"), kind.alias("search_type"), F.when(k % 3 == 0, "console").when(k % 3 == 1, "game").otherwise("").alias("entity_type"), brand.alias("console"), entity.alias("entity"))


def _game() -> Column:
    return F.concat(F.lit("g"), F.col("p_partkey").cast("string"))


def _targets(t: Tables) -> DataFrame:
    lines = t.lineitem.filter("l_suppkey % 7 > 0").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_suppkey").alias("search"), F.col("p_brand").alias("target_console"), _game().alias("target_game")).distinct()


def _wished(t: Tables) -> DataFrame:
    games = t.part.filter("p_partkey % 4 = 0").select(F.lit("games").alias("kind"), F.col("p_brand").alias("console"), _game().alias("game"), F.lit(None).cast("string").alias("franchise"))
    brands = t.part.select("p_brand").distinct().filter(F.col("p_brand").isin("Brand#3", "Brand#7")).select(F.lit("franchise").alias("kind"), F.lit(None).cast("string").alias("console"), F.lit(None).cast("string").alias("game"), F.col("p_brand").alias("franchise"))
    releases = t.part.select(F.col("p_brand").alias("franchise"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("release"), (F.col("p_size") % 5 == 0).alias("primary"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("console"), F.col("p_brand").alias("platform"), _game().alias("game"))
    return intents.wished_keys(games.unionByName(brands), releases)


@query("set14_wished_keys", f"WITH {_W} SELECT console, game FROM w")
def set14(t: Tables) -> DataFrame:
    return _wished(t)


@query("set13_targeted", f"""WITH {_S}, {_T}, d AS (SELECT 'console' AS kind, entity AS console, NULL AS game FROM s WHERE search_type <> 'lot' AND entity_type = 'console' UNION SELECT 'lot', CASE WHEN entity_type = 'console' THEN entity ELSE console END, NULL FROM s WHERE search_type = 'lot' AND (entity_type = 'console' OR entity = '')
  UNION SELECT 'game', console, entity FROM s WHERE entity <> '' UNION SELECT 'game', console, target_game FROM t JOIN s USING (search)) SELECT * FROM d""")
def set13(t: Tables) -> DataFrame:
    return intents.targeted(_searches(t), _targets(t))


@query("val10_match_intents", f"""WITH {_S}, {_W}, m AS (SELECT s.*, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS tc, CASE WHEN l_linenumber % 3 > 0 THEN 'g' || p_partkey END AS tg FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON search = l_suppkey),
  k AS (SELECT *, coalesce(tg, CASE WHEN entity_type = 'game' THEN entity END) AS g, CASE WHEN tg IS NOT NULL THEN coalesce(tc, console) ELSE console END AS c FROM m)
  SELECT l_orderkey, l_linenumber, search, l_partkey, CASE WHEN search_type = 'lot' THEN 'lot' WHEN search_type = 'discovery' THEN 'discovery' WHEN entity_type = 'console' OR search_type = 'console' THEN 'console' WHEN g IS NOT NULL THEN CASE WHEN w.game IS NOT NULL THEN 'wishlist' ELSE 'recommendation' END ELSE 'manual' END AS intent FROM k LEFT JOIN w ON w.console = k.c AND w.game = k.g""")
def val10(t: Tables) -> DataFrame:
    """Lines as matches of their supplier's search, some of them found by a title."""
    n = F.col("l_linenumber")
    titles = intents.title_wishes(t.part.select("p_partkey", F.col("p_brand").alias("target_console"), _game().alias("target_game")), _wished(t))
    lines = t.lineitem.join(titles.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    matches = lines.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("search"), "l_partkey", F.when(n % 2 == 0, F.col("target_console")).alias("target_console"), F.when(n % 3 > 0, F.col("target_game")).alias("target_game"), "wished_on")
    return intents.searched_match_intents(matches, _searches(t), _wished(t))


@query("val10_search_intents", f"""WITH {_S}, {_W}, {_T}, o AS (SELECT s.*, CASE WHEN search_type = 'lot' THEN 'lot' WHEN search_type = 'discovery' THEN 'discovery' WHEN entity_type = 'console' OR search_type = 'console' THEN 'console' WHEN entity_type = 'game' THEN CASE WHEN w.game IS NOT NULL THEN 'wishlist' ELSE 'recommendation' END ELSE 'manual' END AS own
    FROM s LEFT JOIN w ON w.console = s.console AND w.game = s.entity), h AS (SELECT search, bool_or(w.game IS NOT NULL) AS any_hit, bool_and(w.game IS NOT NULL) AS all_hit FROM t LEFT JOIN w ON w.console = target_console AND w.game = target_game GROUP BY search)
  SELECT search, CASE WHEN own IN ('recommendation', 'manual') AND any_hit IS NOT NULL THEN CASE WHEN any_hit THEN 'wishlist' ELSE 'recommendation' END ELSE own END AS intent, CASE WHEN own IN ('recommendation', 'manual') AND any_hit IS NOT NULL THEN CASE WHEN all_hit THEN 'wishlist' ELSE 'recommendation' END ELSE own END AS strict FROM o LEFT JOIN h USING (search)""")
def val10_searches(t: Tables) -> DataFrame:
    return intents.both_intents(_searches(t), _targets(t), _wished(t))
