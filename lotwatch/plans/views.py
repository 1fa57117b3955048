"""Views over what is known: upserts of decisions and matches, filters, lookups, counts, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.text import fold
from lotwatch.operators import rows, upserts
from lotwatch.plans.base import Tables, query
from lotwatch.plans.runs import placed


def stamp(text: str):
    return F.lit(text).cast("timestamp")


# Sinks -------------------------------------------------------------------------------------------------------------


@query("snk02_upsert_match", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice + 1 END AS score, CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 150000 ELSE true END AS is_active FROM orders")
def snk02(t: Tables) -> DataFrame:
    """A match that is found again gets its new score and is active again; the others stay as they are."""
    known = t.orders.filter("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_totalprice").alias("score"), (F.col("o_totalprice") > 150000).alias("is_active"))
    found = t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("score"), F.lit(False).alias("is_active"))
    return upserts.upsert(known, found, ["o_orderkey"], set_to={"is_active": F.lit(True)})


@query("snk04_upsert_decision", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'following' ELSE 'dismissed' END AS decision, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS price_at_decision FROM orders")
def snk04(t: Tables) -> DataFrame:
    """A changed decision keeps the price at which the first one was made."""
    known = t.orders.filter("o_orderstatus <> 'O'").select("o_orderkey", F.lit("following").alias("decision"), F.col("o_totalprice").alias("price_at_decision"))
    new = t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", F.lit("dismissed").alias("decision"), (F.col("o_totalprice") + 1).alias("price_at_decision"))
    return upserts.upsert(known, new, ["o_orderkey"], kept=["price_at_decision"])


@query("snk05_purchase", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'purchased' ELSE 'snoozed' END AS decision, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS reserved FROM orders")
def snk05(t: Tables) -> DataFrame:
    """A purchase turns the decision and clears what was reserved."""
    known = t.orders.select("o_orderkey", F.lit("snoozed").alias("decision"), F.col("o_totalprice").alias("reserved"))
    bought = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("purchased").alias("decision"), F.lit(None).cast("double").alias("reserved"))
    return upserts.upsert(known, bought, ["o_orderkey"])


@query("snk06_shipped_where_null", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, TIMESTAMP '1999-01-01') AS shipped_at FROM orders")
def snk06(t: Tables) -> DataFrame:
    shipped = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", F.coalesce(shipped, stamp("1999-01-01")).alias("shipped_at"))


@query("snk26_logical_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '1999-01-01' END AS deleted_at FROM orders")
def snk26(t: Tables) -> DataFrame:
    """Deleted searches keep their rows, and so their history."""
    gone = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", stamp("1999-01-01").alias("deleted_at"))
    return upserts.upsert(t.orders.select("o_orderkey", F.lit(None).cast("timestamp").alias("deleted_at")), gone, ["o_orderkey"])


@query("snk27_partial_preferences", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_nationkey >= 20 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def snk27(t: Tables) -> DataFrame:
    """An absent field keeps its value, one given as null is cleared."""
    given = F.when(F.col("s_nationkey") < 10, F.array(F.lit("s_name"))).when(F.col("s_nationkey") >= 20, F.array(F.lit("s_acctbal"))).otherwise(F.array().cast("array<string>"))
    changes = t.supplier.select("s_suppkey", given.alias("given"), F.lit(None).cast("string").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return upserts.partial_update(t.supplier, changes, "s_suppkey", ["s_name", "s_acctbal"]).select("s_suppkey", "s_name", "s_acctbal")


@query("snk29_watchlist", "SELECT s_suppkey AS item, s_name AS lot_id FROM supplier WHERE s_nationkey >= 10 UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier WHERE s_nationkey < 10")
def snk29(t: Tables) -> DataFrame:
    items = t.supplier.select(F.col("s_suppkey").alias("item"), F.col("s_name").alias("lot_id"), F.lit("").alias("url"))
    new = t.supplier.filter("s_nationkey < 10").select((-1 - F.col("s_suppkey")).alias("item"), F.col("s_name").alias("lot_id"), F.lit("").alias("url"))
    return upserts.replaced_or_appended(items, new, "lot_id", "url").select("item", "lot_id")


# Filters -----------------------------------------------------------------------------------------------------------


@query("flt05_visible_and_dismissed", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0) THEN 'dismissed' ELSE 'visible' END AS shown FROM orders")
def flt05(t: Tables) -> DataFrame:
    dismissed = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("dismissed").alias("shown"))
    return t.orders.join(dismissed, "o_custkey", "left").select("o_orderkey", F.coalesce("shown", F.lit("visible")).alias("shown"))


@query("flt06_recount_after_dismissals", "SELECT o_orderpriority, count(*) AS matches FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def flt06(t: Tables) -> DataFrame:
    left = t.orders.join(t.customer.filter("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return left.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("matches"))


@query("flt09_collection_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'widget') AND p_type = 'ECONOMY'")
def flt09(t: Tables) -> DataFrame:
    """A folded text within any of the fields, and a choice of each list."""
    every = fold(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return t.part.filter(F.contains(every, fold(F.lit("WÍDGET"))) & (F.col("p_type") == "ECONOMY")).select("p_partkey")


@query("flt12_token_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'cold') AND contains(lower(p_name || ' ' || p_type), 'eco') ORDER BY p_brand, p_name, p_partkey LIMIT 40")
def flt12(t: Tables) -> DataFrame:
    """All of the words somewhere in a game; the first 40 by platform and title."""
    text = fold(F.concat_ws(" ", "p_name", "p_type"))
    return t.part.filter(F.contains(text, F.lit("cold")) & F.contains(text, F.lit("eco"))).orderBy("p_brand", "p_name", "p_partkey").limit(40).select("p_partkey")


@query("flt16_slot_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') OR o_orderstatus = 'P'")
def flt16(t: Tables) -> DataFrame:
    """Searches of a slot; those without slots of their own are in all."""
    slots = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))
    return t.orders.filter((F.size(slots) == 0) | F.arrays_overlap(slots, F.array(F.lit("1-URGENT"), F.lit("3-MEDIUM")))).select("o_orderkey")


@query("flt22_wish_view", "SELECT 'all' AS view, count(*) AS wishes FROM orders UNION ALL SELECT 'fulfilled', count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'pending', count(*) FILTER (o_orderstatus <> 'F') FROM orders")
def flt22(t: Tables) -> DataFrame:
    views = F.array(F.lit("all"), F.when(F.col("o_orderstatus") == "F", "fulfilled").otherwise("pending"))
    return t.orders.select(F.explode(views).alias("view")).groupBy("view").agg(F.count(F.lit(1)).alias("wishes"))


# Joins, counts, windows --------------------------------------------------------------------------------------------


@query("join03_live_matches", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'O' AND c_acctbal >= 0")
def join03(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'O'").join(t.customer.filter("c_acctbal >= 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join09_featured", "SELECT c_custkey, (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS o_orderkey FROM customer WHERE c_acctbal >= 0")
def join09(t: Tables) -> DataFrame:
    """Featured rows with the first match of their key."""
    first = rows.first_wins(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.filter("c_acctbal >= 0").join(first, "c_custkey", "left").select("c_custkey", "o_orderkey")


@query("join24_additions", "SELECT c_custkey AS id, 'base' AS origin FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'added' FROM customer WHERE c_acctbal < 0 AND c_nationkey < 10")
def join24(t: Tables) -> DataFrame:
    """Additions come in where the base doesn't have their id."""
    base = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.lit("base").alias("origin"))
    additions = t.customer.filter("c_nationkey < 10").select(F.col("c_custkey").alias("id"), F.lit("added").alias("origin"))
    return base.unionByName(additions.join(base, "id", "left_anti"))


@query("join29_dismissed_live", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'live' ELSE 'gone' END AS state, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS price FROM orders WHERE o_orderpriority < '3'")
def join29(t: Tables) -> DataFrame:
    """What the user dismissed, with its live row or a row that stands for it."""
    live = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit("live").alias("state"))
    return t.orders.filter("o_orderpriority < '3'").select("o_orderkey").join(live, "o_orderkey", "left").select("o_orderkey", F.coalesce("state", F.lit("gone")).alias("state"), "price")


@query("agg02_three_maxima", "SELECT o_custkey, max(o_totalprice) AS best_score, max(o_orderdate) AS last_seen, max(o_orderkey) AS newest, arg_max(o_orderpriority, (o_totalprice, o_orderkey)) AS of_the_best FROM orders GROUP BY 1")
def agg02(t: Tables) -> DataFrame:
    """Three maxima; the other columns are those of the best score."""
    best = F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best_score"), F.max("o_orderdate").cast("timestamp").alias("last_seen"), F.max("o_orderkey").alias("newest"), best.alias("of_the_best"))


@query("agg15_distinct_ids", "SELECT DISTINCT l_partkey AS id FROM lineitem")
def agg15(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("id")).distinct().orderBy("id")


@query("agg23_title_coverage", "SELECT p_brand, count(*) AS total, count(*) FILTER (c) AS covered, min(p_name) FILTER (NOT c) AS first_uncovered FROM (SELECT *, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS c FROM part) GROUP BY 1")
def agg23(t: Tables) -> DataFrame:
    covered = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("c")).distinct()
    c = F.coalesce("c", F.lit(False))
    return t.part.join(covered, "p_partkey", "left").groupBy("p_brand").agg(F.count(F.lit(1)).alias("total"), F.count_if(c).alias("covered"), F.min(F.when(~c, F.col("p_name"))).alias("first_uncovered"))


@query("agg24_state_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS owned, count(*) FILTER (o_orderstatus = 'O') AS wanted, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3') AS working FROM orders")
def agg24(t: Tables) -> DataFrame:
    owned = F.col("o_orderstatus") == "F"
    return t.orders.agg(F.count(F.lit(1)).alias("total"), F.count_if(owned).alias("owned"), F.count_if(F.col("o_orderstatus") == "O").alias("wanted"), F.count_if(owned & (F.col("o_orderpriority") < "3")).alias("working"))


@query("agg36_capacity", "SELECT c_nationkey, count(*) AS active, greatest(0, 25 - count(*)) AS free FROM customer GROUP BY 1")
def agg36(t: Tables) -> DataFrame:
    """Active searches of a slot against the cap of 25."""
    return t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("active")).withColumn("free", F.greatest(F.lit(0).cast("long"), 25 - F.col("active")))


@query("agg39_first_seen_order", "SELECT l_suppkey, count(*) AS lots, row_number() OVER (ORDER BY min(l_shipdate), l_suppkey) AS place FROM lineitem GROUP BY 1")
def agg39(t: Tables) -> DataFrame:
    """Sources in the order in which they were first seen; one row a source is windowed."""
    g = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lots"), F.min("l_shipdate").alias("first"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("first", "l_suppkey"))).drop("first")


@query("win04_representative", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def win04(t: Tables) -> DataFrame:
    """A cluster's newest member stands for it."""
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("win15_latest_run", "SELECT user_id, event_type, max(event_id) AS event_id FROM events e WHERE ts = (SELECT max(ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type) GROUP BY ALL")
def win15(t: Tables) -> DataFrame:
    return rows.first_wins(t.events, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")


# Order -------------------------------------------------------------------------------------------------------------


@query("srt04_preview", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, -1) DESC, o_orderpriority DESC, o_orderkey) AS place FROM orders")
def srt04(t: Tables) -> DataFrame:
    """By score, an unknown one below all, then by confidence."""
    score = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.lit(-1.0))
    return placed(t.orders, ["o_custkey"], score.desc(), F.col("o_orderpriority").desc(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


@query("srt06_active_first", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_orderkey) AS place FROM orders")
def srt06(t: Tables) -> DataFrame:
    return placed(t.orders, ["o_custkey"], (F.col("o_orderstatus") == "O").desc(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


@query("srt10_as_text", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000) DESC, o_custkey::VARCHAR, o_orderkey::VARCHAR) AS place FROM orders")
def srt10(t: Tables) -> DataFrame:
    """Highest score first; source and lot as text, so that 10 comes before 9."""
    return placed(t.orders, ["o_orderstatus"], F.floor(F.col("o_totalprice") / 1000).desc(), F.col("o_custkey").cast("string").asc(), F.col("o_orderkey").cast("string").asc()).select("o_orderkey", "place")


@query("srt11_watch_hits", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, coalesce(CASE WHEN o_orderstatus <> 'P' THEN epoch(o_orderdate) END, 1e12), o_orderkey) AS place FROM orders")
def srt11(t: Tables) -> DataFrame:
    left = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")), F.lit(1e12))
    return placed(t.orders, ["o_custkey"], F.col("o_orderpriority").asc(), left.asc(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


@query("srt15_games", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_size DESC, CASE WHEN p_type <> 'ECONOMY' THEN p_retailprice END NULLS LAST, p_partkey) AS place FROM part")
def srt15(t: Tables) -> DataFrame:
    low = F.when(F.col("p_type") != "ECONOMY", F.col("p_retailprice"))
    return placed(t.part, ["p_brand"], F.lower("p_name").asc(), F.col("p_size").desc(), low.asc_nulls_last(), F.col("p_partkey").asc()).select("p_partkey", "place")


@query("srt16_listing_modes", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS cheapest, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS dearest, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_retailprice, p_partkey) AS by_title FROM part")
def srt16(t: Tables) -> DataFrame:
    price, key = F.col("p_retailprice"), F.col("p_partkey").asc()
    x = placed(t.part, ["p_brand"], price.asc(), key).withColumnRenamed("place", "cheapest")
    x = placed(x, ["p_brand"], price.desc(), key).withColumnRenamed("place", "dearest")
    return placed(x, ["p_brand"], F.col("p_name").asc(), price.asc(), key).select("p_partkey", "cheapest", "dearest", F.col("place").alias("by_title"))


@query("srt18_wishes", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F'), o_orderdate, o_orderkey) AS place FROM orders")
def srt18(t: Tables) -> DataFrame:
    """Pending wishes first, then in order of their making."""
    return placed(t.orders, ["o_custkey"], (F.col("o_orderstatus") == "F").asc(), F.col("o_orderdate").asc(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


@query("srt21_home_without_featured", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def srt21(t: Tables) -> DataFrame:
    """The twelve best that aren't featured already."""
    best = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    featured = t.orders.orderBy(*best).limit(3).select("o_orderkey")
    return t.orders.join(F.broadcast(featured), "o_orderkey", "left_anti").orderBy(*best).limit(12).select("o_orderkey")


@query("srt22_pending_deliveries", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def srt22(t: Tables) -> DataFrame:
    return placed(t.orders.filter("o_orderstatus = 'P'"), ["o_orderpriority"], F.col("o_orderdate").asc(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


@query("srt25_runs_newest_first", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_type, event_id) AS place FROM events")
def srt25(t: Tables) -> DataFrame:
    """A user's days newest first, each day's receipts by search."""
    return placed(t.events, ["user_id"], F.date_trunc("day", F.col("ts").cast("timestamp")).desc(), F.col("event_type").asc(), F.col("event_id").asc()).select("event_id", "place")
