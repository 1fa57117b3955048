"""Runs against what was known: reconciliation, sinks, state over runs, collections and rankings.

Stand-ins: a known row is an order that isn't open, a row that a run saw is one that isn't finished (so orders in
progress are both); the group of a row is its customer, who is covered completely with a balance of 0 or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions import money as V
from lotwatch.functions import text as X
from lotwatch.functions import times as D
from lotwatch.operators import collection, feed, lifecycle, match, reconcile, rows, value
from lotwatch.plans.base import Tables, query

NOW = "1998-08-02 12:00:00"
_KNOWN = "known AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O')"
_SEEN = "seen AS (SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderstatus <> 'F')"
_RUN = f"WITH {_KNOWN}, {_SEEN}"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def known(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus <> 'O'").select("o_orderkey", "o_custkey", "o_totalprice")


def seen(t: Tables) -> DataFrame:
    dearer = F.when(F.col("o_orderpriority") < "3", 1).otherwise(0)
    return t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + dearer).alias("o_totalprice"))


def placed(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The ranks of rows within their groups, as column place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# Sets --------------------------------------------------------------------------------------------------------------


@query(
    "set01_union_sources",
    "SELECT 'part' AS source, 'part-' || p_partkey AS id, p_name AS title, p_retailprice AS price FROM part UNION ALL SELECT 'supplier', 'supplier-' || s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'customer', 'customer-' || c_custkey, c_name, NULL FROM customer",
)
def set01(t: Tables) -> DataFrame:
    """Rows of several sources in one schema."""
    conformed = lambda df, source, key, title, price: df.select(F.lit(source).alias("source"), F.concat_ws("-", F.lit(source), key).alias("id"), F.col(title).alias("title"), price.cast("double").alias("price"))
    parts = conformed(t.part, "part", "p_partkey", "p_name", F.col("p_retailprice"))
    return parts.unionByName(conformed(t.supplier, "supplier", "s_suppkey", "s_name", F.col("s_acctbal"))).unionByName(conformed(t.customer, "customer", "c_custkey", "c_name", F.lit(None)))


@query("set02_processed_and_active", "SELECT DISTINCT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set02(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("id")).intersect(t.customer.filter("c_acctbal > 0").select("c_custkey"))


@query("set03_new_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def set03(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).join(t.orders, F.col("id") == F.col("o_custkey"), "left_anti").distinct()


@query(
    "set04_equality_proof",
    "WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), c AS (SELECT (SELECT count(*) FROM e WHERE k NOT IN (SELECT k FROM r)) AS missing, (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM e)) AS unexpected) SELECT missing, unexpected, missing = 0 AND unexpected = 0 AS complete FROM c",
)
def set04(t: Tables) -> DataFrame:
    return reconcile.sets_equal(t.orders.select(F.col("o_custkey").alias("k")), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query(
    "set05_reconcile",
    f"{_RUN} SELECT o_orderkey, o_custkey, o_totalprice, 'current' AS origin FROM seen UNION ALL SELECT k.*, 'previous' FROM known k LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT o_orderkey FROM seen) AND NOT coalesce(c_acctbal >= 0, false)",
)
def set05(t: Tables) -> DataFrame:
    """Known rows that the run didn't see go only where their group was covered completely."""
    receipts = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, "complete").otherwise("partial").alias("status"))
    return reconcile.reconcile(known(t), seen(t), receipts, ["o_orderkey"], "o_custkey")


@query(
    "set12_dismissals",
    f"""WITH d AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority < '3' THEN o_orderdate END AS missing_since, o_totalprice > 150000 AS active FROM orders WHERE o_orderstatus = 'F'),
    a AS (SELECT d.*, CASE WHEN active THEN 'clear' WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'protect' WHEN missing_since IS NULL THEN 'start' WHEN epoch(TIMESTAMP '{NOW}') - epoch(missing_since) >= 48 * 3600 THEN 'delete' ELSE 'wait' END AS action FROM d LEFT JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, o_custkey, action, CASE WHEN action IN ('clear', 'protect') THEN NULL WHEN action = 'start' THEN TIMESTAMP '{NOW}' ELSE missing_since END AS missing_since FROM a""",
)
def set12(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'")
    dismissed = done.select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") < "3", F.col("o_orderdate").cast("timestamp")).alias("missing_since"))
    healthy = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    out = reconcile.expire_dismissals(dismissed, done.filter("o_totalprice > 150000"), healthy, ["o_orderkey"], "o_custkey", now())
    return out.select("o_orderkey", "o_custkey", "action", "missing_since")


@query("set15_edits_diff", "SELECT p_partkey, p_retailprice + 1 AS p_retailprice, p_type FROM part WHERE p_size > 25")
def set15(t: Tables) -> DataFrame:
    """Only rows that differ from the base are stored."""
    current = t.part.withColumn("p_retailprice", F.when(F.col("p_size") > 25, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return collection.changed_only(t.part, current, "p_partkey", ["p_retailprice", "p_type"]).select("p_partkey", "p_retailprice", "p_type")


_CANDIDATE = "CASE WHEN p_size > 40 THEN lower(p_type) ELSE p_type END"


@query("set16_merge_preserving", f"SELECT p_partkey, CASE WHEN p_size < 10 THEN {_CANDIDATE} ELSE p_type END AS p_type FROM part")
def set16(t: Tables) -> DataFrame:
    return collection.merged_preserving(*_merge_sides(t), "p_partkey", ["p_type"])[0].select("p_partkey", "p_type")


@query("set16_merge_conflicts", "SELECT p_partkey, 'p_type' AS field, p_type AS kept, lower(p_type) AS offered FROM part WHERE p_size > 40 AND p_type <> lower(p_type)")
def set16_conflicts(t: Tables) -> DataFrame:
    return collection.merged_preserving(*_merge_sides(t), "p_partkey", ["p_type"])[1]


def _merge_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    existing = t.part.withColumn("p_type", F.when(F.col("p_size") >= 10, F.col("p_type")))
    return existing, t.part.withColumn("p_type", F.when(F.col("p_size") > 40, F.lower("p_type")).otherwise(F.col("p_type")))


@query("set17_issues", "SELECT CAST(c_custkey AS VARCHAR) AS name, 'source' AS kind FROM customer WHERE c_acctbal < 0 UNION ALL SELECT DISTINCT o_orderpriority, 'step' FROM orders WHERE o_orderpriority < '3' AND o_orderpriority NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)")
def set17(t: Tables) -> DataFrame:
    """Partial sources, then failed steps that no source stands for."""
    sources = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("name"), F.lit("source").alias("kind"))
    steps = t.orders.filter("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("name"), F.lit("step").alias("kind")).distinct()
    return sources.unionByName(steps.join(sources, "name", "left_anti"))


@query("set18_active_keys", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set18(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'O'").select("o_custkey").distinct()


# Sinks -------------------------------------------------------------------------------------------------------------


@query(
    "snk01_upsert_listing",
    f"""{_RUN} SELECT coalesce(s.o_orderkey, k.o_orderkey) AS o_orderkey, coalesce(s.o_totalprice, k.o_totalprice) AS o_totalprice, CASE WHEN s.o_totalprice <> k.o_totalprice THEN k.o_totalprice END AS previous_price,
    s.o_totalprice IS NOT NULL AND k.o_totalprice IS NOT NULL AND s.o_totalprice <> k.o_totalprice AS changed, k.o_orderkey IS NULL AS first_seen_now, s.o_orderkey IS NOT NULL AS seen_now FROM known k FULL JOIN seen s ON s.o_orderkey = k.o_orderkey""",
)
def snk01(t: Tables) -> DataFrame:
    """Inserted or overwritten; the former price is kept only where both are known and differ."""
    before = F.lit("1998-01-01").cast("timestamp")
    old = known(t).select("o_orderkey", "o_totalprice").withColumns({"previous_price": F.lit(None).cast("double"), "price_changed_at": F.lit(None).cast("timestamp"), "first_seen_at": before, "last_seen_at": before})
    x = reconcile.upsert_listings(old, seen(t).select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice", now())
    return x.select("o_orderkey", "o_totalprice", "previous_price", F.col("price_changed_at").isNotNull().alias("changed"), (F.col("first_seen_at") == now()).alias("first_seen_now"), (F.col("last_seen_at") == now()).alias("seen_now"))


@query("snk03_deactivate", f"{_RUN} SELECT k.o_orderkey, k.o_custkey, CASE WHEN s.o_orderkey IS NOT NULL THEN true ELSE NOT coalesce(c_acctbal >= 0, false) END AS is_active FROM known k LEFT JOIN seen s ON s.o_orderkey = k.o_orderkey LEFT JOIN customer ON c_custkey = k.o_custkey")
def snk03(t: Tables) -> DataFrame:
    receipts = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") >= 0).alias("authoritative"))
    matches = known(t).select("o_orderkey", "o_custkey", F.lit(True).alias("is_active"))
    return reconcile.deactivate(matches, seen(t), receipts, "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "is_active")


@query("snk07_keep_if_empty", "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name FROM part")
def snk07(t: Tables) -> DataFrame:
    new = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise("").alias("p_name"))
    return reconcile.keep_if_empty(t.part.select("p_partkey", "p_name"), new, ["p_partkey"], ["p_name"])


@query("snk08_exclusive", f"{_RUN} SELECT o_orderkey, 'following' AS list FROM known WHERE o_orderkey NOT IN (SELECT o_orderkey FROM seen) UNION ALL SELECT o_orderkey, 'dismissed' FROM seen")
def snk08(t: Tables) -> DataFrame:
    """What is dismissed is no longer followed."""
    following, dismissed = reconcile.exclusive(known(t), seen(t), ["o_orderkey"])
    return following.select("o_orderkey", F.lit("following").alias("list")).unionByName(dismissed.select("o_orderkey", F.lit("dismissed").alias("list")))


@query("snk09_purge_expired", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate >= TIMESTAMP '1996-01-01'")
def snk09(t: Tables) -> DataFrame:
    x = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("expires"))
    return reconcile.purge_expired(x, "expires", F.lit("1996-01-01").cast("timestamp")).select("o_orderkey")


@query("snk17_content_hash", """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS digest FROM nation""")
def snk17(t: Tables) -> DataFrame:
    """The digest of a row as compact JSON, keys in order; null members are left out."""
    return t.nation.select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), 256).alias("digest"))


@query("snk20_run_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 100 OR o_orderstatus = 'P'")
def snk20(t: Tables) -> DataFrame:
    """The newest runs, and those with something pending."""
    return reconcile.newest_kept(t.orders.select("o_orderkey", "o_orderdate"), 100, F.col("o_orderdate"), "o_orderkey", t.orders.filter("o_orderstatus = 'P'").select("o_orderkey")).select("o_orderkey")


@query("snk21_outbox_id", "SELECT n_regionkey, sha1(string_agg(x, chr(0) ORDER BY o, x)) AS id FROM (SELECT n_regionkey, 0 AS o, 'new' AS x FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 1, 'run-' || n_regionkey FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 2, n_name FROM nation) GROUP BY n_regionkey")
def snk21(t: Tables) -> DataFrame:
    """One id for the items of a mail, of which there are few."""
    items = t.nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("ids"))
    return items.select("n_regionkey", lifecycle.outbox_id(F.lit("new"), F.concat_ws("-", F.lit("run"), "n_regionkey"), F.col("ids")).alias("id"))


@query("snk23_backoff", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 1 THEN 60 WHEN l_linenumber = 2 THEN 300 WHEN l_linenumber = 3 THEN 900 ELSE 3600 END AS seconds FROM lineitem")
def snk23(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", lifecycle.backoff_seconds(F.col("l_linenumber")).alias("seconds"))


# State over runs ---------------------------------------------------------------------------------------------------


@query(
    "str01_lifecycle",
    f"""{_RUN}, x AS (SELECT coalesce(s.o_orderkey, k.o_orderkey) AS o_orderkey, s.o_orderkey IS NOT NULL AS here, k.o_orderkey IS NOT NULL AS was, coalesce(k.o_totalprice > 100000, false) AS active, coalesce(c_acctbal >= 0, false) AS proof
    FROM known k FULL JOIN seen s ON s.o_orderkey = k.o_orderkey LEFT JOIN customer ON c_custkey = coalesce(s.o_custkey, k.o_custkey)),
    e AS (SELECT *, CASE WHEN here AND NOT was THEN 'new' WHEN here AND active THEN 'seen' WHEN here THEN 'back' WHEN NOT active THEN 'gone' WHEN proof THEN 'removed' ELSE 'kept' END AS event FROM x)
    SELECT o_orderkey, event, CASE WHEN was THEN 3 ELSE 0 END + CASE WHEN here THEN 1 ELSE 0 END AS seen_count, event IN ('new', 'seen', 'back', 'kept') AS active FROM e""",
)
def str01(t: Tables) -> DataFrame:
    first = F.lit("1998-01-01").cast("timestamp")
    state = known(t).select("o_orderkey", "o_custkey", first.alias("first_seen"), first.alias("last_seen"), F.lit(3).alias("seen_count"), (F.col("o_totalprice") > 100000).alias("active"))
    proof = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return lifecycle.update_lifecycle(state, seen(t), proof, ["o_orderkey"], "o_custkey", now()).select("o_orderkey", "event", "seen_count", "active")


@query("str01_history", "WITH l AS (SELECT max(date_trunc('day', ts)) AS last FROM events) SELECT user_id, event_type, min(date_trunc('day', ts)) AS first_seen, max(date_trunc('day', ts)) AS last_seen, count(DISTINCT date_trunc('day', ts)) AS seen_count, max(date_trunc('day', ts)) = any_value(last) AS active FROM events, l GROUP BY user_id, event_type")
def str01_history(t: Tables) -> DataFrame:
    """The same state from the whole history: a day is a run."""
    days = t.events.select("user_id", "event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("run"))
    last = days.agg(F.max("run").alias("last"))
    return lifecycle.lifecycle_from_history(days, ["user_id", "event_type"], "run", F.lit(0).cast("timestamp")).drop("active").join(F.broadcast(last)).withColumn("active", F.col("last_seen") == F.col("last")).drop("last")


@query("str03_due_slots", "WITH o AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND o_orderstatus <> 'F') SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'due' ELSE 'skipped' END AS state FROM o")
def str03(t: Tables) -> DataFrame:
    """Of a day's overdue slots the last is due; those that a run has fulfilled are neither."""
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.lit(1e-6) * F.col("o_orderkey"))
    slots = t.orders.select("o_orderkey", at.alias("at"))
    return lifecycle.due_slots(slots, t.orders.filter("o_orderstatus = 'F'"), F.lit("1997-01-01 00:00:59").cast("timestamp"), "o_orderkey", "at").select("o_orderkey", "state")


@query("str06_lease", f"WITH x AS (SELECT event_id, CASE WHEN value < 100 THEN 'pending' WHEN value < 200 THEN 'running' ELSE 'done' END AS s, epoch(max(ts) OVER ()) - epoch(ts) AS age FROM events) SELECT event_id, CASE WHEN s = 'pending' AND age > 600 THEN 'failed' WHEN s = 'running' AND age > 1800 THEN 'failed' ELSE s END AS status FROM x")
def str06(t: Tables) -> DataFrame:
    ts, last = F.col("ts").cast("timestamp"), t.events.agg(F.max("ts").cast("timestamp").alias("last"))
    status = F.when(F.col("value") < 100, "pending").when(F.col("value") < 200, "running").otherwise("done")
    return t.events.join(F.broadcast(last)).select("event_id", lifecycle.lease_status(status, ts, F.lit(None).cast("timestamp"), F.col("last")).alias("status"))




@query("str12_snapshot_status", "SELECT o_orderkey, CASE WHEN epoch(TIMESTAMP '1996-01-01') - epoch(o_orderdate) < -300 THEN 'unavailable' WHEN epoch(TIMESTAMP '1996-01-01') - epoch(o_orderdate) > 36 * 3600 THEN 'stale' ELSE 'current' END AS status FROM orders")
def str12(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", lifecycle.snapshot_status(F.col("o_orderdate").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")).alias("status"))


# Joins -------------------------------------------------------------------------------------------------------------


@query("join05_decision_history", "SELECT o_orderkey, c_name, o_totalprice, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey")
def join05(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))


@query("join07_reserved", "SELECT n_nationkey, round(sum(o_totalprice), 2) AS reserved FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY 1")
def join07(t: Tables) -> DataFrame:
    x = t.orders.filter("o_orderstatus = 'O'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_nationkey").agg(F.round(F.sum("o_totalprice"), 2).alias("reserved"))


@query("join08_last_wins", "SELECT c_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join08(t: Tables) -> DataFrame:
    """A lookup in which the last row of a key wins."""
    last = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join11_groups_to_refresh", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join11(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join14_reference_lookup", "SELECT l_orderkey, l_linenumber, p_retailprice AS reference FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def join14(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.filter("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.col("p_retailprice").alias("reference"))


@query("join18_uncovered_entities", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def join18(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("join19_enriched", f"{_RUN} SELECT coalesce(s.o_orderkey, k.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, k.o_custkey) AS o_custkey, coalesce(s.o_totalprice, k.o_totalprice) AS o_totalprice FROM known k FULL JOIN seen s ON s.o_orderkey = k.o_orderkey")
def join19(t: Tables) -> DataFrame:
    return collection.replaced(known(t), seen(t), ["o_orderkey"])


@query("join20_patched", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'EDITED' ELSE p_type END AS p_type, p_retailprice FROM part UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal FROM supplier")
def join20(t: Tables) -> DataFrame:
    """Base rows with the user's edits, and the user's own rows."""
    base = t.part.select("p_partkey", "p_type", "p_retailprice")
    edits = t.part.select("p_partkey", F.when(F.col("p_size") > 25, "EDITED").alias("p_type"))
    manual = t.supplier.select((-1 - F.col("s_suppkey")).alias("p_partkey"), F.col("s_name").alias("p_type"), F.col("s_acctbal").alias("p_retailprice"))
    return collection.patched(base, edits, "p_partkey", ["p_type"], manual)


@query("join21_two_tier", "WITH i AS (SELECT * FROM nation WHERE n_regionkey < 2) SELECT c_custkey, CASE WHEN i.n_nationkey IS NOT NULL THEN 'id' WHEN n.n_nationkey IS NOT NULL THEN 'name' END AS found_by, coalesce(i.n_regionkey, n.n_regionkey) AS n_regionkey FROM customer LEFT JOIN i ON i.n_nationkey = c_nationkey LEFT JOIN nation n ON n.n_name = 'NATION_' || c_nationkey AND n.n_regionkey > 2")
def join21(t: Tables) -> DataFrame:
    """By id where the right side has one, else by name."""
    right = t.nation.select(F.when(F.col("n_regionkey") < 2, F.col("n_nationkey")).alias("id"), F.when(F.col("n_regionkey") > 2, F.col("n_name")).alias("name"), "n_regionkey")
    left = t.customer.select("c_custkey", F.col("c_nationkey").alias("id"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name"))
    return rows.two_tier(left, right, ["id"], ["name"], ["n_regionkey"]).select("c_custkey", "found_by", "n_regionkey")


@query("join23_overrides", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size > 40 ELSE p_size % 2 = 0 END AS owned FROM part WHERE p_size <> 7")
def join23(t: Tables) -> DataFrame:
    """Flags that the user has set win over the catalog's; what the user removed is left out."""
    items = t.part.select("p_partkey", (F.col("p_size") % 2 == 0).alias("owned"))
    overrides = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size") > 40).alias("owned"), (F.col("p_size") == 7).alias("removed"))
    return collection.overridden(items, overrides, "p_partkey", ["owned"])


# Aggregates --------------------------------------------------------------------------------------------------------


@query("agg03_active_count", "SELECT count(*) AS active FROM orders WHERE o_orderstatus = 'O'")
def agg03(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("active"))


@query("agg07_pending", "SELECT o_custkey, count(*) AS pending, round(sum(o_totalprice), 2) AS amount FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def agg07(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("pending"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("agg10_price_per_piece", "SELECT p_brand, round(median(l_extendedprice / l_quantity) * 12 + 1e-9, 2) AS twelve FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1")
def agg10(t: Tables) -> DataFrame:
    x = t.lineitem.filter("l_quantity > 0").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("p_brand").agg(V.cents(F.median(F.col("l_extendedprice") / F.col("l_quantity")) * 12).alias("twelve"))


@query("agg16_counts_by_source", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'N') AS main, count(*) FILTER (l_returnflag <> 'N') AS extra FROM lineitem GROUP BY 1")
def agg16(t: Tables) -> DataFrame:
    main = F.col("l_returnflag") == "N"
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(main).alias("main"), F.count_if(~main).alias("extra"))


@query("agg18_coverage_rollup", "SELECT count(*) AS sources, count(*) FILTER (c_acctbal >= 0) AS complete, bool_and(c_acctbal >= 0) AS authoritative FROM customer")
def agg18(t: Tables) -> DataFrame:
    ok = F.col("c_acctbal") >= 0
    return t.customer.agg(F.count(F.lit(1)).alias("sources"), F.count_if(ok).alias("complete"), F.bool_and(ok).alias("authoritative"))


@query("agg19_worst_health", "SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 0 ELSE 1 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'ok' END AS health FROM events GROUP BY 1")
def agg19(t: Tables) -> DataFrame:
    """The worst of a source's states."""
    worst = F.max(F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 0).otherwise(1))
    return t.events.groupBy("user_id").agg(F.element_at(F.array(F.lit("ok"), F.lit("partial"), F.lit("failed")), worst + 1).alias("health"))


@query("agg22_union_of_matches", "SELECT o_custkey, o_orderpriority AS search, max(o_totalprice) AS confidence, count(*) AS members FROM orders GROUP BY ALL")
def agg22(t: Tables) -> DataFrame:
    """A cluster's matches: of each search the highest confidence of any member."""
    return t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("search")).agg(F.max("o_totalprice").alias("confidence"), F.count(F.lit(1)).alias("members"))


@query("agg27_progress", "SELECT p_brand, count(*) FILTER (p_size <> 7) AS total, count(*) FILTER (p_size <> 7 AND p_size > 25) AS owned, CASE WHEN count(*) FILTER (p_size <> 7) > 0 THEN round(100.0 * count(*) FILTER (p_size <> 7 AND p_size > 25) / count(*) FILTER (p_size <> 7))::INTEGER END AS percent FROM part GROUP BY 1")
def agg27(t: Tables) -> DataFrame:
    return collection.progress(t.part, ["p_brand"], F.col("p_size") > 25, F.col("p_size") != 7)


@query("agg33_group_summary", "SELECT p_brand, count(DISTINCT l_suppkey) AS results, count(*) FILTER (l_linestatus = 'O') AS active, max(l_shipdate) AS last_checked, count(*) FILTER (l_returnflag = 'R') AS errors FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg33(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("p_brand").agg(F.countDistinct("l_suppkey").alias("results"), F.count_if(F.col("l_linestatus") == "O").alias("active"), F.max("l_shipdate").cast("timestamp").alias("last_checked"), F.count_if(F.col("l_returnflag") == "R").alias("errors"))


@query("agg37_by_type", "SELECT p_type, p_brand, count(*) AS pieces FROM part GROUP BY ALL")
def agg37(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("pieces"))


# Order -------------------------------------------------------------------------------------------------------------


@query("srt02_score_confidence_seen", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_discount DESC, l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem")
def srt02(t: Tables) -> DataFrame:
    order = [F.col(c).desc() for c in ("l_quantity", "l_discount", "l_shipdate")] + [F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return placed(t.lineitem, ["l_suppkey"], *order).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "place")


@query("srt05_status_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS place FROM orders")
def srt05(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return placed(t.orders, ["o_custkey"], rank.asc(), F.col("o_orderdate").desc(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


@query("srt08_watch_closing_score", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority < '3' DESC, coalesce(CASE WHEN o_orderstatus <> 'P' THEN epoch(o_orderdate) END, 1e18), o_totalprice DESC, o_orderkey) AS place FROM orders")
def srt08(t: Tables) -> DataFrame:
    """Watched ones first, then by closing time with unknown ones last, then by score."""
    closing = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")), F.lit(1e18))
    return placed(t.orders, ["o_custkey"], (F.col("o_orderpriority") < "3").desc(), closing.asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()).select("o_orderkey", "place")


@query("srt13_name_and_year", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(nullif(p_size, 7), 9999), p_name, p_partkey) AS rising, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(nullif(p_size, 7), -1) DESC, p_name, p_partkey) AS falling FROM part")
def srt13(t: Tables) -> DataFrame:
    """Missing years come last in either direction."""
    year = F.nullif(F.col("p_size"), F.lit(7))
    x = placed(t.part, ["p_brand"], F.coalesce(year, F.lit(9999)).asc(), F.col("p_name").asc(), F.col("p_partkey").asc()).withColumnRenamed("place", "rising")
    return placed(x, ["p_brand"], F.coalesce(year, F.lit(-1)).desc(), F.col("p_name").asc(), F.col("p_partkey").asc()).select("p_partkey", "rising", F.col("place").alias("falling"))


@query("srt20_retirement", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def srt20(t: Tables) -> DataFrame:
    """The oldest candidates for retirement."""
    return t.orders.filter("o_orderstatus = 'F'").orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey")


@query("srt28_coverage_gaps", "SELECT c_mktsegment, count(*) AS uncovered FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def srt28(t: Tables) -> DataFrame:
    x = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("uncovered"))
    return x.orderBy(F.desc("uncovered"), "c_mktsegment")


# Values, filters, texts --------------------------------------------------------------------------------------------


@query("flt01_active_lot", "SELECT event_id, event_type NOT IN ('cancelado', 'cancelled', 'cerrado', 'closed', 'ended', 'finalizado', 'finished', 'inactive', 'inactivo', 'outofstock', 'sold', 'vendido') AS active FROM events")
def flt01(t: Tables) -> DataFrame:
    return t.events.select("event_id", match.is_active(F.concat(F.lit(" "), F.upper("event_type"))).alias("active"))


@query("flt07_snoozed", "SELECT o_orderkey, o_orderstatus = 'P' AND o_orderdate > TIMESTAMP '1996-01-01' AS snoozed FROM orders")
def flt07(t: Tables) -> DataFrame:
    decision = F.when(F.col("o_orderstatus") == "P", "snoozed")
    return t.orders.select("o_orderkey", feed.snooze_active(decision, F.col("o_orderdate").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")).alias("snoozed"))



@query("math04_safe_amount", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 2) END AS amount, NULL::DOUBLE AS from_text FROM supplier")
def math04(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", V.amount(F.col("s_acctbal").cast("string")).alias("amount"), V.amount(F.col("s_name")).alias("from_text"))


@query("math08_weight", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 4.5 ELSE 3.0 END::DOUBLE AS kg FROM part")
def math08(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", V.weight_estimate(F.lit("console"), F.when(F.col("p_size") > 25, "cib").otherwise("unknown")).alias("kg"))







@query("strf34_distinct_terms", "SELECT p_partkey, p_name || ',' || p_brand AS terms FROM part")
def strf34(t: Tables) -> DataFrame:
    """The first spelling of each term, whatever its case; blank ones go."""
    terms = F.array(F.concat(F.lit(" "), "p_name"), F.upper("p_name"), F.lit("  "), F.col("p_brand"), F.lower("p_brand"))
    return t.part.select("p_partkey", F.array_join(X.distinct_ci(terms, 24), ",").alias("terms"))


@query("strf36_query_text", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' new ' || p_brand ELSE p_name || ' ' || p_brand END AS q FROM part")
def strf36(t: Tables) -> DataFrame:
    terms = F.when(F.col("p_size") > 25, F.array(F.col("p_name"), F.lit("new"), F.lit("NEW"))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", X.query_text(terms, F.col("p_name"), F.col("p_brand")).alias("q"))


@query("strf41_lot_number", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size || 'b' ELSE '' END AS lot FROM part")
def strf41(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.lot_number(F.when(F.col("p_size") > 25, F.concat(F.lit("Lote N° "), F.col("p_size").cast("string"), F.lit("B: x"))).otherwise(F.col("p_name"))).alias("lot"))


@query("date03_parse_any", "SELECT o_orderkey, o_orderdate AS a, date_trunc('day', o_orderdate) AS b, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey) AS c, NULL::TIMESTAMP AS d FROM orders")
def date03(t: Tables) -> DataFrame:
    """Three formats, seconds and milliseconds since 1970, and what is neither."""
    at = F.col("o_orderdate").cast("timestamp")
    millis = ((1704067200 + F.col("o_orderkey")) * 1000).cast("string")
    return t.orders.select("o_orderkey", D.parse_any(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("a"), D.parse_any(F.date_format(at, "dd/MM/yyyy")).alias("b"), D.parse_any(millis).alias("c"), D.parse_any(F.lit("12")).alias("d"))


@query("date01_parse_iso", "SELECT o_orderkey, o_orderdate AS utc, o_orderdate + INTERVAL 3 HOUR AS local, NULL::TIMESTAMP AS bad FROM orders WHERE o_orderdate >= TIMESTAMP '1993-03-01'")
def date01(t: Tables) -> DataFrame:
    """A time without an offset is UTC in one reading and local in the other; 1993 on the local zone is three hours late."""
    iso = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    x = t.orders.filter("o_orderdate >= '1993-03-01'")
    return x.select("o_orderkey", D.parse_utc(F.concat(iso, F.lit("Z"))).alias("utc"), D.parse_local(iso).alias("local"), D.parse_utc(F.lit("soon")).alias("bad"))
