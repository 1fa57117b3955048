"""Verdicts on the stand-in listings: what is known of each is made from the digits of its id and its part's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions import money as V
from lotwatch.operators import lifecycle, valuation
from lotwatch.plans.base import Tables, query
from lotwatch.plans.markets import LISTING, listings
from lotwatch.plans.runs import NOW, now

_BAND = "CASE WHEN ratio <= 0.75 THEN 'ganga' WHEN ratio <= 0.9 THEN 'buena' WHEN ratio <= 1.1 THEN 'razonable' WHEN ratio <= 1.3 THEN 'premium' ELSE 'caro' END"
#: The same in SQL as _known() makes in Spark.
KNOWN = f"""{LISTING}, k AS (SELECT *, listing_id AS i, price / (1000.0 + 900.0 * size) AS ratio FROM l),
a AS (SELECT *, {_BAND} AS price_band, i % 10 / 10.0 AS sure, CASE WHEN size % 3 = 0 THEN 'console' ELSE 'game' END AS item, CASE WHEN flag = 'R' THEN ['', 'unknown', 'suspect', 'copy'][1 + i % 4] ELSE 'declared' END AS auth,
  size % 2 = 0 AS original, source_id % 5 = 0 AS lot, i % 3 = 0 AS sized, CASE WHEN size % 3 = 0 THEN ['ready', 'cib', 'missing', 'damaged', 'console-only', 'undeclared'][1 + i % 6] END AS kit,
  flag = 'A' AND i % 7 = 0 AS untested, status = 'F' AS read, i % 8 AS defect, i % 9 = 0 AS lacking, CASE i % 5 WHEN 0 THEN false WHEN 1 THEN true END AS takes_back, i % 6 AS images,
  CASE i % 11 WHEN 0 THEN 'declared' WHEN 1 THEN 'incomplete' ELSE '' END AS objective, ['ebay-sold', 'peer-listings', 'manual', 'editorial'][1 + source_id % 4] AS mark,
  CASE WHEN size % 7 = 0 THEN '' ELSE '2026-01-01' END AS observed, CASE WHEN size % 5 <> 1 THEN size % 6 <> 0 END AS independent, size % 13 = 0 AS stale, CASE WHEN size % 5 <> 2 THEN size % 17 <> 0 END AS comparable, i % 4 <> 0 AS shipped, i % 3 = 0 AS available FROM k),
b AS (SELECT *, list_distinct(list_filter([CASE WHEN sure < 0.6 OR (item = 'console' AND ratio > 0 AND ratio < 0.3) THEN 'identity' END, CASE WHEN auth IN ('unknown', 'suspect', 'copy') THEN 'authenticity' END,
    CASE WHEN kit NOT IN ('cib', 'ready') THEN 'completeness' END, CASE WHEN kit = 'damaged' OR untested OR defect IN (1, 2) THEN 'condition' END, CASE WHEN NOT read THEN 'details' END, CASE WHEN defect = 3 THEN 'cosmetic' END,
    CASE WHEN defect = 4 THEN 'originality-accessory' END, CASE WHEN lacking THEN 'missing-pieces' END, CASE WHEN lacking AND kit IN ('ready', 'cib') THEN 'contradiction' END, CASE WHEN NOT takes_back THEN 'returns' END,
    CASE WHEN images < 3 THEN 'photos' END, CASE WHEN objective <> '' THEN 'contents' END, CASE WHEN lot AND NOT sized THEN 'lot-quantity' END, CASE WHEN mark = 'peer-listings' OR NOT independent OR stale THEN 'benchmark' END,
    CASE WHEN NOT shipped THEN 'shipping' END, CASE WHEN NOT available THEN 'availability' END], lambda x: x IS NOT NULL)) AS blocks,
  list_filter([CASE WHEN auth = 'suspect' THEN 'authenticity-suspect' END, CASE WHEN auth = 'unknown' AND original AND NOT lot THEN 'authenticity-unknown' END, CASE WHEN auth = 'copy' THEN 'copy' END, CASE WHEN kit = 'damaged' THEN 'damage' END,
    CASE WHEN defect = 1 THEN 'functional-defect' END, CASE WHEN objective = 'declared' THEN 'cib-unverified' END], lambda x: x IS NOT NULL) AS review,
  CASE auth WHEN 'suspect' THEN 25 WHEN 'copy' THEN 25 WHEN 'unknown' THEN CASE WHEN original AND NOT lot THEN 4 ELSE 0 END ELSE 0 END + CASE WHEN kit = 'damaged' THEN 10 ELSE 0 END + CASE defect WHEN 1 THEN 12 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END
    + CASE WHEN NOT takes_back THEN 3 ELSE 0 END + CASE WHEN lot AND NOT sized THEN 15 ELSE 0 END + CASE WHEN lacking AND kit IS NOT NULL THEN CASE WHEN kit = 'console-only' THEN 6 ELSE 4 END ELSE 0 END AS penalty,
  CASE WHEN lot AND NOT sized THEN 'unconfirmed-quantity' WHEN objective = 'incomplete' THEN 'incomplete' ELSE 'primary' END AS section FROM a),
g AS (SELECT *, CASE WHEN section <> 'primary' THEN 'sin-referencia' WHEN price_band IN ('ganga', 'buena') AND list_has_any(blocks, ['condition', 'cosmetic', 'originality-accessory', 'returns', 'contradiction', 'notice', 'photos']) THEN 'razonable'
    WHEN price_band = 'ganga' AND len(blocks) > 0 THEN 'buena' ELSE price_band END AS gated FROM b),
v AS (SELECT *, CASE WHEN len(review) > 0 AND section = 'primary' AND gated IN ('ganga', 'buena', 'razonable') THEN 'revisar' ELSE gated END AS band FROM g)"""


def _known(t: Tables) -> DataFrame:
    """Listings with `a`, what is known of them, and columns that later rules look at."""
    i, size, flag = F.col("listing_id"), F.col("size"), F.col("flag")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (1 + at).cast("int"))
    none = F.array().cast(valuation.DEFECTS)
    defect = lambda severity, piece="": F.array(F.struct(F.lit(severity).alias("label"), F.lit(severity).alias("severity"), F.lit(piece).alias("piece")))
    defects = F.when(i % 8 == 1, defect("functional")).when(i % 8 == 2, defect("functional", "controller")).when(i % 8 == 3, defect("cosmetic")).when(i % 8 == 4, defect("generic")).otherwise(none)
    ratio = F.col("price") / (1000.0 + 900.0 * size)
    benchmark = F.struct(
        pick(("ebay-sold", "peer-listings", "manual", "editorial"), F.col("source_id") % 4).alias("source"), F.when(size % 7 == 0, "").otherwise("2026-01-01").alias("observed_at"),
        F.when(size % 5 != 1, size % 6 != 0).alias("independent"), (size % 13 == 0).alias("stale"), F.when(size % 5 != 2, size % 17 != 0).alias("comparable"),
    )
    lacking = i % 9 == 0
    a = valuation.assessed(
        band=V.decision_band(ratio), ratio=ratio, match_confidence=i % 10 / 10.0, item_kind=F.when(size % 3 == 0, "console").otherwise("game"), authenticity=F.when(flag == "R", pick(("", "unknown", "suspect", "copy"), i % 4)).otherwise("declared"),
        original_required=size % 2 == 0, is_lot=F.col("source_id") % 5 == 0, lot_quantity=F.when(i % 3 == 0, "confirmed").otherwise("declared"),
        kit_status=F.when(size % 3 == 0, pick(("ready", "cib", "missing", "damaged", "console-only", "undeclared"), i % 6)), untested=(flag == "A") & (i % 7 == 0), details_expected=F.lit(True), evidence_read=F.col("status") == "F",
        defects=defects, missing=F.when(lacking, F.array(F.lit("cables"))), returns_accepted=F.when(i % 5 == 0, False).when(i % 5 == 1, True), images=i % 6, incomplete=lacking,
        objective_status=F.when(i % 11 == 0, "declared").when(i % 11 == 1, "incomplete").otherwise(""), benchmark=benchmark, shipping_known=i % 4 != 0, availability_verified=i % 3 == 0,
    )
    return listings(t).select("*", a.alias("a"))


def _judged(t: Tables) -> DataFrame:
    return _known(t).withColumn("v", valuation.gates(F.col("a")))


@query("val05_gates", f"WITH {KNOWN} SELECT listing_id, section, price_band, gated AS gated_band, band, array_to_string(list_sort(blocks), ',') AS blockers, array_to_string(review, ',') AS review_keys, penalty FROM v")
def val05(t: Tables) -> DataFrame:
    v = F.col("v")
    keys = F.array_join(F.array_sort(F.transform(v["blockers"], lambda b: b["key"])), ",")
    return _judged(t).select("listing_id", *[v[c].alias(c) for c in ("section", "price_band", "gated_band", "band")], keys.alias("blockers"), F.array_join(v["review_keys"], ",").alias("review_keys"), v["penalty"].alias("penalty"))


@query(
    "val06_effective_band",
    f"""WITH {KNOWN}, e AS (SELECT *, i % 2 = 0 AS seen, i % 4 < 2 AS confirmed FROM v),
    o AS (SELECT *, CASE WHEN seen AND band = 'revisar' AND list_has_all(['cib-unverified'], review) THEN gated ELSE band END AS own, CASE WHEN seen THEN list_filter(blocks, lambda x: x <> 'contents') ELSE blocks END AS keys FROM e)
    SELECT listing_id, CASE WHEN own = 'buena' AND confirmed AND price_band = 'ganga' AND list_has_all(['availability'], keys) THEN 'ganga' ELSE own END AS band FROM o""",
)
def val06(t: Tables) -> DataFrame:
    i = F.col("listing_id")
    return _judged(t).select("listing_id", valuation.effective_band(F.col("v.band"), F.col("v"), i % 4 < 2, i % 2 == 0).alias("band"))


_RELIABLE = "(mark IN ('ebay-sold', 'pricecharting', 'retail', 'manual') AND observed <> '' AND coalesce(independent, true) AND NOT stale AND coalesce(comparable, true))"


@query("val07_reliability", f"WITH {KNOWN} SELECT listing_id, {_RELIABLE} AS reliable FROM v")
def val07(t: Tables) -> DataFrame:
    return _known(t).select("listing_id", valuation.benchmark_reliable(F.col("a.benchmark")).alias("reliable"))


_CLEAR = f"""(len(list_filter(blocks, lambda x: NOT (x = 'benchmark' AND fell))) = 0 AND section = 'primary' AND band NOT IN ('revisar', 'sin-referencia') AND len(review) = 0 AND read AND shipped AND (fell OR {_RELIABLE}))"""


@query(
    "val08_alert_reasons",
    f"""WITH {KNOWN}, f AS (SELECT *, i % 16 = 5 AS fell FROM v)
    SELECT listing_id, {_CLEAR} AS clear, (section <> 'primary')::INTEGER + (band IN ('revisar', 'sin-referencia'))::INTEGER + (len(review) > 0)::INTEGER + len(list_filter(blocks, lambda x: NOT (x = 'benchmark' AND fell))) + (NOT read)::INTEGER + (NOT shipped)::INTEGER + (NOT fell AND NOT {_RELIABLE})::INTEGER AS reasons FROM f""",
)
def val08(t: Tables) -> DataFrame:
    a = F.col("a")
    why = valuation.alert_clearance(F.col("v"), F.lit(None), a["benchmark"], a["evidence_read"], a["shipping_known"], F.col("listing_id") % 16 == 5)
    return _judged(t).select("listing_id", F.size(why).alias("reasons")).select("listing_id", (F.col("reasons") == 0).alias("clear"), "reasons")


@query(
    "val09_exceptional",
    f"""WITH {KNOWN}, f AS (SELECT *, i % 16 = 5 AS fell, ['wishlist', 'manual', 'console', 'recommendation'][1 + source_id % 4] AS intent FROM v)
    SELECT listing_id FROM f WHERE intent IN ('wishlist', 'console') AND {_CLEAR} AND (fell OR (i % 7 = 0 AND i % 2 = 0) OR (ratio > 0 AND ratio <= 0.55))""",
)
def val09(t: Tables) -> DataFrame:
    """Listings that may interrupt: the fail-closed gates leave few of them."""
    a, i = F.col("a"), F.col("listing_id")
    intent = F.element_at(F.array(*map(F.lit, ("wishlist", "manual", "console", "recommendation"))), (1 + F.col("source_id") % 4).cast("int"))
    drop = F.when(i % 16 == 5, 0.25).when(i % 16 == 6, 0.1)
    keep = valuation.is_exceptional(F.col("v"), F.lit(None), a["benchmark"], a["evidence_read"], a["shipping_known"], F.array(intent), a["ratio"], i % 7 == 0, i % 2 == 0, F.lit(True), drop)
    return _judged(t).filter(keep).select("listing_id")


@query("math14_target", f"WITH {KNOWN}, c AS (SELECT i, size % 5 AS z, price, CASE WHEN size % 3 > 0 THEN price + 100 END AS cost, shipped, 900.0 * size AS goal FROM v) SELECT i AS listing_id, CASE WHEN z = 0 THEN NULL WHEN shipped AND cost IS NOT NULL THEN cost <= goal WHEN coalesce(cost, price) > goal THEN false END AS meets FROM c")
def math14(t: Tables) -> DataFrame:
    size, price = F.col("size"), F.col("price")
    return listings(t).select("listing_id", V.meets_target(price, F.when(size % 3 > 0, price + 100), F.when(size % 5 != 0, 900.0 * size), F.col("listing_id") % 4 != 0).alias("meets"))


@query(
    "math15_query_ceiling",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 3 > 0 THEN p_retailprice END ELSE least(CASE WHEN p_size % 5 = 0 THEN 30.0 * p_size WHEN p_size % 3 = 0 THEN greatest(30.0, 45.0) * p_size WHEN p_size % 2 = 0 THEN 45.0 * p_size ELSE 30.0 * p_size END,
      CASE WHEN p_size % 3 > 0 THEN p_retailprice END) END AS ceiling FROM part""",
)
def math15(t: Tables) -> DataFrame:
    """Parts with and without a general ceiling, a loose one, a boxed one and a declared completeness."""
    n = F.col("p_size")
    shape = F.when(n % 3 == 0, None).when(n % 2 == 0, "boxed").otherwise("loose")
    return t.part.select("p_partkey", V.query_ceiling(F.when(n % 3 > 0, F.col("p_retailprice")), F.when(n % 4 != 0, 30.0 * n), F.when(n % 5 != 0, 45.0 * n), shape).alias("ceiling"))


@query(
    "str09_notices",
    """WITH p AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NOT NULL AS noticed FROM events)
    SELECT event_id, CASE WHEN NOT noticed THEN 'new' WHEN value + 2 <= 20 AND before > 20 THEN 'crossed' ELSE 'fell' END AS reason FROM p
    WHERE NOT noticed OR (before > 0 AND value IS NOT NULL AND ((value + 2 <= 20 AND before > 20) OR (value < before AND (before - value) / before >= 0.08)))""",
)
def str09(t: Tables) -> DataFrame:
    """Values of an event type as prices: the target is 20 and 2 more are what the piece costs in the end."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    x = t.events.withColumn("before", F.lag("value").over(w)).withColumn("noticed", F.lag("event_id").over(w).isNotNull())
    why = valuation.notice_reason(F.col("noticed"), F.col("before"), F.col("value"), F.lit(20.0), F.col("value") + 2 <= 20)
    kind = F.when(why == "nueva", "new").when(why.startswith("cruzó"), "crossed").otherwise("fell")
    return x.filter(why != "").select("event_id", kind.alias("reason"))


@query(
    "math11_completion_cost",
    """SELECT p_partkey, CASE WHEN p_size <= 5 THEN NULL ELSE CASE WHEN p_size > 25 THEN 'cables,controller' WHEN p_size > 10 THEN 'cables' ELSE '' END END AS pieces, CASE WHEN p_size > 25 OR p_size <= 5 THEN CASE WHEN p_size > 25 THEN '' END ELSE 'controller' END AS replaced,
      CASE WHEN p_size > 25 THEN 35.0 WHEN p_size > 10 THEN 35.0 WHEN p_size > 5 THEN 20.0 END::DOUBLE AS total FROM part""",
)
def math11(t: Tables) -> DataFrame:
    """Missing by the title, by the page (whose power supply comes with the cables), and a broken controller."""
    n, none = F.col("p_size"), F.array().cast("array<string>")
    missing = F.when(n > 25, F.array(F.lit("cables"), F.lit("controller"), F.lit("box"))).when(n > 10, F.array(F.lit("cables"))).otherwise(none)
    described = F.when(n > 10, F.array(F.lit("power-supply"), F.lit("cables"))).otherwise(none)
    broken = F.struct(F.lit("stick").alias("label"), F.lit("functional").alias("severity"), F.lit("controller").alias("piece"))
    c = valuation.completion(missing, described, F.when(n > 5, F.array(broken, broken)))
    return t.part.select("p_partkey", c.alias("c")).select("p_partkey", F.array_join("c.pieces", ",").alias("pieces"), F.array_join("c.replaced", ",").alias("replaced"), "c.total")


@query(
    "val03_total_score",
    f"""WITH {KNOWN}, s AS (SELECT *, round_even(25.0 * sure, 0)::INTEGER AS p1, round_even(25 * greatest(0.0, least(1.0, (1.30 - ratio) / 0.55)), 0)::INTEGER AS p2, i % 13 < 4 AS tested FROM v),
    d AS (SELECT *, round_even(15 * CASE WHEN defect = 1 THEN 0.1 WHEN tested AND defect IN (1, 2, 3) THEN 0.6 WHEN tested THEN 1.0 WHEN untested THEN 0.15 ELSE 0.4 END, 0)::INTEGER AS p3,
      round_even(15 * CASE kit WHEN 'cib' THEN 1.0 WHEN 'ready' THEN 1.0 WHEN 'undeclared' THEN 0.4 WHEN 'missing' THEN 0.3 WHEN 'console-only' THEN 0.2 WHEN 'damaged' THEN 0.1 ELSE CASE WHEN size % 2 = 0 THEN 1.0 ELSE 0.45 END END, 0)::INTEGER AS p4,
      round_even(10 * CASE WHEN takes_back THEN 1.0 WHEN NOT takes_back THEN 0.4 ELSE 0.7 END, 0)::INTEGER AS p5, CASE WHEN shipping > 0.4 * price THEN 2 ELSE 10 END AS p6 FROM s)
    SELECT listing_id, p1 AS collection, p2 AS price, p3 AS condition, p4 AS completeness, p5 AS seller, p6 AS logistics,
      greatest(0, least(100, p1 + p2 + p3 + p4 + p5 + p6 - CASE WHEN NOT independent THEN 6 ELSE 0 END - CASE WHEN stale THEN 5 ELSE 0 END - CASE WHEN untested AND NOT tested AND defect <> 1 THEN 10 ELSE 0 END - 3 * (i % 2) - penalty)) AS score FROM d""",
)
def val03(t: Tables) -> DataFrame:
    """The six dimensions and the score; every seller is known, shipping is the stand-in's."""
    a, i = F.col("a"), F.col("listing_id")
    s = valuation.score(
        a["ratio"], a["benchmark"], a["match_confidence"], i % 13 < 4, a["untested"], a["defects"], a["kit_status"], F.col("size") % 2 == 0, F.lit(True), a["returns_accepted"], a["returns_refused"], F.col("price"), F.col("shipping"), i % 2, F.col("v.penalty"),
    )
    return _judged(t).select("listing_id", s.alias("s")).select("listing_id", *[f"s.{c}" for c in ("collection", "price", "condition", "completeness", "seller", "logistics")], F.col("s.score").cast("int").alias("score"))


_AGE = f"epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)"


@query(
    "str10_verification",
    f"""WITH x AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority < '3' AS changed, {_AGE} AS age, o_orderkey % 4 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k = 0 THEN 'ended' WHEN s <> 'P' AND age < 86400 * 700 AND NOT changed THEN 'verified' WHEN s <> 'P' THEN 'expired' WHEN k = 1 THEN 'available' ELSE 'pending' END AS state, CASE WHEN k = 0 OR s = 'P' THEN '' WHEN changed THEN 'price-changed' WHEN age >= 86400 * 700 THEN 'stale' ELSE '' END AS reason FROM x""",
)
def str10(t: Tables) -> DataFrame:
    """Orders as verified listings: one in four has ended, for one in four the source itself says that it can be bought."""
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    verified = F.when(F.col("o_orderstatus") != "P", at)
    changed = F.when(F.col("o_orderpriority") < "3", at + F.expr("INTERVAL 1 HOUR"))
    v = lifecycle.verification_state(F.when(k == 0, "ended").otherwise("available"), k == 2, k != 3, verified, changed, now(), 24 * 700)
    return t.orders.select("o_orderkey", v.alias("v")).select("o_orderkey", "v.*")


@query("str11_detail_fresh", f"SELECT o_orderkey, {_AGE} < 24 * 3600 * 900 AND o_totalprice = CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS fresh FROM orders")
def str11(t: Tables) -> DataFrame:
    """Cached pages by age, and by the price that they were read at."""
    cached = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return t.orders.select("o_orderkey", lifecycle.detail_usable(F.col("o_orderdate").cast("timestamp"), cached, F.col("o_totalprice"), now(), 24 * 900).alias("fresh"))


@query("flt18_usable_references", f"WITH {KNOWN} SELECT listing_id FROM v WHERE size % 4 = 3 OR sure < 0.6 OR item = CASE size % 4 WHEN 0 THEN 'console' WHEN 1 THEN 'game' ELSE 'accessory' END OR mark = 'peer-listings'")
def flt18(t: Tables) -> DataFrame:
    """Listings whose search's reference may be used: no entity, an unsure kind, the entity's own kind, or one of peers."""
    a, n = F.col("a"), F.col("size") % 4
    entity: Column = F.when(n == 0, "console").when(n == 1, "game").when(n == 2, "accessory").otherwise("")
    return _known(t).filter(valuation.usable_reference(a["benchmark"]["source"], entity, a["item_kind"], a["match_confidence"] >= 0.6)).select("listing_id")


@query(
    "agg20_run_status",
    """WITH s AS (SELECT o_orderdate::DATE::VARCHAR AS day, ['first', 'second', 'others'][1 + o_custkey % 3] AS source, CASE o_orderstatus WHEN 'P' THEN 'failed' WHEN 'O' THEN 'partial' ELSE 'success' END AS status, o_orderkey % 2 = 0 AS inventory, o_orderkey % 4 > 0 AS proven FROM orders),
    p AS (SELECT day, source, bool_or(status = 'failed') AS failed, bool_or(status = 'partial' OR (status = 'success' AND inventory AND NOT proven)) AS doubt FROM s GROUP BY day, source)
    SELECT day, CASE WHEN bool_and(failed) THEN 'failure' WHEN bool_or(failed) OR bool_or(doubt) THEN 'partial_failure' ELSE 'success' END AS status FROM p GROUP BY day""",
)
def agg20(t: Tables) -> DataFrame:
    """Days as runs, orders as their steps by source: an inventory without proof makes a run partial."""
    names = ("first", "second", "others")
    source = F.element_at(F.array(*map(F.lit, names)), (1 + F.col("o_custkey") % 3).cast("int"))
    status = F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "O", "partial").otherwise("success")
    step = F.struct(source.alias("source"), status.alias("status"), (F.col("o_orderkey") % 2 == 0).alias("inventory"), (F.col("o_orderkey") % 4 > 0).alias("authoritative"))
    # A run has a few distinct steps, however many orders there are.
    runs = t.orders.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.collect_set(step).alias("steps"))
    return runs.select("day", valuation.overall_status(F.col("steps"), names).alias("status"))
