"""Recorded marketplaces and accessories on stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.operators import accessories
from lotwatch.plans.base import Tables, query
from lotwatch.plans.markets import LISTING, listings
from lotwatch.sources import recorded
from lotwatch.streaming.lifecycle import shared_folder

SPAN = 5000


def _answers(t: Tables) -> DataFrame:
    i, size = F.col("listing_id"), F.col("size")
    condition = F.when(size % 3 == 0, "new").when(size % 3 == 1, "used").otherwise("refurbished")
    return listings(t).select("listing_id", "title", "price", F.when(i % 7 == 0, "EUR").otherwise("USD").alias("currency"), condition.alias("condition"), F.when(size % 4 == 0, 0.0).otherwise(F.col("shipping")).alias("delivery_cost"), F.when(i % 5 > 0, i % 2 == 0).alias("returns_accepted"))


@query(
    "flt20_recorded_answers",
    f"""WITH {LISTING}, m AS (SELECT max(listing_id) AS last FROM l), w AS (SELECT last, greatest(1, last + {recorded.HEADROOM} - 20000 + 1) AS low, last + {recorded.HEADROOM} AS high FROM m)
    SELECT listing_id, title, price FROM l, w WHERE listing_id BETWEEN low AND high AND price <= 40000 AND listing_id % 7 > 0 AND size % 3 = 1 AND listing_id % 5 > 0 AND listing_id % 2 = 0 AND (contains(title, 'red') OR contains(title, 'plate'))""",
)
def flt20(t: Tables) -> DataFrame:
    """Listings recorded as answers and read back: a window of ids, a ceiling, a currency, a condition and returns at the source, words in Spark."""
    path = shared_folder(t.spark, "answers")
    answers = _answers(t)
    recorded.record(answers, path, SPAN)
    low, high = recorded.id_window(answers.agg(F.max("listing_id")).first()[0], window=20_000)
    found = recorded.recorded(t.spark, path, SPAN).filter((F.col("listing_id") >= low) & (F.col("listing_id") <= high) & (F.col("price") <= 40_000) & (F.col("currency") == "USD") & (F.col("condition") == "used") & (F.col("returns_accepted") == F.lit(True)))
    return found.filter(recorded.matches_query(F.col("title"), "Réd, plate")).select("listing_id", "title", "price")


@query(
    "flt20_browse_filter",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 4 > 0 THEN 'price:[..' || regexp_replace(printf('%.2f', p_retailprice), '\\.?0+$', '') || '],priceCurrency:' || CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END END,
      CASE WHEN p_size % 3 = 0 THEN 'conditions:{USED}' WHEN p_size % 3 = 1 THEN 'conditions:{CERTIFIED_REFURBISHED|SELLER_REFURBISHED}' END, CASE WHEN p_size % 5 = 0 THEN 'maxDeliveryCost:0' END, CASE WHEN p_size % 6 = 0 THEN 'returnsAccepted:true' END) AS filter FROM part""",
)
def flt20_browse(t: Tables) -> DataFrame:
    n = F.col("p_size")
    criteria = {"max_item": F.when(n % 4 > 0, F.col("p_retailprice")), "currency": F.when(n % 2 == 0, " eur"), "condition": F.when(n % 3 == 0, "Used").when(n % 3 == 1, "refurbished").otherwise("any"), "free_shipping": n % 5 == 0, "returns_required": n % 6 == 0}
    return t.part.select("p_partkey", recorded.browse_filter(criteria).alias("filter"))


_ACCESSORIES = """
WITH RECURSIVE p AS (SELECT p_brand AS brand, p_partkey AS k, p_size AS n, p_name || ' ' || p_size AS name, p_name || ' ' || (p_size - 20) || ' usado' AS entry FROM part),
base AS (SELECT * FROM p WHERE n <= 25), manual AS (SELECT * FROM p WHERE n > 40), old AS (SELECT brand, k AS e, entry, row_number() OVER (PARTITION BY brand ORDER BY k) AS nth FROM p WHERE n BETWEEN 26 AND 40),
kept AS (SELECT brand, k, n, CASE WHEN k % 2 = 0 THEN 'p' || k ELSE 'q' || k END AS id, name, k % 4 = 0 AS owned FROM base WHERE k % 3 = 0),
by_name AS (SELECT brand, name, max(k) AS k FROM kept GROUP BY brand, name),
found AS (SELECT b.*, 'p' || b.k AS id, i.k AS ik, m.k AS mk FROM base b LEFT JOIN kept i ON i.brand = b.brand AND i.id = 'p' || b.k LEFT JOIN by_name m ON m.brand = b.brand AND m.name = b.name),
free AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY k) AS row FROM found WHERE ik IS NULL AND mk IS NULL),
cand AS (SELECT f.brand, f.row, list(e ORDER BY e) AS es FROM free f JOIN old o ON o.brand = f.brand AND (contains(o.entry, f.name) OR contains(f.name, o.entry) OR contains(o.entry, f.id)) GROUP BY ALL),
walk AS (SELECT brand, 0::BIGINT AS row, []::BIGINT[] AS taken, NULL::BIGINT AS e FROM (SELECT DISTINCT brand FROM free) UNION ALL
  SELECT brand, row, CASE WHEN e IS NULL THEN taken ELSE list_append(taken, e) END, e FROM (SELECT f.brand, f.row, w.taken, list_filter(coalesce(c.es, []), lambda y: NOT list_contains(w.taken, y))[1] AS e FROM walk w JOIN free f ON f.brand = w.brand AND f.row = w.row + 1 LEFT JOIN cand c ON c.brand = f.brand AND c.row = f.row)),
taken AS (SELECT f.brand, f.k, o.e, greatest(1, regexp_extract(o.entry, '(\\d+)', 1)::INTEGER) AS quantity FROM walk w JOIN free f ON f.brand = w.brand AND f.row = w.row JOIN old o ON o.brand = w.brand AND o.e = w.e),
every AS (
  SELECT f.brand, CASE WHEN ik IS NOT NULL THEN f.id WHEN mk IS NOT NULL THEN CASE WHEN mk % 2 = 0 THEN 'p' || mk ELSE 'q' || mk END ELSE f.id END AS id, CASE WHEN coalesce(ik, mk) IS NOT NULL THEN coalesce(ik, mk) % 4 = 0 ELSE t.e IS NOT NULL END AS owned,
    CASE WHEN ik IS NOT NULL THEN f.n WHEN mk IS NOT NULL THEN f.n ELSE coalesce(t.quantity, 0) END AS quantity, CASE WHEN ik IS NOT NULL THEN 'id' WHEN mk IS NOT NULL THEN 'name' WHEN t.e IS NOT NULL THEN 'legacy' END AS found_by, 'catalog' AS origin, 0 AS part, f.k AS place
  FROM found f LEFT JOIN taken t ON t.brand = f.brand AND t.k = f.k
  UNION ALL SELECT brand, 'm' || k, true, 2, NULL, 'manual', 1, k FROM manual
  UNION ALL SELECT brand, 'legacy-' || replace(entry, ' ', '-'), true, greatest(1, regexp_extract(entry, '(\\d+)', 1)::INTEGER), NULL, 'legacy', 2, 900 + 10 * (row_number() OVER (PARTITION BY brand ORDER BY o.e) - 1) FROM old o WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.brand = o.brand AND t.e = o.e))
SELECT brand, id, owned, quantity, found_by, origin, row_number() OVER (PARTITION BY brand ORDER BY owned DESC, part, place, id)::INTEGER AS place FROM every
"""


@query("join31_accessories", _ACCESSORIES)
def join31(t: Tables) -> DataFrame:
    """Parts of each brand as its accessories: small ones listed, a third of them kept, large ones hand-made, the rest old entries."""
    k, n = F.col("p_partkey"), F.col("p_size")
    p = t.part.select(F.col("p_brand").alias("brand"), k.alias("k"), n.alias("n"), F.concat_ws(" ", "p_name", n).alias("name"), F.concat_ws(" ", "p_name", (n - 20).cast("string"), F.lit("Usado")).alias("entry"))
    prefixed = lambda c: F.concat(F.lit(c), F.col("k").cast("string"))
    base = p.filter("n <= 25").select("brand", prefixed("p").alias("id"), F.upper("name").alias("name"), F.lit("").alias("image"), F.col("k").alias("place"))
    own = p.filter("n <= 25 AND k % 3 = 0").select("brand", F.when(F.col("k") % 2 == 0, prefixed("p")).otherwise(prefixed("q")).alias("id"), "name", F.lit("").alias("image"), (F.col("k") % 4 == 0).alias("owned"), F.col("n").alias("quantity"), F.lit("").alias("notes"), F.lit("catalog").alias("source"), F.col("k").alias("place"))
    made = p.filter("n > 40").select("brand", prefixed("m").alias("id"), F.concat(F.lit("extra "), F.col("k").cast("string")).alias("name"), F.lit("").alias("image"), F.lit(True).alias("owned"), F.lit(2).alias("quantity"), F.lit("").alias("notes"), F.lit("manual").alias("source"), F.col("k").alias("place"))
    old = p.filter("n BETWEEN 26 AND 40").select("brand", "entry", F.col("k").alias("place"))
    return accessories.reconciled(base, own.unionByName(made), old, ["brand"]).select("brand", "id", "owned", "quantity", "found_by", "origin", "place")
