"""Registries and runs on stand-ins: nations as sources, suppliers and customers as their lots, months as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.operators import registry_runs as R
from lotwatch.plans.base import Tables, query
from lotwatch.plans.texts import FRANCHISES, GENERIC, POSITIVES, RISKS, STRONG, TERMS

# A nation's report by its key: none for 5 and 11, else by the remainder of 4.
_REPORTED = "n_nationkey NOT IN (5, 11)"


@query(
    "set06_registry",
    f"""WITH p AS (SELECT c_nationkey AS source, c_custkey AS lot, c_acctbal AS price FROM customer WHERE c_custkey % 3 > 0), c AS (SELECT c_nationkey AS source, c_custkey AS lot, c_acctbal + 1 AS price FROM customer WHERE c_custkey % 2 = 0),
    s AS (SELECT n_nationkey AS source, n_nationkey % 4 = 0 AS sure FROM nation WHERE {_REPORTED})
    SELECT source, lot, coalesce(c.price, p.price) AS price, CASE WHEN c.lot IS NOT NULL THEN 'current' ELSE 'previous' END AS origin FROM p FULL JOIN c USING (source, lot) LEFT JOIN s USING (source) WHERE c.lot IS NOT NULL OR NOT coalesce(sure, true)""",
)
def set06(t: Tables) -> DataFrame:
    """Nations as registered sources, customers as their lots; a report leaves two nations out."""
    lots = t.customer.select(F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("lot"), F.col("c_acctbal").alias("price"))
    n = F.col("n_nationkey")
    told = t.nation.filter(~n.isin(5, 11)).select(n.alias("source"), F.when(n % 4 < 2, "Success").otherwise("partial").alias("status"), (n % 2 == 0).alias("authoritative"), n.alias("lot"))
    found = R.reconciled_registry(lots.filter("lot % 3 > 0").withColumn("at", F.lit(0)), lots.filter("lot % 2 = 0").withColumn("price", F.col("price") + 1).withColumn("at", F.lit(1)), told.withColumn("at", F.lit(0)), "source", "lot", "at")
    return found.select("source", "lot", "price", "origin")


_HITS = "list_filter([{}], lambda k: regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || replace(k, ' ', '\\s+') || '([^\\p{{L}}\\p{{N}}_]|$)'))".format(", ".join(f"'{x}'" for x in TERMS))
_FLAGS = lambda terms: f"list_filter([{', '.join(repr(x) for x in terms)}], lambda k: contains(t, k))"
_ANY = lambda terms: f"list_has_any(hits, [{', '.join(repr(x) for x in terms)}])"


@query(
    "set07_rescored",
    f"""WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 9 = 0 THEN '' ELSE trim(regexp_replace(strip_accents(lower(text)), '[ \\t\\n\\r\\f]+', ' ', 'g')) END AS t FROM documents),
    h AS (SELECT *, CASE WHEN t = '' THEN NULL ELSE {_HITS} END AS hits, {_FLAGS(RISKS)} AS risks, {_FLAGS(POSITIVES)} AS merits FROM d)
    SELECT doc_id, CASE WHEN t = '' THEN 'old' ELSE array_to_string(hits, ', ') END AS matched_keywords, CASE WHEN t = '' THEN 7 ELSE (6 * len(hits) + CASE WHEN {_ANY(STRONG)} THEN 12 ELSE 0 END + CASE WHEN {_ANY(FRANCHISES)} THEN 8 ELSE 0 END + CASE WHEN {_ANY(GENERIC)} THEN 4 ELSE 0 END
      + CASE WHEN n_chars > 2000 THEN 2 ELSE 0 END + least(2 * len(merits), 6) - 8 * len(risks)) END::INTEGER AS score FROM h WHERE t = '' OR len(hits) > 0""",
)
def set07(t: Tables) -> DataFrame:
    """Documents as cached rows, judged by another dictionary than they were found with; some have no description."""
    rows = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text")).alias("description"), F.when(F.col("n_chars") > 2000, 1.0).alias("value"), F.lit(0).alias("bids"), F.lit("old").alias("matched_keywords"), F.lit("").alias("risk_flags"), F.lit("").alias("positive_flags"), F.lit(7).alias("score")
    )
    found = R.rescored(rows, "description", "value", "bids", TERMS, (), RISKS, POSITIVES, strong=STRONG, franchises=FRANCHISES, generic=GENERIC)
    return found.select("doc_id", "matched_keywords", "score")


@query(
    "src38_cached_rows",
    """WITH r AS (SELECT o_orderkey, o_custkey, date_trunc('month', o_orderdate) AS run FROM orders), p AS (SELECT DISTINCT run, o_custkey FROM r UNION SELECT date_trunc('month', max(o_orderdate)), c_custkey FROM orders, customer WHERE c_custkey % 10 = 0 GROUP BY c_custkey),
    w AS (SELECT o_custkey, max(run) AS run FROM p WHERE o_custkey % 4 > 0 AND run < TIMESTAMP '2000-01-01' GROUP BY o_custkey) SELECT o_orderkey, r.o_custkey, r.run FROM r JOIN w USING (o_custkey, run)""",
)
def src38(t: Tables) -> DataFrame:
    """Months as runs: a pending customer's orders of the last month before 2000 that looked at the customer."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    rows = t.orders.select("o_orderkey", "o_custkey", month.alias("run"))
    last = t.orders.agg(F.max(month).alias("run"))
    empty = t.customer.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey")).crossJoin(F.broadcast(last)).select("run", "o_custkey")  # one row on the other side
    processed = rows.select("run", "o_custkey").union(empty).distinct().withColumn("at", F.col("run")).filter(F.col("run") < F.lit("2000-01-01").cast("timestamp"))
    pending = t.customer.filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.cached_rows(rows, processed, pending, "o_custkey", "run", "at").select("o_orderkey", "o_custkey", "run")


_RECEIPTS = "SELECT s_nationkey AS source, c_custkey AS grp, CASE WHEN c_custkey % 13 = 0 THEN 'partial' ELSE 'complete' END AS status, c_custkey % 17 = 0 AS cut, c_custkey % 19 = 0 AS bad, c_custkey % 5 AS lots FROM customer JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = c_nationkey WHERE c_custkey % 23 > 0"


@query(
    "agg17_proven_coverage",
    f"""WITH r AS ({_RECEIPTS}), e AS (SELECT c_nationkey AS source, c_custkey AS grp FROM customer WHERE c_custkey % 29 > 0), n AS (SELECT DISTINCT s_nationkey AS source FROM supplier),
    j AS (SELECT coalesce(e.source, r.source) AS source, e.grp IS NOT NULL AS named, r.grp IS NOT NULL AND status = 'complete' AND NOT cut AND NOT bad AS done, coalesce(lots, 0) AS lots FROM e FULL JOIN r ON e.source = r.source AND e.grp = r.grp),
    s AS (SELECT source, count(*) AS groups, count(*) FILTER (named AND done) AS complete, count(*) FILTER (named AND NOT done) AS partial, count(*) FILTER (NOT named) AS unexpected, sum(lots)::BIGINT AS lots FROM j GROUP BY source)
    SELECT source, coalesce(groups, 0) AS groups, coalesce(complete, 0) AS complete, coalesce(partial, 0) AS partial, coalesce(unexpected, 0) AS unexpected, coalesce(lots, 0) AS lots, source % 7 > 0 AND source % 5 > 0 AND coalesce(partial, 0) = 0 AND coalesce(unexpected, 0) = 0 AS authoritative FROM n LEFT JOIN s USING (source)""",
)
def agg17_proven(t: Tables) -> DataFrame:
    """What receipts prove of each nation's customers as groups, some of them cut short or never named by discovery."""
    k = F.col("c_custkey")
    sources = t.supplier.select(F.col("s_nationkey").alias("source")).distinct()
    asked = t.customer.filter(k % 23 > 0).join(sources, F.col("source") == F.col("c_nationkey"))
    receipts = asked.select("source", k.alias("grp"), F.lit("2026-01-01").alias("started_at"), F.when(k % 17 > 0, "2026-01-02").otherwise(" ").alias("finished_at"), F.when(k % 13 == 0, "partial").otherwise(" Complete").alias("status"), (k % 5).cast("string").alias("lots"), F.when(k % 19 == 0, "x").otherwise("").alias("errors"))
    expected = t.customer.filter(k % 29 > 0).select(F.col("c_nationkey").alias("source"), k.alias("grp"))
    n = F.col("source")
    steps = sources.select("source", (n % 7 > 0).alias("discovery_proven"), F.when(n % 5 == 0, "failed").when(n % 2 == 0, "skipped").otherwise("success").alias("matches_status"), F.lit(True).alias("matches_proven"))
    return R.coverage(expected, receipts, steps, ["source"], "grp")
