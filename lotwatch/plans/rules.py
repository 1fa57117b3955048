"""Rules on stand-ins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.operators import rules
from lotwatch.plans.base import Tables, query


@query("strf10_sequel", "SELECT p_partkey, p_size BETWEEN 2 AND 9 AND p_type <> 'ECONOMY' AS sequel FROM part")
def strf10(t: Tables) -> DataFrame:
    """A title followed by its size: a sequel's number from 2 to 9, but a quantity before "discs"."""
    name = F.split("p_name", " ")
    tokens = F.concat(name, F.array(F.col("p_size").cast("string")), F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("discs"))).otherwise(F.array(F.lit("new"))))
    return t.part.select("p_partkey", rules.names_a_sequel(tokens, name, F.array().cast("array<string>")).alias("sequel"))


@query("strf19_console_variant", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'super-slim' WHEN p_size > 30 THEN 'slim' WHEN p_size > 20 THEN 'fat' ELSE '' END AS variant FROM part")
def strf19(t: Tables) -> DataFrame:
    word = F.when(F.col("p_size") > 40, "SuperSlim").when(F.col("p_size") > 30, "Slim").when(F.col("p_size") > 20, "Phat").otherwise("slimline")
    return t.part.select("p_partkey", rules.console_variant(F.concat(F.lit("PS3 "), word, F.lit(" 500GB"))).alias("variant"))


@query("math17_bundle_benchmark", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' OR p_size <= 3 THEN p_retailprice ELSE round(p_retailprice + least(p_size - 3, 10) * 7.25 + 1e-9, 2) END AS value, CASE WHEN p_type = 'ECONOMY' OR p_size <= 3 THEN 0.9 ELSE 0.72 END::DOUBLE AS confidence FROM part")
def math17(t: Tables) -> DataFrame:
    source = F.when(F.col("p_type") == "ECONOMY", "peer-listings").otherwise("ebay-sold")
    b = rules.bundle_benchmark(F.col("p_retailprice"), F.lit(0.9), source, F.col("p_size") - 3, F.lit(7.25))
    return t.part.select("p_partkey", b.alias("b")).select("p_partkey", "b.*")


@query("math20_console_weight", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 2.1 WHEN p_size > 10 THEN 5.0 END::DOUBLE AS kg FROM part")
def math20(t: Tables) -> DataFrame:
    weights = F.create_map(F.lit("slim"), F.lit(2.1), F.lit("fat"), F.lit(0.0))
    variant = F.when(F.col("p_size") > 40, "slim").when(F.col("p_size") > 25, "fat").otherwise("")
    return t.part.select("p_partkey", rules.console_weight(F.when(F.col("p_size") > 10, 5.0), weights, variant).alias("kg"))


@query("agg21_run_totals", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'degraded' ELSE 'completed' END AS status FROM events GROUP BY 1")
def agg21(t: Tables) -> DataFrame:
    x = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return x.withColumn("status", rules.run_status(F.col("failed"), F.col("total")))


@query("str04_manual_run", "SELECT event_id, epoch(date_trunc('hour', ts) + INTERVAL 1 HOUR)::BIGINT - floor(epoch(ts))::BIGINT BETWEEN 0 AND 1800 AS satisfied FROM events")
def str04(t: Tables) -> DataFrame:
    """An event as a run by hand, the next full hour as the slot."""
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", rules.satisfies_slot(ts, F.date_trunc("hour", ts) + F.expr("INTERVAL 1 HOUR")).alias("satisfied"))


@query(
    "date08_closing_label",
    "SELECT o_orderkey, CASE date_diff('day', DATE '1996-01-01', o_orderdate::DATE) WHEN 0 THEN 'Cierra hoy — ' WHEN 1 THEN 'Cierra mañana — ' ELSE 'Cierra ' END || ['lun', 'mar', 'mie', 'jue', 'vie', 'sab', 'dom'][isodow(o_orderdate)] || ' ' || strftime(o_orderdate, '%d') || ' ' || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month(o_orderdate)] AS label FROM orders",
)
def date08(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", rules.closing_label(F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date")).alias("label"))


@query("date09_note_date", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def date09(t: Tables) -> DataFrame:
    note = F.concat(F.lit("Visto el "), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("12-1998-01"), F.lit("."))
    return t.orders.select("o_orderkey", rules.note_date(note).alias("day"))


@query("win02_variant", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'boxed' ELSE 'loose' END AS shape, CASE WHEN p_type = 'ECONOMY' THEN 'pal' ELSE '' END AS region, CASE WHEN p_size > 40 THEN 'platinum' ELSE '' END AS edition FROM part")
def win02(t: Tables) -> DataFrame:
    title = F.concat_ws(" ", F.lit("Thing"), F.when(F.col("p_size") > 25, "CIB").otherwise("loose"), F.when(F.col("p_type") == "ECONOMY", "PAL"), F.when(F.col("p_size") > 40, "Platinum"))
    return t.part.select("p_partkey", rules.variant(title, ("greatest hits", "platinum")).alias("v")).select("p_partkey", "v.*")


@query("win11_best_with_finders", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, count(DISTINCT o_orderpriority) AS searches, min(o_orderpriority) AS first_search FROM orders GROUP BY 1")
def win11(t: Tables) -> DataFrame:
    return rules.best_with_finders(t.orders, "o_custkey", "o_orderpriority", F.col("o_totalprice").desc(), F.col("o_orderkey").asc()).select("o_custkey", "o_orderkey", "searches", "first_search")


@query("join26_first_wish", "SELECT l_orderkey, l_linenumber, l_partkey, w.wish FROM lineitem JOIN (SELECT p_partkey, min(o_orderkey) AS wish FROM part JOIN orders ON p_partkey = o_custkey GROUP BY 1) w ON l_partkey = w.p_partkey")
def join26(t: Tables) -> DataFrame:
    """Listings with the first wish for their title."""
    wishes = t.part.join(t.orders, F.col("p_partkey") == F.col("o_custkey")).select(F.col("p_partkey").alias("l_partkey"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("wish"))
    return rules.first_wish(t.lineitem, wishes, "l_partkey", "at", "wish").select("l_orderkey", "l_linenumber", "l_partkey", "wish")
