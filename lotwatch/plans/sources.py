"""Readers and parsers over JSON and text columns that stand for a marketplace's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lotwatch.functions import money as V
from lotwatch.plans.base import Tables, query
from lotwatch.sources import documents, listings


@query("json01_decode", "SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) END AS k FROM events")
def json01(t: Tables) -> DataFrame:
    """A JSON column with a fallback for rows that are corrupt."""
    kind = StructType([StructField("k", LongType())])
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return t.events.select("event_id", F.coalesce(documents.json_field(text, kind, F.struct(F.lit(-1).cast("long").alias("k")))["k"], F.lit(0)).alias("k"))


@query("json03_canonical", """SELECT n_nationkey, '{"a":"' || n_name || '","m":"' || n_regionkey || '","z":"' || n_nationkey || '"}' AS extra FROM nation""")
def json03(t: Tables) -> DataFrame:
    entries = F.create_map(F.lit("z"), F.col("n_nationkey").cast("string"), F.lit("a"), F.col("n_name"), F.lit("m"), F.col("n_regionkey").cast("string"))
    return t.nation.select("n_nationkey", documents.canonical_json(entries).alias("extra"))


@query("json07_persisted_wins", "SELECT n_nationkey, 'new' AS name, n_regionkey AS region FROM nation")
def json07(t: Tables) -> DataFrame:
    persisted = F.create_map(F.lit("name"), F.lit("new"))
    legacy = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    m = documents.merged_maps(persisted, legacy)
    return t.nation.select("n_nationkey", m["name"].alias("name"), m["region"].cast("int").alias("region"))


@query("json08_stable_array", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || [p_brand])), ',') AS words FROM part")
def json08(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(documents.stable_array(F.concat(F.split("p_name", " "), F.split("p_name", " "), F.array("p_brand"))), ",").alias("words"))


@query("prj21_listing_kind", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'auction' WHEN p_size > 25 THEN 'best_offer' WHEN p_size > 10 THEN 'fixed_price' ELSE 'unknown' END AS kind FROM part")
def prj21(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    options = F.concat(F.when(F.col("p_size") > 10, F.array(F.lit("FIXED_PRICE"))).otherwise(none), F.when(F.col("p_size") > 25, F.array(F.lit("best_offer"))).otherwise(none), F.when(F.col("p_size") > 40, F.array(F.lit("AUCTION"))).otherwise(none))
    return t.part.select("p_partkey", listings.listing_kind(options).alias("kind"))


@query("prj03_price_of_three", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_extendedprice WHEN l_linestatus = 'O' THEN l_quantity ELSE l_tax END AS price FROM lineitem")
def prj03(t: Tables) -> DataFrame:
    """The next bid, the current price or the base price: the first that is neither missing nor 0."""
    nonzero = lambda c: F.nullif(c, F.lit(0.0))
    price = F.coalesce(nonzero(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), nonzero(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)), F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", price.alias("price"))


def answers(t: Tables) -> DataFrame:
    """Parts as a marketplace would answer a search with them."""
    text = lambda c: F.col(c).cast("string")
    shipping = F.when(F.col("p_size") > 25, F.struct(F.struct(F.when(F.col("p_size") > 40, "0.00").otherwise("12.50").alias("value"), F.lit("usd").alias("currency")).alias("shippingCost"), F.lit("FIXED").alias("shippingCostType")))
    row = F.struct(
        text("p_partkey").alias("itemId"), F.concat(F.lit("  "), "p_name", F.lit("  ")).alias("title"), F.when(F.col("p_size") == 7, "javascript:x").otherwise("https://shop.example/i").alias("itemWebUrl"),
        F.struct(text("p_retailprice").alias("value"), F.lit("usd").alias("currency")).alias("price"), F.when(shipping.isNotNull(), F.array(shipping)).alias("shippingOptions"), F.array(F.lit("AUCTION")).alias("buyingOptions"),
        F.struct(F.lit("99.4").alias("feedbackPercentage"), F.lit("someone").alias("username")).alias("seller"),
    )
    return t.part.select(F.to_json(row).alias("json"))


@query(
    "src13_summaries",
    "SELECT p_partkey::VARCHAR AS external_id, trim(p_name) AS title, round(p_retailprice, 2) AS price_amount, 'USD' AS price_currency, CASE WHEN p_size > 40 THEN 0.0 WHEN p_size > 25 THEN 12.5 END::DOUBLE AS shipping_amount, CASE WHEN p_size > 40 THEN 'Envío gratis' WHEN p_size > 25 THEN 'Envío USD 12.5' ELSE '' END AS shipping_label, 'auction' AS listing_kind, '99.4% de feedback' AS seller_label FROM part WHERE p_size <> 7",
)
def src13(t: Tables) -> DataFrame:
    """Search results as listings; those without a public address are no listings."""
    out = listings.summaries(answers(t), "json", "shop")
    return out.select("external_id", "title", "price_amount", "price_currency", "shipping_amount", "shipping_label", "listing_kind", "seller_label")


@query("src22_final_price", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 3 THEN l_extendedprice ELSE l_quantity END AS price FROM lineitem")
def src22(t: Tables) -> DataFrame:
    price = listings.final_price(F.col("l_extendedprice"), F.col("l_quantity"), F.greatest(F.col("l_linenumber") - 3, F.lit(0)))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", price.alias("price"))


@query("src35_conformed_lots", "SELECT CASE WHEN p_size > 25 THEN p_brand ELSE 'g:' || p_size || ':' || p_name END AS identity, min(p_partkey) AS p_partkey, 'house' AS source_id FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1")
def src35(t: Tables) -> DataFrame:
    """Lots of one house: its id filled in, others' lots left out, one of each identity."""
    lots = t.part.select(
        "p_partkey", F.when(F.col("p_type") == "ECONOMY", "other").otherwise("").alias("source_id"), F.lit("").alias("source_label"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(" ").alias("lot_id"),
        F.lit(None).cast("string").alias("lot_url"), F.lit("g").alias("group_id"), F.col("p_size").cast("string").alias("lot_number"), F.col("p_name").alias("title"),
    )
    return listings.conformed(lots, "house", "The house", "p_partkey").select("identity", "p_partkey", "source_id")


@query("math03_auction_charges", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 0.1 + 1e-9, 2) AS premium, round(round(l_extendedprice * 0.1 + 1e-9, 2) * 0.22 + 1e-9, 2) AS tax, round(l_extendedprice + round(l_extendedprice * 0.1 + 1e-9, 2) + round(round(l_extendedprice * 0.1 + 1e-9, 2) * 0.22 + 1e-9, 2) + 5 + 1e-9, 2) AS total FROM lineitem")
def math03(t: Tables) -> DataFrame:
    """A house's premium, the tax on the premium, and other charges."""
    charges = V.auction_charges(F.col("l_extendedprice"), F.lit(10.0), F.lit(22.0), F.lit(5.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", charges.alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "c.*")


@query("math16_lot_ceiling", "SELECT p_partkey, round(p_size * p_retailprice * CASE WHEN p_type = 'ECONOMY' THEN 0.5 ELSE 1 END + 1e-9, 2) AS ceiling FROM part")
def math16(t: Tables) -> DataFrame:
    """What a lot may cost: its pieces at their ceiling, half of it where they are filler."""
    return t.part.select("p_partkey", V.lot_ceiling(F.col("p_size"), F.col("p_retailprice"), F.col("p_type") == "ECONOMY").alias("ceiling"))
