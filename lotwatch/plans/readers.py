"""Readers over documents made of the tables: CSV and JSON files, item pages, images, auction markup, catalogs and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.plans.base import Tables, query
from lotwatch.sources import documents, listings
from lotwatch.streaming.lifecycle import shared_folder


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("src02_csv_scan", """SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_size % 5 > 0 THEN p_name || ', "' || p_type || '"' || chr(10) || 'x' END AS note, NULL::VARCHAR AS lost FROM part""")
def src02(t: Tables) -> DataFrame:
    """Rows written as CSV with quotes, commas and line ends, and read back as text; a column that the header lacks is null."""
    path = shared_folder(t.spark, "csv")
    note = F.when(F.col("p_size") % 5 > 0, _text(F.col("p_name"), ', "', F.col("p_type"), '"\nx'))
    t.part.select("p_partkey", note.alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return documents.scan_csv(t.spark, path, ["p_partkey", "note", "lost"])


@query("src05_json_documents", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier WHERE s_suppkey % 4 > 0")
def src05(t: Tables) -> DataFrame:
    """A document per supplier, in files of many, every fourth cut short or of another shape, which gives no row."""
    s = F.col("s_suppkey")
    whole = F.to_json(F.struct(s.alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    texts = t.supplier.select(F.when(s % 8 == 0, F.substring(whole, 1, 15)).when(s % 4 == 0, "[1]").otherwise(whole).alias("value"))
    path = shared_folder(t.spark, "json")
    texts.write.option("lineSep", documents.RECORD).text(path)
    return documents.scan_json(t.spark, f"{path}/*.txt", "id long, name string, balance double", sequence=True)


@query(
    "src08_catalog_games",
    """WITH g AS (SELECT p_brand AS console, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part) SELECT console, 'g' || p_partkey AS game, p_name AS title, place::INTEGER AS place FROM g""",
)
def src08(t: Tables) -> DataFrame:
    """A catalog document of brands as consoles and parts as their games, taken apart again."""
    game = F.struct("p_partkey", _text("g", F.col("p_partkey")).alias("id"), F.col("p_name").alias("title"))
    per_console = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_list(game)).alias("games"))
    # A catalog is one document; here each console has one of its own, as a console's games are.
    own = F.map_from_arrays(F.array("p_brand"), F.array(F.struct(F.transform("games", lambda g: F.struct(g["id"].alias("id"), g["title"].alias("title"))).alias("juegosCatalogo"))))
    text = per_console.select(F.to_json(F.struct(own.alias("byConsole"))).alias("j"))
    kind = "struct<byConsole: map<string, struct<juegosCatalogo: array<struct<id: string, title: string>>>>>"
    return documents.catalog_games(text.select(F.from_json("j", kind).alias("d")).select("d.byConsole"))


@query(
    "src14_item_details",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN true ELSE p_size % 4 = 2 END AS available, p_name || ' & ' || p_type AS description, CASE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 END AS returns_accepted, (p_size % 5 > 0)::INTEGER + p_size % 3 AS images,
      CASE WHEN p_size % 6 > 0 THEN (1.25 * (p_size % 6))::DOUBLE END AS taxes, CASE WHEN p_size % 7 > 0 THEN (p_size % 7)::DOUBLE END AS shipping FROM part""",
)
def src14(t: Tables) -> DataFrame:
    """Item pages as a marketplace answers them: state, text, returns, images, declared taxes, shipping."""
    n = F.col("p_size")
    image = '{"imageUrl":"https://i/1"}'
    text = _text(
        '{"description":"<p>', F.col("p_name"), "</p><script>x</script> &amp; <b>", F.col("p_type"), '</b>","estimatedAvailabilities":', F.when(n % 4 == 0, "[]").when(n % 4 == 1, '[{},{"estimatedAvailabilityStatus":"in_stock"}]').when(n % 4 == 2, '[{"estimatedAvailabilityStatus":"LIMITED_STOCK"}]').otherwise('[{"estimatedAvailabilityStatus":"OUT_OF_STOCK"}]'),
        F.when(n % 3 == 0, _text(',"returnTerms":{"returnsAccepted":', (n % 2 == 0).cast("string"), "}")).otherwise(""), F.when(n % 5 > 0, f',"image":{image}').otherwise(""), F.when(n % 3 == 1, f',"additionalImages":[{image},{{}}]').when(n % 3 == 2, f',"additionalImages":[{image},{image}]').otherwise(""),
        ',"taxes":[{"taxAmount":{"value":"', (1.25 * (n % 6)).cast("string"), '"}},{"taxAmount":{"value":"odd"}},{}],"shippingOptions":[{"shippingCost":{"value":"', F.when(n % 7 > 0, (n % 7).cast("string")).otherwise("free"), '"}}]}',
    )
    d = listings.detail(F.col("j"))
    return t.part.select("p_partkey", text.alias("j")).select("p_partkey", d.alias("d")).select("p_partkey", *[f"d.{c}" for c in ("available", "description", "returns_accepted", "images", "taxes", "shipping")])


@query("src21_first_images", "SELECT o_orderkey, coalesce((SELECT arg_min('i' || l_linenumber, (CASE WHEN l_linenumber % 3 = 0 THEN 10000000 ELSE 10 - l_linenumber END, l_linenumber)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R'), '') AS image FROM orders")
def src21(t: Tables) -> DataFrame:
    """An order's lines as a lot's images: by their order, ones without an order last, without an address none."""
    n = F.col("l_linenumber")
    image = F.struct(n.alias("n"), F.when(n % 3 == 0, "").otherwise((10 - n).cast("string")).alias("order"), F.when(n % 2 == 0, _text(" i", n)).alias("url"), _text("i", n).alias("image"), F.col("l_returnflag").alias("flag"))
    lots = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(image)).alias("images"))
    shown = F.transform("images", lambda i: F.struct(i["order"].alias("order"), F.when(i["flag"] != "R", i["url"]).alias("url"), F.when(i["flag"] != "R", i["image"]).otherwise("").alias("image")))
    first = lots.select(F.col("l_orderkey").alias("o_orderkey"), listings.first_image(shown).alias("image"))
    return t.orders.select("o_orderkey").join(first, "o_orderkey", "left").select("o_orderkey", F.coalesce("image", F.lit("")).alias("image"))


_ITEMS = "SELECT o_orderkey AS g, o_custkey % 3 AS c, l_linenumber AS n, l_suppkey AS pic, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey || '.jpg') - 1 AS place, count(*) OVER (PARTITION BY o_orderkey) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 10 > 0"
# A feed is one customer's orders; lots reuse the numbers 1 to 3, so that pictures have to tell some apart.
_LOTS = f"""WITH i AS ({_ITEMS}), k AS (SELECT *, 1 + n % 3 AS number FROM i QUALIFY row_number() OVER (PARTITION BY g, 1 + n % 3, pic ORDER BY place) = 1), f AS (SELECT *, place = min(place) OVER (PARTITION BY g, number) AS first FROM k)"""


def _feeds(t: Tables) -> DataFrame:
    """Feeds in a text column, one for each customer; every tenth has a document type, which is never read."""
    lot = F.struct(F.col("l_linenumber").alias("n"), _text("<lote><title>Lote ", F.col("l_linenumber"), "</title><link>https://r/lote/", 1 + F.col("l_linenumber") % 3, "</link><foto>https://r/f/", F.col("l_suppkey"), ".jpg</foto></lote>").alias("x"))
    groups = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.array_sort(F.collect_list(lot)).alias("lots"), F.count(F.lit(1)).alias("m"))
    declared = F.col("m") + F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)
    item = _text("<item><title>Remate ", F.col("o_orderkey"), "</title><link>", F.col("o_orderkey"), "</link><cantLotes>", declared, "</cantLotes><lotes>", F.array_join(F.transform("lots", lambda x: x["x"]), ""), "</lotes></item>")
    feeds = groups.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("x")))).alias("items"))
    body = _text("<rss><channel>", F.array_join(F.transform("items", lambda x: x["x"]), ""), "</channel></rss>")
    return feeds.select(F.when(F.col("o_custkey") % 10 == 0, _text("<!DOCTYPE rss>", body)).otherwise(body).alias("xml"))


@query("src26_feed_lots", _LOTS + " SELECT g::VARCHAR AS group_id, CASE WHEN first THEN g || ':' || number ELSE g || ':' || number || ':item-' || pic END AS lot_id, place::INTEGER AS place FROM f")
def src26(t: Tables) -> DataFrame:
    return listings.feed_lots(_feeds(t), "xml").select("group_id", "lot_id", "place")


@query("src27_feed_receipts", _LOTS + " SELECT g::VARCHAR AS group_id, CASE WHEN any_value(c) = 0 THEN 'partial' ELSE 'complete' END AS status, count(*) AS lots FROM f GROUP BY g")
def src27(t: Tables) -> DataFrame:
    """Groups whose feed declares as many lots as it has are complete."""
    return listings.feed_receipts(listings.feed_lots(_feeds(t), "xml"))


@query("src33_price_markup", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity ELSE 0.0 END AS base, CASE WHEN l_linestatus = 'F' THEN l_quantity + 1 WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0.0 END AS current, CASE WHEN l_tax > 0.04 THEN 'live' ELSE '' END AS status FROM lineitem")
def src33(t: Tables) -> DataFrame:
    """Auction markup of lines: a bid attribute, a class that says so, or just a price."""
    tag = _text('<span class="woo-ua-auction-price ', F.when(F.col("l_returnflag") == "N", "base").otherwise("Current-Bid"), '"', F.when(F.col("l_linestatus") == "F", _text(' data-bid="', F.col("l_quantity") + 1, '"')).otherwise(""), F.when(F.col("l_tax") > 0.04, ' data-status=" LIVE "').otherwise(""), "><b>USD</b> ", F.col("l_quantity"), "</span>")
    p = listings.price_details(F.col("html"))
    return t.lineitem.select("l_orderkey", "l_linenumber", tag.alias("html")).select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", "p.base", "p.current", "p.status")
