"""Linked data in pages: every object of their JSON-LD blocks, at any depth, and the products and offers among them.

Blocks become VARIANT values. A walk unfolds one level of containers after the other within the row, as often as the
block is deep: no shuffle, no driver, no bound on depth. Blocks that can't be read are rows with an error and cost
nothing else of their page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions.money import either_amount
from lotwatch.functions.text import let
from lotwatch.operators.rows import first_wins
from lotwatch.sources.listings import clean

NODES = "array<struct<path: array<int>, node: variant>>"
# What a page says of its currency and stock; a commission in a page's summary.
LOCAL, LOCAL_NAMES = "UYU", ("", "$", "$U", "$U.", "UYU", "PESO", "PESOS")
DOLLAR_NAMES = ("US$", "U$S", "USD", "DOLAR", "DOLARES", "DÓLAR", "DÓLARES")
CLOSED = ("outofstock", "soldout", "discontinued")
COMMISSION = r"(?i)comisi[oó]n[^0-9%]{0,60}([0-9]+(?:[.,][0-9]+)?)\s*%"
MISSING, INVALID, NO_PRODUCTS = "JSON-LD ausente", "JSON-LD inválido", "JSON-LD sin productos"


def blocks(pages: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """A row for each JSON-LD script of a page: keys, block (its place from 0) and raw."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\btype\s*=\s*["']?\s*application/ld\+json\s*(?:;[^"'>]*)?["']?[^>]*>(.*?)</script"""), 1)
    return pages.select(*keys, F.posexplode(scripts).alias("block", "raw"))


def depth(raw: Column) -> Column:
    """How deep a JSON text's containers lie in each other."""
    brackets = F.regexp_extract_all(F.regexp_replace(raw, r'"(?:[^"\\]++|\\.)*+"', ""), F.lit(r"[\[\]{}]"), 0)
    step = lambda a, b: let(a["at"] + F.when(b.isin("{", "["), 1).otherwise(-1), lambda n: F.struct(n.alias("at"), F.greatest(a["most"], n).alias("most")))
    return F.aggregate(brackets, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda a: a["most"])


def containers(raw: Column) -> Column:
    """All objects and arrays of a JSON text, the text itself first: array of (path, node); null if it can't be read.

    A path has a place for each level, by which nodes sort in the order of a walk; members of an object are in the
    order of their names, as VARIANT keeps no other.
    """
    no_path = F.array().cast("array<int>")

    def members(f: Column) -> Column:
        each = F.coalesce(F.try_variant_get(f["node"], "$", "array<variant>"), F.map_values(F.try_variant_get(f["node"], "$", "map<string, variant>")), F.array().cast("array<variant>"))
        whole = F.transform(each, lambda x, n: F.struct(F.concat(f["path"], F.array(n)).alias("path"), x.alias("node")))
        return F.filter(whole, lambda x: F.schema_of_variant(x["node"]).rlike("^(ARRAY|OBJECT)<"))

    def level(a: Column, _: Column) -> Column:
        return F.struct(F.concat(a["found"], a["front"]).alias("found"), F.flatten(F.transform(a["front"], members)).cast(NODES).alias("front"))

    def walked(root: Column, deep: Column) -> Column:
        begin = F.struct(F.array().cast(NODES).alias("found"), F.array(F.struct(no_path.alias("path"), root.alias("node"))).cast(NODES).alias("front"))
        return F.aggregate(F.sequence(F.lit(1), deep), begin, level, lambda a: a["found"])

    root = F.try_parse_json(raw)
    deep = depth(raw)
    return F.when(root.isNull(), None).when(deep == 0, F.array().cast(NODES)).otherwise(walked(root, F.greatest(deep, F.lit(1))))


def objects(found: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each object in a column of JSON texts, in place of the text: path and node (a VARIANT); others have no row."""
    kept = [c for c in found.columns if c != raw]
    each = found.select(*kept, F.explode(containers(F.col(raw))).alias("_n")).select(*kept, "_n.path", "_n.node")
    return each.filter(F.schema_of_variant("node").startswith("OBJECT<"))


def text_at(node: Column, path: str) -> Column:
    """What is at a path of a node as clean text; the empty string for nothing."""
    return clean(F.try_variant_get(node, path, "string"))


def has_type(node: Column, name: str) -> Column:
    """Is the node of this schema type, alone or among others, in any case?"""
    kinds = F.coalesce(F.try_variant_get(node, "$['@type']", "array<string>"), F.array(F.try_variant_get(node, "$['@type']", "string")))
    return F.exists(kinds, lambda k: F.coalesce(F.lower(clean(k)) == name, F.lit(False)))


def first_offer(node: Column) -> Column:
    """The node's offer, or the first of several."""
    offers = F.try_variant_get(node, "$.offers", "variant")
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT<")
    several = F.filter(F.coalesce(F.try_variant_get(offers, "$", "array<variant>"), F.array().cast("array<variant>")), is_object)
    return F.when(is_object(offers), offers).otherwise(F.try_element_at(several, F.lit(1)))


def page_lot_number(url: Column) -> Column:
    """The lot that an address's query names, the first of the name that isn't blank."""
    return F.trim(F.url_decode(F.regexp_extract(url, r"(?i)[?&]lote=([^&#]*)", 1)))


def currency(name: Column) -> Column:
    known = F.upper(clean(name))
    return F.when(known.isin(*LOCAL_NAMES), LOCAL).when(known.isin(*DOLLAR_NAMES), "USD").otherwise(F.substring(known, 1, 8))


def first_image_url(node: Column) -> Column:
    """The image of a node: an address, an object with one, or the first of a list that has one."""
    image = F.try_variant_get(node, "$.image", "variant")
    address = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.nullif(text_at(v, "$.url"), F.lit("")), F.nullif(text_at(v, "$.contentUrl"), F.lit("")))
    listed = F.filter(F.transform(F.coalesce(F.try_variant_get(image, "$", "array<variant>"), F.array(image)), address), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.try_element_at(listed, F.lit(1)), F.lit(""))


def products(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The products that pages describe, the first of each lot number: key, lot_number, title, description, lot_url, image_url, currency, price and status.

    The number is that of the offer's address, the product's own, or behind LOTE-<key>- in its sku; none, no product.
    """
    node = F.col("node")
    found = objects(blocks(pages, [key], html)).filter(has_type(node, "product"))
    offer = F.col("_offer")
    found = found.withColumn("_offer", first_offer(node)).withColumn("_offer_url", text_at(offer, "$.url")).withColumn("_url", text_at(node, "$.url"))
    sku = F.regexp_extract(text_at(node, "$.sku"), r"(?i)^LOTE[-_]", 0)
    behind = F.substring(text_at(node, "$.sku"), F.length(sku) + 1, F.lit(2**31 - 1))
    own = F.when((sku != "") & F.lower(behind).startswith(F.lower(F.col(key).cast("string"))), F.regexp_extract(F.substring(behind, F.length(F.col(key).cast("string")) + 1, F.lit(2**31 - 1)), r"^[-_](.+)$", 1)).otherwise("")
    known = lambda c: F.nullif(c, F.lit(""))
    number = F.coalesce(known(page_lot_number(F.col("_offer_url"))), known(page_lot_number(F.col("_url"))), own)
    found = found.withColumn("lot_number", number).filter("lot_number <> ''").withColumn("_same", F.lower("lot_number"))
    found = first_wins(found, [key, "_same"], "block", "path")
    name = text_at(node, "$.name")
    prefix = F.regexp_extract(name, r"(?i)^\s*lote\s*#?\s*", 0)
    rest = F.substring(name, F.length(prefix) + 1, F.lit(2**31 - 1))
    bare = F.when((prefix != "") & F.lower(rest).startswith(F.lower("lot_number")), F.regexp_extract(F.substring(rest, F.length("lot_number") + 1, F.lit(2**31 - 1)), r"^\s*[-–—:]\s*(.*)$", 1)).otherwise("")
    state = F.lower(F.substring_index(text_at(offer, "$.availability"), "/", -1))
    price = F.try_variant_get(offer, "$.price", "variant")
    number_price = F.when(F.schema_of_variant(price).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(price, "$", "double")).when(F.schema_of_variant(price) == "STRING", either_amount(F.try_variant_get(price, "$", "string")))
    return found.select(
        key, "lot_number", F.coalesce(known(clean(bare)), name).alias("title"), text_at(node, "$.description").alias("description"), F.coalesce(known(F.col("_offer_url")), F.col("_url")).alias("lot_url"),
        first_image_url(node).alias("image_url"), currency(text_at(offer, "$.priceCurrency")).alias("currency"), number_price.alias("price"), F.when(state.isin(*CLOSED), "closed").otherwise("active").alias("status"),
    )


def page_receipts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """For every page: key, blocks, products, commission (percent, from its summary) and warnings."""
    described = products(pages, key, html).groupBy(key).agg(F.count(F.lit(1)).alias("_products"))
    read = blocks(pages, [key], html).groupBy(key).agg(F.count(F.lit(1)).alias("_blocks"), F.count_if(F.try_parse_json("raw").isNull()).alias("_bad"))
    summary = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*["']og:description["'][^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1)
    n, m = F.coalesce("_blocks", F.lit(0)), F.coalesce("_products", F.lit(0))
    warnings = F.array(F.when(n == 0, MISSING), F.when(F.coalesce("_bad", F.lit(0)) > 0, INVALID), F.when((n > 0) & (m == 0), NO_PRODUCTS))
    joined = pages.select(key, summary.alias("_summary")).join(read, key, "left").join(described, key, "left")
    return joined.select(key, n.alias("blocks"), m.alias("products"), either_amount(F.regexp_extract("_summary", COMMISSION, 1)).alias("commission"), F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"))


def enriched_lots(lots: DataFrame, pages: DataFrame, group: str, html: str) -> DataFrame:
    """Lots of groups with what the groups' pages say of them, and metadata_status: enriched, lot_not_found, or unavailable without a page.

    lots: group, lot_number, title, description, lot_url, image_url, currency, current_price, commission_percent. A page's
    address replaces a lot's own only if it names a lot; empty values replace nothing.
    """
    found = products(pages, group, html).withColumn("_same", F.lower("lot_number")).select(group, "_same", F.struct("title", "description", "lot_url", "image_url", "currency", "price", "status").alias("_p"))
    receipts = page_receipts(pages, group, html).select(group, F.col("commission").alias("_commission"), F.col("warnings").alias("metadata_warnings"))
    joined = lots.withColumn("_same", F.lower("lot_number")).join(receipts, group, "left").join(found, [group, "_same"], "left")
    known = lambda name, own: F.coalesce(F.nullif(F.col(f"_p.{name}"), F.lit("")), F.col(own))
    direct = F.when(page_lot_number(F.col("_p.lot_url")) != "", F.col("_p.lot_url"))
    return joined.withColumns({
        "title": known("title", "title"), "description": known("description", "description"), "lot_url": F.coalesce(direct, F.col("lot_url")), "image_url": known("image_url", "image_url"),
        "currency": known("currency", "currency"), "current_price": F.coalesce("_p.price", "current_price"), "commission_percent": F.coalesce("_commission", "commission_percent"),
        "metadata_status": F.when(F.col("_p").isNotNull(), "enriched").when(F.col("metadata_warnings").isNotNull(), "lot_not_found").otherwise("unavailable"),
    }).drop("_same", "_p", "_commission")
