"""Marketplace and auction answers, JSON or HTML in text columns, as listings and lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.money import amount
from lotwatch.functions.text import strip_html
from lotwatch.operators.rows import first_wins

MONEY = "struct<value: string, currency: string>"
SUMMARY = f"""struct<itemId: string, title: string, itemWebUrl: string, shortDescription: string, condition: string, itemEndDate: string, buyingOptions: array<string>, price: {MONEY},
  shippingOptions: array<struct<shippingCost: {MONEY}, shippingCostType: string>>, itemLocation: struct<country: string>, image: struct<imageUrl: string>, seller: struct<feedbackPercentage: string>>"""
DETAIL = f"""struct<description: string, shortDescription: string, conditionDescription: string, returnTerms: struct<returnsAccepted: boolean>, image: struct<imageUrl: string>, additionalImages: array<struct<imageUrl: string>>,
  taxes: array<struct<taxAmount: {MONEY}>>, shippingOptions: array<struct<shippingCost: {MONEY}>>, estimatedAvailabilities: array<struct<estimatedAvailabilityStatus: string>>>"""
# States in which a piece can be bought; what a description and a note of condition show; the place of an image without one.
IN_STOCK = ("IN_STOCK", "LIMITED_STOCK")
NOTE_CHARS, NO_ORDER = 1000, 10_000_000
DESCRIPTION_CHARS = 6000


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def public_url(text: Column) -> Column:
    """An absolute http or https address, else the empty string."""
    url = clean(text)
    return F.when(url.rlike(r"^(?i)https?://[^/?#]+"), url).otherwise("")


def listing_kind(options: Column) -> Column:
    """auction before best_offer before fixed_price, else unknown."""
    held = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.upper(o))
    out = F.lit("unknown")
    for name in ("FIXED_PRICE", "BEST_OFFER", "AUCTION"):
        out = F.when(F.array_contains(held, name), name.lower()).otherwise(out)
    return out


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def summaries(raw: DataFrame, json: str, source: str) -> DataFrame:
    """A listing for each search result that has an id, a title and a public address. Unknown shipping isn't free shipping.

    Of a seller only the reputation is kept, never the name.
    """
    r = raw.select(F.from_json(json, SUMMARY).alias("r"))
    shipping, currency = first(F.col("r.shippingOptions")), F.substring(F.upper(clean(F.col("r.price.currency"))), 1, 8)
    paid = amount(F.trim(shipping["shippingCost"]["value"]))
    kind = F.upper(clean(shipping["shippingCostType"]))
    in_currency = F.coalesce(F.nullif(F.upper(clean(shipping["shippingCost"]["currency"])), F.lit("")), currency)
    feedback = clean(F.col("r.seller.feedbackPercentage"))
    plain = F.regexp_replace(F.format_string("%.2f", paid), r"\.?0+$", "")
    out = r.select(
        F.lit(source).alias("source_id"), clean(F.col("r.itemId")).alias("external_id"), clean(F.col("r.title")).alias("title"), public_url(F.col("r.itemWebUrl")).alias("listing_url"),
        clean(F.col("r.shortDescription")).alias("description"), public_url(F.col("r.image.imageUrl")).alias("image_url"), listing_kind(F.col("r.buyingOptions")).alias("listing_kind"),
        amount(F.trim("r.price.value")).alias("price_amount"), currency.alias("price_currency"), paid.alias("shipping_amount"), F.substring(in_currency, 1, 8).alias("shipping_currency"),
        F.when(paid == 0, "Envío gratis").when(paid.isNotNull(), F.concat(F.lit("Envío "), in_currency, F.lit(" "), plain)).when(kind == "CALCULATED", "Envío a calcular").otherwise(kind).alias("shipping_label"),
        clean(F.col("r.condition")).alias("condition_label"), clean(F.col("r.itemLocation.country")).alias("location_label"),
        F.when(feedback != "", F.concat(feedback, F.lit("% de feedback"))).otherwise("").alias("seller_label"), clean(F.col("r.itemEndDate")).alias("closes_at"),
    )
    return out.filter("external_id <> '' AND title <> '' AND listing_url <> ''")


def detail(json: Column) -> Column:
    """What an item's page adds: description, note, returns, images, taxes only where they are declared, shipping, availability."""
    d = F.from_json(json, DETAIL)
    taxes = F.filter(F.transform(F.coalesce(d["taxes"], F.array().cast(f"array<struct<taxAmount: {MONEY}>>")), lambda t: amount(F.trim(t["taxAmount"]["value"]))), lambda x: x > 0)
    states = F.filter(F.transform(d["estimatedAvailabilities"], lambda s: F.upper(s["estimatedAvailabilityStatus"])), lambda s: s.isNotNull() & (s != ""))
    seen = lambda i: F.coalesce(i["imageUrl"], F.lit("")) != ""
    return F.struct(
        first(states).isin(*IN_STOCK).alias("available"),
        strip_html(F.coalesce(F.nullif(d["description"], F.lit("")), d["shortDescription"]), DESCRIPTION_CHARS).alias("description"),
        F.substring(clean(d["conditionDescription"]), 1, NOTE_CHARS).alias("condition_note"), d["returnTerms"]["returnsAccepted"].alias("returns_accepted"),
        (seen(d["image"]).cast("int") + F.coalesce(F.size(F.filter(d["additionalImages"], seen)), F.lit(0))).alias("images"),
        F.when(F.size(taxes) > 0, F.round(F.aggregate(taxes, F.lit(0.0), lambda a, x: a + x), 2)).alias("taxes"), amount(F.trim(first(d["shippingOptions"])["shippingCost"]["value"])).alias("shipping"),
    )


def first_image(images: Column) -> Column:
    """The address of the first image by its order, ones without an order last; images: array<struct<order, url, image>> of text."""
    address = lambda i: F.trim(F.coalesce(F.nullif(i["url"], F.lit("")), i["image"], F.lit("")))
    ranked = F.transform(images, lambda i, at: F.struct(F.coalesce(F.trim(i["order"]).try_cast("int"), F.lit(NO_ORDER)).alias("order"), at.alias("at"), address(i).alias("address")))
    return F.coalesce(first(F.array_sort(F.filter(ranked, lambda i: i["address"] != "")))["address"], F.lit(""))


def final_price(best: Column, base: Column, bids: Column) -> Column:
    """The best bid where there are bids, else the base price."""
    return F.when(F.coalesce(bids, F.lit(0)) > 0, best).otherwise(base)


def lot_identity(lot_id: Column, url: Column, group: Column, number: Column, title: Column) -> Column:
    """A lot's id, else its address, else group, number and title."""
    known = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(known(lot_id), known(url), F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in (group, number, title)]))


def conformed(lots: DataFrame, source: str, label: str, *order: str) -> DataFrame:
    """Lots of one source: its id and label filled in, others' lots left out, the first of each identity in this order.

    lots: source_id, source_label, lot_id, lot_url, group_id, lot_number, title and more.
    """
    empty = lambda c, value: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value))
    own = lots.withColumns({"source_id": empty("source_id", source), "source_label": empty("source_label", label)}).filter(F.col("source_id") == source)
    own = own.withColumn("identity", lot_identity(*[F.col(c) for c in ("lot_id", "lot_url", "group_id", "lot_number", "title")]))
    return first_wins(own, ["identity"], *order)


def price_details(html: Column) -> Column:
    """Base price, current bid and state of a shop's auction markup: its bid attribute, or the shown price by its class."""
    tag = F.regexp_extract(html, r'(<[^>]*\bwoo-ua-auction-price\b[^>]*>)', 1)
    attribute = lambda name: F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1)
    shown = F.coalesce(F.replace(F.regexp_extract(strip_html(html), r"(\d[\d.,]*)", 1), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))
    bid = F.coalesce(attribute("data-bid").try_cast("double"), F.lit(0.0))
    has_bid = F.contains(F.lower(attribute("class")), F.lit("current-bid")) | (bid > 0)
    return F.struct(
        F.when(has_bid, 0.0).otherwise(shown).alias("base"), F.when(has_bid, F.when(bid > 0, bid).otherwise(shown)).otherwise(0.0).alias("current"), F.lower(F.trim(attribute("data-status"))).alias("status")
    )


def feed_lots(feed: DataFrame, xml: str) -> DataFrame:
    """Lots of RSS feeds in a text column: an item a group, its `lotes` the lots; a feed with a document type is left out.

    Groups come once; a lot number that a group uses again for another picture gets the picture's number as well.
    """
    schema = "channel struct<item: array<struct<title: string, link: string, fecha: string, description: string, cantLotes: string, lotes: struct<lote: array<struct<title: string, link: string, description: string, foto: string>>>>>>"
    sound = ~F.lower(F.substring(xml, 1, 4096)).rlike("<!doctype|<!entity")
    items = feed.filter(sound).select(F.posexplode(F.from_xml(F.col(xml), schema)["channel"]["item"]).alias("at", "g"))
    groups = first_wins(items.select("at", "g", F.col("g.link").alias("group_id")).filter("group_id IS NOT NULL"), ["group_id"], "at")
    lots = groups.select("group_id", F.col("g.title").alias("group_label"), F.col("g.cantLotes").try_cast("int").alias("declared"), F.size("g.lotes.lote").alias("parsed"), F.posexplode("g.lotes.lote").alias("place", "l"))
    number, picture = F.regexp_extract("l.link", r"(\d+)/?$", 1), F.regexp_extract("l.foto", r"(\d+)\D*$", 1)
    lots = lots.select("group_id", "group_label", "declared", "parsed", "place", F.col("l.title").alias("title"), F.col("l.link").alias("lot_url"), F.when(number != "", number).otherwise((F.col("place") + 1).cast("string")).alias("lot_number"), picture.alias("picture"))
    lots = first_wins(lots, ["group_id", "lot_number", "picture"], "place")
    # A group's lots are together by now, in this order: neither their first places nor a join deals them out again.
    again = lots.withColumn("_first", F.min("place").over(Window.partitionBy("group_id", "lot_number")))
    lot_id = F.concat_ws(":", "group_id", "lot_number")
    kept = again.filter((F.col("place") == F.col("_first")) | (F.col("picture") != ""))
    return kept.withColumn("lot_id", F.when(F.col("place") == F.col("_first"), lot_id).otherwise(F.concat(lot_id, F.lit(":item-"), "picture"))).drop("_first", "picture")


def feed_receipts(lots: DataFrame) -> DataFrame:
    """A group is complete if as many lots were read as it declares."""
    status = F.when(F.max("declared") == F.max("parsed"), "complete").otherwise("partial")
    return lots.groupBy("group_id").agg(status.alias("status"), F.count(F.lit(1)).alias("lots"))
