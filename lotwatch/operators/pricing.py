"""What listings of a search are worth: matched ones are priced by references or their peers, and the cheapest read in full.

Three passes that read the listings once: peers' medians of what was matched; a benchmark and a first ratio for each
listing; and, for a few of each search that look cheap, what their whole page says, after which all get their verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.folding import let
from lotwatch.functions.money import cents, decision_band, lot_ceiling, meets_target
from lotwatch.operators import valuation
from lotwatch.operators.rules import bundle_benchmark
from lotwatch.operators.value import PEERS, SOURCE_RANK

#: Listings of a search whose page is read, the cheapest first; where a ratio isn't known it counts as this.
MOST_DETAILS, NO_RATIO = 12, 9.0
#: Parts that a search's listings are dealt over to be ranked: a few searches may hold all of them.
DEALT = 64
PEER_SOURCE, CEILING_SOURCE = "peer-listings", "lot-ceiling"
REFERENCE = "struct<value: double, source: string, observed_at: string, independent: boolean, stale: boolean, region: string, confidence: double>"
#: What a page adds; null for one that wasn't read.
EVIDENCE = f"struct<missing: array<string>, defects: {valuation.DEFECTS}, returns_accepted: boolean, images: int, taxes: double, available: boolean>"


def _extra(missing: Column) -> Column:
    """What completes a piece, by its title alone."""
    return F.coalesce(valuation.completion(missing, F.array().cast("array<string>"), F.array().cast(valuation.DEFECTS))["total"], F.lit(0.0))


def peer_references(matched: DataFrame, observed_at: str) -> DataFrame:
    """search, title, completeness and _peers (REFERENCE): the median of what at least PEERS matched listings of the wanted kind ask, completed."""
    asks = cents(F.col("price") + _extra(F.col("missing")))
    own = matched.filter(~F.col("lot") & (F.col("completeness") != "") & (F.col("price") > 0) & ((F.col("expected") == "") | (F.col("kind") == F.col("expected"))))
    medians = own.groupBy("search", "title", "completeness").agg(cents(F.median(asks)).alias("value"), F.count(asks).alias("_n")).filter(F.col("_n") >= PEERS)
    peers = F.struct(F.col("value"), F.lit(PEER_SOURCE).alias("source"), F.lit(observed_at).alias("observed_at"), F.lit(True).alias("independent"), F.lit(False).alias("stale"), F.lit("").alias("region"), F.lit(0.5).alias("confidence")).cast(REFERENCE)
    return medians.select("search", "title", "completeness", peers.alias("_peers"))


def lot_peers(matched: DataFrame) -> DataFrame:
    """search and _piece, the median price per piece of lots that confirm how many they hold."""
    each = cents(F.col("price") / F.col("pieces"))
    return matched.filter(F.col("lot") & (F.col("pieces") > 0) & (F.col("price") > 0)).groupBy("search").agg(cents(F.median(each)).alias("_piece"), F.count(each).alias("_n")).filter(F.col("_n") >= PEERS).select("search", "_piece")


def best_references(references: DataFrame) -> DataFrame:
    """search, title, completeness and _best (REFERENCE): the curated reference that goes first: independent, fresh, by source, by confidence."""
    ranks = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    ref = F.struct(F.col("value"), "source", "observed_at", "independent", "stale", "region", "confidence").cast(REFERENCE)
    order = F.struct((~F.col("independent")).alias("a"), F.col("stale").alias("b"), F.coalesce(F.try_element_at(ranks, F.col("source")), F.lit(99)).alias("c"), (-F.col("confidence")).alias("d"), F.col("value").alias("e"))
    return references.filter("value > 0").groupBy("search", "title", "completeness").agg(F.min_by(ref, order).alias("_best"))


def benchmark(m: Column) -> Column:
    """Struct of value, reference fields and comparable for a row m of matched with _best, _peers and _piece; null for none.

    A lot is measured by the piece or not at all, and never without a sure number of them. Others take the best
    reference of their completeness; curated ones only for their own kind of piece. A console with games is measured
    against the console and its games, which is no comparison that may alert.
    """
    best, peers = m["_best"], m["_peers"]
    worth = F.when(m["per_piece"].isNotNull(), lot_ceiling(m["pieces"], m["per_piece"], F.coalesce(m["filler"], F.lit(False)))).otherwise(cents(m["_piece"] * m["pieces"]))
    source = F.when(m["per_piece"].isNotNull(), CEILING_SOURCE).otherwise(PEER_SOURCE)
    by_piece = F.when((m["pieces"] > 0) & ~F.coalesce(m["variable_price"], F.lit(False)) & worth.isNotNull(), F.struct(worth.alias("value"), source.alias("source"), F.lit("").alias("observed_at"), F.lit(True).alias("independent"), F.lit(False).alias("stale"), F.lit("").alias("region"), F.lit(0.5).alias("confidence")).cast(REFERENCE))
    usable = valuation.usable_reference(best["source"], m["expected"], m["kind"], m["kind_sure"])
    ranked = lambda r: F.struct(~r["independent"], r["stale"], F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv]), r["source"]), F.lit(99)), -r["confidence"])
    curated = F.when(best.isNotNull() & usable, best)
    chosen = F.when(curated.isNull(), peers).when(peers.isNull(), curated).when(ranked(peers) < ranked(curated), peers).otherwise(curated)
    own = F.when(m["lot"], by_piece).when(m["completeness"] != "", chosen)

    def finished(r: Column) -> Column:
        bundled = (m["kind"] == "console") & ~m["lot"]
        b = bundle_benchmark(r["value"], r["confidence"], r["source"], F.when(bundled, m["games"]), m["game_value"])
        adjusted = F.coalesce(b["value"] != r["value"], F.lit(False))
        foreign = F.coalesce(m["region"].isin("pal", "ntsc-j") & (F.coalesce(r["region"], F.lit("")) != m["region"]), F.lit(False))
        return F.when(r.isNotNull(), F.struct(b["value"].alias("value"), r["source"].alias("source"), r["observed_at"].alias("observed_at"), r["independent"].alias("independent"), r["stale"].alias("stale"), (~adjusted & ~foreign).alias("comparable")))

    return let(own, finished)


def priced(m: Column, evidence: Column) -> Column:
    """Struct of completion, functional_cost, ratio, price_band and meets for a row with its benchmark (b), given its page's evidence or null.

    What completes the piece is added on both sides of the target and of the ratio; without known shipping the ratio is
    that of the price.
    """
    done = valuation.completion(m["missing"], evidence["missing"], evidence["defects"])

    def costed(c: Column) -> Column:
        extra, taxes = F.coalesce(c["total"], F.lit(0.0)), F.coalesce(evidence["taxes"], F.lit(0.0))
        known = m["price"].isNotNull() & m["shipping"].isNotNull()
        base = cents(m["price"] + F.coalesce(m["shipping"], F.lit(0.0)) + taxes + extra)
        ratio = F.when(m["b"]["value"] > 0, base / m["b"]["value"])
        functional = F.when(known, base).otherwise(cents(m["price"] + extra))
        return F.struct(c.alias("completion"), functional.alias("functional_cost"), ratio.alias("ratio"), decision_band(ratio).alias("price_band"), meets_target(m["price"], functional, m["target"], known).alias("meets"), known.alias("shipping_known"))

    return let(done, costed)


def cheapest_of_each(df: DataFrame, cheap: str, order: str, most: int) -> DataFrame:
    """The rows of (search, listing and more) with `_asked`: is it among the `most` first of its search for which `cheap` holds, by this order and listing?

    A search's listings are ranked in DEALT parts; only the first of each part meet in one group, all others stay dealt.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy("search", *by).orderBy(order, "listing"))
    x = df.withColumn("_part", F.pmod(F.xxhash64("listing"), F.lit(DEALT)))
    x = x.withColumn("_near", F.col(cheap) & (place(cheap, "_part") <= most)).withColumn("_part", F.when(~F.col("_near"), F.col("_part")))
    return x.withColumn("_asked", F.col("_near") & (place("_near", "_part") <= most)).drop("_near", "_part")


def valued(matched: DataFrame, references: DataFrame, details: DataFrame, observed_at: str, most: int = MOST_DETAILS) -> DataFrame:
    """Every matched listing with b (its benchmark), p (costs, ratio and band by price), v (valuation.VERDICT), s (score), and read.

    matched: search, listing, title (what it is attributed to, or empty), kind, kind_sure, expected (kind, or empty),
    completeness (cib, loose, or empty for what is compared with neither), objective_id, objective_status, price, shipping,
    region, lot, pieces (null unless confirmed), filler, variable_price, per_piece, games, game_value, missing, target,
    confidence, tested, untested, unverified, seller_known, has_details (the source can give pages). references: search,
    title, completeness and the fields of REFERENCE. details: listing and evidence (EVIDENCE), one row a listing.

    Candidates for reading are those of a good band by price or at their target, the cheapest `most` of each search by
    ratio; ties by listing. A source that can give pages and didn't give one blocks the best band.
    """
    keys = ["search", "title", "completeness"]
    x = matched.join(best_references(references), keys, "left").join(peer_references(matched, observed_at), keys, "left").join(lot_peers(matched), "search", "left")
    row = F.struct(*[F.col(c) for c in x.columns])
    x = x.withColumn("_m", row).withColumn("b", benchmark(F.col("_m"))).drop("_m", "_best", "_peers", "_piece")
    nothing = F.lit(None).cast(EVIDENCE)
    row = lambda df: F.struct(*[F.col(c) for c in df.columns])
    first = x.withColumn("_p", priced(row(x), nothing))
    looks_cheap = F.col("has_details") & (F.coalesce(F.col("_p.price_band").isin("ganga", "buena"), F.lit(False)) | F.coalesce("_p.meets", F.lit(False)))
    asked = cheapest_of_each(first.withColumn("_cheap", looks_cheap).withColumn("_order", F.coalesce("_p.ratio", F.lit(NO_RATIO))), "_cheap", "_order", most)
    chosen = asked.drop("_p", "_cheap", "_order")
    read = chosen.join(details.select("listing", F.col("evidence").alias("_evidence")), "listing", "left").withColumn("_evidence", F.when(F.col("_asked"), F.col("_evidence"))).drop("_asked")
    final = read.withColumn("p", priced(row(read), F.col("_evidence")))
    e, p = F.col("_evidence"), F.col("p")
    a = valuation.assessed(
        band=p["price_band"], ratio=p["ratio"], match_confidence=F.col("confidence"), item_kind=F.col("kind"), item_confident=F.col("kind_sure"), is_lot=F.col("lot"), lot_quantity=F.when(F.col("pieces") > 0, "confirmed").otherwise("unconfirmed"),
        lot_filler=F.when(F.col("filler"), F.array(F.lit("relleno"))), untested=F.col("untested"), details_expected=F.col("has_details"), evidence_read=e.isNotNull(), defects=e["defects"], missing=e["missing"], returns_accepted=e["returns_accepted"], images=e["images"],
        objective_id=F.col("objective_id"), objective_status=F.col("objective_status"), incomplete=p["completion"].isNotNull(), benchmark=F.col("b").cast("struct<value: double, source: string, observed_at: string, independent: boolean, stale: boolean, comparable: boolean>").dropFields("value"),
        shipping_known=p["shipping_known"], availability_verified=e["available"],
    )
    judged = final.withColumn("_a", a).withColumn("v", valuation.gates(F.col("_a"))).drop("_a")
    s = valuation.score(
        p["ratio"], F.col("b"), F.col("confidence"), F.col("tested"), F.col("untested"), e["defects"], F.lit(None).cast("string"), F.col("completeness") != "", F.col("seller_known"), e["returns_accepted"], F.lit(None).cast("boolean"), F.col("price"), F.col("shipping"), F.col("unverified"), F.col("v.penalty"),
    )
    return judged.withColumn("s", s).withColumn("read", e.isNotNull()).drop("_evidence")
