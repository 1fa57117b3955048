"""Amounts, shipping, charges and scores as expressions over double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of price over benchmark, courier rates per kg, weights in kg, prices of missing parts.
BANDS = (("ganga", 0.75), ("buena", 0.90), ("razonable", 1.10), ("premium", 1.30))
DEAREST = "caro"
COURIER_RATES = {("usa", "general"): 17.50, ("usa", "media"): 10.50, ("europa", "general"): 21.50, ("europa", "media"): 14.50}
WEIGHTS_KG = {
    ("game", "loose"): 0.15, ("game", "boxed"): 0.25, ("game", "cib"): 0.30, ("game", "sealed"): 0.30,
    ("console", "loose"): 3.0, ("console", "boxed"): 4.0, ("console", "cib"): 4.5, ("console", "sealed"): 4.5,
    ("accessory", "loose"): 0.4, ("accessory", "boxed"): 0.6, ("accessory", "cib"): 0.6, ("accessory", "sealed"): 0.6,
}
COMPLETION_COSTS = {"controller": 20.0, "cables": 15.0, "jumper-pak": 10.0, "battery-cover": 6.0, "charger": 10.0, "power-supply": 20.0, "av-cable": 8.0}
COMPLETION_PARENT = {"power-supply": "cables", "av-cable": "cables"}
SCORE_WEIGHTS = {"collection": 25, "price": 25, "condition": 15, "completeness": 15, "seller": 10, "logistics": 10}


def cents(x: Column, places: int = 2) -> Column:
    """Rounded half up, also where a double falls just short of the half that its decimal has."""
    return F.round(x + 1e-9, places)


def lookup(table: dict, *keys: Column) -> Column:
    """A constant table's value for these keys, else null."""
    pairs = [F.lit(x) for k, v in table.items() for x in ("|".join(k) if isinstance(k, tuple) else k, v)]
    return F.element_at(F.create_map(*pairs), F.concat_ws("|", *keys))


def amount(value: Column, least: float = 0.0) -> Column:
    """A finite amount of at least `least`, in cents; null for anything else, text that is no number included."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | (x < least), None).otherwise(F.round(x, 2))


def locale_amount(text: Column) -> Column:
    """A number written like 1.234,56: dots are thousands, the comma is decimal."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9.,-]", "")
    return F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def either_amount(text: Column) -> Column:
    """A number in English or Spanish writing: of two kinds of separators the last one is decimal.

    A single separator before three digits parts thousands, before any other number of digits it is decimal; of several
    of one kind all part thousands if three digits follow each, else the last is decimal.
    """

    def read(raw: Column) -> Column:
        last = F.regexp_extract(raw, "([.,])[^.,]*$", 1)
        other = F.when(last == ",", ".").otherwise(",")
        pieces = F.split(raw, "[.,]")
        n, tail = F.size(pieces), F.element_at(pieces, -1)
        joined = F.array_join(pieces, "")
        pointed = F.concat(F.array_join(F.slice(pieces, 1, F.greatest(n - 1, F.lit(0))), ""), F.lit("."), tail)
        threes = F.forall(F.slice(pieces, 2, F.greatest(n - 1, F.lit(0))), lambda p: F.char_length(p) == 3)
        alike = F.when(n == 2, F.when((F.char_length(tail) == 3) & (F.regexp_replace(pieces[0], "^[+-]+", "") != ""), joined).otherwise(pointed)).when(threes, joined).otherwise(pointed)
        mixed = F.replace(F.replace(raw, other, F.lit("")), last, F.lit("."))
        return F.when(last == "", raw).when(F.contains(raw, other), mixed).otherwise(alike).try_cast("double")

    return F.element_at(F.transform(F.array(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9,.+-]", "")), read), 1)


def total_amount(price: Column, shipping: Column) -> Column:
    """Price and shipping; the price where shipping isn't known."""
    return price + F.coalesce(shipping, F.lit(0.0))


def with_commission(price: Column, percent: Column, packaging: Column) -> Column:
    """What a bid costs in the end; 0 without a bid."""
    return F.when(F.coalesce(price, F.lit(0.0)) <= 0, 0.0).otherwise(cents(price * (1 + F.coalesce(percent, F.lit(0.0)) / 100) + F.coalesce(packaging, F.lit(0.0))))


def billable_weight(kg: Column) -> Column:
    """Up to the next 100 g, 100 g at least."""
    return F.when(kg <= 0.1, 0.1).otherwise(F.round(F.ceil(F.round(kg, 4) * 10) / 10, 2))


def courier(kg: Column, origin: Column, category: Column) -> Column:
    return F.round(billable_weight(kg) * lookup(COURIER_RATES, F.lower(origin), F.lower(category)), 2)


def weight_estimate(kind: Column, completeness: Column) -> Column:
    """Kilograms of a game, console or accessory; null for others; unknown completeness counts as loose."""
    shape = F.when(completeness.isin("loose", "boxed", "cib", "sealed"), completeness).otherwise("loose")
    return lookup(WEIGHTS_KG, kind, shape)


def cost_breakdown(price: Column, shipping: Column, kind: Column, completeness: Column, market: Column, origin: str = "usa", category: str = "general") -> Column:
    """Subtotal, weight, courier and imported total; only the import market has weight and courier."""
    subtotal = cents(total_amount(price, shipping))
    weight = F.when(market == "import", weight_estimate(kind, completeness))
    fee = courier(weight, F.lit(origin), F.lit(category))
    return F.struct(
        subtotal.alias("subtotal"), weight.alias("weight_kg"), billable_weight(weight).alias("billable_kg"), fee.alias("courier"),
        cents(subtotal + fee).alias("imported_total"), (price.isNotNull() & shipping.isNotNull()).alias("exact"),
    )


def decision_band(ratio: Column) -> Column:
    """The band of a price over its benchmark; null without one."""
    out = F.lit(DEAREST)
    for name, top in reversed(BANDS):
        out = F.when(ratio <= top, name).otherwise(out)
    return F.when(ratio.isNotNull(), out)


def price_points(ratio: Column, most: float = 25.0) -> Column:
    """All points at 0.75 of the benchmark or below, none from 1.30 on."""
    return cents(most * F.least(F.greatest((1.30 - ratio) / 0.55, F.lit(0.0)), F.lit(1.0)))


def confidence(hit: Column, total: Column, unverified: Column, blocked: Column) -> Column:
    """Share of the signals that were met, less what couldn't be verified; 0 if anything blocks."""
    base = F.when(total > 0, 0.4 + 0.6 * hit / total).otherwise(0.6) - 0.08 * unverified
    return F.when(blocked, 0.0).otherwise(F.round(F.least(F.greatest(base, F.lit(0.05)), F.lit(1.0)), 2))


def money_en(x: Column) -> Column:
    return F.format_number(x, 2)


def money_es(x: Column) -> Column:
    return F.translate(F.format_number(x, 2), ",.", ".,")


def auction_charges(price: Column, premium_percent: Column, tax_percent: Column, others: Column) -> Column:
    """Premium on a hammer price, tax on the premium, and the total with other charges."""
    premium = cents(price * (premium_percent / 100))
    tax = cents(premium * (tax_percent / 100))
    return F.struct(premium.alias("premium"), tax.alias("tax"), cents(price + premium + tax + F.coalesce(others, F.lit(0.0))).alias("total"))


def lot_ceiling(pieces: Column, ceiling: Column, filler: Column) -> Column:
    """The pieces' ceilings together, half of it for a lot of filler."""
    return cents(pieces * ceiling * F.when(filler, 0.5).otherwise(1.0))


def meets_target(price: Column, functional_cost: Column, target: Column, cost_known: Column) -> Column:
    """Does a piece, made ready, cost at most its target? Null without target or price.

    Where the shipping isn't known the cost is only a floor: above the target it is false, below it isn't known.
    """
    cost = F.coalesce(functional_cost, price)
    known = F.coalesce(cost_known, F.lit(False)) & functional_cost.isNotNull()
    judged = F.when(known, cost <= target).when(cost > target, False)
    return F.when((target > 0) & price.isNotNull(), judged)


def query_ceiling(general: Column, loose: Column, boxed: Column, completeness: Column) -> Column:
    """The price up to which a query's listings count: the title's ceiling, never above the search's own.

    A title may have a higher one for boxed copies; without it the loose one holds for all, without a loose one neither
    does. Where completeness isn't declared (null), as when a source is asked, the higher of the two holds.
    """
    own = F.when(boxed.isNull(), loose).when(completeness.isNull(), F.greatest(loose, boxed)).otherwise(F.when(completeness.isin("cib", "boxed", "sealed"), boxed).otherwise(loose))
    return F.when(loose.isNull(), general).otherwise(F.least(own, general))
