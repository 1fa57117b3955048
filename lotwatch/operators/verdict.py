"""Judging listings against saved searches: one expression per rule, each giving a reason, a block or a doubt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwatch.functions.money import confidence
from lotwatch.functions.text import COMPLETENESS_SIGNALS, completeness_of, contains_term, first_signal, let, normalize, region_of

# Words by which listings say what state they are in, and how they deny being a copy.
TESTED = ("tested", "working", "fully functional", "functional", "probado", "funciona")
UNTESTED = ("untested", "not tested", "as-is", "as is", "for parts", "parts only", "sin probar")
REPRODUCTION = ("reproduction", "repro", "bootleg", "counterfeit", "fake", "pirata")
CASE_ONLY = ("case only", "box only", "manual only", "empty case", "no disc", "no game")
NEGATED_COPY = r"\b(?:not|no|non|never|zero)\s+(?:a\s+|an\s+)?(?:repro(?:duction)?s?|fakes?|bootlegs?|counterfeits?|clones?|copy|copies)\b"


def item(kind: str, text: Column | str, when: Column, signals: int = 0, hit: Column | None = None) -> Column:
    """A rule's finding, or null where it doesn't apply."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(when, F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(signals).alias("signals"), (F.lit(0) if hit is None else hit.cast("int")).alias("hit")))


def text_signals(title: Column, criteria: dict[str, Column]) -> Column:
    """What the rules look at in a title, given the criteria's terms (include, any, exclude, prefer): the same for equal ones."""
    terms = lambda name: F.transform(F.coalesce(criteria.get(name, F.lit(None)).cast("array<string>"), F.array().cast("array<string>")), lambda t: normalize(t)).alias(name)
    base = F.struct(normalize(title).alias("text"), *map(terms, ("include", "any", "exclude", "prefer")))

    def read(b: Column) -> Column:
        text, holds = b["text"], lambda t: contains_term(b["text"], t)
        return F.struct(
            *[b[c].alias(c) for c in ("include", "any", "prefer")],
            completeness_of(text).alias("declared"), region_of(text).alias("seen"), F.filter(b["include"], lambda t: ~holds(t)).alias("missing"), F.filter(b["exclude"], holds).alias("banned"), F.exists(b["any"], holds).alias("some"), F.exists(b["prefer"], holds).alias("liked"),
            (let(F.regexp_replace(text, NEGATED_COPY, " "), lambda t: first_signal(t, REPRODUCTION)) != "").alias("copy"), (first_signal(text, UNTESTED) != "").alias("untested"), (first_signal(text, TESTED) != "").alias("works"), (first_signal(text, CASE_ONLY) != "").alias("case"),
        )

    return let(base, read)


def _given(signals: Column, price: Column, shipping: Column, criteria: dict[str, Column]) -> Column:
    """Signals, numbers and criteria as one struct."""
    get = lambda name, kind: criteria.get(name, F.lit(None)).cast(kind).alias(name)
    numbers = [get(k, "double") for k in ("max_item", "max_total", "min_lot", "lot")]
    return F.struct(signals.alias("d"), price.alias("price"), shipping.alias("shipping"), *numbers, get("completeness", "string"), get("region", "string"), get("tested", "boolean"), get("allow_copies", "boolean"))


def findings(signals: Column, price: Column, shipping: Column, criteria: dict[str, Column]) -> Column:
    """What judge() sums: an array of kind, text, signals and hit, in the order of the rules."""
    return let(_given(signals, price, shipping, criteria), _findings)


def summed(found: Column) -> Column:
    """The verdict on an array of findings, from whichever rules."""
    return let(found, _summed)


def judge(signals: Column, price: Column, shipping: Column, criteria: dict[str, Column]) -> Column:
    """Struct of matched, confidence, reasons, blockers and unverified, from text_signals() and the numbers.

    criteria may further hold: max_item, max_total, min_lot, lot (numbers), completeness, region (text), tested and
    allow_copies (booleans). Missing or null criteria don't judge.
    """
    return summed(findings(signals, price, shipping, criteria))


def evaluate(title: Column, price: Column, shipping: Column, criteria: dict[str, Column]) -> Column:
    """judge() on a title's own text_signals(); for many listings of few titles read those once a title and join them."""
    return judge(text_signals(title, criteria), price, shipping, criteria)


def _findings(b: Column) -> Column:
    """What the rules find, in their order."""
    d = b["d"]
    include, any_, prefer, missing, banned, some, liked = d["include"], d["any"], d["prefer"], d["missing"], d["banned"], d["some"], d["liked"]
    price, shipping, total = b["price"], b["shipping"], b["price"] + F.coalesce(b["shipping"], F.lit(0.0))
    max_item, max_total, min_lot, lot = b["max_item"], b["max_total"], b["min_lot"], b["lot"]
    want, declared, region, seen = b["completeness"], d["declared"], b["region"], d["seen"]
    tested, copies = F.coalesce(b["tested"], F.lit(False)), F.coalesce(b["allow_copies"], F.lit(False))
    is_copy, untested, works = d["copy"], d["untested"], d["works"]
    findings = F.array(
        item("block", F.concat(F.lit("excluded: "), F.array_join(banned, ", ")), F.size(banned) > 0),
        item("block", F.concat(F.lit("missing: "), F.array_join(missing, ", ")), F.size(missing) > 0, 1),
        item("reason", "all terms", (F.size(include) > 0) & (F.size(missing) == 0), 1, F.lit(True)),
        item("block", "none of the terms", (F.size(any_) > 0) & ~some, 1),
        item("reason", "one of the terms", (F.size(any_) > 0) & some, 1, F.lit(True)),
        item("reason", "preferred term", (F.size(prefer) > 0) & liked, 1, F.lit(True)),
        item("note", "no preferred term", (F.size(prefer) > 0) & ~liked, 1),
        item("block", "too few pieces", lot < min_lot, 1),
        item("unverified", "pieces not declared", min_lot.isNotNull() & lot.isNull(), 1),
        item("reason", "enough pieces", lot >= min_lot, 1, F.lit(True)),
        item("block", "price above the limit", price > max_item, 1),
        item("reason", "price within the limit", price <= max_item, 1, F.lit(True)),
        item("unverified", "shipping unknown", max_total.isNotNull() & shipping.isNull() & (price <= max_total)),
        item("block", "total above the limit", F.when(shipping.isNull(), price > max_total).otherwise(total > max_total), 1),
        item("reason", "total within the limit", shipping.isNotNull() & (total <= max_total), 1, F.lit(True)),
        item("block", "not tested", tested & untested, 1),
        item("reason", "tested", tested & works & ~untested, 1, F.lit(True)),
        item("unverified", "working order not declared", tested & ~works & ~untested, 1),
        item("block", "other completeness", want.isNotNull() & (declared != "") & (declared != want), 1),
        item("reason", "completeness", want.isNotNull() & (declared == want), 1, F.lit(True)),
        item("unverified", "completeness not declared", want.isNotNull() & (declared == ""), 1),
        item("block", "case without content", d["case"]),
        item("block", "declared copy", is_copy & ~copies),
        item("block", "other region", region.isNotNull() & (seen != "") & (seen != region), 1),
        item("reason", "region", region.isNotNull() & (seen == region), 1, F.lit(True)),
        item("unverified", "region not declared", region.isNotNull() & (seen == ""), 1),
    )
    return F.filter(findings, lambda x: x.isNotNull())


def _summed(f: Column) -> Column:
    of = lambda kind: F.transform(F.filter(f, lambda x: x["kind"] == kind), lambda x: x["text"])
    count = lambda field: F.aggregate(f, F.lit(0), lambda a, x: a + x[field])
    blocked = F.size(of("block")) > 0
    sure = confidence(count("hit"), count("signals"), F.size(of("unverified")), blocked)
    return F.struct((~blocked).alias("matched"), sure.alias("confidence"), of("reason").alias("reasons"), of("block").alias("blockers"), of("unverified").alias("unverified"))


__all__ = ["COMPLETENESS_SIGNALS", "evaluate", "judge", "text_signals"]
