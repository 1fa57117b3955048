"""Rules over titles, weights, benchmarks, runs and days, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.money import cents
from lotwatch.functions.text import completeness_of, contains_term, normalize, region_of

# Numbers of sequels, words that make a number a quantity, media of which "disc only" names one; revisions
# of consoles; Spanish days and months; sources whose prices hold bundles already.
SEQUEL_NUMBERS = ("2", "3", "4", "5", "6", "7", "8", "9")
QUANTITY_WORDS = (
    "disc", "discs", "disk", "disks", "cd", "cds", "dvds", "player", "players", "games", "controllers", "remotes", "copies", "cartridges", "carts", "pack", "packs", "pk",
    "pcs", "pieces", "screw", "screws",
)
LOOSE_MEDIA_WORDS = ("disc", "disk", "cd")
CONSOLE_VARIANTS = (("super-slim", r"\bsuper\s*slim\b"), ("slim", r"\bslim\b"), ("fat", r"\bfat\b|\bphat\b|\boriginal\b"))
WEEKDAYS = ("lun", "mar", "mie", "jue", "vie", "sab", "dom")
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
BUNDLE_GAMES, BUNDLE_CONFIDENCE = 10, 0.8
MANUAL_MINUTES = 30


def is_sequel_number(tokens: Column, at: Column) -> Column:
    """Is the token at this place (from 1) a sequel's number, and not a quantity? "2 in 1" and "2 discs" aren't, "2 disc only" is."""
    token = lambda k: F.try_element_at(tokens, (at + k).cast("int"))
    noun, then = token(1), token(2)
    compiled = (noun == "in") & F.coalesce(then.rlike(r"^\d+$"), F.lit(False))
    loose = noun.isin(*LOOSE_MEDIA_WORDS) & F.coalesce(then == "only", F.lit(False)) & token(2).isNotNull()
    right = F.when(noun.isNull(), True).when(compiled, False).when(noun.isin(*QUANTITY_WORDS), loose).otherwise(True)
    return F.coalesce(token(0).isin(*SEQUEL_NUMBERS), F.lit(False)) & right


def names_a_sequel(tokens: Column, core: Column, subtitle: Column) -> Column:
    """Is every mention of a title followed by a number that it doesn't have? With its subtitle where all of that is there."""
    name = F.when(F.size(F.array_except(subtitle, tokens)) == 0, F.concat(core, subtitle)).otherwise(core)
    size = F.size(name)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - size + 1, F.lit(1))), lambda i: F.slice(tokens, i, size) == name)
    followed = F.forall(places, lambda i: is_sequel_number(tokens, i + size))
    return (F.size(places) > 0) & followed & ~F.element_at(name, -1).rlike(r"\d$")


def console_variant(title: Column) -> Column:
    """The revision that a title declares, else the empty string."""
    text = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit("")
    for name, pattern in reversed(CONSOLE_VARIANTS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def console_weight(general: Column, variants: Column, variant: Column) -> Column:
    """The weight of the declared revision, else of the console in general, if that is above 0. variants: map of kilograms."""
    own = F.try_element_at(variants, variant)
    return F.when(own > 0, own).when(general > 0, general)


def bundle_benchmark(value: Column, confidence: Column, source: Column, games: Column, game_value: Column) -> Column:
    """Benchmark and confidence with up to ten declared games added; prices of peers hold bundles already."""
    counts = F.coalesce((games > 0) & (game_value > 0) & (source != "peer-listings"), F.lit(False))
    extra = cents(F.least(games, F.lit(BUNDLE_GAMES)) * game_value)
    return F.struct(F.when(counts, cents(value + extra)).otherwise(value).alias("value"), F.when(counts, F.round(confidence * BUNDLE_CONFIDENCE, 3)).otherwise(confidence).alias("confidence"))


def run_status(failed: Column, total: Column) -> Column:
    """failed where all searches failed, degraded where some did."""
    return F.when((total > 0) & (failed == total), "failed").when(failed > 0, "degraded").otherwise("completed")


def satisfies_slot(finished: Column, slot: Column, minutes: int = MANUAL_MINUTES) -> Column:
    """Did a run by hand end within so many minutes before a slot?"""
    before = F.unix_timestamp(slot) - F.unix_timestamp(finished)
    return F.coalesce((before >= 0) & (before <= 60 * minutes), F.lit(False))


def closing_label(day: Column, today: Column) -> Column:
    """Cierra hoy, mañana or neither, with weekday, day and month in Spanish."""
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int"))
    readable = F.concat_ws(" ", name(WEEKDAYS, F.weekday(day) + 1), F.lpad(F.dayofmonth(day).cast("string"), 2, "0"), name(MONTHS, F.month(day)))
    ahead = F.datediff(day, today)
    return F.when(ahead == 0, F.concat(F.lit("Cierra hoy — "), readable)).when(ahead == 1, F.concat(F.lit("Cierra mañana — "), readable)).otherwise(F.concat(F.lit("Cierra "), readable))


def note_date(note: Column) -> Column:
    """The first day that a note names, as text like 2026-01-31."""
    return F.nullif(F.regexp_extract(note, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit(""))


def variant(title: Column, editions: tuple[str, ...]) -> Column:
    """boxed or loose, region and edition: what makes two copies of a title differ."""
    text = normalize(title)
    edition = F.lit("")
    for e in reversed(editions):
        edition = F.when(contains_term(text, e), e).otherwise(edition)
    boxed = completeness_of(text).isin("boxed", "cib", "sealed")
    return F.struct(F.when(boxed, "boxed").otherwise("loose").alias("shape"), region_of(text).alias("region"), edition.alias("edition"))


def best_with_finders(results: DataFrame, item: str, search: str, *order: Column) -> DataFrame:
    """Each item's best result, with the number of searches that found it and the first of their names."""
    best = Window.partitionBy(item).orderBy(*order)
    found = results.groupBy(item).agg(F.countDistinct(search).alias("searches"), F.min(search).alias("first_search"))
    return results.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn").join(found, item)


def first_wish(feed: DataFrame, wishes: DataFrame, key: str, position: str, wish: str) -> DataFrame:
    """Each listing of a feed with the first wish, by position, for its title; listings without one are left out."""
    first = wishes.groupBy(key).agg(F.min_by(wish, position).alias(wish))
    return feed.join(first, key)
