"""What searches are after: real wishes, consoles, lots or recommendations; what they target already; and who may be alerted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions.folding import let
from lotwatch.functions.money import money_es
from lotwatch.operators import valuation
from lotwatch.operators.valuation import true

INTENTS = ("wishlist", "console", "lot", "manual", "recommendation", "discovery")


def wished_keys(wishes: DataFrame, releases: DataFrame) -> DataFrame:
    """Distinct (console, game) that are wished for: games of wishes, and a wished collection's primary releases, by game and by release.

    wishes: kind (games or franchise), console, game (one row a game), franchise; releases: franchise, release, primary, console
    (the catalog's, or null), platform, game.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    games = wishes.filter((F.col("kind") == "games") & full("console") & full("game")).select("console", "game")
    own = releases.filter("primary").join(wishes.filter("kind = 'franchise'").select("franchise").distinct(), "franchise", "left_semi")
    console = F.coalesce(F.nullif(F.col("console"), F.lit("")), F.col("platform"), F.lit(""))
    each = own.select(console.alias("console"), F.explode(F.array_distinct(F.filter(F.array("game", "release"), lambda x: F.coalesce(x, F.lit("")) != ""))).alias("game"))
    return games.unionByName(each).distinct()


def _intent(search_type: Column, entity_type: Column, has_game: Column, wished: Column) -> Column:
    return (
        F.when(search_type == "lot", "lot").when(search_type == "discovery", "discovery").when((entity_type == "console") | (search_type == "console"), "console")
        .when(has_game, F.when(wished, "wishlist").otherwise("recommendation")).otherwise("manual")
    )


def match_intents(matches: DataFrame, wished: DataFrame) -> DataFrame:
    """matches with `intent`: what each is after. The title that found a listing counts, not the search that holds it.

    matches: search_type, entity_type, console, entity (of the search), target_console, target_game (of the title, or null).
    """
    titled = F.coalesce(F.col("target_game"), F.lit("")) != ""
    of_game = (F.col("entity_type") == "game") & (F.coalesce(F.col("entity"), F.lit("")) != "")
    console = F.when(titled, F.coalesce(F.nullif(F.col("target_console"), F.lit("")), F.col("console"), F.lit(""))).otherwise(F.coalesce("console", F.lit("")))
    game = F.when(titled, F.col("target_game")).when(of_game, F.col("entity"))
    keys = wished.select(F.col("console").alias("_console"), F.col("game").alias("_game"), F.lit(True).alias("_wished")).distinct()
    x = matches.withColumn("_console", console).withColumn("_game", game).join(keys, ["_console", "_game"], "left")
    return x.withColumn("intent", _intent(F.coalesce("search_type", F.lit("")), F.coalesce("entity_type", F.lit("")), titled | F.coalesce(of_game, F.lit(False)), true(F.col("_wished")))).drop("_console", "_game", "_wished")


def title_wishes(titles: DataFrame, wished: DataFrame) -> DataFrame:
    """titles (a row each, with target_game) with `wished_on`: the consoles on which that game is wished for, null if on none."""
    on = wished.groupBy(F.col("game").alias("target_game")).agg(F.collect_set("console").alias("wished_on"))
    return titles.join(on.hint("merge"), "target_game", "left")


def searched_match_intents(matches: DataFrame, searches: DataFrame, wished: DataFrame) -> DataFrame:
    """The intents of match_intents() for matches that are many: they meet their searches once, and no wishes.

    matches: search, target_console, target_game and its wished_on, see title_wishes(), and other columns, which are returned;
    searches: search, search_type, entity_type, console, entity. No table is broadcast, as compressed files look small enough for it.
    """
    titled, named = F.coalesce(F.col("target_game"), F.lit("")) != "", F.nullif(F.col("target_console"), F.lit(""))
    # What is wished on the title's own console is known by now; only a title without one waits for that of the search.
    hit = F.when(titled & named.isNotNull(), true(F.array_contains("wished_on", named)))
    open_on = F.when(titled & named.isNull(), F.coalesce("wished_on", F.array().cast("array<string>")))
    rest = [c for c in matches.columns if c not in ("target_console", "target_game", "wished_on")]
    none = searches.withColumn("target_console", F.lit("")).withColumn("target_game", F.lit(""))
    own = match_intents(none, wished.hint("merge")).select("search", F.coalesce("console", F.lit("")).alias("_console"), F.col("intent").alias("_own"))
    x = matches.select(*rest, hit.alias("_hit"), open_on.alias("_on")).join(own.hint("merge"), "search")
    by_title = F.col("_own").isin("wishlist", "recommendation", "manual") & (F.col("_hit").isNotNull() | F.col("_on").isNotNull())
    wish = F.coalesce("_hit", F.array_contains("_on", F.col("_console")))
    return x.select(*rest, F.when(by_title, F.when(wish, "wishlist").otherwise("recommendation")).otherwise(F.col("_own")).alias("intent"))


def search_intents(searches: DataFrame, targets: DataFrame, wished: DataFrame, strict: bool = False) -> DataFrame:
    """search and its intent: the best of its titles, or with `strict` a wish only if all its titles are; see both_intents()."""
    return both_intents(searches, targets, wished).select("search", F.col("strict" if strict else "intent").alias("intent"))


def both_intents(searches: DataFrame, targets: DataFrame, wished: DataFrame) -> DataFrame:
    """search, its intent by the best of its titles, and `strict`, a wish only if all its titles are, from one pass over them.

    searches: search, search_type, entity_type, console, entity; targets: search, target_console, target_game.
    """
    none = searches.withColumn("target_console", F.lit("")).withColumn("target_game", F.lit(""))
    own = match_intents(none, wished).select("search", "intent")
    titled = searches.join(targets.filter(F.coalesce("target_game", F.lit("")) != ""), "search")
    hit = F.col("intent") == "wishlist"
    hits = match_intents(titled, wished).groupBy("search").agg(F.bool_or(hit).alias("_any"), F.bool_and(hit).alias("_all"))
    x = own.join(hits, "search", "left")
    by_titles = lambda c: F.when(F.col("intent").isin("recommendation", "manual") & F.col(c).isNotNull(), F.when(F.col(c), "wishlist").otherwise("recommendation")).otherwise(F.col("intent"))
    return x.select("search", by_titles("_any").alias("intent"), by_titles("_all").alias("strict"))


def targeted(searches: DataFrame, targets: DataFrame) -> DataFrame:
    """What searches are after already, as distinct (kind, console, game): console, lot (game is null for both) and game.

    A lot of a console isn't that console. A search without a console names no game by its titles.
    """
    s = searches.select("search", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("search_type", "entity_type", "console", "entity")])
    lot, of_console = F.col("search_type") == "lot", (F.col("entity_type") == "console") & (F.col("entity") != "")
    entry = lambda when, kind, console, game: F.when(when, F.struct(F.lit(kind).alias("kind"), console.alias("console"), game.cast("string").alias("game")))
    no_game, full = F.lit(None), (F.col("console") != "") & (F.col("entity") != "")
    lots = F.when(of_console, F.col("entity")).when((F.col("console") != "") & (F.col("entity") == ""), F.col("console"))
    own = F.array(entry(~lot & of_console, "console", F.col("entity"), no_game), entry(lot & lots.isNotNull(), "lot", lots, no_game), entry(full, "game", F.col("console"), F.col("entity")))
    direct = s.select(F.explode(F.filter(own, lambda e: e.isNotNull())).alias("e")).select("e.*")
    titles = targets.filter(F.coalesce("target_game", F.lit("")) != "").join(s.filter("console <> ''").select("search", "console"), "search").select(F.lit("game").alias("kind"), "console", F.col("target_game").alias("game"))
    return direct.unionByName(titles).distinct()


def alert_review(verdict: Column, band: Column, benchmark: Column, evidence_read: Column, shipping_known: Column, intents: Column, meets: Column) -> Column:
    """Struct of eligible (for an alert), reasons against it, and candidate: cheap as an opportunity, but something is against it."""
    wanted = true(F.arrays_overlap(intents, F.array(*map(F.lit, valuation.ALERTING))))
    why = F.when(true(F.array_contains(intents, "recommendation")), "es una recomendación, no un deseo").otherwise("la búsqueda no apunta a un deseo, una consola que falta ni un lote elegido")
    against = F.concat(valuation.alert_clearance(verdict, band, benchmark, evidence_read, shipping_known), F.when(wanted, F.array().cast("array<string>")).otherwise(F.array(why)))
    cheap = true(verdict["price_band"].isin("ganga", "buena")) | true(meets)
    return let(against, lambda rs: F.struct((F.size(rs) == 0).alias("eligible"), rs.alias("reasons"), ((F.size(rs) > 0) & cheap).alias("candidate")))


def cost_sentence(item: Column, shipping: Column, taxes: Column, extras: Column, total: Column, market: Column, courier: Column, currency: Column) -> Column:
    """The sum in one sentence: what was added, what is estimated, and what isn't known; the empty text without a price.

    extras: array<struct<label, amount>> of what completes the piece. market: import, local or auction.
    """
    money = lambda x: F.concat(currency, F.lit(" "), F.coalesce(money_es(x), F.lit("?")))
    local, text = market == "local", F.lit
    sent = F.when(shipping > 0, F.concat(money(shipping), F.when(local, " de envío local").otherwise(" de envío"))).when(shipping.isNotNull(), F.when(local, "sin envío").otherwise("envío gratis"))
    parts = F.concat(
        F.array(money(item), sent, F.when(taxes > 0, F.concat(money(taxes), text(" de impuestos informados")))),
        F.transform(F.coalesce(extras, F.array().cast("array<struct<label: string, amount: double>>")), lambda e: F.concat(e["label"], text(" estimado en "), money(e["amount"]))),
    )
    added = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " + ")
    before = F.concat(text(" antes del courier"), F.when(courier.isNotNull(), F.concat(text(" (courier a Uruguay ≈ "), money(courier), text(", estimado por peso)."))).otherwise(" (courier a Uruguay sin calcular: falta el peso)."), F.when(taxes.isNull(), " Impuestos: la fuente no los informa.").otherwise(""))
    end = F.when(local, ", compra local (sin courier ni IVA de importación).").when(market == "auction", " con los cargos del remate.").otherwise(before)
    open_ = F.when(shipping.isNull(), ", con el envío todavía sin confirmar").otherwise("")
    return F.when(item.isNull(), "").otherwise(F.concat(added, text(" = "), money(total), open_, end))
