"""Price references of a catalog, with where they come from and whether they are evidence of their own; and what they hold for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions.folding import let
from lotwatch.functions.text import distinct_ci

# Objectives that are compared with their own kind; names of currencies; where a search of closed sales leads.
PEERED = ("game-loose", "game-cib", "console-loose", "console-cib")
LOCAL_MONEY, DOLLARS = ("", "$", "$U", "$U.", "UYU", "PESO", "PESOS"), ("US$", "U$S", "USD", "DOLAR", "DOLARES", "DÓLAR", "DÓLARES")
SOLD_URL = "https://www.ebay.com/sch/i.html?_nkw={}&_sacat=0&LH_Sold=1&LH_Complete=1"
#: A stored price is a copy of another below this difference.
SAME = 0.01
SOURCES = "struct<precioPriceChart: string, precioEbaySold: string, precioCIB: string, precioGameStop: string>"
CATALOG = f"id string, precioPriceChart string, precioEbaySold string, precioCIB string, precioGameStop string, precioNotas struct<verificadoEn: string, fuentes: {SOURCES}>"
REFERENCE = "array<struct<source: string, value: double, completeness: string, condition: string, observed_at: string, confidence: double, independent: boolean, notes: string>>"


def positive(value: Column) -> Column:
    """An amount above 0, in cents; null for anything else."""
    x = value.try_cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), F.round(x, 2))


def _reference(source: str, value: Column, completeness: str, observed: Column, confidence: Column | float, independent: Column | bool, notes: Column, condition: str = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(value.isNotNull(), F.struct(
        F.lit(source).alias("source"), value.alias("value"), F.lit(completeness).alias("completeness"), F.lit(condition).alias("condition"), F.coalesce(observed, F.lit("")).alias("observed_at"), lit(confidence).alias("confidence"),
        lit(independent).alias("independent"), F.coalesce(notes, F.lit("")).alias("notes"),
    ))


def console_references(row: DataFrame) -> DataFrame:
    """A row for each price that a console's catalog entry (CATALOG) holds: entity and the fields of REFERENCE.

    A price of closed sales that its note calls a proxy, or that repeats the price guide's to the cent, is no evidence of
    its own. What one would pay is a rule of one's own and no reference.
    """
    sources = F.col("precioNotas.fuentes")
    at = F.col("precioNotas.verificadoEn")
    prices = F.struct(*[positive(F.col(c)).alias(c) for c in ("precioPriceChart", "precioEbaySold", "precioCIB", "precioGameStop")])

    def listed(p: Column) -> Column:
        note = F.coalesce(sources["precioEbaySold"], F.lit(""))
        proxy = F.contains(F.lower(note), F.lit("proxy")) | F.coalesce(F.abs(p["precioEbaySold"] - p["precioPriceChart"]) < SAME, F.lit(False))
        told = F.when((note == "") & proxy, "Copia de PriceCharting: no es evidencia independiente").otherwise(note)
        return F.array(
            _reference("pricecharting", p["precioPriceChart"], "loose", at, 0.8, True, sources["precioPriceChart"]), _reference("ebay-sold", p["precioEbaySold"], "loose", at, F.when(proxy, 0.35).otherwise(0.9), ~proxy, told),
            _reference("pricecharting", p["precioCIB"], "cib", at, 0.8, True, sources["precioCIB"]), _reference("retail", p["precioGameStop"], "loose", at, 0.6, True, sources["precioGameStop"], "refurbished"),
        ).cast(REFERENCE)

    each = row.select(F.coalesce("id", F.lit("")).alias("entity"), F.explode(F.filter(let(prices, listed), lambda r: r.isNotNull())).alias("r"))
    return each.select("entity", "r.*")


def game_references(games: DataFrame) -> DataFrame:
    """console, game and a reference for games with a typical price. games: console, game, low, mid, high, notes.

    The price is that of shops for a loose copy; its day is the one that the notes name, and without it confidence is less.
    """
    mid = positive(F.col("mid"))
    at = F.regexp_extract(F.coalesce("notes", F.lit("")), r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    r = _reference("retail", mid, "loose", at, F.when(at != "", 0.6).otherwise(0.45), True, F.lit("Precio típico del catálogo para copia suelta."))
    return games.select("console", "game", r.alias("r"), positive(F.col("low")).alias("low"), positive(F.col("high")).alias("high")).filter("r IS NOT NULL").select("console", "game", "r.*", "low", "high")


def entity_references(searches: DataFrame, consoles: DataFrame, games: DataFrame) -> DataFrame:
    """search and the references of what it points to: a game by (console, game), a console by its id, nothing else.

    searches: search, entity_type, entity, console; consoles: console_references(); games: game_references(). The same game
    id stands for other games on other platforms.
    """
    values = ["source", "value", "completeness", "condition", "observed_at", "confidence", "independent"]
    of_game = searches.filter("entity_type = 'game' AND entity <> '' AND console <> ''").join(games.select("console", F.col("game").alias("entity"), *values), ["console", "entity"]).select("search", *values)
    of_console = searches.filter("entity_type = 'console' AND entity <> ''").join(consoles.select("entity", *values), "entity").select("search", *values)
    return of_game.unionByName(of_console)


def expected_kind(search_type: Column, entity_type: Column) -> Column:
    """The kind of piece that a search accepts, or the empty string for any: lots and discoveries take what comes."""
    return F.when(search_type.isin("lot", "discovery"), "").when(entity_type.isin("console", "game", "accessory"), entity_type).when(search_type == "console", "console").otherwise("")


def target_applies(kind: Column, variable_price: Column, entity_type: Column) -> Column:
    """May a search's target be held against this piece? Not against the price of a choice, nor a piece of another kind."""
    return ~F.coalesce(variable_price, F.lit(False)) & ((F.coalesce(entity_type, F.lit("")) == "") | F.coalesce(kind == entity_type, F.lit(False)))


def objective_completeness(objective: Column, status: Column) -> Column:
    """What a listing of this objective is compared with: cib, loose, or nothing."""
    peered = F.coalesce(objective.isin(*PEERED), F.lit(False)) & (F.coalesce(status, F.lit("")) != "incomplete")
    return F.when(peered, F.when(objective.endswith("-cib"), "cib").otherwise("loose")).otherwise("")


def currency(name: Column, default: str = "UYU") -> Column:
    """A currency's code by the names that it goes by."""
    known = F.upper(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))
    return F.when(known.isin(*LOCAL_MONEY), default).when(known.isin(*DOLLARS), "USD").otherwise(F.substring(known, 1, 8))


def sold_link(query: Column) -> Column:
    """Where a marketplace shows closed sales of a query; null for a blank one."""
    clean = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    before, after = SOLD_URL.split("{}")
    return F.when(clean != "", F.concat(F.lit(before), F.url_encode(clean), F.lit(after)))


def search_queries(main: Column, more: Column) -> Column:
    """A search's queries: the main one, then the others, white space collapsed, each in its first spelling."""
    every = F.concat(F.array(F.coalesce(main, F.lit(""))), F.coalesce(more, F.array().cast("array<string>")))
    return distinct_ci(F.transform(every, lambda q: F.regexp_replace(F.coalesce(q, F.lit("")), r"\s+", " ")), None, 2**31 - 1)
