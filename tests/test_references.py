"""References of catalogs and small rules on rows that are known to be right."""

import pytest
from pyspark.sql import functions as F

from lotwatch.operators import references as R


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("v")).first()["v"]


def test_references_of_consoles(spark):
    notes = {"verificadoEn": "2026-01-01", "fuentes": {"precioPriceChart": "guide", "precioEbaySold": None, "precioCIB": "", "precioGameStop": "shop"}}
    entries = [("a", "100", "100.004", "250", "120", notes), ("b", "100", "90", None, None, notes), ("c", None, "80", "0", "-1", {"verificadoEn": None, "fuentes": {"precioPriceChart": "", "precioEbaySold": "es PROXY", "precioCIB": "", "precioGameStop": ""}}), ("d", "n/d", None, "NaN", "Infinity", None)]
    got = {(r["entity"], r["source"], r["completeness"]): (r["value"], r["confidence"], r["independent"], r["observed_at"]) for r in R.console_references(spark.createDataFrame(entries, R.CATALOG)).collect()}
    assert got == {
        ("a", "pricecharting", "loose"): (100.0, 0.8, True, "2026-01-01"), ("a", "ebay-sold", "loose"): (100.0, 0.35, False, "2026-01-01"), ("a", "pricecharting", "cib"): (250.0, 0.8, True, "2026-01-01"), ("a", "retail", "loose"): (120.0, 0.6, True, "2026-01-01"),
        ("b", "pricecharting", "loose"): (100.0, 0.8, True, "2026-01-01"), ("b", "ebay-sold", "loose"): (90.0, 0.9, True, "2026-01-01"), ("c", "ebay-sold", "loose"): (80.0, 0.35, False, ""),
    }


def test_references_of_games_and_searches(spark):
    games = R.game_references(spark.createDataFrame([("ps2", "gow", "10", "15.5", "20", "tiendas 2026-02-03"), ("ps4", "gow", None, "30", None, None), ("ps2", "x", "1", None, "3", ""), ("ps2", "y", "1", "0", "3", "")], "console string, game string, low string, mid string, high string, notes string"))
    assert sorted((r["console"], r["value"], r["observed_at"], r["confidence"], r["low"]) for r in games.collect()) == [("ps2", 15.5, "2026-02-03", 0.6, 10.0), ("ps4", 30.0, "", 0.45, None)]
    consoles = R.console_references(spark.createDataFrame([("ps2", "100", None, "300", None, None)], R.CATALOG))
    searches = spark.createDataFrame([(1, "game", "gow", "ps2"), (2, "game", "gow", "ps4"), (3, "game", "gow", ""), (4, "console", "ps2", ""), (5, "console", "", "ps2"), (6, "", "ps2", "ps2"), (7, None, None, None), (8, "accessory", "gow", "ps2")], "search int, entity_type string, entity string, console string")
    assert sorted((r["search"], r["value"]) for r in R.entity_references(searches, consoles, games).collect()) == [(1, 15.5), (2, 30.0), (4, 100.0), (4, 300.0)]


@pytest.mark.parametrize(("search", "entity", "kind"), [("lot", "console", ""), ("discovery", "game", ""), ("game", "game", "game"), ("", "accessory", "accessory"), ("console", "", "console"), ("console", "game", "game"), ("game", "", ""), (None, None, "")])
def test_expected_kinds(spark, search, entity, kind):
    assert one(spark, R.expected_kind(F.col("s"), F.col("e")), "s string, e string", search, entity) == kind


@pytest.mark.parametrize(("kind", "variable", "entity", "applies"), [("console", False, "console", True), ("game", False, "console", False), ("game", True, "", False), ("game", None, "", True), (None, False, "game", False), ("lot", False, None, True)])
def test_targets_hold_for_their_kind(spark, kind, variable, entity, applies):
    assert one(spark, R.target_applies(*map(F.col, "kve")), "k string, v boolean, e string", kind, variable, entity) is applies


@pytest.mark.parametrize(("name", "code"), [(None, "UYU"), (" $ ", "UYU"), ("u$s", "USD"), ("Dólares", "USD"), ("eur", "EUR"), ("a  very long name", "A VERY L")])
def test_currencies(spark, name, code):
    assert one(spark, R.currency(F.col("n")), "n string", name) == code


@pytest.mark.parametrize(("main", "more", "queries"), [("God of  War", ["god of war", " ps2 ", None, "", "PS2", "x"], ["God of War", "ps2", "x"]), (None, ["a"], ["a"]), (" ", None, [])])
def test_queries_of_a_search(spark, main, more, queries):
    assert one(spark, R.search_queries(F.col("m"), F.col("q")), "m string, q array<string>", main, more) == queries


def test_links_and_objectives(spark):
    assert one(spark, R.sold_link(F.col("q")), "q string", " zelda  64 & ñ ") == "https://www.ebay.com/sch/i.html?_nkw=zelda+64+%26+%C3%B1&_sacat=0&LH_Sold=1&LH_Complete=1" and one(spark, R.sold_link(F.col("q")), "q string", " ") is None
    compared = [one(spark, R.objective_completeness(F.col("o"), F.col("s")), "o string, s string", o, s) for o, s in (("game-cib", "declared"), ("console-loose", None), ("game-cib", "incomplete"), ("lot", ""), (None, None))]
    assert compared == ["cib", "loose", "", "", ""]
