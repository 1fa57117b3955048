"""Intents, targets, alert reviews and cost sentences on rows that are known to be right."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lotwatch.operators import intents, valuation

SEARCH = "search int, search_type string, entity_type string, console string, entity string"
TARGET = "search int, target_console string, target_game string"
SEARCHES = [(1, "lot", "console", "ps2", "ps2"), (2, "discovery", "", "", ""), (3, "game", "console", "", "n64"), (4, "console", "", None, None), (5, "game", "game", "snes", "smw"), (6, "game", "game", "snes", "dkc"), (7, "game", "", "snes", ""), (8, "game", "", "snes", ""), (9, "lot", "", "gb", ""), (10, None, None, None, None)]
TARGETS = [(7, None, "smw"), (7, "nes", "smb"), (8, "snes", "dkc"), (8, None, ""), (6, "snes", "smw"), (10, "snes", "smw"), (3, "snes", "smw")]
WISHED = [("snes", "smw"), ("nes", "smb")]


def frames(spark):
    return spark.createDataFrame(SEARCHES, SEARCH), spark.createDataFrame(TARGETS, TARGET), spark.createDataFrame(WISHED, "console string, game string")


@pytest.mark.parametrize(("strict", "six"), [(False, "wishlist"), (True, "wishlist")])
def test_intents_of_searches(spark, strict, six):
    s, t, w = frames(spark)
    got = {r["search"]: r["intent"] for r in intents.search_intents(s, t, w, strict).collect()}
    assert got == {1: "lot", 2: "discovery", 3: "console", 4: "console", 5: "wishlist", 6: six, 7: "wishlist", 8: "recommendation", 9: "lot", 10: "wishlist"}
    half = spark.createDataFrame([(7, "snes", "smw"), (7, "snes", "dkc")], TARGET)
    assert {r["search"]: r["intent"] for r in intents.search_intents(s, half, w, strict).collect()}[7] == ("recommendation" if strict else "wishlist")


def test_intents_of_matches(spark):
    s, _, w = frames(spark)
    rows = spark.createDataFrame([(5, "snes", "dkc"), (6, None, "smw"), (6, "", None), (7, "nes", "smb"), (7, None, None), (1, "snes", "smw")], TARGET)
    got = sorted((r["search"], r["target_game"] or "", r["intent"]) for r in intents.match_intents(s.join(rows, "search"), w).collect())
    assert got == [(1, "smw", "lot"), (5, "dkc", "recommendation"), (6, "", "recommendation"), (6, "smw", "wishlist"), (7, "", "manual"), (7, "smb", "wishlist")]


def test_intents_of_matches_that_meet_their_searches_once(spark):
    s, _, w = frames(spark)
    w = w.unionByName(spark.createDataFrame([("", "loose"), ("gb", "smw"), ("snes", "gb")], w.schema))
    rows = spark.createDataFrame([(k, c, g) for k in range(1, 11) for c in (None, "", "snes", "nes", "gb") for g in (None, "", "smw", "smb", "dkc", "loose")], TARGET)
    titles = intents.title_wishes(rows.select("target_game").distinct(), w)
    rows = rows.withColumn("id", F.concat_ws("/", "search", F.coalesce("target_console", F.lit("-")), F.coalesce("target_game", F.lit("-"))))
    titles = titles.withColumnRenamed("target_game", "title")
    matches = rows.join(titles, F.col("target_game").eqNullSafe(F.col("title")), "left").drop("title")
    got, want = intents.searched_match_intents(matches, s, w), intents.match_intents(s.join(rows, "search"), w)
    rows_of = lambda df: sorted((r["id"], r["intent"]) for r in df.collect())
    assert rows_of(got) == rows_of(want)
    assert len(rows_of(got)) == 300 and {"wishlist", "recommendation", "manual"} <= {i for _, i in rows_of(got)}


def test_lines_are_dealt_out_by_title_and_by_search_only(spark, sf_dir):
    plan = queries()["val10_match_intents"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    below = lambda i: plan[i + 1 : next((k for k in range(i + 1, len(plan)) if depth[k] <= depth[i]), len(plan))]
    dealt = [x for i, x in enumerate(plan) if "Exchange" in x and any("lineitem.parquet" in y for y in below(i))]
    assert len(dealt) == 2 and not any("Broadcast" in x for x in dealt)
    # Only the names of wished franchises are broadcast, no table that grows with the input.
    assert all("[franchise#" in x for x in plan if "BroadcastHashJoin" in x)


def test_what_is_targeted_already(spark):
    s, t, _ = frames(spark)
    got = {tuple(r) for r in intents.targeted(s, t).collect()}
    assert got == {("lot", "ps2", None), ("game", "ps2", "ps2"), ("console", "n64", None), ("game", "snes", "smw"), ("game", "snes", "dkc"), ("game", "snes", "smb"), ("lot", "gb", None)}


def test_wished_keys(spark):
    wishes = spark.createDataFrame([("games", "snes", "smw", None), ("games", "snes", "smw", None), ("games", "", "x", None), ("games", "n64", None, None), ("franchise", None, None, "god"), ("franchise", None, None, "none")], "kind string, console string, game string, franchise string")
    releases = spark.createDataFrame([("god", "r1", True, "ps2", "p", "g1"), ("god", "r2", True, None, "ps3", None), ("god", "r3", False, "ps2", "p", "g3"), ("other", "r4", True, "ps2", "p", "g4"), ("god", "r5", True, "", "psp", "r5")], "franchise string, release string, primary boolean, console string, platform string, game string")
    assert sorted(tuple(r) for r in intents.wished_keys(wishes, releases).collect()) == [("ps2", "g1"), ("ps2", "r1"), ("ps3", "r2"), ("psp", "r5"), ("snes", "smw")]


SOUND = {"source": "ebay-sold", "observed_at": "2026-10-01", "independent": True, "stale": False, "comparable": True}


@pytest.mark.parametrize(
    ("change", "after", "meets", "want"),
    [
        ({}, ["wishlist"], False, (True, [], False)), ({}, ["recommendation"], False, (False, ["es una recomendación, no un deseo"], True)), ({}, None, False, (False, ["la búsqueda no apunta a un deseo, una consola que falta ni un lote elegido"], True)),
        ({"blockers": [{"key": "photos", "label": "sólo 1 foto"}]}, ["lot", "manual"], False, (False, ["sólo 1 foto"], True)), ({"price_band": "caro", "band": "revisar"}, ["console"], None, (False, ["requiere revisión"], False)), ({"price_band": "caro", "band": "revisar"}, ["console"], True, (False, ["requiere revisión"], True)),
    ],
)
def test_reviews_of_alerts(spark, change, after, meets, want):
    v = {"section": "primary", "price_band": "ganga", "gated_band": "ganga", "band": "ganga", "blockers": [], "review_keys": [], "penalty": 0} | change
    df = spark.createDataFrame([(v, SOUND, after, meets)], f"v {valuation.VERDICT}, b {valuation.BENCHMARK}, i array<string>, m boolean")
    r = df.select(intents.alert_review(F.col("v"), F.lit(None), F.col("b"), F.lit(True), F.lit(True), F.col("i"), F.col("m")).alias("r")).first()["r"]
    assert (r["eligible"], r["reasons"], r["candidate"]) == want


@pytest.mark.parametrize(
    ("row", "sentence"),
    [
        ((59.99, 15.85, None, [("fuente faltante", 20.0)], 95.84, "import", None), "USD 59,99 + USD 15,85 de envío + fuente faltante estimado en USD 20,00 = USD 95,84 antes del courier (courier a Uruguay sin calcular: falta el peso). Impuestos: la fuente no los informa."),
        ((1000.0, 0.0, 4.2, [], 1004.2, "import", 35.0), "USD 1.000,00 + envío gratis + USD 4,20 de impuestos informados = USD 1.004,20 antes del courier (courier a Uruguay ≈ USD 35,00, estimado por peso)."),
        ((10.0, None, 0.0, None, None, "import", 1.0), "USD 10,00 = USD ?, con el envío todavía sin confirmar antes del courier (courier a Uruguay ≈ USD 1,00, estimado por peso)."), ((10.0, 0.0, None, None, 10.0, "local", None), "USD 10,00 + sin envío = USD 10,00, compra local (sin courier ni IVA de importación)."),
        ((10.0, 2.0, None, None, 12.0, "auction", None), "USD 10,00 + USD 2,00 de envío = USD 12,00 con los cargos del remate."), ((None, 2.0, None, None, None, "import", None), ""),
    ],
)
def test_costs_in_a_sentence(spark, row, sentence):
    df = spark.createDataFrame([row], "i double, s double, t double, e array<struct<label: string, amount: double>>, a double, m string, c double")
    assert df.select(intents.cost_sentence(*map(F.col, "isteamc"), F.lit("USD"))).first()[0] == sentence
