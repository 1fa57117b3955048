"""Benchmarks, franchises and readers' order on rows that are known to be right."""

import pytest
from pyspark.sql import functions as F

from lotwatch.operators import franchise, pricing, rows

MATCHED = """search string, listing int, title string, kind string, kind_sure boolean, expected string, completeness string, objective_id string, objective_status string, price double, shipping double, region string, lot boolean, pieces int, filler boolean,
  variable_price boolean, per_piece double, games int, game_value double, missing array<string>, target double, confidence double, tested boolean, untested boolean, unverified int, seller_known boolean, has_details boolean"""
REFERENCES = "search string, title string, completeness string, value double, source string, observed_at string, independent boolean, stale boolean, region string, confidence double"
PLAIN = {
    "search": "s", "title": "t", "kind": "game", "kind_sure": True, "expected": "game", "completeness": "loose", "objective_id": "game-loose", "objective_status": "", "price": 50.0, "shipping": 5.0, "region": "", "lot": False, "pieces": None, "filler": False, "variable_price": False, "per_piece": None,
    "games": None, "game_value": None, "missing": [], "target": None, "confidence": 0.9, "tested": True, "untested": False, "unverified": 0, "seller_known": True, "has_details": True,
}
SOLD = ("s", "t", "loose", 100.0, "ebay-sold", "2026-01-01", True, False, "", 0.9)
READ = {"missing": [], "defects": [], "returns_accepted": True, "images": 9, "taxes": None, "available": True}


def valued(spark, changes, references=(SOLD,), details=None, most=12):
    order = [f.strip().split(" ")[0] for f in MATCHED.split(",")]
    matched = spark.createDataFrame([tuple(({"listing": k} | PLAIN | c)[f] for f in order) for k, c in enumerate(changes)], MATCHED)
    pages = spark.createDataFrame([(k, e) for k, e in (details or {}).items()], f"listing int, evidence {pricing.EVIDENCE}")
    out = pricing.valued(matched, spark.createDataFrame(list(references), REFERENCES), pages, "2026-01-02", most)
    return {r["listing"]: r for r in out.collect()}


def test_each_way_to_a_benchmark(spark):
    changes = [
        {}, {"kind": "accessory"}, {"kind": "accessory", "kind_sure": False}, {"completeness": "cib"}, {"completeness": ""}, {"title": "none"}, {"lot": True, "pieces": 4, "per_piece": 10.0}, {"lot": True, "pieces": 4, "per_piece": 10.0, "filler": True}, {"lot": True, "per_piece": 10.0}, {"lot": True, "pieces": 4},
        {"lot": True, "pieces": 4, "per_piece": 10.0, "variable_price": True}, {"kind": "console", "expected": "console", "games": 3, "game_value": 8.0}, {"region": "pal"}, {"price": None}, {"shipping": None},
    ]
    got = valued(spark, changes)
    value = {k: (r["b"]["value"], r["b"]["source"], r["b"]["comparable"]) if r["b"] else None for k, r in got.items()}
    sold = (100.0, "ebay-sold", True)  # an accessory may only be held against peers, of which there are enough here
    assert [value[k] for k in range(len(changes))] == [sold, (50.0, "peer-listings", True), sold, None, None, None, (40.0, "lot-ceiling", True), (20.0, "lot-ceiling", True), None, (50.0, "peer-listings", True), None, (124.0, "ebay-sold", False), (100.0, "ebay-sold", False), sold, sold]
    assert (got[0]["p"]["ratio"], got[13]["p"]["ratio"], got[14]["p"]["ratio"], got[14]["p"]["shipping_known"]) == (0.55, None, 0.5, False)
    assert got[8]["v"]["section"] == "unconfirmed-quantity" and got[5]["v"]["band"] == "sin-referencia"


def test_peers_and_which_reference_goes_first(spark):
    four = [{"price": p, "missing": ["controller"] if p == 40.0 else []} for p in (40.0, 60.0, 80.0, 100.0)]
    got = valued(spark, [*four, {"price": 500.0, "kind": "accessory"}], references=[])
    assert [(got[k]["b"]["value"], got[k]["b"]["source"]) for k in range(4)] == [(70.0, "peer-listings")] * 4  # 60, 60, 80, 100
    assert got[4]["b"]["value"] == 70.0 and got[0]["p"]["ratio"] == pytest.approx(65 / 70) and not valued(spark, four[:3], references=[])[0]["b"]
    stale = SOLD[:7] + (True,) + SOLD[8:]
    assert valued(spark, four, references=[stale])[0]["b"]["source"] == "peer-listings" and valued(spark, four, references=[stale, SOLD[:4] + ("manual",) + SOLD[5:]])[0]["b"]["source"] == "manual"
    lots = [{"lot": True, "pieces": n, "price": 10.0 * n} for n in (2, 4, 8, 16)]
    assert [valued(spark, lots)[k]["b"]["value"] for k in range(4)] == [20.0, 40.0, 80.0, 160.0]


def test_the_cheapest_are_read_and_judged_again(spark):
    changes = [{"price": 30.0 + k} for k in range(6)] + [{"price": 200.0, "target": 500.0}, {"price": 20.0, "has_details": False}, {"price": 200.0}]
    pages = {k: dict(READ) for k in range(9)}
    pages[1] = READ | {"missing": ["controller"], "defects": [{"label": "stick", "severity": "functional", "piece": "charger"}], "taxes": 4.0}
    pages[2] = READ | {"returns_accepted": False}
    got = valued(spark, changes, details=pages, most=4)
    assert [k for k in sorted(got) if got[k]["read"]] == [0, 1, 2, 3] and got[0]["v"]["band"] == "ganga"
    assert got[1]["p"]["ratio"] == pytest.approx((31 + 5 + 4 + 20 + 10) / 100) and got[1]["p"]["functional_cost"] == 70.0 and got[1]["v"]["band"] == "razonable" and got[2]["v"]["band"] == "razonable"
    assert "details" in [b["key"] for b in got[5]["v"]["blockers"]] and got[5]["v"]["band"] == "buena" and got[7]["v"]["price_band"] == "ganga"
    everything = valued(spark, changes, details=pages)
    assert [k for k in sorted(everything) if everything[k]["read"]] == [0, 1, 2, 3, 4, 5, 6] and everything[6]["p"]["meets"] is True


def test_no_listings_and_no_references(spark):
    assert valued(spark, [{}], references=[])[0]["v"]["band"] == "sin-referencia"
    empty = spark.createDataFrame([], MATCHED)
    assert pricing.valued(empty, spark.createDataFrame([], REFERENCES), spark.createDataFrame([], f"listing int, evidence {pricing.EVIDENCE}"), "x").collect() == []


RELEASES = "franchise string, release string, platform string, year int, primary boolean, crown boolean, ownership string, work_ids array<string>, place int"


def composed(spark, releases, works, platforms=("ps1",), editions=(), hardware=(), tracked=()):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = franchise.composed(df(releases, RELEASES), df(works, "franchise string, work string, status string, excluded boolean"), df(editions, "franchise string, item string, crown boolean"), df(hardware, "franchise string, item string"), df(tracked, "item string, owned boolean"), df([(p,) for p in platforms], "platform string"))
    return {r["franchise"]: tuple(r)[1:] for r in out.collect()}


def test_ratios_and_the_next_step_of_franchises(spark):
    releases = [
        ("f", "a", "ps1", 1997, True, False, "physical", ["w1"], 1), ("f", "b", "ps2", 2001, True, True, "none", ["w2", "w3"], 2), ("f", "c", "ps3", 2008, True, False, "digital", ["w3"], 3), ("f", "d", "gba", 2003, False, False, "none", ["w4", "w5"], 4), ("f", "e", "gba", None, True, False, None, ["w2"], 5),
        ("g", "x", "ps1", None, True, False, "none", ["v1"], 1), ("g", "y", "ps1", 1999, True, False, "none", ["v1"], 2), ("h", "z", "ps1", 1999, True, False, "both", ["u1"], 1),
    ]
    works = [("f", "w1", "released", False), ("f", "w2", "released", None), ("f", "w3", "released", False), ("f", "w4", "announced", False), ("f", "w5", "released", True), ("f", "w6", None, False), ("g", "v1", "released", False), ("h", "u1", "released", False), ("i", "t1", "announced", False)]
    got = composed(spark, releases, works, editions=[("f", "e1", True), ("f", "e2", False)], hardware=[("f", "h1")], tracked=[("b", True), ("h1", False), ("h1", True), ("e2", True)])
    # w2 is all that is open in f; both ps2 and gba bring it, ps2 comes first.
    assert got["f"] == (2, 3, 67, 1, 4, 25, 2, 3, 67, "platform", "ps2", 1)
    assert got["g"] == (0, 1, 0, 0, 2, 0, 0, 0, 0, "release", "y", 0) and got["h"] == (1, 1, 100, 1, 1, 100, 0, 0, 0, None, None, 0) and got["i"] == (0, 0, 0, 0, 0, 0, 0, 0, 0, None, None, 0)
    assert composed(spark, [], []) == {}


def test_titles_as_a_spanish_reader_sorts_them(spark):
    titles = ["ñandú", "nube", "Zelda", "árbol", "Arbol", "arbol", "oso", "nz", "Ñu", "zelda", "", None]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    order = rows.match_order(F.lit(None).cast("boolean"), F.lit(False), F.lit(""), F.lit(None).cast("timestamp"), F.lit(None).cast("int"), F.col("t"), F.col("i"))
    assert [r["t"] for r in df.orderBy(*order).collect()] == ["", None, "arbol", "Arbol", "árbol", "nube", "nz", "ñandú", "Ñu", "oso", "zelda", "Zelda"]
    assert df.alias("a").join(df.alias("b"), rows.spanish(F.col("a.t")) == rows.spanish(F.col("b.t"))).count() == len([t for t in titles if t is not None])


def test_order_of_matches(spark):
    schema = "n int, following boolean, watch boolean, urgency string, closing string, score int, title string"
    given = [(0, False, False, "", None, 9, "b"), (1, None, True, "", None, 1, "b"), (2, True, False, "", None, 1, "b"), (3, False, False, "Cierra HOY", None, 1, "b"), (4, False, False, "Cierre INMINENTE", None, 1, "b"), (5, False, False, "", "2026-01-02", 1, "b"), (6, False, False, "", "2026-01-01", 1, "b"), (7, False, False, "", None, 9, "a"), (8, False, False, "prónto", None, 1, "b"), (9, False, False, "", None, None, "b"), (10, False, False, "", None, 0, "b")]
    df = spark.createDataFrame(given, schema).repartition(3)
    order = rows.match_order(F.col("following"), F.col("watch"), F.col("urgency"), F.col("closing").cast("timestamp"), F.col("score"), F.col("title"), F.col("n"))
    assert [r["n"] for r in df.orderBy(*order).collect()] == [2, 1, 4, 3, 8, 6, 5, 7, 0, 9, 10]


def test_a_search_of_all_listings_is_dealt_out(spark):
    """The cheapest are those of one ranking of the whole search, but no group of the ranking holds more than a part of it."""
    from lotwatch.operators import pricing

    df = spark.range(4000).select(F.lit("one").alias("search"), F.col("id").alias("listing"), (F.col("id") % 3 > 0).alias("cheap"), (F.col("id") * 7919 % 501 / 100).alias("ratio"))
    got = pricing.cheapest_of_each(df, "cheap", "ratio", 12)
    want = sorted((k * 7919 % 501 / 100, k) for k in range(4000) if k % 3)[:12]
    assert sorted((r["ratio"], r["listing"]) for r in got.filter("_asked").collect()) == want
    assert got.count() == 4000
    keys = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert len(keys) == 2 and all("_part" in line for line in keys)
