"""The recorded data source and accessories, against plain versions."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from lotwatch.operators import accessories
from lotwatch.sources import recorded

ANSWERS = [(k, f"title {k}", float(k % 50), "USD" if k % 3 else "EUR", ("new", "used", None)[k % 3], None if k % 4 == 0 else 0.0, bool(k % 2)) for k in range(0, 5000, 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("answers"))
    recorded.record(spark.createDataFrame(ANSWERS, recorded.SCHEMA), path, 1000)
    # What isn't asked for is never opened: two ranges can't be read at all.
    for low in (0, 4000):
        for file in glob.glob(f"{path}/range={low}/*.parquet"):
            with open(file, "wb") as f:
                f.write(b"not parquet")
    return path


def ids(df):
    return sorted(r["listing_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("condition", "keep"),
    [
        ("listing_id BETWEEN 1000 AND 3999", lambda r: 1000 <= r[0] < 4000), ("listing_id > 1500 AND listing_id < 2100 AND price <= 10", lambda r: 1500 < r[0] < 2100 and r[2] <= 10), ("listing_id IN (1002, 3003, 3004)", lambda r: r[0] in (1002, 3003)), ("listing_id = 2001 AND currency = 'EUR'", lambda r: r[0] == 2001),
        ("listing_id BETWEEN 1000 AND 2999 AND condition = 'used' AND delivery_cost = 0 AND returns_accepted = true", lambda r: 1000 <= r[0] < 3000 and r[4] == "used" and r[5] == 0 and r[6]), ("listing_id BETWEEN 1000 AND 2999 AND price < 5 AND title LIKE '%9'", lambda r: 1000 <= r[0] < 3000 and r[2] < 5 and r[1].endswith("9")),
        ("listing_id > 9000", lambda r: False), ("listing_id BETWEEN 1000 AND 1999 AND condition IS NULL", lambda r: 1000 <= r[0] < 2000 and r[4] is None), ("listing_id BETWEEN 2000 AND 3999 AND (price > 40 OR currency = 'EUR')", lambda r: 2000 <= r[0] < 4000 and (r[2] > 40 or r[3] == "EUR")),
    ],
)
def test_filters_reach_the_source(spark, folder, condition, keep):
    assert ids(recorded.recorded(spark, folder, 1000).filter(condition)) == [r[0] for r in ANSWERS if keep(r)]


def test_all_ranges_are_opened_without_filters(spark, folder):
    with pytest.raises(Exception):
        recorded.recorded(spark, folder, 1000).count()


def test_the_plan_leaves_to_spark_what_the_source_cannot_judge(spark, folder):
    df = recorded.recorded(spark, folder, 1000).filter("listing_id >= 1000 AND listing_id < 2000 AND price <= 9 AND currency = 'USD' AND title LIKE '%1%'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if "Filter" in line]
    assert all("listing_id" not in x.split("Scan")[0] or "isnotnull" in x for x in left) and any("title" in x for x in left) and not any("<= 9" in x for x in left)


def test_the_source_notes_its_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, LessThanOrEqual

    reader = recorded.Reader("file:///none", 10)
    given = [LessThanOrEqual(("price",), 40.0), EqualTo(("currency",), "USD"), EqualTo(("condition",), "used"), EqualTo(("delivery_cost",), 0.0), EqualTo(("returns_accepted",), True), LessThan(("price",), 3.0), EqualTo(("title",), "x"), GreaterThan(("listing_id",), 5), EqualTo(("delivery_cost",), 2.0)]
    assert list(reader.pushFilters(given)) == [given[5], given[6], given[8]] and reader.lowest == 6
    assert reader.notation() == "price:[..40],priceCurrency:USD,conditions:{USED},maxDeliveryCost:0,returnsAccepted:true"


@pytest.mark.parametrize(("given", "window"), [((1000,), (1, 1120)), ((10_000,), (7621, 10_120)), ((None,), (2501, 5000)), ((100, 5, 9), (5, 9)), ((100, 9, 5), (5, 9)), ((100, None, 50, 10), (41, 50)), ((100, None, None, 0, -5), (100, 100))])
def test_windows_of_ids(given, window):
    assert recorded.id_window(*given) == window


# Accessories -------------------------------------------------------------------------------------------------------


def walk(base, legacy):
    """In the order of the list, each accessory's first entry that isn't taken."""
    out, taken = {}, set()
    for _, bid, name in sorted(base, key=lambda b: b[0]):
        for place, entry in sorted(legacy):
            if place not in taken and entry and ((name and (name in entry or entry in name)) or (bid and bid in entry)):
                out[bid] = place
                taken.add(place)
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_each_entry_is_taken_once(spark, seed):
    """Texts of few words, so that many accessories want the same entries, in several groups."""
    rng = random.Random(seed)
    words = ["dock", "pad", "pad pro", "cable", "usb", "a", "stand"]
    some = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(0, most)))
    groups = {g: ([(k, rng.choice([f"x{g}{k}", f"{words[k % 5].split()[0]} {g}{k}"]), some(4)) for k in range(25)], [(k, some(5)) for k in range(30)]) for g in "pqr"}
    base = spark.createDataFrame([(g, *b) for g, (bs, _) in groups.items() for b in bs], "g string, place int, id string, name string")
    legacy = spark.createDataFrame([(g, *x) for g, (_, xs) in groups.items() for x in xs], "g string, place int, entry string")
    got = accessories.legacy_matches(base, legacy.withColumnRenamed("place", "at"), ["g"], "id", "name", "place", "entry", "at").collect()
    want = {(g, i): p for g, (bs, xs) in groups.items() for i, p in walk(bs, xs).items()}
    assert {(r["g"], r["id"]): r["at"] for r in got} == want and len(got) == len(want) > 20


def test_accessories_of_a_console(spark):
    base = spark.createDataFrame([("c", "pad", "Control Pad", "b.png", 1), ("c", "dock", "Base de carga", "", 2), ("c", "usb", "Cable USB", "", 3), ("c", "av", "Cable AV", "", 4), ("c", "tv", "Antena", "", 5)], "console string, id string, name string, image string, place int")
    kept = [("c", "pad", "Mi control", "m.png", True, 2, "gastado", "manual", 1), ("c", "x1", "base de CARGA", "k.png", False, 0, None, "catalog", 2), ("c", "charging", "Charging Station", "", True, 1, "", None, 3), ("c", "own", "Hecho a mano", "", True, 1, "", "manual", 4), ("c", "old", "Fuera de lista", "", True, 1, "", "catalog", 5)]
    current = spark.createDataFrame(kept, "console string, id string, name string, image string, owned boolean, quantity int, notes string, source string, place int")
    legacy = spark.createDataFrame([("c", "3 cables usb negros cable usb", 1), ("c", "cable", 2), ("c", "Volante 2", 3), ("c", "¿?", 4)], "console string, entry string, place int")
    got = {r["id"]: r for r in accessories.reconciled(base, current, legacy, ["console"], {"charging": ("antena",)}).collect()}
    assert {k: (r["owned"], r["quantity"], r["found_by"], r["origin"]) for k, r in got.items()} == {
        "pad": (True, 2, "id", "catalog"), "x1": (False, 0, "name", "catalog"), "usb": (True, 3, "legacy", "catalog"), "av": (True, 1, "legacy", "catalog"), "charging": (True, 1, "alias", "catalog"), "own": (True, 1, None, "manual"),
        "legacy-volante-2": (True, 2, None, "legacy"), "legacy-item-2": (True, 1, None, "legacy"),
    }
    assert (got["pad"]["image"], got["x1"]["image"], got["pad"]["notes"]) == ("m.png", "k.png", "gastado")
    assert [r["id"] for r in sorted(got.values(), key=lambda r: r["place"])][-1] == "x1" and sorted(r["place"] for r in got.values()) == list(range(1, 9))
