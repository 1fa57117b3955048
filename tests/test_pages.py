"""Linked data of pages against Python's own JSON, and rows that are known to be right."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lotwatch.functions import money
from lotwatch.sources import pages


def plain_objects(value, path=()):
    """(path, object) of all objects, an object's members by name."""
    inside = [value[k] for k in sorted(value)] if isinstance(value, dict) else value if isinstance(value, list) else []
    found = [(path, value)] if isinstance(value, dict) else []
    return found + [x for n, v in enumerate(inside) for x in plain_objects(v, (*path, n))]


def some_json(rng, deep):
    if deep == 0 or rng.random() < 0.2:
        return rng.choice([1, 2.5, None, True, "text", '"[{', "}]\\", "é", ""])
    inside = [some_json(rng, deep - 1) for _ in range(rng.randrange(4))]
    return inside if rng.random() < 0.5 else {f"{rng.choice('abc')}{n}": v for n, v in enumerate(inside)}


def test_every_object_of_random_texts(spark):
    rng = random.Random(2)
    values = [some_json(rng, rng.randrange(9)) for _ in range(300)] + [[], {}, [[]], [{}]]
    deep = {"x": 1}
    for k in range(60):
        deep = [deep] if k % 2 else {"k": deep}
    values.append(deep)
    texts = [json.dumps(v, ensure_ascii=k % 2 == 0) for k, v in enumerate(values)] + ["{broken", "", "nothing", None, "[1,", '{"a":}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = sorted((r["i"], tuple(r["path"]), r["j"]) for r in pages.objects(rows).select("i", "path", F.to_json("node").alias("j")).collect())
    want = sorted((i, p, v) for i, value in enumerate(values) for p, v in plain_objects(value))
    assert [(i, p, json.loads(j)) for i, p, j in got] == want if len({(i, p) for i, p, _ in want}) == len(want) else False


def block(value, kind="application/ld+json"):
    return f'<script type="{kind}">{value if isinstance(value, str) else json.dumps(value)}</script>'


def product(n, **more):
    return {"@type": "Product", "name": f"Lote {n} - Consola {n}", "offers": {"url": f"https://h.example/r?lote={n}", "price": 10 + n, "priceCurrency": "UYU"}} | more


PAGES = [
    ("7", '<head><meta property="og:description" content="Comisión del comprador: 12,5 %"></head>' + block({"@graph": [{"itemListElement": [{"item": product(1)}, {"item": product(2)}]}]}) + block("{cut") + block([product(1, name="again")])),
    ("8", block({"@type": "Organization"})), ("9", "<p>no data</p>" + block({"@type": "Product"}, "text/javascript")), ("10", None),
    ("11", block({"@type": ["Thing", " PRODUCT "], "name": "Mesa", "sku": "LOTE-11-A5", "image": ["", {"url": " https://i/1 "}], "offers": [3, {"price": "1.234,50", "priceCurrency": "u$s", "availability": "https://schema.org/OutOfStock"}]})
        + block(product(3, offers=[], url="https://h.example/?x=1&LOTE=3%20b#f"), " application/ld+json; charset=utf-8") + block(product(4, offers=None, sku="LOTE_12_9"))),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page string, html string")


def test_products_of_pages(spark):
    got = {(r["page"], r["lot_number"]): r for r in pages.products(frame(spark), "page", "html").collect()}
    assert sorted(got) == [("11", "3 b"), ("11", "A5"), ("7", "1"), ("7", "2")]
    one, five = got["7", "1"], got["11", "A5"]
    assert (one["title"], one["price"], one["currency"], one["status"], one["lot_url"]) == ("Consola 1", 11.0, "UYU", "active", "https://h.example/r?lote=1")
    assert (five["title"], five["price"], five["currency"], five["status"], five["image_url"], five["lot_url"]) == ("Mesa", 1234.5, "USD", "closed", "https://i/1", "")


def test_receipts_of_pages(spark):
    got = {r["page"]: (r["blocks"], r["products"], r["commission"], r["warnings"]) for r in pages.page_receipts(frame(spark), "page", "html").collect()}
    assert got == {"7": (3, 2, 12.5, [pages.INVALID]), "8": (1, 0, None, [pages.NO_PRODUCTS]), "9": (0, 0, None, [pages.MISSING]), "10": (0, 0, None, [pages.MISSING]), "11": (3, 2, None, [])}


def test_lots_with_their_pages(spark):
    lots = spark.createDataFrame([("7", "1", "old", "", "https://own", "", "", 1.0, None), ("7", "99", "kept", "d", "u", "i", "USD", 2.0, 3.0), ("none", "1", "kept", "d", "u", "i", "USD", 2.0, 3.0), ("11", "a5", "old", "d", "u", "i", "EUR", 2.0, 3.0)], "page string, lot_number string, title string, description string, lot_url string, image_url string, currency string, current_price double, commission_percent double")
    got = {(r["page"], r["lot_number"]): r for r in pages.enriched_lots(lots, frame(spark), "page", "html").collect()}
    assert len(got) == 4
    one = got["7", "1"]
    assert (one["title"], one["lot_url"], one["current_price"], one["commission_percent"], one["metadata_status"], one["metadata_warnings"]) == ("Consola 1", "https://h.example/r?lote=1", 11.0, 12.5, "enriched", [pages.INVALID])
    assert (got["7", "99"]["title"], got["7", "99"]["metadata_status"], got["7", "99"]["commission_percent"]) == ("kept", "lot_not_found", 12.5)
    assert (got["none", "1"]["metadata_status"], got["none", "1"]["commission_percent"]) == ("unavailable", 3.0)
    assert (got["11", "a5"]["lot_url"], got["11", "a5"]["description"], got["11", "a5"]["current_price"]) == ("u", "d", 1234.5)


@pytest.mark.parametrize(
    ("text", "number"),
    [("1.234,50", 1234.5), ("1,234.50", 1234.5), ("1,234", 1234.0), ("12,5", 12.5), ("350.000000", 350.0), (",500", 0.5), ("1.234.567", 1234567.0), ("1.2.3", 12.3), ("US$ -7", -7.0), ("+5", 5.0), ("", None), ("-", None), ("a", None), (None, None), ("1.2,3,4", None), ("12", 12.0), ("0.1234", 0.1234)],
)
def test_numbers_of_either_writing(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(money.either_amount(F.col("t"))).first()[0] == number
