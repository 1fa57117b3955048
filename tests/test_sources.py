"""Readers and parsers on literal answers."""

import pytest
from pyspark.sql import functions as F

from lotwatch.sources import documents, listings


def one(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields)).select(column.alias("v")).first()["v"]


def test_csv_with_and_without_file(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('a,b\n1,"x, ""y"""\n2,\n')
    assert documents.scan_csv(spark, str(path), ["b", "c"]).collect() == [('x, "y"', None), (None, None)]
    assert documents.has_column(spark, str(path), "a") and not documents.has_column(spark, str(path), "c")
    assert documents.scan_csv(spark, str(tmp_path / "none.csv"), ["a"]).collect() == [] and not documents.has_column(spark, str(tmp_path / "none.csv"), "a")


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r["x"] for r in documents.scan_json(spark, str(tmp_path / "*.json"), "x int").collect()] == [1]
    assert documents.scan_json(spark, str(tmp_path / "no*.json"), "x int").collect() == []


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"itemId":"1","title":" A  b ","itemWebUrl":"https://x/1","price":{"value":"9.999","currency":"usd"},"shippingOptions":[{"shippingCostType":"CALCULATED"},{"shippingCost":{"value":"1"}}]}', ("1", "A b", 10.0, None, "Envío a calcular")),
        ('{"itemId":"2","title":"b","itemWebUrl":"http://x/2","price":{"value":"-1"},"shippingOptions":[{"shippingCost":{"value":"0.0","currency":"EUR"}}]}', ("2", "b", None, 0.0, "Envío gratis")),
        ('{"itemId":"3","title":"b","itemWebUrl":"javascript:1"}', None), ('{"itemId":"","title":"b","itemWebUrl":"http://x"}', None), ('{"itemId":"4","title":" ","itemWebUrl":"http://x"}', None), ("nonsense", None), (None, None),
    ],
)
def test_summaries(spark, answer, want):
    got = listings.summaries(spark.createDataFrame([(answer,)], "j string"), "j", "shop").select("external_id", "title", "price_amount", "shipping_amount", "shipping_label").collect()
    assert [tuple(r) for r in got] == ([want] if want else [])


def test_detail(spark):
    text = '{"description":"<p>Works</p><script>x</script>","returnTerms":{"returnsAccepted":true},"image":{"imageUrl":"u"},"additionalImages":[{"imageUrl":"v"},{}],"taxes":[{"taxAmount":{"value":"1.10"}},{"taxAmount":{"value":"x"}},{}],"estimatedAvailabilities":[{},{"estimatedAvailabilityStatus":"limited_stock"}]}'
    d = one(spark, listings.detail(F.col("j")), j=text)
    assert (d["available"], d["description"], d["returns_accepted"], d["images"], d["taxes"], d["shipping"]) == (True, "Works", True, 2, 1.1, None)
    bare = one(spark, listings.detail(F.col("j")), j="{}")
    assert (bare["available"], bare["description"], bare["images"], bare["taxes"]) == (None, "", 0, None)


def test_first_image_and_price_markup(spark):
    kind = "array<struct<order: string, url: string, image: string>>"
    images = F.from_json("j", kind)
    assert one(spark, listings.first_image(images), j='[{"url":"last"},{"order":"2","url":"b"},{"order":"1","url":" "},{"order":"2","image":"c"}]') == "b"
    assert one(spark, listings.first_image(images), j="[]") == ""
    price = lambda html: tuple(one(spark, listings.price_details(F.col("h")), h=html))
    assert price('<span class="woo-ua-auction-price starting-bid" data-status=" Live ">$ 1,250.50</span>') == (1250.5, 0.0, "live")
    assert price('<span class="woo-ua-auction-price current-bid" data-bid="300">$ 250</span>') == (0.0, 300.0, "")
    assert price('<span class="woo-ua-auction-price current-bid">$ 250</span>') == (0.0, 250.0, "")


def test_feed(spark):
    lot = lambda n, title, photo: f"<lote><title>{title}</title><link>http://h/lot/{n}</link><foto>http://h/p/{photo}.jpg</foto></lote>"
    item = lambda link, count, lots: f"<item><title>T</title><link>{link}</link><cantLotes>{count}</cantLotes><lotes>{lots}</lotes></item>"
    xml = f"<rss><channel>{item('http://h/1', 3, lot(7, 'a', 11) + lot(7, 'b', 12) + lot(7, 'a', 11))}{item('http://h/1', 1, lot(9, 'z', 1))}{item('http://h/2', 2, lot(1, 'c', 5))}</channel></rss>"
    lots = listings.feed_lots(spark.createDataFrame([(xml,), ("<!DOCTYPE x>" + xml,)], "x string"), "x")
    assert sorted((r["lot_id"], r["title"]) for r in lots.collect()) == [("http://h/1:7", "a"), ("http://h/1:7:item-12", "b"), ("http://h/2:1", "c")]
    assert sorted((r["group_id"], r["status"]) for r in listings.feed_receipts(lots).collect()) == [("http://h/1", "complete"), ("http://h/2", "partial")]


def test_catalog_games(spark):
    text = '{"byConsole":{"n64":{"juegosCatalogo":[{"id":"g1","title":"One"},{"id":"g2","title":"Two"}]},"ps2":{}}}'
    catalog = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", "byConsole map<string, struct<juegosCatalogo: array<struct<id: string, title: string>>>>").alias("c")).select("c.*")
    assert [tuple(r) for r in documents.catalog_games(catalog).orderBy("game").collect()] == [("n64", "g1", "One", 0), ("n64", "g2", "Two", 1)]


def test_feed_deals_a_group_once(spark):
    """Numbers that a group uses again are told where its lots are, without a join of the lots with themselves."""
    plan = listings.feed_lots(spark.createDataFrame([("<rss/>",)], "x string"), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
