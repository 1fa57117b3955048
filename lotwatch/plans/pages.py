"""Linked data in pages: blocks made of the pages' own columns, nested to different depths, some of them corrupt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.plans.base import Tables, query
from lotwatch.sources import pages

#: The page's product stands in this many lists and objects in turn, one more for each page, and starts again.
DEPTHS = 7


def _described(t: Tables) -> DataFrame:
    """Pages with a graph that holds their product at a depth of page_id % DEPTHS, every ninth with a block cut short."""
    title = F.regexp_replace(F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1), r'["\\\n\r\t&]', " ")
    product = F.concat(
        F.lit('{"@type":["Thing","Product"],"name":"Lote '), (F.col("page_id") % 50).cast("string"), F.lit(" - "), title, F.lit('","offers":[7,{"url":"https://x.example/?a=1&lote='), (F.col("page_id") % 50).cast("string"),
        F.lit('","price":"'), (1000 + F.col("page_id")).cast("string"), F.lit(',50","priceCurrency":"U$S","availability":"https://schema.org/'), F.when(F.col("page_id") % 4 == 0, "SoldOut").otherwise("InStock"), F.lit('"}]}'),
    )
    block = product
    for k in range(1, DEPTHS):
        open_, close = ('[1,', ',{"@type":"Person"}]') if k % 2 else ('{"@graph":', ',"level":%d}' % k)
        block = F.when(F.col("page_id") % DEPTHS >= k, F.concat(F.lit(open_), block, F.lit(close))).otherwise(block)
    block = F.when(F.col("page_id") % 9 == 0, F.substring(block, 1, 40)).otherwise(block)
    script = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))
    return t.pages.select("page_id", F.concat("html", F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(script)).alias("html"))


_TITLE = r"""regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '["\\\n\r\t&]', ' ', 'g')"""
_PAGE = f"""WITH p AS (SELECT page_id, page_id % {DEPTHS} AS deep, page_id % 50 AS lot, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title FROM pages WHERE page_id % 11 <> 0)"""


@query("src28_products", _PAGE + " SELECT page_id, lot::VARCHAR AS lot_number, CASE WHEN title = '' THEN 'Lote ' || lot || ' -' ELSE title END AS title, 'https://x.example/?a=1&lote=' || lot AS lot_url, 'USD' AS currency, 1000.5 + page_id AS price, CASE WHEN page_id % 4 = 0 THEN 'closed' ELSE 'active' END AS status FROM p WHERE page_id % 9 <> 0")
def src28(t: Tables) -> DataFrame:
    return pages.products(_described(t), "page_id", "html").select("page_id", "lot_number", "title", "lot_url", "currency", "price", "status")


@query("src28_page_receipts", f"""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 0 ELSE 1 END AS blocks, CASE WHEN page_id % 11 = 0 OR page_id % 9 = 0 THEN 0 ELSE 1 END AS products,
  CASE WHEN page_id % 11 = 0 THEN '{pages.MISSING}' WHEN page_id % 9 = 0 THEN '{pages.INVALID}, {pages.NO_PRODUCTS}' ELSE '' END AS warnings FROM pages""")
def src28_receipts(t: Tables) -> DataFrame:
    found = pages.page_receipts(_described(t), "page_id", "html")
    return found.select("page_id", "blocks", "products", F.array_join("warnings", ", ").alias("warnings"))


_BUILT = r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '["\\\n\r\t&]', ' ', 'g') AS title FROM pages WHERE page_id % 11 <> 0 AND page_id % 9 <> 0),
b0 AS (SELECT page_id, '{"@type":["Thing","Product"],"name":"Lote ' || page_id % 50 || ' - ' || title || '","offers":[7,{"url":"https://x.example/?a=1&lote=' || page_id % 50 || '","price":"' || (1000 + page_id) || ',50","priceCurrency":"U$S","availability":"https://schema.org/' || CASE WHEN page_id % 4 = 0 THEN 'SoldOut' ELSE 'InStock' END || '"}]}' AS j FROM t)
"""
_LEVELS = "".join(f""", b{k} AS (SELECT page_id, CASE WHEN page_id % {DEPTHS} >= {k} THEN {"'[1,' || j || ',{" + '"@type":"Person"' + "}]'" if k % 2 else "'{" + '"@graph":' + "' || j || '," + f'"level":{k}' + "}'"} ELSE j END AS j FROM b{k - 1})""" for k in range(1, DEPTHS))


@query("json04_objects", _BUILT + _LEVELS + rf""" SELECT page_id, length(regexp_replace(n.fullkey, '[^.\[]', '', 'g')) AS depth, count(*) AS objects, count(*) FILTER (json_extract_string(n.value, '$."@type"') = 'Person') AS persons
  FROM b{DEPTHS - 1}, json_tree(j) AS n WHERE n.type = 'OBJECT' GROUP BY ALL""")
def json04(t: Tables) -> DataFrame:
    """Objects of the pages' blocks by their depth; blocks cut short have none."""
    found = pages.objects(pages.blocks(_described(t), ["page_id"], "html"))
    return found.groupBy("page_id", F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("objects"), F.count_if(pages.has_type(F.col("node"), "person")).alias("persons"))
