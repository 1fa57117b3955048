"""Kinds of listings on stand-ins: titles made of a part's name and words that say what is sold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.functions import kinds
from lotwatch.plans.base import Tables, query

#: (words, kind, confident, variable price, category), one for each remainder of a line's supplier.
ENDINGS = (
    ("poster", "accessory", True, False, "printed"), ("with poster", "game", False, False, ""), ("console w/ new screen lens", "console", True, False, ""), ("screen lens", "accessory", True, False, "part"), ("console + carrying case", "console", True, False, ""),
    ("magnet pack", "accessory", True, False, "merch"), ("system bundle", "console", True, False, ""), ("cable for the system", "accessory", True, False, "accessory"), ("manual", "accessory", True, False, "printed"), ("no manual", "game", False, False, ""),
    ("games lot you pick", "lot", True, True, ""), ("lot of 4", "lot", True, False, ""), ("controller", "accessory", True, False, "accessory"), ("cib", "game", True, False, ""), ("with clear plastic box protector", "game", False, False, ""), ("11 x 17.5", "accessory", True, False, "printed"),
    ("usb cable", "accessory", True, False, "accessory"), ("and usb cable", "accessory", True, False, "accessory"),
)
_VALUES = ", ".join(f"({i}, '{words}', '{kind}', {sure}, {variable}, '{category}')" for i, (words, kind, sure, variable, category) in enumerate(ENDINGS))


@query(
    "strf15_item_kinds",
    f"""WITH e(i, words, kind, confident, variable_price, category) AS (VALUES {_VALUES}), t AS (SELECT DISTINCT p_name, l_suppkey % {len(ENDINGS)} AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
    n AS (SELECT l_suppkey % {len(ENDINGS)} AS i, p_name, count(*) AS listings FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT p_name || ' ' || words AS title, kind, confident, variable_price, category, listings FROM n JOIN e USING (i)""",
)
def strf15(t: Tables) -> DataFrame:
    """Lines by their title, each distinct title judged once."""
    words = F.element_at(F.array(*[F.lit(e[0]) for e in ENDINGS]), (1 + F.col("l_suppkey") % len(ENDINGS)).cast("int"))
    titles = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat_ws(" ", "p_name", words).alias("title")).agg(F.count(F.lit(1)).alias("listings"))
    return titles.select("title", kinds.item_kind(F.col("title")).alias("k"), "listings").select("title", "k.kind", "k.confident", "k.variable_price", "k.category", "listings")
