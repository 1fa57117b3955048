"""Readings of titles and pages on stand-ins: a part's name and words that say something of the piece, each distinct text read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions import evidence
from lotwatch.plans.base import Tables, query

#: (words, platform, status) of titles' originality and origin.
ORIGINALITY = (
    ("bootleg cartridge", "n64", "copy"), ("game card usa version", "snes", "copy"), ("game card", "3ds", ""), ("video game cartridge", "n64", "suspect"), ("authentic cartridge", "gb", "declared"), ("not a repro", "gbc", "declared"), ("with repro box", "snes", "unknown"), ("tested", "gba", "unknown"), ("tested", "ps2", ""),
    ("no fakes", "ps1", "declared"), ("genuine", "xbox", "declared"), ("custom translated", "genesis", "copy"),
)
#: (words, platform, status, missing, reader) of consoles.
KITS = (
    ("console with oem controller jumper pak all cords", "n64", "ready", "", ""), ("console only", "n64", "console-only", "controller,cables,jumper-pak", ""), ("lcd lines", "gb", "damaged", "", ""), ("console powers on", "ps2", "undeclared", "", "powers-only"), ("complete in box", "ps2", "cib", "", "unconfirmed"),
    ("with original box no controller", "ps3", "missing", "controller", "unconfirmed"), ("ready to play reads all discs", "ps2", "ready", "", "confirmed"), ("not cib", "ps4", "undeclared", "", "unconfirmed"), ("missing battery cover", "gbc", "missing", "battery-cover", ""), ("no charger turns on", "psp", "missing", "charger", "powers-only"),
)
#: (description, missing, defects, returns refused) of pages.
PAGES = (
    ("does not include the power supply", "power-supply", "", False), ("no power", "", "", False), ("sticks are slightly loose, no returns", "", "loose-stick", True), ("no scratches or issues", "", "", False), ("scratched and yellowed, please read", "", "scratches,discoloration,read-description", False),
    ("sold as is for parts", "", "for-parts,as-is", False), ("aftermarket controllers, av cable missing", "av-cable", "generic-accessory", False), ("all sales final. broken hinge", "", "broken-part", True), ("", "", "", False),
)
#: (words, pieces, quantity, others) of lots for a PS2.
LOTS = (("lot of 12 games", 12, "confirmed", ""), ("games lot", None, "unconfirmed", ""), ("lot of 12 with controllers", 12, "unconfirmed", ""), ("lot of 8 ps1 and ps2 titles", 8, "unconfirmed", "ps1"), ("lot of 9 psp wii games", 9, "confirmed", "psp,wii"), ("lot of 7 games works on ps1", 7, "confirmed", ""), ("cartridge", None, "single", ""))


def _values(rows) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x + "'"
    return ", ".join(f"({i}, {', '.join(map(cell, r))})" for i, r in enumerate(rows))


def _sql(rows, columns: str, select: str) -> str:
    return f"""WITH e(i, words, {columns}) AS (VALUES {_values(rows)}), n AS (SELECT l_suppkey % {len(rows)} AS i, p_name, count(*) AS listings FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_name || ' ' || words AS title, {select}, listings FROM n JOIN e USING (i)"""


def _titles(t: Tables, rows) -> DataFrame:
    """title and k (its place among the rows) with the number of lines; title is the part's name and the row's words."""
    at = (F.col("l_suppkey") % len(rows)).cast("int")
    words = F.element_at(F.array(*[F.lit(r[0]) for r in rows]), at + 1)
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.concat_ws(" ", "p_name", words).alias("title"), at.alias("k"), F.col("p_name").alias("name"), words.alias("words")).agg(F.count(F.lit(1)).alias("listings"))


def _of(rows, place: int) -> Column:
    return F.element_at(F.array(*[F.lit(r[place]) for r in rows]), F.col("k") + 1)


@query("strf21_originality", _sql(ORIGINALITY, "platform, status", "platform, status"))
def strf21(t: Tables) -> DataFrame:
    x = _titles(t, ORIGINALITY).withColumn("platform", _of(ORIGINALITY, 1))
    return x.select("title", "platform", evidence.authenticity(F.col("title"), F.col("platform"))["status"].alias("status"), "listings")


@query("strf22_console_kits", _sql(KITS, "platform, status, missing, reader", "status, missing, reader"))
def strf22(t: Tables) -> DataFrame:
    x = _titles(t, KITS).withColumn("v", evidence.console_kit(F.col("title"), _of(KITS, 1)))
    return x.select("title", "v.status", F.array_join("v.missing", ",").alias("missing"), "v.reader", "listings")


@query("strf23_page_evidence", _sql(PAGES, "missing, defects, refused", "missing, defects, refused"))
def strf23(t: Tables) -> DataFrame:
    v = evidence.listing_evidence(F.col("name"), F.col("words"), F.lit(None).cast("string"), F.lit("ps2"))
    x = _titles(t, PAGES).withColumn("v", v)
    return x.select("title", F.array_join("v.missing", ",").alias("missing"), F.array_join(F.transform("v.defects", lambda d: d["key"]), ",").alias("defects"), F.col("v.returns_refused").alias("refused"), "listings")


@query("strf18_lot_analysis", _sql(LOTS, "pieces, quantity, others", "pieces, quantity, others"))
def strf18(t: Tables) -> DataFrame:
    x = _titles(t, LOTS).withColumn("v", evidence.lot_analysis(F.col("title"), F.lit("ps2")))
    return x.select("title", "v.pieces", "v.quantity", F.array_join("v.others", ",").alias("others"), "listings")


@query("strf20_hardware_origin", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'clone' WHEN 1 THEN 'reissue' ELSE '' END AS status FROM supplier")
def strf20(t: Tables) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ("Genesis bootleg clone", "SNES Classic Edition", "NES not a clone", "Mega Drive tested"))), (1 + F.col("s_suppkey") % 4).cast("int"))
    return t.supplier.select("s_suppkey", evidence.hardware_origin(F.concat_ws(" ", "s_name", words))["status"].alias("status"))
