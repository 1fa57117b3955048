"""Column functions on literal rows with the values that are known to be right."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lotwatch.functions import keywords as K
from lotwatch.functions import text as X
from lotwatch.operators import lifecycle, match


def value(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields)).select(column).first()[0] if fields else spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("title", "pieces"),
    [
        ("PS2 Lot of 10 games", 10), ("Lot of ten Nintendo 64 carts", 10), ("6-Game Lot", 6), ("Pro Skater 3 Game", None), ("Sealed 3 Games", 3), ("PS2 2 Game Bundle", 2), ("lots x 12", 12),
        ("bundle of seventeen", 17), ("(4) discs", 4), ("lote 8 juegos", 8), ("Lot of 5 with 8 games", None), ("Lot of 5 (5) games", 5), ("Lot of 501", None), ("PlayStation 2 games", None), ("", None), (None, None),
    ],
)
def test_lot_size(spark, title, pieces):
    assert spark.createDataFrame([(title,)], "t string").select(X.lot_size(F.col("t"))).first()[0] == pieces


def test_order_of_searched_terms():
    s = K.SEARCHED
    assert s[s.index("dynacom") + 1] == "terminator" and s[s.index("snes") + 1] == "joystick" and s[s.index("wiimote") + 1] == "mario"
    assert s[s.index("metroid") + 1 :][:3] == ("videojuego", "videojuegos", "cartucho") and s[s.index("cassettes") + 1] == "arcade" and s[-1] == "gamevoi"


@pytest.mark.parametrize(
    ("text", "hits"),
    [
        ("Consola Nintendo y juego de Mario", ["nintendo", "mario", "consola"]), ("Mario vende su auto", []), ("Switch de red Cisco", []), ("Mesa de ping pong", []), ("Game Boy Color con cartucho", ["game boy color", "cartucho"]),
        ("DS", []), ("cartuchos para impresora", []), ("Play-Station con joystick", ["playstation", "joystick"]), ("saturn y familia", []), (None, []),
    ],
)
def test_keywords_in_context(spark, text, hits):
    """The whole dictionary with all its rules."""
    assert spark.createDataFrame([(text,)], "t string").select(match.keyword_hits(F.col("t"))).first()[0] == hits


def test_outbox_id(spark):
    got = spark.range(1).select(lifecycle.outbox_id(F.lit("new"), F.lit("run1"), F.array(F.lit("b"), F.lit("a")))).first()[0]
    assert got == hashlib.sha1(b"new\0run1\0a\0b").hexdigest()


def test_page_texts_are_whole(spark):
    body = spark.range(1).select(X.strip_html(F.concat(F.lit("<p>"), F.repeat(F.lit("a b "), 3000)))).first()[0]
    assert len(body) == 11_999


@pytest.mark.parametrize(
    ("title", "core", "subtitle", "sequel"),
    [
        ("dark souls 2", "dark souls", "", True), ("dark souls", "dark souls", "", False), ("dark souls dark souls 2", "dark souls", "", False), ("red dead redemption 2 discs", "red dead redemption", "", False),
        ("dark souls 2 disc only", "dark souls", "", True), ("god war collection 2 in 1", "god war collection", "", False), ("halo 2", "halo", "combat evolved", True), ("spyro 3 year dragon", "spyro", "year dragon", False),
        ("final fantasy 7 7", "final fantasy 7", "", False), ("mario kart 64 2 player", "mario kart", "", False), ("other thing", "halo", "", False),
    ],
)
def test_names_a_sequel(spark, title, core, subtitle, sequel):
    from lotwatch.operators import rules

    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    row = spark.createDataFrame([(title, core, subtitle)], "t string, c string, s string")
    assert row.select(rules.names_a_sequel(words(F.col("t")), words(F.col("c")), words(F.col("s")))).first()[0] is sequel
