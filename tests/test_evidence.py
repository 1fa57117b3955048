"""What titles and pages say, on listings whose reading is known."""

import pytest
from pyspark.sql import functions as F

from lotwatch.functions import evidence, kinds
from lotwatch.functions.platforms import platform_key


def read(spark, rows, column, schema="t string, p string"):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


#: (title, platform, status, signal)
CARTRIDGES = [
    ("Super mario 64 STAR ROAD Video Game Cartridge", "n64", "suspect", "video game cartridge"), ("Pokémon Stadium 2 Compatible N64 Cartridge", "n64", "copy", "compatible n64 cartridge"), ("Contra III The Alien Wars SNES GAME CARD USA VERSION", "snes", "copy", "game card"),
    ("Super Mario World SNES Custom English Translated Cartridge", "snes", "copy", "custom"), ("Pokemon Crystal GBC Gold Shell Holographic Label", "gbc", "copy", "gold shell"), ("Zelda Ocarina of Time N64 Bootleg Cartridge", "n64", "copy", "bootleg"),
    ("Super Mario 64 Nintendo 64 N64 Authentic Cartridge Tested", "n64", "declared", "authentic"), ("Super Mario 64 Nintendo 64 N64 Tested", "n64", "unknown", ""), ("Final Fantasy VII PS1 Complete CIB Black Label", "ps1", "", ""), ("Zelda N64 Not a Repro", "n64", "declared", "not a repro"),
    ("God of War PS2 no fakes", "ps2", "declared", ""), ("Mario Kart 3DS game card", "3ds", "", ""), ("Chrono Trigger SNES with repro box", "snes", "unknown", ""), ("Game USA version", None, "", ""), (None, "n64", "unknown", ""),
]


def test_originality_of_cartridges(spark):
    got = read(spark, [c[:2] for c in CARTRIDGES], evidence.authenticity(F.col("t"), F.col("p")))
    assert [(t, v["status"], v["signal"]) for (t, *_), v in zip(CARTRIDGES, got)] == [(t, s, w) for t, _, s, w in CARTRIDGES]


@pytest.mark.parametrize(
    ("title", "status"),
    [("Sega Mega Drive II Console Chinese Bootleg Clone", "clone"), ("Nintendo NES Classic 2018", "reissue"), ("SNES Classic Edition", "reissue"), ("Sega Genesis Model 1 not a clone", ""), ("Super Nintendo 500 in 1", "clone"), ("Sega Genesis Classic Series", ""), ("", "")],
)
def test_consoles_that_are_not_the_original(spark, title, status):
    assert read(spark, [(title, None)], evidence.hardware_origin(F.col("t")))[0]["status"] == status


KITS = [
    ("Nintendo 64 N64 Console W/ OEM Controller, Jumper Pak, All Cords. Tested/Working", "n64", "ready", [], ""), ("Nintendo 64 Console Only Tested Working", "n64", "console-only", ["controller", "cables", "jumper-pak"], ""), ("Nintendo Game Boy DMG-01 Tested Working LCD Lines", "gb", "damaged", [], ""),
    ("Sony PlayStation 2 Slim SCPH-79001 Console Powers On", "ps2", "undeclared", [], "powers-only"), ("PS2 console complete in box", "ps2", "cib", [], "unconfirmed"), ("PS2 console with original box no controller", "ps2", "missing", ["controller"], "unconfirmed"), ("PS2 ready to play reads all discs", "ps2", "ready", [], "confirmed"),
    ("PS2 reads games, controller and cables", "ps2", "ready", [], "partial"), ("PS3 plays games no power cord, controller not included", "ps3", "console-only", ["controller", "cables"], "confirmed"), ("Game Boy missing battery cover", "gb", "missing", ["battery-cover"], ""), ("Game Boy handheld only", "gb", "undeclared", [], ""),
    ("PSP no charger", "psp", "missing", ["charger"], "unconfirmed"), ("Switch OLED console", "switch", "ready", [], ""), ("PS3 with repro box, controller, cables", "ps3", "ready", [], "unconfirmed"), ("PS3 not CIB", "ps3", "undeclared", [], "unconfirmed"), ("Some console with controller and cables", None, "ready", [], ""),
]


def test_what_a_console_comes_with(spark):
    got = read(spark, [k[:2] for k in KITS], evidence.console_kit(F.col("t"), F.col("p")))
    assert [(k[0], v["status"], v["missing"], v["reader"]) for k, v in zip(KITS, got)] == [(t, s, m, r) for t, _, s, m, r in KITS]
    assert got[2]["issues"] == ["pantalla con líneas"] and got[3]["reads"] == "CD y DVD" and got[9]["undeclared"] == []


PAGES = [
    ("N64 Console Bundle OEM Controller Power AV Jumper Pak Tested", "Does not include the power supply. The joystick is a bit loose.", "", "n64", ["power-supply"], ["loose-stick"], "jumper", False, True),
    ("PS2 console", "No scratches, no issues, works perfectly", "", "ps2", [], [], "", False, True), ("PS2 console scratched", None, None, "ps2", [], ["scratches"], "", False, False), ("PS2", "no power, for parts", "All sales final", "ps2", [], ["for-parts"], "", True, True),
    ("Nintendo 64 console with expansion pak", "aftermarket controllers, yellowed. Please read description", "no returns", None, [], ["discoloration", "read-description", "generic-accessory"], "expansion", True, True),
    ("PSP", "charger sold separately; AV cable is not included", "doesn't turn on", "psp", ["av-cable", "charger"], ["not-working"], "", False, True), (None, None, None, None, [], [], "", False, False),
]


def test_what_a_page_takes_away(spark):
    got = read(spark, [p[:4] for p in PAGES], evidence.listing_evidence(F.col("t"), F.col("d"), F.col("n"), F.col("p")), "t string, d string, n string, p string")
    assert [(v["missing"], [d["key"] for d in v["defects"]], v["memory"], v["returns_refused"], v["read"]) for v in got] == [p[4:] for p in PAGES]
    assert got[4]["defects"][-1]["label"] == "accesorio no original («aftermarket controllers»)" and got[0]["defects"][0]["piece"] == "controller"


LOTS = [
    ("Mystery Mixed Lot of 15 PS2 Games Blind Pack", "ps2", 15, "confirmed", "mystery", "", []), ("PS2 2 Game Bundle God of War Shadow of the Colossus", "ps2", 2, "confirmed", "", "", []), ("PS2 Game Bundle Kingdom Hearts Final Fantasy X", "ps2", None, "unconfirmed", "", "", []),
    ("Lot of 20 Video Games PS1 PS2 Xbox Wii PS4", "ps1", 20, "confirmed", "", "", ["ps2", "xbox", "wii", "ps4"]), ("30X WHOLESALE Nintendo 3DS Imagine Babyz Lot", "3ds", None, "unconfirmed", "", "30x", []), ("Lot of 12 PS1 Games Tested Final Fantasy Crash Spyro", "ps1", 12, "confirmed", "", "", []),
    ("Lot of 16 PS2 Sports Games Madden NBA Tested", "ps2", 16, "confirmed", "", "", []), ("Lot of 12 PS2 controllers and games", "ps2", 12, "unconfirmed", "", "", []), ("Lot of 10 with 10 games and controllers", "ps2", 10, "confirmed", "", "", []), ("God of War PS2", "ps2", None, "single", "", "", []),
    ("Lot of 8 PS1 games works on PS2", "ps1", 8, "confirmed", "", "", []), ("Lot of 8 PS1 and PS2 titles", "ps1", 8, "unconfirmed", "", "", ["ps2"]), (None, "ps1", None, "unconfirmed", "", "", []),
]


def test_how_many_games_a_lot_holds(spark):
    got = read(spark, [x[:2] for x in LOTS], evidence.lot_analysis(F.col("t"), F.col("p")))
    assert [(x[0], v["pieces"], v["quantity"], v["mystery"], v["copies"], v["others"]) for x, v in zip(LOTS, got)] == [(t, n, q, m, c, o) for t, _, n, q, m, c, o in LOTS]
    assert got[6]["filler"] == ["sports", "madden", "nba"] and got[4]["filler"] == ["imagine", "babyz"]


#: Listings of the quality audit: (search, platform, title, kind or category).
AUDITED = [
    ("game", "PS1", "Activision Blizzard Pin Set Crash Bandicoot Spyro", "merch"), ("game", "Genesis", "Castlevania Bloodlines Sega Genesis Vintage Video Game Ad Print", "printed"), ("game", "Game Boy Color", "Legend of Zelda Oracle of Seasons Game Boy Color Pin Pinback", "merch"),
    ("game", "Game Boy", "Scholastic Pokemon Red Game Boy Paperback", "printed"), ("game", "SNES", "Super Metroid SNES Manual Only", "printed"), ("game", "Game Boy", "Pokemon Red Game Boy Cartridge Protective Case", "accessory"), ("console", "Game Boy", "Screen Lens Replacement for the Original Game Boy DMG-01", "part"),
    ("console", "Game Boy", "Genuine Nintendo 2 Player Game Link Cable DMG-04 for Game Boy Console", "accessory"), ("console", "Game Boy Color", "Nintendo Game Boy Color Atomic Purple Box And Inserts Only", "printed"), ("lot", "N64", "Nintendo 64 N64 Console Bundle with 10 Games", "console"),
    ("lot", "Genesis", "Sega Genesis Sonic Diorama Figure Lot", "merch"), ("lot", "Game Boy", "Lot of 10 Game Boy Cartridge Protective Cases for Games", "accessory"), ("lot", "PS1", "Lot of 12 PS1 Games Tested Final Fantasy Crash Spyro", "lot"), ("console", "PS3", "Sony PS3 Slim 160GB Console Tested HDMI Not Working", "console"),
]


def test_audited_listings_are_what_they_are(spark):
    got = read(spark, [(a[2], a[1]) for a in AUDITED], kinds.item_kind(F.col("t")))
    assert [(a[2], v["category"] or v["kind"]) for a, v in zip(AUDITED, got)] == [(a[2], a[3]) for a in AUDITED]
    assert all(read(spark, [(a[2], a[1]) for a in AUDITED], platform_key(F.col("p"))))
    broken = read(spark, [(AUDITED[-1][2], "", "", "ps3")], evidence.listing_evidence(F.col("t"), F.col("d"), F.col("n"), F.col("p")), "t string, d string, n string, p string")[0]
    assert [d["key"] for d in broken["defects"]] == ["not-working"]
