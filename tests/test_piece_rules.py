"""The listings of the quality audit get the decision that was wanted, and each rule on pieces has a row."""

from pyspark.sql import functions as F

from lotwatch.operators import piece_rules as R
from lotwatch.operators import valuation, verdict

# (search, platform, title, decision)
AUDIT = [
    ("game", "N64", "Super mario 64 STAR ROAD Video Game Cartridge", "review"), ("game", "N64", "Pokémon Stadium 2 Compatible N64 Cartridge", "reject"), ("game", "SNES", "Contra III The Alien Wars SNES GAME CARD USA VERSION", "reject"), ("game", "SNES", "Super Mario World SNES Custom English Translated Cartridge", "reject"),
    ("game", "Game Boy Color", "Pokemon Crystal GBC Gold Shell Holographic Label", "reject"), ("game", "N64", "Zelda Ocarina of Time N64 Bootleg Cartridge", "reject"), ("game", "PS1", "Activision Blizzard Pin Set Crash Bandicoot Spyro", "reject"), ("game", "Genesis", "Castlevania Bloodlines Sega Genesis Vintage Video Game Ad Print", "reject"),
    ("game", "Game Boy Color", "Legend of Zelda Oracle of Seasons Game Boy Color Pin Pinback", "reject"), ("game", "Game Boy", "Scholastic Pokemon Red Game Boy Paperback", "reject"), ("game", "SNES", "Super Metroid SNES Manual Only", "reject"), ("game", "Game Boy", "Pokemon Red Game Boy Cartridge Protective Case", "reject"),
    ("game", "N64", "Super Mario 64 Nintendo 64 N64 Authentic Cartridge Tested", "accept"), ("game", "N64", "Super Mario 64 Nintendo 64 N64 Tested", "review"), ("game", "PS1", "Final Fantasy VII PS1 Complete CIB Black Label", "review"), ("console", "Game Boy", "Screen Lens Replacement for the Original Game Boy DMG-01", "reject"),
    ("console", "Game Boy", "Genuine Nintendo 2 Player Game Link Cable DMG-04 for Game Boy Console", "reject"), ("console", "Game Boy Color", "Nintendo Game Boy Color Atomic Purple Box And Inserts Only", "reject"), ("console", "Genesis", "Sega Mega Drive II Console Chinese Bootleg Clone", "reject"), ("console", "NES", "Nintendo NES Classic 2018", "reject"),
    ("console", "PS3", "Sony PS3 Slim 160GB Console Tested HDMI Not Working", "reject"), ("console", "PS3", "Sony PlayStation 3 Fat 80GB Console YLOD", "reject"), ("console", "N64", "Nintendo 64 N64 Console W/ OEM Controller, Jumper Pak, All Cords. Tested/Working", "accept"), ("console", "N64", "Nintendo 64 Console Only Tested Working", "accept"),
    ("console", "Game Boy", "Nintendo Game Boy DMG-01 Tested Working LCD Lines", "review"), ("console", "PS2", "Sony PlayStation 2 Slim SCPH-79001 Console Powers On", "accept"), ("lot", "PS2", "Mystery Mixed Lot of 15 PS2 Games Blind Pack", "reject"), ("lot", "PS2", "PS2 2 Game Bundle God of War Shadow of the Colossus", "reject"),
    ("lot", "PS2", "PS2 Game Bundle Kingdom Hearts Final Fantasy X", "unconfirmed"), ("lot", "PS1", "Lot of 20 Video Games PS1 PS2 Xbox Wii PS4", "reject"), ("lot", "N64", "Nintendo 64 N64 Console Bundle with 10 Games", "reject"), ("lot", "Genesis", "Sega Genesis Sonic Diorama Figure Lot", "reject"),
    ("lot", "Game Boy", "Lot of 10 Game Boy Cartridge Protective Cases for Games", "reject"), ("lot", "3DS", "30X WHOLESALE Nintendo 3DS Imagine Babyz Lot", "reject"), ("lot", "PS1", "Lot of 12 PS1 Games Tested Final Fantasy Crash Spyro", "accept"), ("lot", "PS2", "Lot of 16 PS2 Sports Games Madden NBA Tested", "accept"),
]


def test_decisions_of_the_quality_audit(spark):
    df = spark.createDataFrame([(k, *a[:3]) for k, a in enumerate(AUDIT)], "i int, search string, platform string, title string")
    search = F.col("search")
    original = F.when(search == "game", "required").otherwise("preferred")
    criteria = {"expected": F.when(search != "lot", search).otherwise(""), "search": search, "original": original, "tested": F.when(search == "console", "preferred"), "min_lot": F.when(search == "lot", 10)}
    read = df.withColumn("s", R.piece_signals(F.col("title"), F.col("platform")))
    read = read.withColumn("v", verdict.summed(R.piece_findings(F.col("s"), F.lit(50.0), F.lit(5.0), F.lit("US"), criteria)))
    a = R.piece_assessment(F.col("s"), original, search, band=F.lit("ganga"), ratio=F.lit(0.6), match_confidence=F.col("v.confidence"), shipping_known=F.lit(True))
    g = valuation.gates(a)
    decision = F.when(~F.col("v.matched"), "reject").when(F.col("g.section") == "unconfirmed-quantity", "unconfirmed").when(F.col("g.band") == "revisar", "review").otherwise("accept")
    got = {r["i"]: (r["d"], list(r["v"]["blockers"])) for r in read.withColumn("g", g).select("i", "v", decision.alias("d")).collect()}
    assert [(a[2], got[k]) for k, a in enumerate(AUDIT) if got[k][0] != a[3]] == []
    counts = {d: sum(1 for k in got if got[k][0] == d) for d in ("reject", "review", "unconfirmed", "accept")}
    assert counts == {"reject": 25, "review": 4, "unconfirmed": 1, "accept": 6}


CRITERIA = {"expected": "string", "search": "string", "tested": "string", "original": "string", "min_lot": "double", "max_per_piece": "double", "region": "string", "exclude_regions": "array<string>", "returns_required": "boolean", "free_shipping": "boolean", "source_tells_returns": "boolean"}
# (title, what is given besides, findings)
RULES = [
    ("Kingdom Hearts PS2", {}, []), ("Kingdom Hearts PS2", {"expected": "console"}, [("unverified", "not said to come with: controller, cables"), ("unverified", "reader unconfirmed: CD y DVD")]), ("Kingdom Hearts PS2 CIB", {"expected": "console"}, [("block", "is game, wanted console")]),
    ("Nintendo Wii Console Bundle Installed N64 SNES Games", {"platform": "snes", "search": "console"}, [("block", "console of wii"), ("unverified", "not said to come with: controller, cables")]), ("Lot of 4 games", {"search": "lot", "platform": "ps2", "max_per_piece": 10.0}, [("block", "price per piece above the limit: 12.5")]),
    ("Lot of 4 games", {"search": "lot", "platform": "ps2", "max_per_piece": 20.0, "min_lot": 3}, [("reason", "pieces: 4"), ("reason", "price per piece: 12.5")]), ("Lot of 4 games", {"search": "lot", "platform": "ps2", "min_lot": 5}, [("block", "too few pieces: 4")]),
    ("Games lot PS2", {"search": "lot", "platform": "ps2", "min_lot": 5}, [("unverified", "pieces not declared")]), ("PS2 games lot you pick", {"search": "lot", "platform": "ps2", "min_lot": 5}, [("unverified", "price of a choice, not of a lot")]), ("Games lot PS2", {"search": "lot", "platform": "ps2", "max_per_piece": 5.0}, [("unverified", "price per piece unknown")]),
    ("Lot of 12 PS2 games with controllers", {"search": "lot", "platform": "ps2", "min_lot": 5}, [("reason", "pieces: 12")]), ("Lot of 12 PS2 controllers and carts", {"search": "lot", "platform": "ps2", "min_lot": 5, "max_per_piece": 9.0}, [("unverified", "pieces may not be games: controllers")]),
    ("Lot of 3 PS2 controllers and carts", {"search": "lot", "platform": "ps2", "min_lot": 5}, [("block", "too few pieces: 3")]), ("God of War PS2", {"search": "lot", "platform": "ps2"}, [("block", "a single game")]), ("Zelda N64 bad label", {"tested": "preferred"}, [("block", "declares a defect: bad")]),
    ("Zelda N64 aftermarket shell", {"original": "required"}, [("block", "parts by others: aftermarket")]), ("Zelda N64 genuine", {"original": "required"}, [("reason", "original parts")]), ("Zelda N64", {"original": "preferred"}, [("unverified", "originality: look at label, board and screws")]), ("God of War PS2", {"original": "preferred"}, [("unverified", "originality not declared")]),
    ("Zelda N64 repro", {"original": "preferred"}, [("reason", "parts by others: repro"), ("block", "reproduction: repro")]), ("Zelda N64 repro", {}, [("reason", "possible reproduction: repro")]), ("Zelda N64 not a repro", {}, []), ("Zelda N64 USA version", {}, [("unverified", "marks of copies: usa version")]),
    ("SNES Classic console", {"search": "console", "platform": "snes"}, [("reason", "reissue, not the original: snes classic"), ("unverified", "not said to come with: controller, cables")]), ("PS3 console ready to play, plays games", {"search": "console", "platform": "ps3"}, [("reason", "ready to use")]),
    ("Zelda N64 PAL", {}, [("unverified", "edition pal: does it run, in which language")]), ("Zelda N64 PAL", {"exclude_regions": ["pal"]}, [("block", "excluded region: pal")]), ("Zelda N64", {"exclude_regions": ["ntsc-j"], "location": " jp "}, [("block", "excluded region: ntsc-j")]), ("Zelda N64 made in Japan", {"exclude_regions": ["ntsc-j"]}, []),
    ("Zelda N64", {"returns_required": True, "free_shipping": True, "shipping": None}, [("unverified", "returns not told by the source"), ("unverified", "free shipping not confirmed")]), ("Zelda N64", {"returns_required": True, "source_tells_returns": True, "free_shipping": True}, []), (None, {}, []),
]


def test_each_rule_on_pieces(spark):
    plain = {"platform": "", "price": 50.0, "shipping": 5.0, "location": "US"}
    rows = [(k, t, *((plain | more)[c] for c in plain), *(float(more[c]) if kind == "double" and c in more else more.get(c) for c, kind in CRITERIA.items())) for k, (t, more, _) in enumerate(RULES)]
    schema = "i int, title string, platform string, price double, shipping double, location string, " + ", ".join(f"{c} {kind}" for c, kind in CRITERIA.items())
    column = R.piece_findings(R.piece_signals(F.col("title"), F.col("platform")), F.col("price"), F.col("shipping"), F.col("location"), {c: F.col(c) for c in CRITERIA})
    got = {r["i"]: [(x["kind"], x["text"]) for x in r["v"]] for r in spark.createDataFrame(rows, schema).select("i", column.alias("v")).collect()}
    assert [(RULES[k][0], RULES[k][1], got[k]) for k in sorted(got) if got[k] != RULES[k][2]] == [] and len(got) == len(RULES)


def test_one_verdict_of_both_kinds_of_rules(spark):
    df = spark.createDataFrame([("Zelda Ocarina N64 authentic cartridge tested", 40.0, 5.0)], "t string, p double, s double")
    criteria = {"include": F.array(F.lit("zelda")), "max_item": F.lit(50.0)}
    signals = verdict.text_signals(F.col("t"), criteria)
    both = F.concat(verdict.findings(signals, F.col("p"), F.col("s"), criteria), R.piece_findings(R.piece_signals(F.col("t"), F.lit("N64")), F.col("p"), F.col("s"), F.lit("US"), {"expected": F.lit("game"), "original": F.lit("required")}))
    v = df.select(verdict.summed(both).alias("v")).first()["v"]
    # Of three signals (term, price, original parts) two are met: "authentic" declares the cartridge, not its parts.
    assert v["matched"] and v["reasons"] == ["all terms", "price within the limit"] and v["unverified"] == ["originality: look at label, board and screws"] and v["confidence"] == round(0.4 + 0.6 * 2 / 3 - 0.08, 2)
