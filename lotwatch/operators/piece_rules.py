"""Rules on the piece itself: its kind, platform, lot, originality, what is in the box, and where it comes from.

They go beside the rules on terms and prices (`verdict`) and give findings of the same shape, so that one verdict sums
both. Rules look at what a title was read to say, once for each distinct title; criteria that aren't given don't judge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwatch.functions import evidence as E
from lotwatch.functions import platforms as P
from lotwatch.functions.folding import let, normalize
from lotwatch.functions.kinds import item_kind, names_games
from lotwatch.functions.money import cents
from lotwatch.functions.text import completeness_of, first_signal, region_of
from lotwatch.operators import valuation
from lotwatch.operators.verdict import REPRODUCTION, item

# Words by which listings declare a defect, original parts and parts by others; an accessory for games.
DEFECTS = (
    "bad", "needs", "defective", "faulty", "no sound", "no audio", "no video", "no display", "no picture", "no signal", "not reading", "doesn t read", "doesnt read", "won t read", "read error", "cracked", "some issues", "has issues", "with issues",
    "ylod", "yellow light", "yellow light of death", "blod", "rrod", "red ring", "no hdmi", "hdmi not working", "hdmi doesn t work", "hdmi doesnt work", "hdmi broken", "broken hdmi", "hdmi issue", "hdmi issues", "hdmi port damaged",
)
ORIGINAL = ("oem", "original", "genuine", "official")
BY_OTHERS = ("aftermarket", "third party", "generic", "clone", "replica", "reproduction", "repro")
CASES_FOR = r"\b(?:cases?|protectors?|sleeves?|covers?|boxes)\s+(?:for|fits)\b"
NO_LOT_CATEGORIES = ("printed", "merch", "part")


def piece_signals(title: Column, platform: Column) -> Column:
    """All that the rules look at in a title, for a search's platform as someone wrote it: the same for equal ones."""
    found = F.struct(F.coalesce(title, F.lit("")).alias("title"), P.resolve_platform(platform, title).alias("platform"))

    def read(b: Column) -> Column:
        t, key = b["title"], b["platform"]
        text = F.struct(normalize(t).alias("text"), item_kind(t).alias("item"))

        def signals(s: Column) -> Column:
            bare = E.without_denials(E.padded(t))["text"]
            region = region_of(F.trim(F.replace(s["text"], F.lit("made in japan"), F.lit(" "))))
            return F.struct(
                key.alias("platform"), P.platforms_in_text(t).alias("named"), s["item"].alias("item"), names_games(t).alias("games"), F.lower(t).rlike(CASES_FOR).alias("cases"), E.lot_analysis(t, key).alias("lot"), E.authenticity(t, key).alias("authenticity"),
                E.hardware_origin(t).alias("origin"), E.console_kit(t, key).alias("kit"), first_signal(s["text"], DEFECTS).alias("defect"), first_signal(s["text"], ORIGINAL).alias("original"), first_signal(F.trim(bare), BY_OTHERS).alias("by_others"),
                first_signal(F.trim(bare), REPRODUCTION).alias("copy"), region.alias("region"), completeness_of(s["text"]).alias("completeness"), F.coalesce(P.platform_attribute(key, "medium") == "cartridge", F.lit(False)).alias("cartridge"),
            )

        return let(text, signals)

    return let(found, read)


def piece_findings(signals: Column, price: Column, shipping: Column, location: Column, criteria: dict[str, Column]) -> Column:
    """What the rules on the piece find, from piece_signals(); the shape of verdict's findings.

    criteria: expected (kind), search (lot, console or another type), tested and original (any, preferred, required),
    min_lot, max_per_piece, region, exclude_regions, returns_required, free_shipping, source_tells_returns.
    """
    kinds = {"expected": "string", "search": "string", "tested": "string", "original": "string", "min_lot": "double", "max_per_piece": "double", "region": "string", "exclude_regions": "array<string>", "returns_required": "boolean", "free_shipping": "boolean", "source_tells_returns": "boolean"}
    given = [criteria.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    base = F.struct(signals.alias("s"), price.alias("price"), shipping.alias("shipping"), location.alias("location"), *given)
    return let(base, _found)


def _found(b: Column) -> Column:
    s, k, lot, kit, text = b["s"], b["s"]["item"], b["s"]["lot"], b["s"]["kit"], F.lit
    true = valuation.true
    level = lambda name: F.coalesce(b[name], F.lit("any"))
    lots = true(b["search"] == "lot")
    consoles = true(b["expected"] == "console") | true(b["search"] == "console")
    sure, of_kind = true(k["confident"]), k["kind"]
    say = lambda *parts: F.concat(*[text(p) if isinstance(p, str) else F.coalesce(p.cast("string"), text("")) for p in parts])

    # A number counts pieces only if the lot's analysis lets it.
    open_number = lots & true(lot["quantity"] == "unconfirmed") & lot["pieces"].isNotNull()
    declared = F.when(~open_number, lot["pieces"])
    least = F.when(~open_number, b["min_lot"])
    each = cents(b["price"] / declared)
    priced = b["max_per_piece"].isNotNull() & b["price"].isNotNull()
    measured = priced & (declared > 0) & ~true(k["variable_price"])

    original = level("original")
    asks_original, needs_original = original != "any", original == "required"
    console_piece = (of_kind == "console") | (consoles & ~sure)
    authentic = s["authenticity"]
    judged_copy = ~console_piece & (of_kind != "accessory")
    copy = F.coalesce(F.nullif(s["copy"], text("")), F.when(judged_copy & (authentic["status"] == "copy"), authentic["signal"]), text(""))
    copy_blocks = needs_original | ((original == "preferred") & judged_copy)
    is_console = consoles & of_kind.isin("console", "game") & console_piece
    seen = F.coalesce(F.nullif(s["region"], text("")), F.when(F.upper(F.trim(b["location"])) == "JP", "ntsc-j"), text(""))
    excluded = F.coalesce(b["exclude_regions"], F.array().cast("array<string>"))
    category = F.coalesce(F.nullif(k["category"], text("")), text("accessory"))
    others = F.array_join(lot["others"], ", ")

    findings = F.array(
        item("block", say("is ", F.when(of_kind == "accessory", category).otherwise(of_kind), ", wanted ", b["expected"]), true(b["expected"] != "") & sure & (of_kind != b["expected"])),
        item("block", say("console of ", F.get(s["named"], 0)), consoles & true(s["platform"] != "") & (F.size(s["named"]) > 0) & true(F.get(s["named"], 0) != s["platform"])),
        item("block", say("no lot of games: ", category), lots & sure & (of_kind == "accessory") & (~s["games"] | k["category"].isin(*NO_LOT_CATEGORIES) | s["cases"])),
        item("block", "a console with games", lots & sure & (of_kind == "console")),
        item("block", "a single game", lots & ~(sure & (of_kind == "console")) & (lot["quantity"] == "single")),
        item("block", say("surprise lot: ", lot["mystery"]), lots & (lot["mystery"] != "")),
        item("block", say("copies of one game: ", lot["copies"]), lots & (lot["copies"] != "")),
        item("block", say("platforms mixed: ", others), lots & (F.size(lot["others"]) >= 2)),
        item("block", say("too few pieces: ", lot["pieces"]), open_number & true(lot["pieces"] < b["min_lot"])),
        item("unverified", say("pieces may not be games: ", lot["why"]), open_number & ~true(lot["pieces"] < b["min_lot"])),
        item("unverified", F.when(true(k["variable_price"]), "price of a choice, not of a lot").otherwise("pieces not declared"), least.isNotNull() & declared.isNull(), 1),
        item("block", say("too few pieces: ", declared), true(declared < least), 1),
        item("reason", say("pieces: ", declared), true(declared >= least), 1, F.lit(True)),
        item("block", say("price per piece above the limit: ", each), true(measured & (each > b["max_per_piece"])), 1),
        item("reason", say("price per piece: ", each), true(measured & (each <= b["max_per_piece"])), 1, F.lit(True)),
        item("unverified", "price per piece unknown", priced & ~true(measured) & least.isNull() & ~open_number),
        item("block", say("declares a defect: ", s["defect"]), (level("tested") != "any") & (s["defect"] != "")),
        item("block", say("parts by others: ", s["by_others"]), needs_original & (s["by_others"] != ""), 1),
        item("reason", say("parts by others: ", s["by_others"]), (original == "preferred") & (s["by_others"] != ""), 1),
        item("reason", "original parts", asks_original & (s["by_others"] == "") & (s["original"] != ""), 1, F.lit(True)),
        item("unverified", F.when(s["cartridge"] & of_kind.isin("game", "lot"), "originality: look at label, board and screws").otherwise("originality not declared"), asks_original & (s["by_others"] == "") & (s["original"] == ""), 1),
        item("block", say("reproduction: ", copy), (copy != "") & copy_blocks),
        item("reason", say("possible reproduction: ", copy), (copy != "") & ~copy_blocks),
        item("unverified", say("marks of copies: ", authentic["signal"]), (copy == "") & judged_copy & (authentic["status"] == "suspect")),
        item("block", say(s["origin"]["status"], ", not the original: ", s["origin"]["signal"]), is_console & (s["origin"]["status"] != "") & asks_original),
        item("reason", say(s["origin"]["status"], ", not the original: ", s["origin"]["signal"]), is_console & (s["origin"]["status"] != "") & ~asks_original),
        item("reason", F.when(kit["status"] == "cib", "complete in box").otherwise("ready to use"), is_console & kit["status"].isin("ready", "cib")),
        item("unverified", say("not said to come with: ", F.array_join(kit["undeclared"], ", ")), is_console & (F.size(kit["undeclared"]) > 0) & (kit["status"] != "console-only")),
        item("unverified", say("reader ", kit["reader"], ": ", kit["reads"]), is_console & kit["reader"].isin("powers-only", "partial", "unconfirmed")),
        item("block", say("excluded region: ", seen), true(F.array_contains(excluded, seen))),
        item("unverified", say("edition ", s["region"], ": does it run, in which language"), s["region"].isin("pal", "ntsc-j") & ~true(F.array_contains(excluded, s["region"])) & (F.coalesce(b["region"], text("")) == "")),
        item("unverified", "returns not told by the source", true(b["returns_required"]) & ~true(b["source_tells_returns"])),
        item("unverified", "free shipping not confirmed", true(b["free_shipping"]) & b["shipping"].isNull()),
    )
    return F.filter(findings, lambda x: x.isNotNull())


def piece_assessment(signals: Column, original: Column, search: Column, **more: Column) -> Column:
    """valuation.ASSESSED from a title's signals: what the verdict's gates look at; `more` are fields known from elsewhere."""
    s, k = signals, signals["item"]
    lots = valuation.true(search == "lot")
    console = k["kind"] == "console"
    boxed = F.when(console, s["kit"]["status"] == "cib").otherwise(s["completeness"] == "cib")
    known = {
        "item_kind": k["kind"], "item_confident": k["confident"], "original_required": F.coalesce(original, F.lit("any")) != "any", "is_lot": lots, "lot_quantity": s["lot"]["quantity"], "lot_filler": s["lot"]["filler"],
        "authenticity": F.when(~console & (k["kind"] != "accessory"), s["authenticity"]["status"]), "origin": F.when(console, s["origin"]["status"]), "kit_status": F.when(console, s["kit"]["status"]), "kit_reader": F.when(console, s["kit"]["reader"]), "reads": s["kit"]["reads"],
        "objective_id": F.when(console, "console-cib").otherwise("game-cib"), "objective_status": F.when(boxed & ~lots, "declared").otherwise(""), "missing": None,
    }
    return valuation.assessed(**{n: c for n, c in (known | more).items() if c is not None})
