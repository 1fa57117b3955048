"""What titles and pages say of a piece besides its kind: is it original, what is in the box, what is broken, how many a lot holds.

Every reading is an expression over a normalised text, and gives the words that it rests on. A denial isn't a
confession: "not a repro", "no CIB" and "no scratches" are taken out before anything is looked for. What a page says
only ever takes away; nothing is added to a piece because its description mentions it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwatch.functions import platforms as P
from lotwatch.functions.folding import let, normalize
from lotwatch.functions.kinds import any_of, bare_title, item_kind, names_games
from lotwatch.functions.text import lot_size

# Patterns over normalised texts. Results depend on these words and, where the first one found is named, on
# their order.
PACKAGING = (
    r"\b(?:repro(?:duction)?|replacement|custom|aftermarket|reprint(?:ed)?|reproduced|fake|third\s+party)\s+(?:box(?:es)?|cases?|packaging|manuals?|inserts?)\b",
    r"\b(?:box|case|manual|packaging)\s+(?:is\s+)?(?:a\s+)?(?:repro(?:duction)?|reprint(?:ed)?|custom|replacement)\b", r"\bnot\s+(?:the\s+)?original\s+(?:box|case|packaging)\b",
)
NO_COPY = r"\b(?:not|no|non|never|zero)\s+(?:a\s+|an\s+)?(?:repro(?:duction)?s?|fakes?|bootlegs?|counterfeits?|clones?|copy|copies|knock\s*offs?)\b"
REISSUES = (
    r"\bclassic\s+(?:mini|edition)\b", r"\bmini\s+classic\b", r"\b(?:nes|snes|super\s+nes|super\s+nintendo|famicom|playstation|ps|genesis|mega\s+drive|sega)\s+(?:classic|mini)\b(?!\s+series)", r"\bplug\s+(?:and|n)\s+play\b", r"\bretro\s*bit\b",
    r"\bretron\b", r"\bhyperkin\b", r"\bsupaboy\b",
)
CLONES = (
    r"\bbootlegs?\b", r"\bclones?\b", r"\bfamiclones?\b", r"\bknock\s*offs?\b", r"\bcounterfeit\b", r"\bfakes?\b", r"\breplicas?\b", r"\bunofficial\b", r"\bcompatible\s+(?:console|system)\b", r"\b\d{2,4}\s+in\s+1\b", r"\bbuilt\s*in\s+games\b",
)
COPIES = (r"\brepro(?:duction)?s?\b", r"\bbootlegs?\b", r"\bcounterfeit\b", r"\bfakes?\b", r"\bpirat[ae]s?\b", r"\breplicas?\b", r"\bknock\s*offs?\b")
CARTRIDGE_COPIES = (
    r"\bgame\s+cards?\b", r"\bcompatible\s+(?:[a-z0-9]+\s+){0,2}(?:cartridges?|carts?|game\s+cards?|cards?)\b", r"\b(?:cartridges?|carts?)\s+compatible\b", r"\bcustom\b", r"\bfan\s*made\b", r"\btranslat(?:ed|ion)\b", r"\benglish\s+patch(?:ed)?\b",
    r"\brom\s*hacks?\b", r"\bhack(?:ed|s)?\b", r"\bhomebrew\b", r"\bgold\s+shell\b", r"\bholographic\s+labels?\b", r"\bmulti\s*carts?\b", r"\b\d{2,4}\s+in\s+1\b", r"\beverdrive\b", r"\bflash\s+carts?\b",
)
CARTRIDGE_SUSPECTS = (
    r"\bvideo\s+game\s+cartridge\b", r"\bgame\s+cartridge\s+for\b", r"\b(?:cartridge|cart|card)\s+for\b", r"\b(?:8|16|32|64)\s*bit\b", r"\b(?:us|usa|english|eng|ntsc|north\s+america)\s+version\b", r"\bregion\s+free\b", r"\bnew\s+(?:cartridge|cart)\b",
    r"\bbrand\s+new\b(?!.*\bsealed\b)",
)
AUTHENTIC = (r"\bauthentic\b", r"\bgenuine\b", r"\boem\b", r"\bofficial(?:ly)?\b", r"\b100\s*(?:percent\s+)?original\b", r"\blegit\b", r"\boriginal\s+(?:authentic|cart(?:ridge)?s?)\b")
_POWER = r"power\s+(?:supply|adapter|brick|cord|cable)|ac\s+adapters?"
PRESENT = {
    "controller": r"(?:controllers?|controler|dual\s*shock\s*\d?|sixaxis|game\s*pads?|joy\s*pads?|joysticks?|joy\s*cons?)", "cables": rf"(?:cables?|cords?|hook\s*ups?|{_POWER}|av|a\s+v|hdmi|psu)", "jumper-pak": r"(?:jumper|expansion)\s*pa(?:k|ck)s?",
    "battery-cover": r"battery\s+(?:covers?|doors?|lids?)", "charger": r"(?:chargers?|charging\s+(?:cables?|cords?|docks?|cradles?)|power\s+(?:adapters?|cords?|cables?|supply)|ac\s+adapters?)",
}
MISSABLE = PRESENT | {"cables": rf"(?:cables?|cords?|hook\s*ups?|{_POWER}|av\s+cables?|hdmi\s+cables?|psu)"}
MISSING_BEFORE = r"\b(?:no|without|missing|w\s+o|minus|lacks?|lacking|needs?)\s+(?:(?:the|a|an|any|its|original|oem|official)\s+)*"
MISSING_AFTER = r"\s+(?:not\s+included|missing|sold\s+separately|not\s+incl)\b"
CONSOLE_BOX = (
    r"\bcib\b", r"\bcomplete\s+in\s+(?:the\s+)?(?:original\s+)?box\b", r"\bin\s+(?:the\s+)?(?:original\s+)?box\b", r"\bwith\s+(?:the\s+)?(?:original\s+)?box\b", r"\bw\s+(?:original\s+)?box\b", r"\boriginal\s+box\b", r"\bboxed\b", r"\bnew\s+in\s+box\b",
    r"\bnib\b", r"\bsealed\b",
)
NOT_COMPLETE = r"\b(?:no|not|non|isn\s*t|never)\s+(?:a\s+|an\s+)?(?:cib|complete(?:\s+in\s+(?:the\s+)?(?:original\s+)?box)?|sealed|boxed)\b"
CONSOLE_ONLY = r"\b(?:console|system|unit|handheld)\s+only\b"
READY = (r"\bready\s+to\s+(?:play|go)\b", r"\beverything\s+(?:you\s+)?need(?:ed|s)?\b", r"\bcomplete\s+(?:set\s*up|setup)\b", r"\bplug\s+in\s+and\s+play\b")
ISSUES = (
    (r"\b(?:lcd|screen)\s+(?:has\s+)?(?:(?:some|minor|small|vertical|horizontal|dead)\s+)*lines?\b", "pantalla con líneas"), (r"\b(?:vertical|horizontal)\s+lines?\b", "pantalla con líneas"), (r"\bdead\s+pixels?\b", "píxeles muertos"),
    (r"\bdiscolou?r(?:ed|ation)\b", "decoloración"), (r"\byellow(?:ed|ing)\b", "plástico amarillento"), (r"\bscratch(?:ed|es)?\s+(?:screen|lens)\b", "pantalla rayada"), (r"\b(?:screen|lens)\s+(?:is\s+)?scratch(?:ed|es)?\b", "pantalla rayada"),
    (r"\bloose\s+(?:cartridge\s+|cart\s+)?(?:port|slot)\b", "puerto con juego"), (r"\b(?:port|slot|reader|laser|drive)\s+(?:issues?|problems?)\b", "puerto o lector con problemas"), (r"\b(?:slow|sometimes)\s+(?:to\s+)?reads?\b", "lector irregular"),
    (r"\bintermittent(?:ly)?\b", "falla intermitente"), (r"\bminor\s+issues?\b", "problemas menores declarados"), (r"\bcosmetic\s+(?:damage|issues?|wear)\b", "daño cosmético"),
)
READS_BOTH = (
    r"\breads?\s+(?:all|every|any)\s+(?:discs?|games?|formats?|media)\b", r"\breads?\s+everything\b", r"\b(?:cds?|blue(?:\s+bottom)?|ps1)\s+(?:discs?\s+|games?\s+)?(?:and|&|\+)\s+(?:dvds?|silver|ps2)\b",
    r"\b(?:dvds?|silver|ps2)\s+(?:discs?\s+|games?\s+)?(?:and|&|\+)\s+(?:cds?|blue|ps1)\b",
)
READS = (
    r"\breads?\s+(?:the\s+)?(?:discs?|games?|cds?|dvds?|blu\s*rays?)\b", r"\bplays?\s+(?:all\s+)?(?:games?|discs?|dvds?|cds?|blu\s*rays?)\b", r"\btested\s+(?:with|on)\s+(?:a\s+|several\s+|multiple\s+|\d+\s+)?(?:games?|discs?)\b",
    r"\b(?:disc|disk|optical)?\s*(?:drive|laser|reader)\s+(?:works|working|tested|good|reads|is\s+good|fully\s+functional)\b", r"\bnew\s+laser\b", r"\bloads?\s+games?\b", r"\bgame\s+tested\b",
)
POWERS = (r"\bpowers?\s+(?:on|up)\b", r"\bturns?\s+on\b", r"\bpower\s+tested\b", r"\blights?\s+(?:up|on)\b", r"\bboots?\s+(?:up|to)\b")
PAGE_MISSING = {
    "power-supply": r"(?:power\s+(?:supply|supplies|adapter|brick|cord|cable)|ac\s+adapters?|psu|power)", "av-cable": r"(?:av|a\s+v|composite|video|hdmi)\s+(?:cables?|cords?)", "controller": r"(?:controllers?|game\s*pads?|joy\s*pads?)",
    "jumper-pak": r"(?:jumper|expansion)\s*pa(?:k|ck)s?", "charger": r"(?:chargers?|charging\s+(?:cables?|cords?))",
}
PAGE_BEFORE = (
    r"\b(?:no|without|missing|minus|lacks?|lacking|w\s+o|needs?\s+(?:a\s+|an\s+)?(?:new\s+)?|(?:does|do|did)\s*(?:not|n\s*t)\s+(?:include|come\s+with|have)|not\s+(?:include|including|come\s+with)|doesn\s+t\s+(?:include|come\s+with|have)|don\s+t\s+have|you\s+will\s+need)"
    r"\s+(?:(?:the|a|an|any|its|original|oem|official)\s+)*"
)
PAGE_AFTER = r"\s+(?:(?:is|are)\s+)?(?:not\s+included|missing|sold\s+separately|not\s+incl|excluded|not\s+pictured)\b"
POWER_NAMED = r"\bpower\s+(?:supply|supplies|adapter|brick|cord|cable)|\bac\s+adapters?|\bpsu\b"
DEFECTS = (
    (r"\b(?:joy\s*)?sticks?\s+(?:(?:is|are|a\s+bit|bit|slightly|very|little|kind\s+of)\s+)*(?:loose|worn|wobbly|floppy|drifts?|drifting|sloppy)\b", "loose-stick", "stick del control flojo", "functional", "controller"),
    (r"\b(?:loose|worn|wobbly|floppy|sloppy)\s+(?:joy\s*)?sticks?\b", "loose-stick", "stick del control flojo", "functional", "controller"),
    (r"\b(?:joy\s*)?sticks?\b(?:\s+[a-z]+){0,4}?\s+(?:is|are|feels?|seems?)\s+(?:a\s+bit\s+|slightly\s+|very\s+|kind\s+of\s+|a\s+little\s+)?(?:loose|worn|wobbly|floppy|sloppy)\b", "loose-stick", "stick del control flojo", "functional", "controller"),
    (r"\bstick\s+drift\b|\bdrift(?:s|ing)?\b", "loose-stick", "stick del control con drift", "functional", "controller"),
    (r"\bfor\s+parts\b|\bparts\s+only\b|\bparts\s+or\s+repair\b", "for-parts", "se vende para repuestos", "functional", ""), (r"\bas\s+is\b", "as-is", "se vende «as is»", "functional", ""),
    (r"\buntested\b|\bnot\s+tested\b|\bunable\s+to\s+test\b|\bcan\s+t\s+test\b|\bcould\s+not\s+test\b", "untested", "sin probar", "functional", ""),
    (r"\b(?:not|doesn\s+t|does\s+not|won\s+t|will\s+not|isn\s+t)\s+(?:work(?:ing)?|turn\s+on|power\s+on|read|load|boot)\b", "not-working", "no funciona del todo", "functional", ""),
    (r"\bno\s+(?:video|picture|display|sound|audio)\b", "not-working", "no funciona del todo", "functional", ""), (r"\bneeds?\s+(?:repair|fixing|work|cleaning\s+to\s+work)\b", "needs-repair", "necesita reparación", "functional", ""),
    (r"\b(?:broken|cracked|snapped|missing)\s+(?:tabs?|hinges?|pins?|buttons?|shell|case|housing|port|clips?)\b|\b(?:tabs?|hinges?|pins?|buttons?|shell|case|housing|port|clips?)\s+(?:is\s+|are\s+)?(?:broken|cracked|snapped)\b", "broken-part", "pieza rota", "functional", ""),
    (r"\bscratch(?:es|ed|y)?\b|\bscuff(?:s|ed)?\b|\bscrapes?\b", "scratches", "rayas o raspones", "cosmetic", ""), (r"\byellow(?:ed|ing)\b|\bdiscolou?r(?:ed|ation)\b|\bsun\s+faded\b", "discoloration", "plástico decolorado", "cosmetic", ""),
    (r"\b(?:sticker|label)\s+(?:residue|damage|torn|peeling)\b|\btorn\s+label\b", "label-wear", "etiqueta dañada", "cosmetic", ""),
    (r"\bplease\s+read\b|\bread\s+(?:the\s+)?(?:full\s+)?description\b|\bsee\s+(?:the\s+)?description\b|\bread\s+before\b", "read-description", "el vendedor pide leer la descripción", "notice", ""),
)
NO_DEFECT = (
    r"\b(?:no|zero|without|never|not\s+any|free\s+of)\s+(?:(?:major|visible|noticeable|real|known|significant|obvious|deep|stick|any)\s+)*"
    r"(?:scratch(?:es)?|scuffs?|scrapes?|drift|issues?|problems?|damage|cracks?|yellowing|discolou?ration)\b"
)
GENERIC = (
    r"\b(?:aftermarket|after\s+market|third\s+party|3rd\s+party|generic|non\s+oem|not\s+oem|off\s+brand|compatible|replacement|repro(?:duction)?)\s+(?:(?:n64|nintendo|ps\d?|sega|snes|nes)\s+)?"
    r"(?:controllers?|power\s+(?:supply|adapter)|ac\s+adapters?|av\s+cables?|cables?|chargers?|memory\s+cards?)\b"
)
NO_RETURNS = r"\bno\s+returns?\b|\breturns?\s+(?:are\s+)?not\s+accepted\b|\ball\s+sales\s+(?:are\s+)?final\b|\bno\s+refunds?\b"
EXPANSION, JUMPER = r"\bexpansion\s*pa(?:k|ck)s?\b", r"\bjumper\s*pa(?:k|ck)s?\b"
MYSTERY = (
    r"\bmystery\b", r"\bblind\s+(?:packs?|box(?:es)?|bags?|lots?)\b", r"\bsurprise\b", r"\bgrab\s+bags?\b", r"\brandom\s+(?:games?|titles?|lot|selection|assortment|picks?)\b", r"\b(?:games?|titles?)\s+(?:are\s+)?(?:chosen\s+)?(?:at\s+)?random(?:ly)?\b",
    r"\blucky\s+(?:box|bag|lot|dip)\b", r"\bunknown\s+titles?\b", r"\byou\s+get\s+what\s+you\s+get\b",
)
SAME_GAME = (r"^\s*\d{1,3}\s*x\s", r"\b\d{1,3}\s+(?:copies|units)\b", r"\bx\s*\d{1,3}\s+(?:copies|units)\b", r"\bsame\s+(?:game|title)\b", r"\bmultiple\s+copies\b", r"\bwholesale\b")
FILLER = tuple(rf"\b{x}\b" for x in (
    r"sports?", "madden", "nfl", "nba", "nhl", "mlb", "fifa", "ncaa", "espn", "pga", r"tiger\s+woods", "nascar", r"2k\d{1,2}", "baseball", "football", "basketball", "hockey", "soccer", "imagine", "petz", "babyz", "barbie", "karaoke", r"duplicates?", "bulk", "reseller", "resale",
))
NO_GAMES = (r"\bconsoles?\b", r"\bsystems?\b", r"\bcontrollers?\b", r"\bmemory\s+cards?\b", r"\bcables?\b", r"\bcords?\b", r"\baccessor(?:y|ies)\b", r"\bchargers?\b", r"\bmovies?\b", r"\bumd\s+videos?\b")
COMPATIBLE = r"\b(?:compatible\s+with|works\s+(?:on|with|in)|plays\s+(?:on|in)|playable\s+on|for\s+use\s+(?:on|with)|backwards?\s+compatible(?:\s+with)?)\s+(?:[a-z0-9]+\s+){0,4}"
LOT_WORD = r"\b(?:lots?|bundles?)\b"
_N = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
GAME_COUNTS = (
    rf"\b(?:\d{{1,3}}|{_N})\s*-\s*(?:games?|discs?|titles?|carts?|cartridges?)\b", rf"\b(?:\d{{1,3}}|{_N})\s+(?:games|discs|titles|carts|cartridges|juegos)\b", rf"\b(?:\d{{1,3}}|{_N})\s+game\s+(?:lot|bundle|set|pack)\b",
    rf"\(\s*(?:\d{{1,3}}|{_N})\s*\)\s*(?:games?|discs?|carts?|cartridges?)\b",
)
HOME_KIT = ("controller", "cables")


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), normalize(text), F.lit(" "))


def first_of(text: Column, patterns: Sequence[str]) -> Column:
    """What the first of the patterns, in their order, finds first; the empty string for nothing."""
    each = [F.nullif(F.trim(F.regexp_extract(text, f"({p})", 1)), F.lit("")) for p in patterns]
    return F.when(text.rlike(any_of(patterns)), F.coalesce(*each, F.lit(""))).otherwise("")


def without_denials(text: Column) -> Column:
    """Struct of a normalised text without copied packaging and denied copies, and whether a copy is denied."""
    bare = F.regexp_replace(text, any_of(PACKAGING), " ")
    return let(bare, lambda b: F.struct(F.regexp_replace(b, NO_COPY, " ").alias("text"), b.rlike(NO_COPY).alias("denied")))


def _status(status: Column | str, signal: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(status).alias("status"), lit(signal).alias("signal"))


def hardware_origin(title: Column) -> Column:
    """Struct of status (reissue, clone, or empty for an original) and the words that say so."""

    def judged(text: Column) -> Column:
        s = F.struct(first_of(text, REISSUES).alias("a"), first_of(text, CLONES).alias("b"))
        return let(s, lambda x: F.when(x["a"] != "", _status("reissue", x["a"])).when(x["b"] != "", _status("clone", x["b"])).otherwise(_status("", "")))

    return let(without_denials(padded(title)), lambda d: let(d["text"], judged))


def authenticity(title: Column, platform: Column) -> Column:
    """Struct of status (copy, suspect, declared, unknown, or empty where the rule doesn't apply) and signal, by a platform's key.

    Only retro cartridges have a market of reproductions: there silence is unknown, and a seller's phrases are suspect.
    """
    retro = F.coalesce(P.platform_attribute(platform, "medium") == "cartridge", F.lit(False))

    def judged(d: Column) -> Column:
        text = d["text"]
        found = F.struct(*[first_of(text, p).alias(n) for n, p in (("copy", COPIES), ("cart", CARTRIDGE_COPIES), ("sure", AUTHENTIC), ("odd", CARTRIDGE_SUSPECTS))], d["denied"].alias("denied"), retro.alias("retro"))
        return let(found, lambda x: (
            F.when(x["copy"] != "", _status("copy", x["copy"])).when(~x["retro"], _status(F.when(x["denied"] | (x["sure"] != ""), "declared").otherwise(""), ""))
            .when(x["cart"] != "", _status("copy", x["cart"])).when(x["sure"] != "", _status("declared", x["sure"])).when(x["denied"], _status("declared", "not a repro"))
            .when(x["odd"] != "", _status("suspect", x["odd"])).otherwise(_status("unknown", ""))
        ))

    return let(without_denials(padded(title)), judged)


def console_kit(title: Column, platform: Column) -> Column:
    """What a console comes with, by its title: struct of status, present, missing, undeclared, issues, reader and reads.

    status: damaged, cib, console-only, missing, ready or undeclared; reader: confirmed, partial, powers-only or
    unconfirmed, empty for a platform without one. An unknown platform needs a controller and cables.
    """
    of = lambda name: P.platform_attribute(platform, name)
    needs = F.coalesce(of("requires"), F.array(*map(F.lit, HOME_KIT)))
    home = F.coalesce(of("family") == "home", F.lit(True))

    def states(text: Column) -> Column:
        alone = text.rlike(CONSOLE_ONLY)
        each = []
        for piece in PRESENT:
            lacks = text.rlike(rf"{MISSING_BEFORE}{MISSABLE[piece]}\b") | text.rlike(rf"\b{MISSABLE[piece]}{MISSING_AFTER}")
            without = alone if piece != "battery-cover" else F.lit(False)
            each += [F.lit(piece), F.when(lacks, "missing").when(text.rlike(rf"\b{PRESENT[piece]}\b"), "present").when(without, "missing").otherwise("undeclared")]
        issues = F.array_distinct(F.filter(F.array(*[F.when(text.rlike(p), label) for p, label in ISSUES]), lambda x: x.isNotNull()))
        boxless = F.regexp_replace(F.regexp_replace(text, any_of(PACKAGING), " "), NOT_COMPLETE, " ")
        several = F.coalesce(F.size(of("reader_media")) > 1, F.lit(False))
        reader = F.when(text.rlike(any_of(READS_BOTH)), "confirmed").when(text.rlike(any_of(READS)), F.when(several, "partial").otherwise("confirmed")).when(text.rlike(any_of(POWERS)), "powers-only").otherwise("unconfirmed")
        reads = F.coalesce(of("reader"), F.lit(""))
        return F.struct(
            F.create_map(*each).alias("of"), alone.alias("alone"), issues.alias("issues"), boxless.rlike(any_of(CONSOLE_BOX)).alias("box"), text.rlike(any_of(READY)).alias("ready"),
            F.when(reads != "", reader).otherwise("").alias("reader"), reads.alias("reads"), needs.alias("needs"), home.alias("home"),
        )

    def judged(s: Column) -> Column:
        pick = lambda state: F.filter(s["needs"], lambda p: F.element_at(s["of"], p) == state)
        parts = F.struct(pick("present").alias("present"), pick("missing").alias("missing"), pick("undeclared").alias("undeclared"))

        def named(k: Column) -> Column:
            told = s["ready"] & (F.size(k["undeclared"]) > 0)
            present = F.when(told, F.concat(k["present"], k["undeclared"])).otherwise(k["present"])
            undeclared = F.when(told, F.array().cast("array<string>")).otherwise(k["undeclared"])
            bare = F.size(F.array_except(F.array(*map(F.lit, HOME_KIT)), k["missing"])) == 0
            status = (
                F.when(F.size(s["issues"]) > 0, "damaged").when(s["box"] & (F.size(k["missing"]) == 0), "cib").when(s["home"] & (s["alone"] | bare), "console-only")
                .when(F.size(k["missing"]) > 0, "missing").when(F.size(undeclared) == 0, "ready").otherwise("undeclared")
            )
            return F.struct(status.alias("status"), present.alias("present"), k["missing"], undeclared.alias("undeclared"), s["issues"], s["reader"], s["reads"])

        return let(parts, named)

    return let(let(padded(title), states), judged)


def listing_evidence(title: Column, description: Column, note: Column, platform: Column) -> Column:
    """What a listing's page takes away: struct of missing, defects (key, label, severity, piece), memory, returns_refused and read.

    What is missing is read from description and note only, defects from the title too. "No power" alone is a piece that
    doesn't start, not a missing supply.
    """
    body = padded(F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(note, F.lit(""))))
    texts = F.struct(body.alias("body"), padded(title).alias("title"))

    def judged(t: Column) -> Column:
        own, whole = t["body"], F.concat(t["title"], F.lit(" "), t["body"])
        lacking = []
        for piece, stem in PAGE_MISSING.items():
            lacks = own.rlike(rf"{PAGE_BEFORE}{stem}\b") | own.rlike(rf"\b{stem}{PAGE_AFTER}")
            lacking.append(F.when(lacks & own.rlike(POWER_NAMED) if piece == "power-supply" else lacks, piece))
        clean = F.regexp_replace(whole, NO_DEFECT, " ")
        made = lambda key, label, severity, piece: F.struct(F.lit(key).alias("key"), label.alias("label"), F.lit(severity).alias("severity"), F.lit(piece).alias("piece"))

        def found(c: Column) -> Column:
            each = F.filter(F.array(*[F.when(c.rlike(p), made(key, F.lit(label), severity, piece)) for p, key, label, severity, piece in DEFECTS]), lambda d: d.isNotNull())
            return let(each, lambda ds: F.filter(ds, lambda d, i: F.array_position(F.transform(ds, lambda y: y["key"]), d["key"]) == i + 1))

        generic = F.trim(F.regexp_extract(whole, f"({GENERIC})", 1))
        label = F.concat(F.lit("accesorio no original («"), generic, F.lit("»)"))
        extra = F.when(generic != "", F.array(made("generic-accessory", label, "generic", ""))).otherwise(F.array().cast("array<struct<key: string, label: string, severity: string, piece: string>>"))
        is_n64 = F.coalesce(platform == "n64", F.lit(False)) | t["title"].rlike(r"\bn64\b|\bnintendo\s+64\b")
        memory = F.when(is_n64 & whole.rlike(EXPANSION), "expansion").when(is_n64 & whole.rlike(JUMPER), "jumper").otherwise("")
        return F.struct(
            F.filter(F.array(*lacking), lambda x: x.isNotNull()).alias("missing"), F.concat(let(clean, found), extra).alias("defects"), memory.alias("memory"), whole.rlike(NO_RETURNS).alias("returns_refused"), (F.trim(own) != "").alias("read"),
        )

    return let(texts, judged)


def lot_analysis(title: Column, platform: Column) -> Column:
    """What a title says of a lot: struct of pieces, quantity (confirmed, unconfirmed, or single for no lot), why, mystery, copies, filler and others (platforms).

    A number counts games if the title says so, or if nothing else comes with them; games of one other platform leave
    open how many are of the wanted one.
    """
    read = F.struct(padded(title).alias("text"), bare_title(title).alias("bare"), lot_size(title).alias("pieces"), item_kind(title)["kind"].alias("kind"), names_games(title).alias("games"))

    def judged(r: Column) -> Column:
        filler = F.array_distinct(F.filter(F.array(*[F.nullif(F.trim(F.regexp_extract(r["text"], f"({p})", 1)), F.lit("")) for p in FILLER]), lambda x: x.isNotNull()))
        others = F.when(F.coalesce(platform, F.lit("")) != "", F.array_remove(P.platforms_in_text(F.regexp_replace(r["text"], COMPATIBLE, " ")), platform)).otherwise(F.array().cast("array<string>"))
        besides = F.when(~r["bare"].rlike(any_of(GAME_COUNTS)), F.coalesce(F.trim(first_of(r["bare"], NO_GAMES)), F.lit(""))).otherwise("")
        single = r["pieces"].isNull() & (r["kind"] == "game") & ~r["games"] & ~r["bare"].rlike(LOT_WORD)
        head = F.struct(filler.alias("filler"), others.alias("others"), besides.alias("besides"), single.alias("single"))

        def told(h: Column) -> Column:
            quantity = F.when(h["single"], "single").when(r["pieces"].isNull() | (h["besides"] != "") | (F.size(h["others"]) == 1), "unconfirmed").otherwise("confirmed")
            why = F.when(h["single"], "single").when(r["pieces"].isNull(), "no number").when(h["besides"] != "", h["besides"]).when(F.size(h["others"]) == 1, F.get(h["others"], 0)).otherwise("")
            return F.struct(r["pieces"].alias("pieces"), quantity.alias("quantity"), why.alias("why"), first_of(r["text"], MYSTERY).alias("mystery"), first_of(r["text"], SAME_GAME).alias("copies"), h["filler"], h["others"])

        return let(head, told)

    return let(read, judged)


__all__ = ["authenticity", "console_kit", "hardware_origin", "listing_evidence", "lot_analysis"]
