"""Which platforms a text names, where each name consumes what it reads."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwatch.functions.folding import let, normalize


@dataclass(frozen=True)
class Platform:
    """key, label, home or handheld, cartridge, disc or card, what a unit needs to be ready, what its reader reads."""

    key: str
    label: str
    family: str
    medium: str
    requires: tuple[str, ...]
    reader: str
    reader_media: tuple[str, ...]
    names: tuple[str, ...]


_HOME = ("controller", "cables")
# Facts of the hardware and the names it goes by, in the order in which platforms are listed.
PLATFORMS = (
    Platform("snes", "SNES", "home", "cartridge", _HOME, "", (), ("snes", "super nintendo entertainment system", "super nintendo", "super nes", "super famicom", "sfc")),
    Platform("nes", "NES", "home", "cartridge", _HOME, "", (), ("nes", "nintendo entertainment system")),
    Platform("n64", "Nintendo 64", "home", "cartridge", (*_HOME, "jumper-pak"), "", (), ("n64", "nintendo 64")),
    Platform("ps1", "PlayStation 1", "home", "disc", _HOME, "CD", (), ("ps1", "psx", "psone", "ps one", "playstation 1", "playstation one", "playstation1")),
    Platform("ps2", "PlayStation 2", "home", "disc", _HOME, "CD y DVD", ("cd", "dvd"), ("ps2", "playstation 2", "playstation2")),
    Platform("ps3", "PlayStation 3", "home", "disc", _HOME, "Blu-ray y DVD", (), ("ps3", "playstation 3", "playstation3")),
    Platform("genesis", "Genesis", "home", "cartridge", _HOME, "", (), ("genesis", "sega genesis", "mega drive", "megadrive", "sega mega drive")),
    Platform("gb", "Game Boy", "handheld", "cartridge", ("battery-cover",), "", (), ("game boy", "gameboy", "dmg 01", "dmg01", "original game boy")),
    Platform("gbc", "Game Boy Color", "handheld", "cartridge", ("battery-cover",), "", (), ("game boy color", "gameboy color", "gbc")),
    Platform("3ds", "Nintendo 3DS", "handheld", "card", ("charger",), "", (), ("3ds", "nintendo 3ds", "new 3ds", "3ds xl", "new 3ds xl", "2ds", "2ds xl", "new 2ds xl")),
    Platform("gba", "Game Boy Advance", "handheld", "cartridge", ("battery-cover",), "", (), ("game boy advance", "gameboy advance", "gba", "gba sp", "game boy advance sp")),
    Platform("ds", "Nintendo DS", "handheld", "card", ("charger",), "", (), ("nintendo ds", "ds lite", "dsi", "dsi xl", "ds")),
    Platform("psp", "PSP", "handheld", "disc", ("charger",), "UMD", (), ("psp", "playstation portable")),
    Platform("vita", "PS Vita", "handheld", "card", ("charger",), "", (), ("ps vita", "psvita", "playstation vita", "vita")),
    Platform("ps4", "PlayStation 4", "home", "disc", _HOME, "Blu-ray", (), ("ps4", "playstation 4", "playstation4")),
    Platform("ps5", "PlayStation 5", "home", "disc", _HOME, "Blu-ray", (), ("ps5", "playstation 5", "playstation5")),
    Platform("gamecube", "GameCube", "home", "disc", _HOME, "mini DVD", (), ("gamecube", "game cube", "gcn", "nintendo gamecube")),
    Platform("wii", "Wii", "home", "disc", _HOME, "DVD", (), ("wii", "nintendo wii")),
    Platform("wiiu", "Wii U", "home", "disc", _HOME, "disco", (), ("wii u", "nintendo wii u")),
    Platform("switch", "Nintendo Switch", "home", "card", (), "", (), ("nintendo switch", "switch oled", "switch lite")),
    Platform("dreamcast", "Dreamcast", "home", "disc", _HOME, "GD-ROM", (), ("dreamcast", "sega dreamcast")),
    Platform("saturn", "Sega Saturn", "home", "disc", _HOME, "CD", (), ("sega saturn", "saturn")),
    Platform("segacd", "Sega CD", "home", "disc", _HOME, "CD", (), ("sega cd", "mega cd")),
    Platform("sms", "Master System", "home", "cartridge", _HOME, "", (), ("master system", "sega master system")),
    Platform("gamegear", "Game Gear", "handheld", "cartridge", (), "", (), ("game gear", "sega game gear")),
    Platform("xbox", "Xbox", "home", "disc", _HOME, "DVD", (), ("xbox", "original xbox")),
    Platform("xbox360", "Xbox 360", "home", "disc", _HOME, "DVD", (), ("xbox 360", "x360")),
    Platform("xboxone", "Xbox One", "home", "disc", _HOME, "Blu-ray", (), ("xbox one",)),
    Platform("atari2600", "Atari 2600", "home", "cartridge", _HOME, "", (), ("atari 2600", "atari vcs")),
)


class Phrases:
    """Phrases that stand for keys, ready to be read off a normalized text.

    A phrase of more words, then of more letters, then the earlier one goes first and takes its words away from the
    others. Phrases of several words are marked one after the other, as what one takes may free words that another one
    would have taken; single words overlap nothing, and one scan reads them with the marks.
    """

    def __init__(self, keys: dict[str, Sequence[str]]) -> None:
        pairs = [(p, k) for k, names in keys.items() for p in names]
        self.ranked = sorted(pairs, key=lambda x: (-len(x[0].split()), -len(x[0])))
        self.key_of: dict[str, str] = {}
        for p, k in self.ranked:
            self.key_of.setdefault(p, k)
        self.marks = {f"#{i}#": p for i, p in enumerate(self.key_of) if " " in p}
        singles = [p for p in self.key_of if " " not in p]
        self.pattern = rf"(?<![a-z0-9])({'|'.join([r'#[0-9]+#', *singles])})(?![a-z0-9])"

    def found(self, text: Column) -> Column:
        """The phrases in a normalized text, in order of appearance."""
        # With two spaces between words, neighbours share none.
        marked = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
        for mark, p in self.marks.items():
            marked = F.replace(marked, F.lit(f" {p.replace(' ', '  ')} "), F.lit(f" {mark} "))
        names = F.create_map(*[F.lit(x) for kv in (self.marks | {p: p for p in self.key_of}).items() for x in kv])
        return F.transform(F.regexp_extract_all(marked, F.lit(self.pattern), 1), lambda p: F.element_at(names, p))

    def keys(self, text: Column) -> Column:
        """The distinct keys that a normalized text names, in order of appearance."""
        table = F.create_map(*[F.lit(x) for kv in self.key_of.items() for x in kv])
        return F.array_distinct(F.transform(self.found(text), lambda p: F.element_at(table, p)))


@functools.cache
def phrases(platforms: Sequence[Platform] = PLATFORMS) -> Phrases:
    return Phrases({p.key: p.names for p in platforms})


def platforms_in_text(text: Column, platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """Keys of the platforms that a text names: "game boy color" isn't a Game Boy too, "super nintendo" no NES."""
    return phrases(platforms).keys(normalize(text))


def platform_key(value: Column, platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """The platform that someone wrote down: a name of it, or a text that names just one; else the empty string."""
    known = phrases(platforms)
    table = F.create_map(*[F.lit(x) for kv in known.key_of.items() for x in kv])
    one = lambda found: F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))).otherwise("")
    return let(normalize(value), lambda t: F.coalesce(F.try_element_at(table, t), let(known.keys(t), one)))


def resolve_platform(declared: Column, title: Column, platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """The declared platform, or the first that the title names, or null."""
    own = platform_key(declared, platforms)
    as_key = F.when(declared.isin(*[p.key for p in platforms]), declared)
    first = F.try_element_at(platforms_in_text(title, platforms), F.lit(1))
    return F.coalesce(F.nullif(own, F.lit("")), as_key, first)


def platform_payload(value: Column, platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """Struct of key, label and place in the list; what isn't known goes by its own text, last."""
    entries = [x for i, p in enumerate(platforms) for x in (F.lit(p.key), F.struct(F.lit(p.key).alias("key"), F.lit(p.label).alias("label"), F.lit(i).alias("place")))]
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    own = F.struct(normalize(text).alias("key"), text.alias("label"), F.lit(len(platforms)).alias("place"))
    return let(platform_key(value, platforms), lambda k: F.coalesce(F.try_element_at(F.create_map(*entries), k), own))


def platform_attribute(key: Column, name: str, platforms: Sequence[Platform] = PLATFORMS) -> Column:
    """family, medium, reader or label of a platform's key; arrays for requires and reader_media; null for no platform."""
    value = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, tuple) else F.lit(x)
    return F.try_element_at(F.create_map(*[x for p in platforms for x in (F.lit(p.key), value(getattr(p, name)))]), key)


# Names of consoles that end in one digit, written apart: the space in "playstation 3", whose 3 is no sequel.
_APART = sorted({m.groups() for p in PLATFORMS for n in p.names if (m := re.fullmatch("([a-z]+) ?([1-9])", n))})
SPACED_NUMBER = "|".join(rf"(?<=(?<![a-z0-9]){name}) (?={digit}(?![a-z0-9]))" for name, digit in _APART)


def fuse_platform_numbers(text: Column) -> Column:
    """A normalized text with "playstation 3" as one word. "nintendo 64" stays apart: no game's number gets that far."""
    return F.regexp_replace(text, SPACED_NUMBER, "")
