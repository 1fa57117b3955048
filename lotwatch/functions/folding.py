"""Folding of letters: lower case, without accents, by the Unicode decompositions.

The tables are made from Python's Unicode data at import: what each letter of the basic plane comes to when it is taken
apart and its marks are dropped. They become one translate() in the JVM, which texts of plain ASCII don't reach.
Hangul syllables, which come apart into several letters, stay as they are. Letters beyond the basic plane stay too,
but for the first 1,100 of the private plane, which fold_compatible() uses as marks.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_HANGUL, _SURROGATES = range(0xAC00, 0xD7A4), range(0xD800, 0xE000)


def plain(text: str, form: str) -> str:
    """The text in lower case, taken apart by NFD or NFKD, without marks: by category (NFD) or by combining class (NFKD)."""
    apart = unicodedata.normalize(form, text)
    if form == "NFD":
        return "".join(c for c in apart.lower() if unicodedata.category(c) != "Mn")
    return "".join(c for c in apart if not unicodedata.combining(c))


def _table(form: str) -> dict[str, str]:
    """What each letter comes to, where that is something else."""
    out = {}
    for k in range(0x80, 0x10000):
        if k not in _HANGUL and k not in _SURROGATES:
            to = plain(chr(k), form)
            to = to.lower() if len(to) == len(to.lower()) == 1 else to
            if to != chr(k) and not (form == "NFD" and chr(k).lower() != chr(k)):
                out[chr(k)] = to
    return out


ACCENTS, COMPATIBLE = _table("NFD"), _table("NFKD")
#: Letters that become several, by NFKD only.
SEVERAL = {k: v for k, v in COMPATIBLE.items() if len(v) > 1}


def _translated(text: Column, table: dict[str, str]) -> Column:
    single = [(k, v) for k, v in table.items() if len(v) == 1]
    gone = "".join(k for k, v in table.items() if not v)
    return F.translate(text, "".join(k for k, _ in single) + gone, "".join(v for _, v in single))


#: Where some letter of SEVERAL may be: a few ranges, so that ordinary texts are told by a short test.
_MAYBE = r"[\u00bc-\u00be\u0132-\u0133\u013f-\u0140\u0149\u01c4-\u01cc\u01f1-\u01f3\u0587-\u1fff\u2025-\u20ab\u20ad-\uffff]"
assert all(re.match(_MAYBE, k) for k in SEVERAL)
#: Each of SEVERAL is marked by a letter of its own from here on, in the private plane.
_MARK = 0xF0000


def _several(text: Column) -> Column:
    """The text with ligatures, fractions and the like spelt out."""
    letters = list(SEVERAL)
    marked = F.translate(text, "".join(letters), "".join(chr(_MARK + i) for i in range(len(letters))))
    mark = rf"\x{{{_MARK:X}}}-\x{{{_MARK + len(letters) - 1:X}}}"
    spelt = F.split(F.lit("\x00".join(SEVERAL.values())), "\x00")
    parts = F.transform(F.regexp_extract_all(marked, F.lit(f"([{mark}]|[^{mark}]+)"), 1), lambda x: F.when(x.rlike(f"[{mark}]"), F.get(spelt, F.ascii(x) - _MARK)).otherwise(x))
    return F.when(text.rlike(_MAYBE), F.array_join(parts, "")).otherwise(text)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold(text: Column) -> Column:
    """Lower case without accents (NFD); null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(_is_ascii(text), F.lower(text)).otherwise(_translated(F.lower(text), ACCENTS))


def normalize(text: Column) -> Column:
    """Folded words of a-z and 0-9, with single spaces between them."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def py_normalize(term: str) -> str:
    """normalize() of a constant, on the driver."""
    return re.sub("[^a-z0-9]+", " ", plain(term, "NFD")).strip()


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def fold_compatible(text: Column) -> Column:
    """Lower case, without accents and with compatible letters alike (NFKD): full width, ligatures, fractions."""
    text = F.coalesce(text, F.lit(""))
    return F.when(_is_ascii(text), F.lower(text)).otherwise(_translated(F.lower(_several(text)), COMPATIBLE))
