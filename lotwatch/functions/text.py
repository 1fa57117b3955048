"""Text columns: folding, whole-word signals, titles, lots, HTML. All of them are expressions; none is a UDF."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwatch.functions import keywords as K
from lotwatch.functions.folding import fold, fold_compatible, let, normalize, py_normalize
from lotwatch.functions.platforms import fuse_platform_numbers

# Words by which listings declare what they are.
REGION_SIGNALS = {
    "ntsc-j": ("ntsc-j", "japan", "japanese", "jp region", "jpn", "japon", "japonesa", "super famicom", "famicom", "sfc", "jp", "ll"),
    "pal": ("pal", "europe", "european", "uk region", "australia", "pegi"),
    "ntsc-u/c": ("ntsc-u", "ntsc u", "usa", "us region", "american", "north america"),
}
COMPLETENESS_SIGNALS = {
    "sealed": ("sealed", "factory sealed", "new sealed", "brand new sealed"),
    "cib": ("cib", "complete in box", "complete with box", "box and manual", "with manual"),
    "loose": ("loose", "cart only", "disc only", "game only", "console only"),
    "boxed": ("boxed", "in box", "with box", "w box", "original box", "con caja"),
}
TITLE_STOPWORDS = ("the", "a", "an", "of", "and", "y", "el", "la", "los", "las", "de")
ROMAN_NUMERALS = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
COMPILATION_WORDS = {
    "collection": "collection", "collections": "collection", "trilogy": "trilogy", "trilogies": "trilogy", "quadrilogy": "quadrilogy",
    "saga": "saga", "anthology": "anthology", "anthologies": "anthology", "compilation": "compilation", "compilations": "compilation",
    "volume": "volume", "volumes": "volume", "vol": "volume",
}
SELLERS = ("my", "personal", "private")


def fold_spaces(text: Column) -> Column:
    """Folded text with its punctuation, white space collapsed; letters that only look different are alike."""
    return F.trim(F.regexp_replace(fold_compatible(text), r"(?U)[\s\x1c-\x1f]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def contains_term(normalized: Column, term: str | Column) -> Column:
    """Is the term in a normalized text as whole words? An empty term never is."""
    needle = F.lit(py_normalize(term)) if isinstance(term, str) else term
    return (needle != "") & F.contains(F.concat(F.lit(" "), normalized, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def first_signal(normalized: Column, signals: Sequence[str]) -> Column:
    """The first of these terms that the text holds, else the empty string."""
    out = F.lit("")
    for s in reversed(signals):
        out = F.when(contains_term(normalized, s), s).otherwise(out)
    return out


def first_class(normalized: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """The first class one of whose signals the text holds, else the empty string."""
    out = F.lit("")
    for name in reversed(list(classes)):
        held = F.lit(False)
        for s in classes[name]:
            held = held | contains_term(normalized, s)
        out = F.when(held, name).otherwise(out)
    return out


def detect_region(title: Column) -> Column:
    return let(normalize(title), region_of)


def region_of(normalized: Column) -> Column:
    return first_class(normalized, REGION_SIGNALS)


def without_negations(normalized: Column, words: Sequence[str] = ("cib", "sealed", "boxed", "complete")) -> Column:
    """Leave out what a text says that a piece is not: "not sealed", "no cib"."""
    return F.regexp_replace(normalized, rf"\b(?:not|no|non)\s+(?:{'|'.join(words)})\b", " ")


def detect_completeness(title: Column) -> Column:
    """sealed, cib, loose or boxed, in this order of precedence; negated ones don't count."""
    return let(normalize(title), completeness_of)


def completeness_of(normalized: Column) -> Column:
    return let(without_negations(normalized), lambda t: first_class(t, COMPLETENESS_SIGNALS))


def title_tokens(title: Column) -> Column:
    """Identifying words: no apostrophes, Roman numerals as digits, no stop words, platform numbers fused to their names."""
    bare = normalize(F.regexp_replace(F.coalesce(title, F.lit("")), "['’`´]", ""))
    romans = F.create_map(*[F.lit(x) for kv in ROMAN_NUMERALS.items() for x in kv])
    kept = F.filter(F.split(fuse_platform_numbers(bare), " "), lambda t: (t != "") & ~t.isin(*TITLE_STOPWORDS))
    return F.transform(kept, lambda t: F.coalesce(F.element_at(romans, t), t))


def compilation_words(tokens: Column) -> Column:
    """The words by which tokens name a compilation, in their main form; "my collection" is the seller's."""
    names = F.create_map(*[F.lit(x) for kv in COMPILATION_WORDS.items() for x in kv])

    def named(t: Column, i: Column) -> Column:
        word, before = F.try_element_at(names, t), F.get(tokens, i - 1)
        return F.when((word == "collection") & F.coalesce(before.isin(*SELLERS), F.lit(False)), None).otherwise(word)

    return F.array_distinct(F.filter(F.transform(tokens, named), lambda t: t.isNotNull()))


def without_platforms(lowered: Column) -> Column:
    for p in K.PLATFORM_PATTERNS:
        lowered = F.regexp_replace(lowered, p, " ")
    return lowered


def lot_size(title: Column, patterns: Sequence[str] = K.LOT_PATTERNS, most: int = K.MOST_PIECES) -> Column:
    """The one number of pieces that a title declares, in digits or words; null for none or for several different ones."""
    text = without_platforms(F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" ")))
    words = F.create_map(*[x for i, w in enumerate(K.NUMBER_WORDS) for x in (F.lit(w), F.lit(i + 1))])
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in patterns])))
    found = F.array_distinct(F.transform(found, lambda x: F.coalesce(x.try_cast("int"), F.element_at(words, x))))
    found = F.filter(found, lambda n: (n >= 1) & (n <= most))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))


#: Fixed value: what a preview of a page shows.
PREVIEW = 6000


def strip_html(html: Column, most: int | None = None) -> Column:
    """Text of a page: no scripts, styles or tags, the common entities read, white space collapsed; cut at `most` if given."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))
    return out if most is None else F.substring(out, 1, most)


def tag_attribute(html: Column, tag: str, name: str) -> Column:
    """The attribute of the first such tag; the empty string without one."""
    return F.regexp_extract(html, rf'<{tag}\b[^>]*\s{name}="([^"]*)"', 1)


def tag_text(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)


def split_list(text: Column, separator: str = ",") -> Column:
    """Trimmed parts that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), re.escape(separator)), lambda x: F.trim(x)), lambda x: x != "")


def distinct_ci(terms: Column, most: int | None = None, longest: int = 80) -> Column:
    """The terms, trimmed and cut, the first spelling of each regardless of case, at most `most` of them."""
    cleaned = F.filter(F.transform(terms, lambda t: F.substring(F.trim(t), 1, longest)), lambda t: t != "")
    lowered = F.transform(cleaned, lambda t: F.lower(t))
    kept = F.filter(F.transform(cleaned, lambda t, i: F.when(F.array_position(lowered, F.lower(t)) == i + 1, t)), lambda t: t.isNotNull())
    return kept if most is None else F.slice(kept, 1, most)


def query_text(terms: Column, name: Column, platform: Column, longest: int = 300) -> Column:
    """A search's text: its terms, or its name where it has none, then the platform, words in any case once."""
    base = F.when(F.size(terms) > 0, terms).otherwise(F.array(name))
    return F.substring(F.array_join(distinct_ci(F.concat(base, F.array(F.coalesce(platform, F.lit(""))))), " "), 1, longest)


def shorten(text: Column, most: int) -> Column:
    """At most so many characters, three of them dots where something is cut."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def lot_number(title: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(title, F.lit(""))), r"\blote?\s*(?:n[°ºo]\.?\s*)?(\d+[a-z]?)\b", 1)
