"""Keyword matching of lots: dictionary hits, rules of context, shadowed parents, flags and the score.

All of it is column expressions over one pass of the text. A single alternation of all terms decides whether a text
is looked at term by term; most texts of a scan stop there.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwatch.functions import keywords as K
from lotwatch.functions.text import fold_spaces, let, py_normalize

_EDGE = r"[\p{L}\p{N}_]"


def _plain(term: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9&.\-]+", " ", term.lower().translate(str.maketrans("áéíóúñ", "aeioun"))).split())


def term_body(term: str) -> str:
    """The term as a regular expression: its known spellings, else its words with any white space between."""
    base = _plain(term)
    return K.SPELLINGS.get(base) or r"\s+".join(re.sub(r"([&.\-])", r"\\\1", w) for w in base.split())


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """Does a folded text hold one of these terms as whole words?"""
    if not terms:
        return F.lit(False)
    return text.rlike(rf"(?<!{_EDGE})(?:{'|'.join(term_body(t) for t in terms)})(?!{_EDGE})")


@dataclass(frozen=True)
class Rule:
    """Drop `terms` from the hits unless the text gives them a context.

    With `only_if` terms or a `pattern` the rule holds only for texts with one of them, with `alone` only where
    there are no other hits.
    """

    terms: Sequence[str]
    context: Sequence[str]
    only_if: Sequence[str] = field(default=())
    pattern: str = ""
    alone: bool = False


def _gaming_but(*terms: str) -> tuple[str, ...]:
    return tuple(t for t in K.GAMING if t not in terms)


RULES = (
    Rule(("mario",), K.MARIO),
    Rule(("family",), K.FAMILY),
    Rule(("saturn",), _gaming_but("saturn")),
    Rule(("32x",), K.SEGA_32X),
    Rule(("odyssey", "terminator"), K.GAMING),
    Rule(("switch",), _gaming_but("switch"), only_if=K.NETWORK),
    Rule(("ds",), _gaming_but("ds"), alone=True),
    Rule(("pong",), _gaming_but("pong"), pattern=K.PING_PONG, alone=True),
    Rule(("cartucho", "cartuchos"), K.GAMING),
)
SEARCHED = K.SEARCHED


def nothing() -> Column:
    return F.array().cast("array<string>")


def raw_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that a folded text holds, in the dictionary's order.

    One scan takes the longest term from each place where a word begins; the terms are then looked for at the
    beginnings of the few distinct spellings that it found, not in the text.
    """
    longest = sorted(dict.fromkeys(terms), key=lambda t: -len(_plain(t)))
    scan = rf"(?<!{_EDGE})(?=({'|'.join(f'(?:{term_body(t)})' for t in longest)})(?!{_EDGE}))"
    # A capture in an alternative would move the group's number; bodies have none.
    found = F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(scan), 1)), "\x01")

    def held(spellings: Column) -> Column:
        each = F.array(*[F.when(spellings.rlike(rf"(?:^|\x01)(?:{term_body(t)})(?!{_EDGE})"), t) for t in terms])
        return F.when(spellings != "", F.filter(each, lambda t: t.isNotNull())).otherwise(nothing())

    return let(found, held) if terms else nothing()


def in_context(text: Column, hits: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The hits without those that a rule drops; every rule sees the hits as they were."""
    dropped = []
    for r in rules:
        own = F.array(*map(F.lit, r.terms))
        applies = F.arrays_overlap(hits, own) & ~has_any(text, r.context)
        if r.only_if:
            applies = applies & has_any(text, r.only_if)
        if r.pattern:
            applies = applies & text.rlike(rf"(?<!{_EDGE}){r.pattern}(?!{_EDGE})")
        if r.alone:
            applies = applies & (F.size(F.array_except(hits, own)) == 0)
        dropped.append(F.when(applies, own).otherwise(nothing()))
    return F.array_except(hits, F.flatten(F.array(*dropped))) if dropped else hits


def drop_shadowed(hits: Column, shadows: Mapping[str, Sequence[str]] = K.SHADOWS) -> Column:
    """The hits without the parents of more specific ones."""
    parents = F.flatten(F.array(*[F.when(F.array_contains(hits, s), F.array(*map(F.lit, p))).otherwise(nothing()) for s, p in shadows.items()]))
    return F.array_except(hits, parents)


def drop_restricted(hits: Column, families: Mapping[str, str] = K.RESTRICTED, anchors: Sequence[str] = K.CONSOLE_WORDS) -> Column:
    """No hits where all are ambiguous, unless two families meet and one is an anchor word."""
    words = F.array(*map(F.lit, families))
    names = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    others = F.size(F.array_except(hits, words)) > 0
    met = F.size(F.array_distinct(F.filter(F.transform(hits, lambda t: F.element_at(names, t)), lambda f: f.isNotNull()))) >= 2
    return F.when(others | (met & F.arrays_overlap(hits, F.array(*map(F.lit, anchors)))), hits).otherwise(nothing())


def keyword_hits(description: Column, terms: Sequence[str] = SEARCHED, rules: Sequence[Rule] = RULES) -> Column:
    """The distinct terms that a description matches, after context, shadowing and restriction."""

    def judged(text: Column) -> Column:
        hits = let(let(raw_hits(text, terms), lambda h: in_context(text, h, rules)), lambda h: drop_shadowed(h))
        return F.when(has_any(text, terms), let(hits, lambda h: drop_restricted(h))).otherwise(nothing())

    return let(fold_spaces(description), judged)


def flags(description: Column, terms: Sequence[str]) -> Column:
    """The terms that a text contains, in any place of a word."""
    held = lambda text: F.filter(F.array(*[F.when(F.contains(text, F.lit(_plain(t))), t) for t in terms]), lambda t: t.isNotNull())
    return let(fold_spaces(description), held)


def match_score(hits: Column, risks: Column, positives: Column, value: Column | None = None, bids: Column | None = None, strong: Sequence[str] = K.STRONG, franchises: Sequence[str] = K.FRANCHISES, generic: Sequence[str] = K.GENERIC) -> Column:
    """6 a hit, 12, 8 and 4 for a strong, a franchise and a generic one, 2 each for a value and bids, 2 a merit up to 6, -8 a risk."""
    def any_of(terms: Sequence[str], points: int) -> Column:
        return F.when(F.arrays_overlap(hits, F.array(*map(F.lit, terms))), points).otherwise(0)

    more = lambda c: F.lit(0) if c is None else F.when(c > 0, 2).otherwise(0)
    return (
        6 * F.size(F.array_distinct(hits)) + any_of(strong, 12) + any_of(franchises, 8) + any_of(generic, 4)
        + more(value) + more(bids) + F.least(2 * F.size(positives), F.lit(6)) - 8 * F.size(risks)
    )


def is_active(status: Column, inactive: Sequence[str] = K.INACTIVE) -> Column:
    """Lots are active unless their state says otherwise; unknown states are."""
    return ~F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*inactive)


__all__ = ["Rule", "RULES", "drop_restricted", "drop_shadowed", "flags", "has_any", "in_context", "is_active", "keyword_hits", "let", "match_score", "py_normalize", "raw_hits"]
