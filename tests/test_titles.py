"""Folding, platforms and title targets against plain versions and rows that are known to be right."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lotwatch.functions import folding
from lotwatch.functions import platforms as P
from lotwatch.functions import text as X
from lotwatch.operators import match, titles


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string").orderBy("i")


def plain_a(text):
    marks = "".join(c for c in unicodedata.normalize("NFD", text).lower() if unicodedata.category(c) != "Mn")
    return re.sub("[^a-z0-9]+", " ", marks).strip()


def plain_b(text):
    return " ".join("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().split())


def test_every_letter_folds_as_its_decomposition(spark):
    """All code points below U+2000, and the rest of the basic plane but Hangul and what is newer than the JVM's tables."""
    letters = [chr(k) for k in (*range(1, 0x3200), *range(0xF900, 0xFFFE)) if unicodedata.category(chr(k)) != "Cn"]
    values = [f"a{c}b x{c} {c}1" for c in letters]
    got = texts(spark, values).select("i", X.normalize(F.col("t")), X.fold_spaces(F.col("t"))).collect()
    assert [v for (_, a, _), v in zip(got, values) if a != plain_a(v)] == []
    assert [v for (_, _, b), v in zip(got, values) if b != plain_b(v) and ord(v[1]) < 0x1C80] == ["aϹb xϹ Ϲ1"]  # a sigma whose small letter depends on its place
    assert sum(b != plain_b(v) for (_, _, b), v in zip(got, values)) < 5


@pytest.mark.parametrize(("text", "plain"), [("Ōkami Kōei", "okami koei"), ("Dvořák", "dvorak"), ("őş İstanbul", "os istanbul"), ("Ｍａｒｉｏ ﬁn ½", "mario fin 1⁄2"), (None, "")])
def test_folded_titles(spark, text, plain):
    assert texts(spark, [text]).select(X.fold_spaces(F.col("t"))).first()[0] == plain
    if text and text.isalpha():
        assert texts(spark, [text]).select(X.normalize(F.col("t"))).first()[0] == plain


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("Super Nintendo (SNES) lot", ["snes"]), ("Game Boy Color & Game Boy", ["gbc", "gb"]), ("GBA SP vs. Nintendo DS Lite", ["gba", "ds"]), ("original game boy advance sp", ["gba"]),
        ("original Xbox 360", ["xbox"]), ("Nintendo Wii U", ["wiiu"]), ("PlayStation 3, PS One; Méga Drive", ["ps3", "ps1", "genesis"]), ("Nintendo", []), ("", []), (None, []),
    ],
)
def test_platforms_in_text(spark, text, keys):
    assert texts(spark, [text]).select(P.platforms_in_text(F.col("t"))).first()[0] == keys


def test_one_scan_reads_what_phrase_after_phrase_would(spark):
    known, rng = P.phrases(), random.Random(7)
    words = sorted({w for p in known.key_of for w in p.split()})
    values = [" ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(known.ranked)[0] for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    want = []
    for v in values:
        left, at = f" {v} ", {}
        for phrase, key in known.ranked:
            while (m := re.search(rf"(?<= ){phrase}(?= )", left)) is not None:
                at[m.start()] = key
                left = left[: m.start()] + "#" * len(phrase) + left[m.end() :]
        want.append(list(dict.fromkeys(at[k] for k in sorted(at))))
    assert [r[0] for r in texts(spark, values).select(known.keys(F.col("t"))).collect()] == want


@pytest.mark.parametrize(("declared", "title", "payload", "resolved"), [("N64", "", ("n64", "Nintendo 64", 2), "n64"), ("nintendo  64 ", "x", ("n64", "Nintendo 64", 2), "n64"), ("Neo  Geo", "for PSP", ("neo geo", "Neo Geo", 29), "psp"), ("xbox360", "", ("xbox360", "xbox360", 29), "xbox360"), (None, "", ("", "", 29), None)])
def test_declared_platforms(spark, declared, title, payload, resolved):
    row = spark.createDataFrame([(declared, title)], "d string, t string").select(P.platform_payload(F.col("d")).alias("p"), P.resolve_platform(F.col("d"), F.col("t")).alias("r")).first()
    assert (tuple(row["p"]), row["r"]) == (payload, resolved)


@pytest.mark.parametrize(
    ("title", "tokens"),
    [
        ("God of War III (Sony PlayStation 3, 2013)", "god war 3 sony playstation3 2013"), ("Mario Kart (Nintendo 64)", "mario kart nintendo 64"), ("Kirby's Dream Land", "kirbys dream land"),
        ("Halo xbox 360", "halo xbox 360"), ("PS 2 Dark Souls II", "ps2 dark souls 2"), (None, ""),
    ],
)
def test_title_tokens(spark, title, tokens):
    assert " ".join(texts(spark, [title]).select(X.title_tokens(F.col("t"))).first()[0]) == tokens


def test_compilation_words(spark):
    got = texts(spark, ["God of War Collection", "from my collection", "Trilogy Volumes vol 2", "personal collections", "collection"]).select(F.array_sort(X.compilation_words(X.title_tokens(F.col("t"))))).collect()
    assert [r[0] for r in got] == [["collection"], [], ["trilogy", "volume"], [], ["collection"]]


# Behaviour that collectors rely on: (search, its targets, listing, the target it names).
SEARCHES = {
    "snes": ["Super Mario World", "Donkey Kong Country", "Donkey Kong Country 2"],
    "zelda": ["The Legend of Zelda: Ocarina of Time", "The Legend of Zelda: Majora's Mask", "Crash Bandicoot 3: Warped"],
    "gow": ["God of War III", "God of War: Ascension", "God of War: Origins Collection"],
    "souls": ["Dark Souls", "Halo: Combat Evolved", "Mass Effect 2", "Spyro: Year of the Dragon"],
}
ALIASES = {"God of War: Origins Collection": ["God of War Collection Volume II"]}
NAMED = [
    ("snes", "Donkey Kong Country SNES cart", "Donkey Kong Country"), ("snes", "Donkey Kong Country 2 Diddy's", "Donkey Kong Country 2"), ("snes", "Kirby Super Star", None), ("snes", "SUPER MARIO WORLD snes", "Super Mario World"),
    ("zelda", "Zelda Ocarina of Time N64", "The Legend of Zelda: Ocarina of Time"), ("zelda", "Legend of Zelda N64", None), ("zelda", "Legend of Zelda Majoras Mask", "The Legend of Zelda: Majora's Mask"), ("zelda", "Crash Bandicoot Warped PS1", "Crash Bandicoot 3: Warped"),
    ("gow", "God of War Saga", None), ("gow", "God of War 3 PS3", "God of War III"), ("gow", "God of War Ascension (Sony PlayStation 3, 2013)", "God of War: Ascension"), ("gow", "God of War Collection Volume II", "God of War: Origins Collection"), ("gow", "God of War Origins Collection", "God of War: Origins Collection"),
    ("souls", "Dark Souls II", None), ("souls", "Dark Souls 2 disc only", None), ("souls", "Dark Souls 2 discs", "Dark Souls"), ("souls", "Dark Souls & Dark Souls II", "Dark Souls"), ("souls", "Halo 2 xbox", None), ("souls", "Mass Effect 2 - Trilogy disc", None),
    ("souls", "Mass Effect 2/3", "Mass Effect 2"), ("souls", "Spyro 3 Year of the Dragon", "Spyro: Year of the Dragon"), ("souls", "Dark Souls from my collection", "Dark Souls"), ("souls", "", None), ("souls", None, None),
]


def targets_of(spark, searches, aliases=None):
    rows = [(s, n, (aliases or {}).get(n), f"{s}/{k}", k) for s, names in searches.items() for k, n in enumerate(names)]
    return spark.createDataFrame(rows, "search string, name string, aliases array<string>, target string, place int")


def test_titles_name_their_targets(spark):
    rows = spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(NAMED)], "k int, search string, title string")
    got = titles.attributed(rows, targets_of(spark, SEARCHES, ALIASES), ["search"], "title", "target", "name", "aliases", "place").collect()
    names = {f"{s}/{k}": n for s, ns in SEARCHES.items() for k, n in enumerate(ns)}
    assert {(NAMED[r["k"]][1], names.get(r["target"])) for r in got} == {(t, n) for _, t, n in NAMED} and len(got) == len(NAMED)


def plainly(title, names, sequel):
    """All pairs: the winning (target, shared, core) of one title."""
    words, best = title.split(), None
    for k, (target, core, sub) in enumerate(names):
        series = sub and any(o != target and set(core) <= set(c + s) for o, c, s in names)
        by_core = set(core) <= set(words) and (not series or set(sub) & set(words))
        by_sub = sub and set(sub) <= set(words) and set(core) & set(words)
        if (by_core or by_sub) and not sequel(words, core + sub if set(sub) <= set(words) else core):
            rank = (len(set(core + sub) & set(words)), len(core), -k)
            best = max(best or (rank, target), (rank, target))
    return best and (best[1], best[0][0], best[0][1])


def sequel(words, name):
    ends = [i + len(name) for i in range(len(words) - len(name) + 1) if words[i : i + len(name)] == name]
    return bool(ends) and not name[-1][-1].isdigit() and all(i < len(words) and words[i] in "23456789" for i in ends)


def test_all_pairs_of_few_words(spark):
    """Many titles and targets of few words, so that sets nest, tie and share their rarest words; no plan has a cross join."""
    rng = random.Random(11)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "2", "3"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    names = [(f"t{k:02}", some(rng.randrange(1, 4)), some(rng.randrange(0, 3))) for k in range(40)]
    listings = sorted({" ".join(some(rng.randrange(0, 7))) for _ in range(400)})
    targets = spark.createDataFrame([("s", " ".join(c) + (": " + " ".join(s) if s else ""), [], t, k) for k, (t, c, s) in enumerate(names)], "search string, name string, aliases array<string>, target string, place int")
    rows = spark.createDataFrame([("s", x) for x in listings] * 2 + [(None, "aa"), ("other", "aa bb")], "search string, title string")
    df = titles.attributed(rows, targets, ["search"], "title", "target", "name", "aliases", "place")
    assert not re.search("CartesianProduct|BroadcastNestedLoop", df._jdf.queryExecution().toString())
    want = {x: plainly(x, names, sequel) for x in listings}
    got = df.collect()
    assert len(got) == 2 * len(listings) + 2
    for r in got:
        found = None if r["target"] is None else (r["target"], r["shared"], r["core"])
        assert found == (want[r["title"]] if r["search"] == "s" else None), r["title"]
    assert sum(v is not None for v in want.values()) > 100


def test_empty_tables(spark):
    listings = spark.createDataFrame([("s", "aa")], "search string, title string")
    targets = targets_of(spark, {"s": ["", None, " : sub", "..."]})
    assert titles.attributed(listings, targets, ["search"], "title", "target", "name", "aliases", "place").collect() == [("s", "aa", None, None, None)]
    assert titles.attributed(listings.limit(0), targets, ["search"], "title", "target", "name", "aliases", "place").collect() == []


def test_hits_are_those_of_each_term_alone(spark):
    """raw_hits() scans once; each term's own expression over the whole text says the same."""
    rng = random.Random(3)
    terms = match.SEARCHED
    pieces = [*terms, "play-station", "game-boy", "gameboy", "x box", "ps-vita", "dual shock", "joycon", "and", "super", "boy", "advance", "sp", "n", "64", "sega"]
    values = [rng.choice([" ", ", ", "-", "/", ""]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(1500)] + ["", None]
    alone = F.filter(F.array(*[F.when(match.has_any(F.col("f"), [t]), t) for t in terms]), lambda t: t.isNotNull())
    rows = texts(spark, values).withColumn("f", X.fold_spaces(F.col("t"))).select("t", match.raw_hits(F.col("f"), terms).alias("got"), alone.alias("want")).collect()
    assert [(r["t"], r["got"], r["want"]) for r in rows if r["got"] != r["want"]] == []
