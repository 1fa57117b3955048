"""The randomness battery against a plain version, planted tokens, and texts with very many hits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lotwatch.llm import secrets
from tests.llm.fixtures import DOCS, hard_documents

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def tail(z):
    return max(math.erfc(z / math.sqrt(2)) / 2, 1e-40)


def plain(token):
    """Three p-values' least times three, for a token that is long enough."""
    bare = token.rstrip("=")
    if all(c in "0123456789abcdef" for c in bare) or all(c in "0123456789ABCDEF" for c in bare):
        alphabet, bare = secrets.DIGITS, bare.lower()
    elif all(c in secrets.BASE32 for c in bare):
        alphabet = secrets.BASE32
    else:
        alphabet, bare = LETTERS, bare.translate(str.maketrans("-_=", "+//"))
    v, k, n = [alphabet.index(c) for c in bare], len(alphabet), len(bare)
    if n < 16:
        return 1e-40
    bins = 4 if n < 40 else 8
    counts = [sum(x * bins // k == i for x in v) for i in range(bins)]
    chi, df = sum(c * c for c in counts) * bins / n - n, bins - 1
    p_chi = 1.0 if chi <= 0 else tail((math.cbrt(chi / df) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    high = [x >= k / 2 for x in v]
    n1 = sum(high)
    n0 = n - n1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * n1 * n0 / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = min(1, 2 * tail(math.sqrt(n) if not n1 or not n0 or spread <= 0 else abs(runs - mean) / math.sqrt(spread)))
    off = [x - sum(v) / n for x in v]
    square = sum(x * x for x in off)
    p_serial = 1e-40 if square <= 0 else min(1, 2 * tail(abs(sum(a * b for a, b in zip(off, off[1:])) / square + 1 / n) * math.sqrt(n)))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def keys(dice, n, alphabet=LETTERS, least=24, most=64):
    return ["".join(dice.choices(alphabet, k=dice.randrange(least, most))) for _ in range(n)]


def test_p_values(spark):
    dice = random.Random(2)
    tokens = [*keys(dice, 40), *keys(dice, 20, "0123456789ABCDEF"), *keys(dice, 20, secrets.BASE32), *keys(dice, 20, "abcab-"), "a" * 30, "abcdefghijklmnopqrstuvwx", "aZ" * 20, "short==", "q1" * 400 + "=="]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.randomness(F.col("t")).alias("p")).collect()
    for r in got:
        want = plain(r["t"])
        assert r["p"] == pytest.approx(want, rel=2e-2, abs=1e-6), r["t"]


def test_planted_keys_and_slugs(spark):
    """Random keys are reported, hyphenated slugs and paths of words aren't."""
    dice = random.Random(4)
    words = ["sunset", "garden", "window", "market", "silver", "travel", "winter", "yellow", "planet", "bridge"]
    planted = keys(dice, 200, LETTERS[:62], 28, 60)
    slugs = ["-".join(dice.choices(words, k=dice.randrange(4, 8))) for _ in range(600)]
    rows = [(i, f"see {x} there", "en", "s", 0) for i, x in enumerate([*planted, *slugs])]
    got = {r["doc_id"]: r["n_random"] for r in secrets.scan(spark.createDataFrame(rows, DOCS)).collect()}
    caught, false = sum(got[i] for i in range(200)), sum(got[i] for i in range(200, 800))
    assert caught >= 190 and false <= 12


def test_keys_that_overlap_base_spans(spark):
    dice = random.Random(6)
    a, b = keys(dice, 2, LETTERS[:62], 30, 31)
    texts = {1: f"token={a}", 2: f"{a}_token={b}", 3: f"{a} token={b} {a}", 4: f"{a}" + "0" * 0 + f" {b}", 5: f"x{a}/AKIA" + "B" * 16 + f"/{b} {b}"}
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOCS)
    for r in secrets.scan(docs, fdr=1e-30).collect():
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        base = [(int(s), int(e)) for k, s, e in spans if k != "random"]
        extra = {(int(s), int(e)) for k, s, e in spans if k == "random"}
        runs = {m.span() for m in __import__("re").finditer(secrets.KEY, texts[r["doc_id"]])}
        assert extra == {x for x in runs if not any(x[0] < e and s < x[1] for s, e in base)}


def test_very_many_hits_in_one_text(spark):
    dice = random.Random(8)
    runs = keys(dice, 6_000, secrets.DIGITS, 24, 40)
    text = " ".join(x if i % 2 else f"token={x}" for i, x in enumerate(runs)) + " " + " ".join(keys(dice, 3_000))
    r = secrets.scan(spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)).first()
    assert r["n_assign"] == 3_000 and r["n_hex"] == 6_000


def test_repeated_rows_and_clashing_columns(spark):
    docs = hard_documents(spark).withColumn("base", F.lit(1)).withColumn("keys", F.lit("x")).withColumn("x", F.lit(0))
    twice = docs.unionByName(docs)
    once = sorted(map(str, secrets.scan(docs).drop("spans", "n_random").collect()))
    assert sorted(map(str, secrets.scan(twice).drop("spans", "n_random").collect())) == sorted(once * 2)
