"""Reconciliation on rows that are few but hard."""

import unicodedata

from pyspark.sql import functions as F

from lotwatch import registry
from lotwatch.operators import reconcile

ITEM, ROW = "item int, source string, lot string, url string, phrase string", "source string, lot string, url string, text string, pos int"


def hits(spark, items, rows):
    found = reconcile.watch_hits(spark.createDataFrame(items, ITEM), spark.createDataFrame(rows, ROW), "item", "source", "lot", "url", "phrase", "text", "pos")
    return {r["item"]: (r["pos"], r["how"]) for r in found.collect()}


def test_watch_hits_of_every_event(spark, sf_dir):
    found = registry.QUERIES["join10_watch_hits_all"](spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert found.count() == events.filter("user_id IS NOT NULL AND (value IS NOT NULL OR event_type IS NOT NULL)").count()


def test_watch_hits_meets_one_row_per_key(spark):
    """20,000 items and as many rows of one source with equal lot, url and phrase: 1.2 billion pairs otherwise."""
    n = spark.range(20_000)
    items = n.select(F.col("id").alias("item"), F.lit("s").alias("source"), F.lit("1").alias("lot"), F.lit("u").alias("url"), F.lit("coin").alias("phrase"))
    rows = n.select(F.lit("s").alias("source"), F.lit("1").alias("lot"), F.lit("u").alias("url"), F.lit("Old coin").alias("text"), (F.col("id") + 5).alias("pos"))
    found = reconcile.watch_hits(items, rows, "item", "source", "lot", "url", "phrase", "text", "pos")
    joined = found.groupBy("pos", "how").count().collect()
    assert [tuple(r) for r in joined] == [(5, "lot", 20_000)]


def test_watch_hits_first_row_and_way(spark):
    rows = [("a", "1", "u", "Silver coin", 9), ("a", "2", "v", "coin", 3), ("b", "1", "u", "coin", 1)]
    items = [(1, "a", "1", None, None), (2, "a", "1", "v", None), (3, "a", None, None, "COIN"), (4, "b", "2", None, "coin"), (5, "a", "7", "x", "gold"), (6, "a", "2", "v", "coin")]
    assert hits(spark, items, rows) == {1: (9, "lot"), 2: (3, "url"), 3: (3, "phrase"), 4: (1, "phrase"), 6: (3, "lot")}


def plain(text):
    """normalize_text of the reference."""
    out = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return " ".join(out.lower().split())


def test_watch_hits_by_phrases_like_the_reference(spark):
    """Several words, accents, parts of words, short and blank phrases, punctuation; every phrase against every text."""
    texts = ["Old silver  COIN of 1890", "quicksilver coins", "Dvořák, complete works", "CAFÉ de la Paix", "café set", "", None, "a", "½ crown (ﬁne)", "50% off_lot", "日本 コイン", "ab", "x-ray tube", "İstanbul"]
    rows = [(s, None, None, t, i) for s, ts in (("a", texts), ("b", texts[::-1])) for i, t in enumerate(ts)]
    phrases = ["silver coin", "SILVER", "ver coin", "er  co", "dvorak", "Dvořák, Comp", "Cafe", "café set", "a", "b", "ab", "", " ", "\u3000", None, "1⁄2", "fine", "%", "_lot", ".*", "本", "x-ray", "missing words here", "istanbul", "́", "silver\tcoin\n"]
    items = [(2 * i + k, s, None, None, p) for i, p in enumerate(phrases) for k, s in enumerate("ab")]
    want = {}
    for item, source, _, _, phrase in items:
        at = [pos for s, _, _, t, pos in rows if s == source and (phrase or "").strip() and plain(phrase) in plain(t)]
        if at:
            want[item] = (min(at), "phrase")
    assert hits(spark, items, rows) == want and len(want) > 30
