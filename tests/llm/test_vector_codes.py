"""Codes against a plain search over all entries in Python integers, and against the SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

from lotwatch.llm import vector_codes
from tests.oracle import difference

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, embedding, label), one distance after the other."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for x in cut:
                own.setdefault(nearest(x[p], book)[1], []).append(x[p])
            books[p] = [[sum(c) // len(own[j]) for c in zip(*own[j])] if j in own else e for j, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    last = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in x) for x in last]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{j:02x}" for _, j in x), e, by_label[label], digest) for (i, _, label), x, e in zip(kept, last, errors)]


def answers(df):
    return sorted((tuple(r) for r in vector_codes.digests(*vector_codes.compress(df)).collect()), key=str)


@pytest.mark.parametrize("largest", [3, 1000, 2**24, 2**33])
def test_search_finds_what_a_scan_finds(largest):
    rng = np.random.default_rng(largest)
    entries = rng.integers(-largest, largest + 1, (64, 3))
    entries[5] = entries[40] = entries[2]  # ties
    parts = np.concatenate([rng.integers(-largest, largest + 1, (500, 3)), entries])
    book = vector_codes.Codebook(entries)
    best, least = book.nearest(parts, rng.integers(0, 64, len(parts)))
    for x, j, d in zip(parts.tolist(), best, least):
        assert (int(d), int(j)) == min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries.tolist()))


def test_a_good_start_spares_most_entries():
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, (256, 2))
    parts = entries[rng.integers(0, 256, 2000)] + rng.integers(-5, 6, (2000, 2))
    book = vector_codes.Codebook(entries)
    best, _ = book.nearest(parts, np.zeros(2000, int))
    from_zero, book.looked_at = book.looked_at, 0
    book.nearest(parts, best)
    assert book.looked_at < from_zero / 4


def test_hard_rows(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-0.4, 0.4) for _ in range(8)], k % 3 or None) for k in range(290)]
    rows += [(7, rows[7][1], 1)] * 3 + [(None, rows[9][1], 2), (4, rows[50][1], None)]  # repeated rows and ids
    rows += [(500, None, 1), (501, [None] + [0.1] * 7, 1), (502, [math.nan] + [0.1] * 7, 1), (503, [math.inf] + [0.1] * 7, 1), (504, [-math.inf] * 8, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS code", "'e' AS error", "0 AS v", "label AS own_label", "9 AS r")
    plainly = plain([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    assert len(plainly) == 295 and answers(df) == sorted(plainly, key=str)


def test_few_rows_huge_components_and_none(spark):
    wide = "vec_id long, embedding array<double>, label string"
    rows = [(1, [2.0**51, -(2.0**51), 3.5, -0.001], "a"), (2, [2.0**51 + 1, 5.0, 1e9, 2.5], "a"), (3, [0.0, 0.0, 1e9 + 1, 2.5], None), (4, [1.0] * 4, None)]
    with pytest.raises(Exception, match="64|too large|convert|int"):
        answers(spark.createDataFrame([*rows, *[(k, [x * 2.0**6 for x in v], s) for k, v, s in rows]], wide).filter("vec_id > 0").limit(8).selectExpr("vec_id", "transform(embedding, x -> x * 1024) AS embedding", "label"))
    df = spark.createDataFrame([(k, [x / 2.0**24 for x in v], s) for k, v, s in rows] * 2, wide)
    assert answers(df) == sorted(plain([tuple(r) for r in df.collect()]), key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.digests(*vector_codes.compress(empty)).collect() == []
    assert answers(spark.createDataFrame([(1, None, 1)], SCHEMA)) == []
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 6, 1)], SCHEMA))


def test_more_labels_than_are_broadcast(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 2)
    assert difference(vector_codes.query(spark, sf_dir), sf_dir, vector_codes.ORACLE) == ""


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    assert difference(vector_codes.query(spark, sf_dir), sf_dir, vector_codes.ORACLE) == ""
