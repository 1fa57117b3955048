"""Runs against a plain search over all stretches, and the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lotwatch.llm import periodic_runs
from tests.llm.fixtures import empty_documents, hard_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """(start, length, period) of every run, from the longest stretch of each period at each place."""
    found = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)  # the first period of a stretch is its smallest
            i = j + 1
    return sorted((s, m, p) for (s, m), p in found.items())


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def texts_of_words(rng):
    yield []
    yield [0]
    yield [0] * 11
    yield [0] * 12
    yield [0] * 400
    yield [0, 1] * 30 + [0, 2]
    yield ([0] * 13 + [1]) * 9
    yield [0, 0, 1] * 40 + [0, 0, 0] * 9 + [0, 0, 1] * 5
    fib = ["0", "01"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield [int(c) for c in fib[-1]]  # as many runs as there are in such texts
    for size in (2, 3, 5):
        for n in (30, 90, 257):
            yield [rng.randrange(size) for _ in range(n)]
    for _ in range(60):
        n, p = rng.randrange(12, 300), rng.randrange(1, 60)
        base = [rng.randrange(50) for _ in range(n)]
        a = rng.randrange(n)
        yield [base[i] if i < a else base[a + (i - a) % p] for i in range(n)]


def test_all_runs_of_many_texts_at_once(monkeypatch):
    texts = list(texts_of_words(random.Random(5)))
    want = [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t)]
    numbers, counts = np.array([w for t in texts for w in t]), [len(t) for t in texts]
    assert [tuple(r) for r in periodic_runs.runs_of(numbers, counts).tolist()] == want
    monkeypatch.setattr(periodic_runs, "PROBES", 40)  # blocks of few grid points
    assert [tuple(r) for r in periodic_runs.runs_of(numbers, counts).tolist()] == want


def test_one_word_a_hundred_thousand_times():
    assert periodic_runs.runs_of(np.zeros(100_000, int), [100_000]).tolist() == [[0, 0, 100_000, 1]]


def test_words_as_python_splits_them(spark):
    import pyarrow as pa

    texts = ["", None, " a", "a ", "a\x0bb\x0cc\td\re\nf", "\x1c x\x85y  é", "last", "", "glued"]
    words, counts = periodic_runs.words_of(pa.array(texts))
    want = [[w.encode() for w in WORD.findall(t or "")] for t in texts]
    assert words.to_pylist() == [w for t in want for w in t]
    assert counts.tolist() == [len(t) for t in want]


@pytest.mark.parametrize("copies", [1, 2])
def test_query_on_hard_rows(spark, tmp_path, copies):
    docs = hard_documents(spark).filter("doc_id is null or doc_id <> 14")  # 60,000 words are too many for the plain version
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(["a b c " * 9, "x " * 500, "one two " * 6 + "three " * 12, "\n".join(["line of five words here"] * 8)] * 10)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True).selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS n_words")
    for _ in range(copies - 1):
        docs = docs.unionByName(docs)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.query(spark, str(tmp_path))
    assert got.columns == COLUMNS
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[1] for r in want)


def test_query_on_the_documents(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.query(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    short = [k for k, t in rows.items() if len(t or "") < 6000]
    assert len(short) > 100 and all(got[k] == plain_row(k, rows[k]) for k in short)


def test_very_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 5003}" for i in range(60_000)))], "doc_id long, text string")
    row = periodic_runs.find_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 60_000, 5003)]
    assert row["collapsed"] == " ".join(f"w{i}" for i in range(5003))
    assert periodic_runs.digests(periodic_runs.find_runs(empty_documents(spark))).collect() == []
