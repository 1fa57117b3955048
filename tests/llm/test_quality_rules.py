"""Counted rules, ratio and cut against plain Python, and the query against its SQL."""

import math
import re

import pyarrow as pa
import pytest

from lotwatch.llm import quality_rules
from tests.llm.fixtures import WORD, empty_documents, hard_documents
from tests.oracle import difference

PUNCT = re.compile(rb"[!-/:-@\[-`{-~]+|[^\x20\x09-\x0D!-/:-@\[-`{-~]+")
LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def plain_grams(text):
    out = []
    for t in PUNCT.findall((text or "").encode().lower()):
        h = 0
        for b in t:
            h = (h * 257 + b + 1) % (2**31 - 1)
        out.append(h)
    return [h % 65536 for h in out] + [(a * 65599 + b) % (2**31 - 1) % 65536 for a, b in zip(out, out[1:])]


def plain(docs, labels):
    """(doc_id, five counts, base_failed, n_grams, log_ratio, cut, kept) of every row."""
    best = {}
    for i, q in labels:
        if i is not None and q is not None:
            best[i] = max(best.get(i, q), q)
    raw, good, rows = {}, {}, []
    for i, text in docs:
        for b in plain_grams(text):
            raw[b] = raw.get(b, 0) + 1
            good[b] = good.get(b, 0) + (best.get(i, 0) > 0)
    f = sum(good.values()) / max(1, sum(raw.values()))
    weight = {b: math.floor(2**20 * math.log((good[b] + 8 * f) / (f * (r + 8))) + 0.5) if f else 0 for b, r in raw.items()}
    for i, text in docs:
        grams, counts = plain_grams(text), plain_counts(text)
        failed = counts[0] < 50 or counts[4] * 2 > counts[0]
        rows.append((i, counts, failed, len(grams), sum(weight[b] for b in grams) // max(1, len(grams))))
    judged = [(s // 4096, best[i] > 0) for i, _, failed, _, s in rows if not failed and i in best]
    n = [sum(1 for _, g in judged if g is k) for k in (False, True)]
    cut = None
    if all(n):
        bins = sorted({b for b, _ in judged})
        gain, at = max((sum((b >= x) * (n[0] if g else -n[1]) for b, g in judged), -x) for x in bins)
        if gain > 0:
            cut = (bins[bins.index(-at) - 1] - at + 1) // 2 * 4096
    return [(i, *c, failed, m, s / 2**20, None if cut is None else cut / 2**20, not failed and (cut is None or s >= cut)) for i, c, failed, m, s in rows]


def answers(spark, docs, labels):
    return sorted(map(tuple, quality_rules.judge(docs, spark.createDataFrame(labels, LABELS)).collect()), key=str)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_rules_and_ngrams_of_odd_texts():
    texts = ["", None, "a b c a b c", "a b c a b", "x x x x", "x x x", "line one\n \nline one\nline one \n\t\nq", "###a*b$ é|<日本>  \x0b%&", "İ !! ÉA--b\x85c \x1cd", " tail ", "a!b", "!" * 9000 + "y" * 70_000, "q\nq\nq", "\x7f~}{`_"]
    arrow = pa.array(texts)
    raw, ends = quality_rules.bytes_of(arrow)
    got = quality_rules.rule_counts(arrow, raw, ends)
    assert list(zip(*(got[c].tolist() for c in quality_rules.COUNTS))) == [plain_counts(t) for t in texts]
    bucket, text = quality_rules.ngrams(raw, ends)
    found = [[] for _ in texts]
    for b, i in zip(bucket.tolist(), text.tolist()):
        found[i].append(b)
    assert found == [plain_grams(t) for t in texts]


def junk(k):
    return " ".join(f"buy{i * k % 41}!! ***now{i * k % 41} $$$pay{i}" for i in range(40))


@pytest.mark.parametrize("few", [2_000_000, 1])
def test_hard_rows(spark, monkeypatch, few):
    monkeypatch.setattr(quality_rules, "FEW_LABELS", few)
    docs = hard_documents(spark).filter("doc_id IS NULL OR doc_id <> 14")
    more = [(100 + k, " ".join(f"{w}{((k + 1) * i) % 61}" for i in range(60) for w in ("some", "plain", "words"))) for k in range(12)] + [(200 + k, junk(k + 1)) for k in range(8)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.union(docs.filter("doc_id IN (3, 101, 203) OR doc_id IS NULL")).selectExpr("*", "7 AS quality", "1 AS n_words", "true AS kept", "0 AS good", "2 AS labelled")
    labels = [(100 + k, 1, 0) for k in range(8)] + [(200 + k, 0, 0) for k in range(5)] + [(200, 0, 0), (101, 0, 1), (1, 1, 0), (None, 1, 0), (3, None, 0), (9999, 1, 0)]
    got = answers(spark, docs, labels)
    assert got == sorted(plain(rows_of(docs), [x[:2] for x in labels]), key=str)
    assert not any(r[6] for r in got if r[0] and 100 <= r[0] < 300)
    verdict = {r[0]: r[-1] for r in got}
    assert all(verdict[100 + k] for k in range(12)) and not any(verdict[200 + k] for k in range(8))


@pytest.mark.parametrize("labels", [[], [(101, 1, 0), (102, 1, 0)], [(101, 0, 0)]])
def test_without_good_or_bad_labels_only_the_rules_decide(spark, labels):
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(k))) for k in (49, 50, 101, 102)], "doc_id long, text string")
    got = answers(spark, docs, labels)
    assert got == sorted(plain(rows_of(docs), [x[:2] for x in labels]), key=str)
    assert [r[-1] for r in sorted(got)] == [False, True, True, True]


def test_long_text_and_empty_table(spark):
    words = [f"long{i % 5003}" for i in range(60_000)]
    row = quality_rules.judge(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), spark.createDataFrame([], LABELS)).first()
    assert (row["n_words"], row["n_repeat_words"], row["kept"]) == (60_000, 60_000, False)
    assert answers(spark, empty_documents(spark), [(1, 1, 0)]) == []


def test_held_out_labels(spark, sf_dir):
    """Fitted without half of the labels, the verdicts tell those nearly as well."""
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels.filter("doc_id % 2 = 0")).filter("NOT base_failed").collect()}
    for quality, right in ((0, lambda r: not r["kept"]), (1, lambda r: r["kept"])):
        held = [got[r["doc_id"]] for r in labels.filter(f"doc_id % 2 = 1 AND quality = {quality}").collect() if r["doc_id"] in got]
        assert len(held) > 5 and sum(map(right, held)) >= 0.98 * len(held)


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    assert difference(quality_rules.query(spark, sf_dir), sf_dir, quality_rules.ORACLE) == ""
