"""Registries, receipts and earlier runs on rows that are known to be right."""

import pytest
from pyspark.sql import functions as F

from lotwatch.operators import registry_runs as R

ROWS = "source string, lot string, price int, at int"
STATUS = "source string, status string, authoritative boolean, at int"
KNOWN = [("sure", "1", 1, 0), ("sure", "2", 1, 0), ("part", "1", 1, 0), ("part", "2", 1, 0), ("fail", "1", 1, 0), ("gone", "1", 1, 0), ("weak", "1", 1, 0)]
SEEN = [("sure", "2", 2, 0), ("part", "2", 2, 0), ("part", "2", 3, 1), ("part", "3", 2, 0), ("gone", "9", 2, 0), ("new", "1", 2, 0)]
TOLD = [("sure", "partial", False, 0), ("sure", " SUCCESS", True, 1), ("part", "partial", True, 0), ("fail", "failed", True, 0), ("weak", "success", None, 0), ("new", "success", True, 0)]


@pytest.mark.parametrize(
    ("valid", "want"),
    [
        (True, {"sure": {"2": 2}, "part": {"1": 1, "2": 3, "3": 2}, "fail": {"1": 1}, "gone": {"9": 2}, "weak": {"1": 1}, "new": {"1": 2}}),
        (False, {"sure": {"2": 2}, "part": {"1": 1, "2": 3, "3": 2}, "fail": {"1": 1}, "gone": {"1": 1, "9": 2}, "weak": {"1": 1}, "new": {"1": 2}}),
    ],
)
def test_only_proof_retires_what_is_known(spark, valid, want):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = R.reconciled_registry(df(KNOWN, ROWS), df(SEEN, ROWS), df(TOLD, STATUS), "source", "lot", "at", valid).collect()
    got = {}
    for r in out:
        got.setdefault(r["source"], {})[r["lot"]] = r["price"]
    assert got == want and len(out) == sum(map(len, want.values()))
    none = R.reconciled_registry(df(KNOWN, ROWS), df([], ROWS), df([], STATUS), "source", "lot", "at", valid)
    assert none.count() == (0 if valid else len(KNOWN))


RECEIPT = "source string, grp string, started_at string, finished_at string, status string, lots string, errors string"


def receipt(grp, source="s", **change):
    r = {"source": source, "grp": grp, "started_at": "a", "finished_at": "b", "status": "complete", "lots": "3", "errors": "0"} | change
    return tuple(r.values())


def test_receipts_that_prove_a_group(spark):
    rows = [
        receipt("1"), receipt("2", status=" Complete "), receipt("3", errors=""), receipt("4", errors=None, lots=None), receipt("5", errors="1"), receipt("6", status="partial"), receipt("7", status="odd"), receipt("8", finished_at=" "), receipt("9", started_at=None), receipt("10", lots="-1"), receipt("11", lots="x"), receipt(""), receipt(None),
        receipt("1", status="failed"),
    ]
    assert sorted(r["grp"] for r in R.complete_groups(spark.createDataFrame(rows, RECEIPT), ["source"], "grp").collect()) == ["1", "2", "3", "4"]


def test_authority_of_sources(spark):
    expected = [(s, g) for s in ("ok", "skip", "short", "failed", "blind", "unproven") for g in ("1", "2")] + [("more", "1")]
    receipts = [receipt(g, s) for s in ("ok", "skip", "failed", "blind", "unproven", "more") for g in ("1", "2")] + [receipt("1", "short")]
    steps = [("ok", True, "success", True), ("skip", True, "skipped", True), ("short", True, "success", True), ("failed", True, "failed", True), ("blind", False, "success", True), ("unproven", True, "success", None), ("more", True, "success", True), ("idle", True, "success", True)]
    covered = R.coverage(spark.createDataFrame(expected, "source string, grp string"), spark.createDataFrame(receipts, RECEIPT), spark.createDataFrame(steps, "source string, discovery_proven boolean, matches_status string, matches_proven boolean"), ["source"], "grp")
    got = {r["source"]: tuple(r)[1:] for r in covered.collect()}
    assert got["ok"] == (2, 2, 0, 0, 6, True) and got["skip"][-1] and got["short"] == (2, 1, 1, 0, 3, False) and got["more"] == (2, 1, 0, 1, 6, False) and got["idle"] == (0, 0, 0, 0, 0, True)
    assert not any(got[s][-1] for s in ("failed", "blind", "unproven"))
    assert tuple(R.coverage_total(covered).first()) == (8, 14, 12, 1, 1, 39, False) and R.coverage_total(covered.filter("source IN ('ok', 'skip')")).first()["authoritative"] and not R.coverage_total(covered.limit(0)).first()["authoritative"]


def test_rows_of_the_newest_run_of_each_group(spark):
    processed = spark.createDataFrame([("r1", 1, "a"), ("r1", 1, "b"), ("r2", 2, "b"), ("r2", 2, "c"), ("r3", 3, "a"), ("r3", 3, "d")], "run string, at int, grp string")
    rows = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r2", "c", 3), ("r2", "b", 4), ("r2", "b", 5), ("r1", "d", 6)], "run string, grp string, n int")
    pending = spark.createDataFrame([("a",), ("b",), ("b",), ("d",), ("x",)], "grp string")
    # The newest run that looked at a and d found nothing there.
    assert sorted(r["n"] for r in R.cached_rows(rows, processed, pending, "grp", "run", "at").collect()) == [4, 5]
    assert sorted(r["n"] for r in R.cached_rows(rows, processed, pending, "grp", "run", "at", F.lit("r3")).collect()) == [1, 4, 5]
    merged = R.merged_with_cache(rows.filter("n = 4").withColumn("n", F.lit(40)), rows.filter("n > 3"), ["run", "grp"], "n")
    assert sorted(r["n"] for r in merged.collect()) == [6, 40]


def test_latest_run_with_matches(spark):
    runs = spark.createDataFrame([("r1", 1, 5, 0), ("r2", 2, 0, 3), ("r3", 3, 0, None), ("r4", 4, None, 0)], "run string, at int, a int, b int")
    latest = lambda *args: [r["run"] for r in R.latest_matchful(runs, "run", "at", *args).collect()]
    assert latest(["a", "b"]) == ["r2"] and latest(["a"]) == ["r1"] and latest(["a", "b"], F.lit("r2")) == ["r1"] and latest(["a"], F.lit("r1")) == []


def test_cached_rows_by_todays_rules(spark):
    rows = [("1", "Consola Nintendo con caja, sin probar", 5.0, 0, "x", "", "", 1), ("2", "mesa de luz", 5.0, 1, "x", "", "", 1), ("3", " ", 5.0, 1, "kept", "", "", 9), ("4", None, None, None, "kept", "", "", 9)]
    df = spark.createDataFrame(rows, "id string, description string, value double, bids int, matched_keywords string, risk_flags string, positive_flags string, score int")
    got = {r["id"]: r for r in R.rescored(df, "description", "value", "bids").collect()}
    assert sorted(got) == ["1", "3", "4"] and (got["3"]["matched_keywords"], got["4"]["score"]) == ("kept", 9)
    assert (got["1"]["matched_keywords"], got["1"]["risk_flags"], got["1"]["positive_flags"], got["1"]["score"]) == ("nintendo, consola", "sin probar", "caja", 12 + 12 + 4 + 2 + 2 - 8)


@pytest.mark.parametrize(("code", "reported", "ids", "want"), [(0, 2, ["a", "b", "a", " "], ("success", True)), (0, 3, ["a", "b"], ("partial", False)), (0, None, [], ("partial", False)), (1, 2, ["a", "b"], ("failed", False)), (None, 0, None, ("failed", False)), (0, 0, None, ("success", True))])
def test_discoveries_need_more_than_an_exit_of_0(spark, code, reported, ids, want):
    df = spark.createDataFrame([(code, reported, ids)], "c int, r int, i array<string>")
    assert tuple(df.select(R.discovery_status(F.col("c"), F.col("r"), F.col("i")).alias("v")).first()["v"]) == want
