"""Validation of documents, and publications folded in order of arrival, on rows that are known to be right."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lotwatch.operators import publication, validation


def docs(spark, *values):
    rows = [(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "k int, j string").withColumn("doc", F.try_parse_json("j")).orderBy("k")


def found(spark, rules, *values):
    rows = docs(spark, *values).select("k", validation.errors(F.col("doc"), rules).alias("e")).orderBy("k").collect()
    return [[(e["path"], e["code"]) for e in r["e"]] for r in rows]


SOUND = {"matches": [{"lotId": "1"}], "status": "success", "generatedAt": "2026-01-02T03:04:05Z", "runId": "r1"}


@pytest.mark.parametrize(
    ("change", "codes"),
    [
        ({}, []), ({"matches": None}, ["invalid_matches"]), ({"matches": {}}, ["invalid_matches"]), ({"matches": [1, {}]}, ["invalid_match_item"]), ({"matches": [[]]}, ["invalid_match_item"]), ({"featured": None}, []), ({"featured": {"a": 1}}, []), ({"featured": []}, ["invalid_featured"]), ({"featured": "x"}, ["invalid_featured"]),
        ({"status": "odd"}, ["invalid_scan_status"]), ({"status": None}, ["invalid_scan_status"]), ({"status": "partial_failure"}, []), ({"scanStatus": " FAILURE ", "status": "odd"}, []), ({"status": "unavailable"}, ["unavailable"]), ({"sync": {"status": "unavailable"}}, ["unavailable"]),
        ({"generatedAt": "soon"}, ["invalid_generated_at"]), ({"generatedAt": None}, ["invalid_generated_at"]), ({"runId": " "}, ["invalid_run_id"]), ({"runId": None, "sync": {"runId": "r2"}}, []), ({"sync": {"status": "odd"}}, ["invalid_sync_status"]), ({"sync": {"status": "Stale"}}, []), ({"sync": "text"}, []),
        ({"sync": {"runId": "r2"}}, ["run_id_mismatch"]), ({"sync": {"generatedAt": "2026-01-02T03:04:06Z"}}, ["generated_at_mismatch"]), ({"sync": {"generatedAt": "2026-01-02T00:04:05-03:00"}}, []), ({"matches": 1, "runId": "", "generatedAt": ""}, ["invalid_matches", "invalid_generated_at", "invalid_run_id"]),
    ],
)
def test_reasons_against_snapshots(spark, change, codes):
    assert [c for _, c in found(spark, validation.SNAPSHOT, SOUND | change)[0]] == codes


def test_documents_that_are_none(spark):
    assert found(spark, validation.SNAPSHOT, "{broken", "[1]", "7", None, "null") == [[("", "invalid_shape")]] * 5


def test_every_error_of_a_manifest_with_its_path(spark):
    sound = {"schemaVersion": 1, "importId": "i", "consoleId": 5, "games": [{"clientRef": "g", "title": "t", "ownershipType": "both", "digitalOrigin": "", "entitledPlatforms": ["PS4", "PS5"]}], "photos": []}
    broken = {
        "schemaVersion": "1", "importId": " ", "games": [{"clientRef": "g", "title": "t"}, {"ownershipType": "stolen", "digitalOrigin": "x", "classificationStatus": "y", "entitledPlatforms": ["PS3"]}, 7], "accessories": [{"clientRef": "a", "completeness": "half"}],
        "photos": [{"clientRef": "p", "fileName": "f", "entityType": "car", "role": "selfie"}],
    }
    got = found(spark, validation.MANIFEST, sound, broken, {"schemaVersion": 1.0, "importId": 0, "consoleId": [], "games": None, "accessories": {}}, {"schemaVersion": 1, "importId": "i", "consoleId": "c", "games": [{"clientRef": 1, "title": "t", "entitledPlatforms": "PS4"}]})
    assert got[0] == []
    assert got[1] == [
        ("schemaVersion", "schema_version"), ("importId", "required"), ("consoleId", "required"), ("games[1].clientRef", "required"), ("games[1].title", "required"), ("games[1].ownershipType", "unknown_value"), ("games[1].digitalOrigin", "unknown_value"), ("games[1].classificationStatus", "unknown_value"),
        ("games[1].entitledPlatforms", "unknown_value"), ("games[2].clientRef", "required"), ("games[2].title", "required"), ("accessories[0].name", "required"), ("accessories[0].completeness", "unknown_value"), ("photos[0].entityType", "unknown_value"), ("photos[0].entityId", "required"), ("photos[0].role", "unknown_value"),
    ]
    assert got[2] == [("games", "not_a_list"), ("accessories", "not_a_list")]
    assert got[3] == [("games[0].entitledPlatforms", "unknown_value")]


def test_choice_of_a_snapshot(spark):
    now = F.lit("2026-01-02 04:00:00").cast("timestamp")
    newer = SOUND | {"runId": "r2", "generatedAt": "2026-01-02T03:30:00Z"}
    cases = {
        "server": ({"server": SOUND, "runtime": SOUND, "static": None}, ("server", "ready", "", [])), "newer": ({"server": SOUND, "runtime": newer}, ("server", "degraded", "run_id", [])), "older": ({"server": newer, "static": SOUND}, ("server", "ready", "run_id", [])),
        "fallback": ({"server": {}, "runtime": "x", "static": newer}, ("static", "degraded", "", ["runtime:invalid_shape", "server:invalid_matches"])), "none": ({"server": SOUND | {"status": "odd"}}, (None, "unavailable", "", ["server:invalid_scan_status"])),
        "stale": ({"server": SOUND | {"generatedAt": "2025-12-31T03:04:05Z"}}, ("server", "stale", "", [])), "empty": ({"server": SOUND | {"matches": []}}, ("server", "empty", "", [])), "partial": ({"server": SOUND | {"issues": ["x"]}}, ("server", "degraded", "", [])),
        "hash": ({"server": SOUND | {"snapshotHash": "a"}, "static": newer | {"snapshotHash": "a"}}, ("server", "ready", "", [])), "fresh": ({"server": SOUND | {"generatedAt": "2025-12-31T03:04:05Z", "sync": {"ageSeconds": 5}}}, ("server", "ready", "", [])),
    }
    rows = [(name, kind, v if isinstance(v, str) else json.dumps(v)) for name, (snapshots, _) in cases.items() for kind, v in snapshots.items() if v is not None]
    c = spark.createDataFrame(rows, "name string, kind string, j string").select("name", "kind", validation.snapshot_candidate(F.try_parse_json("j"), now).alias("c"))
    got = {r["name"]: (r["origin"], r["status"], r["divergence"], r["reasons"]) for r in validation.chosen_snapshot(c, ["name"], "kind", "c").collect()}
    assert got == {name: want for name, (_, want) in cases.items()}


def test_lifecycle_payloads(spark):
    own = {"version": 1, "activeKeys": [{"sourceId": " A ", "lotId": 5}, {"sourceId": "a", "lotId": "5"}, {"sourceId": "b", "lotId": "x" * 257}, 7], "sourceHealth": {"A": {"status": " Success", "inventoryAuthoritative": True}, "b": "partial", "c": {"status": "odd", "inventoryAuthoritative": "yes"}}}
    rows = docs(spark, {"publicationLifecycle": own}, {"publicationLifecycle": own | {"version": 2}}, {}, {"publicationLifecycle": {"version": 1, "activeKeys": {}, "sourceHealth": []}}).select("k", validation.lifecycle_payload(F.col("doc")).alias("l")).orderBy("k").collect()
    first, other, none, bad = (r["l"] for r in rows)
    assert first["applies"] and [tuple(h) for h in first["health"]] == [("a", "success", True), ("b", "partial", False), ("c", "odd", False)] and tuple(first["keys"][0]) == ("a", "5") and len(first["keys"]) == 3
    assert [(e["path"], e["code"]) for e in first["errors"]] == [("publicationLifecycle.activeKeys[2].lotId", "lot_id"), ("publicationLifecycle.activeKeys[3].", "key_not_an_object"), ("publicationLifecycle.activeKeys[3].sourceId", "source_id"), ("publicationLifecycle.activeKeys[3].lotId", "lot_id"), ("publicationLifecycle.sourceHealth", "source_status")]
    assert not other["applies"] and not none["applies"] and other["errors"] == [] and [e["code"] for e in bad["errors"]] == ["invalid_keys", "invalid_health"]


def test_one_bad_image_costs_only_itself(spark):
    doc = {"activeMatchMetadata": [{"sourceId": "a", "lotId": "1", "imageUrl": "/x.png"}, {"sourceId": "A", "lotId": 2, "image_url": "https://i/2"}, {"sourceId": "a", "lotId": "3"}]}
    assert [tuple(m) for m in docs(spark, doc).select(validation.match_images(F.col("doc"))).first()[0]] == [("a", "2", "https://i/2")]


# Publications ------------------------------------------------------------------------------------------------------

START = dt.datetime(2026, 1, 1)
ATTEMPT = "series string, n int, run string, digest string, generated timestamp, arrival timestamp, expected string"


def attempts(spark, rows):
    """rows: (series, run, content, generated minute, arrival minute, expected)."""
    return spark.createDataFrame([(s, n, run, digest, None if g is None else START + dt.timedelta(minutes=g), START + dt.timedelta(minutes=a), e) for n, (s, run, digest, g, a, e) in enumerate(rows)], ATTEMPT)


def states(df):
    return publication.published(df, ["series"], "run", "digest", "generated", "arrival", ["n"], "expected")


def walked(rows):
    """The same, one attempt after the other."""
    out, now, history = {}, {}, {}
    for n, (s, run, digest, g, a, e) in sorted(enumerate(rows), key=lambda x: (x[1][4], x[0])):
        current = now.get(s)
        if run is None or digest is None or g is None:
            state = "invalid"
        elif e is not None and e != digest:
            state = "hash_mismatch"
        elif g > a + 5:
            state = "ahead_of_time"
        elif history.get((s, run), digest) != digest:
            state = "run_conflict"
        elif current and current[:2] == (run, digest):
            state = "idempotent"
        elif current and g < current[2]:
            state = "older"
        elif current and g == current[2] and digest != current[1]:
            state = "same_time_conflict"
        else:
            state, now[s], history[s, run] = "accepted", (run, digest, g), digest
        out[n] = (state, now[s][0] if s in now else None)
    return out


def test_publications_one_by_one(spark):
    rows = [
        ("a", "r1", "x", 0, 10, None), ("a", "r1", "x", 0, 11, "x"), ("a", "r1", "y", 5, 12, None), ("a", "r2", "y", 0, 13, None), ("a", "r2", "x", 0, 14, None), ("a", "r3", "z", -5, 15, None), ("a", "r4", "z", 21, 15, None), ("a", "r4", "z", 20, 15, None),
        ("a", None, "z", 16, 16, None), ("a", "r5", None, 16, 16, None), ("a", "r5", "w", None, 16, None), ("a", "r5", "w", 30, 30, "other"), ("b", "r1", "y", 1, 9, None), ("a", "r2", "x", 20, 31, None), ("a", "r2", "x", 40, 41, None), ("a", "r1", "x", 40, 42, None),
    ]
    got = {r["n"]: r["state"] for r in states(attempts(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == ["accepted", "idempotent", "run_conflict", "same_time_conflict", "accepted", "older", "ahead_of_time", "accepted", "invalid", "invalid", "invalid", "hash_mismatch", "accepted", "same_time_conflict", "accepted", "accepted"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_orders_of_arrival(spark, seed):
    """Whatever order rows lie in, and over batches of two rows, the fold gives what a walk gives."""
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice(["r1", "r2", "r3", None]), rng.choice("xyz"), rng.randrange(12), rng.randrange(5, 40), rng.choice([None, None, "x"])) for _ in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {r["n"]: (r["state"], r["current_run"]) for r in states(attempts(spark, rows).repartition(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == walked(rows)
    assert {s for s, _ in got.values()} >= {"accepted", "idempotent", "run_conflict", "older"}


def test_receipts_and_what_became_of_requests(spark):
    rows = [("a", "r1", "x", 0, 10, None), ("a", "r1", "x", 0, 11, None), ("a", "r2", "y", 5, 12, None), ("a", "r3", "z", 1, 13, None)]
    df = attempts(spark, rows)
    s = states(df)
    held, current = publication.receipts(s, ["series"], "run", "digest", "arrival"), publication.current_publications(s, ["series"], "arrival", ["n"])
    assert sorted((r["run"], r["digest"], r["publications"]) for r in held.collect()) == [("r1", "x", 2), ("r2", "y", 1)]
    got = {r["n"]: (r["publication"], r["superseded_by"]) for r in publication.publication_state(df, held, current, ["series"], "run", "digest", "arrival").collect()}
    assert got == {0: ("superseded", "r2"), 1: ("superseded", "r2"), 2: ("current", None), 3: ("missing", None)}
    assert states(df.limit(0)).collect() == []


def test_one_form_of_a_document(spark):
    rows = docs(spark, '{"b": 1, "a": [1, {"d": null, "c": "é"}]}', '{ "a":[1,{"c":"é","d":null}],"b":1 }', '{"a":[1,{"c":"e","d":null}],"b":1}', "{broken", None).select(publication.canonical(F.col("j")).alias("c"), publication.content_hash(F.col("j")).alias("h")).collect()
    assert rows[0]["c"] == '{"a":[1,{"c":"é","d":null}],"b":1}' and rows[0]["h"] == rows[1]["h"] != rows[2]["h"] and rows[3]["h"] is None and rows[4]["h"] is None
