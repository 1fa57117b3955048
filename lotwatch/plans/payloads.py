"""Documents that arrive from elsewhere: manifests, snapshots, lifecycles and publications made of the tables' own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.operators import publication, validation
from lotwatch.plans.base import Tables, query


def _variant(t: DataFrame, key: str, text: Column) -> DataFrame:
    return t.select(key, F.try_parse_json(text).alias("doc"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Every digit of a key breaks another rule of a manifest.
_MANIFEST_SQL = """
WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), e AS (
  SELECT k, 0 AS o, '' AS path, 'invalid_shape' AS code FROM p WHERE k % 19 = 0
  UNION ALL SELECT k, 1, 'schemaVersion', 'schema_version' FROM p WHERE k % 19 > 0 AND k % 3 = 0
  UNION ALL SELECT k, 2, 'importId', 'required' FROM p WHERE k % 19 > 0 AND n % 4 = 0
  UNION ALL SELECT k, 3, 'consoleId', 'required' FROM p WHERE k % 19 > 0 AND n % 5 = 0
  UNION ALL SELECT k, 4, 'accessories', 'not_a_list' FROM p WHERE k % 19 > 0 AND k % 7 = 0
  UNION ALL SELECT k, 5, 'games[1].clientRef', 'required' FROM p WHERE k % 19 > 0 AND k % 2 = 0
  UNION ALL SELECT k, 6, 'games[1].ownershipType', 'unknown_value' FROM p WHERE k % 19 > 0 AND n % 3 = 0
  UNION ALL SELECT k, 7, 'games[1].entitledPlatforms', 'unknown_value' FROM p WHERE k % 19 > 0 AND n % 2 = 0
  UNION ALL SELECT k, 8, 'photos[0].entityType', 'unknown_value' FROM p WHERE k % 19 > 0 AND k % 5 = 0
  UNION ALL SELECT k, 9, 'photos[0].role', 'unknown_value' FROM p WHERE k % 19 > 0 AND k % 11 = 0)
SELECT k AS p_partkey, count(e.k)::INTEGER AS errors, coalesce(string_agg(path || ':' || code, ',' ORDER BY o), '') AS found FROM p LEFT JOIN e USING (k) GROUP BY k
"""


@query("json09_manifest_errors", _MANIFEST_SQL)
def json09(t: Tables) -> DataFrame:
    """All errors of every manifest, with their paths."""
    k, n = F.col("p_partkey"), F.col("p_size")
    either = lambda when, yes, no: F.when(when, yes).otherwise(no)
    text = _text(
        '{"schemaVersion":', either(k % 3 == 0, '"1"', "1"), ',"importId":"', either(n % 4 == 0, "  ", "i"), '"', either(n % 5 == 0, "", ',"consoleId":7'), either(k % 7 == 0, ',"accessories":{}', ""),
        ',"games":[{"clientRef":1,"title":"a"},{"title":"b"', either(k % 2 == 0, "", ',"clientRef":"g"'), ',"ownershipType":"', either(n % 3 == 0, "stolen", "both"), '","entitledPlatforms":', either(n % 2 == 0, '["PS4","PS3"]', '["PS5"]'),
        '}],"photos":[{"clientRef":"p","fileName":"f","entityId":3,"entityType":"', either(k % 5 == 0, "car", "game"), '","role":"', either(k % 11 == 0, "selfie", ""), '"}]}',
    )
    found = _variant(t.part, "p_partkey", F.when(k % 19 == 0, F.lit("[1]")).otherwise(text)).select("p_partkey", validation.errors(F.col("doc"), validation.MANIFEST).alias("e"))
    return found.select("p_partkey", F.size("e").alias("errors"), F.array_join(F.transform("e", lambda e: F.concat(e["path"], F.lit(":"), e["code"])), ",").alias("found"))


def _snapshot(key: Column, shift: int) -> Column:
    """A snapshot's JSON whose faults depend on a key, in another way for each kind of snapshot."""
    k = key + shift
    stamp = _text("2026-01-", F.lpad((1 + k % 20).cast("string"), 2, "0"), "T10:00:00Z")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (1 + at).cast("int"))
    return _text(
        '{"matches":', pick(("[]", '[{"lotId":"1"}]', "[1]", '{"a":1}', '[{}]'), k % 5), ',"status":"', pick(("success", "partial_failure", "failure", "odd"), k % 4), '","generatedAt":"', F.when(k % 13 == 0, "soon").otherwise(stamp),
        '","runId":"', F.when(k % 17 == 0, "").otherwise(_text("run", k % 6)), '","sync":{"status":"', pick(("", "current", "stale", "", "broken", "unavailable", ""), k % 7), '","runId":"', F.when(k % 11 == 0, "other").otherwise(""), '"},"issues":', pick(("[]", '["x"]'), k % 2), "}",
    )


def _snapshot_sql(name: str, shift: int) -> str:
    k = f"(s_suppkey + {shift})"
    return f"""SELECT s_suppkey, '{name}' AS kind, CASE WHEN {k} % 5 = 3 THEN 'invalid_matches' WHEN {k} % 5 = 2 THEN 'invalid_match_item' WHEN {k} % 7 = 5 THEN 'unavailable' WHEN {k} % 4 = 3 THEN 'invalid_scan_status'
      WHEN {k} % 13 = 0 THEN 'invalid_generated_at' WHEN {k} % 17 = 0 AND {k} % 11 > 0 THEN 'invalid_run_id' WHEN {k} % 7 = 4 THEN 'invalid_sync_status' WHEN {k} % 11 = 0 AND {k} % 17 > 0 THEN 'run_id_mismatch' ELSE '' END AS reason,
      ({k} % 5 = 3)::INTEGER + ({k} % 5 IN (2, 3) AND {k} % 5 <> 3)::INTEGER + ({k} % 7 = 5)::INTEGER + ({k} % 4 = 3)::INTEGER + ({k} % 13 = 0)::INTEGER + ({k} % 17 = 0 AND {k} % 11 > 0)::INTEGER + ({k} % 7 = 4)::INTEGER + ({k} % 11 = 0 AND {k} % 17 > 0)::INTEGER AS errors,
      1 + {k} % 20 AS day, CASE WHEN {k} % 17 > 0 THEN 'run' || {k} % 6 ELSE 'other' END AS run_id, {k} % 7 = 2 OR ({k} % 7 IN (0, 3, 6) AND 1 + {k} % 20 < 15) AS stale, {k} % 4 IN (1, 2) OR {k} % 2 = 1 AS weak, {k} % 5 IN (1, 4) AS some FROM supplier"""


_KINDS = (("server", 0), ("runtime", 3), ("static", 8))
_SNAPSHOTS = "c AS (" + " UNION ALL ".join(_snapshot_sql(*x) for x in _KINDS) + ")"


def _candidates(t: Tables) -> DataFrame:
    now = F.lit("2026-01-16 22:00:00").cast("timestamp")
    parts = [t.supplier.select("s_suppkey", F.lit(name).alias("kind"), F.try_parse_json(_snapshot(F.col("s_suppkey"), shift)).alias("doc")) for name, shift in _KINDS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select("s_suppkey", "kind", validation.snapshot_candidate(F.col("doc"), now).alias("c"))


@query("src42_snapshot_reasons", f"WITH {_SNAPSHOTS} SELECT s_suppkey, kind, reason, errors FROM c")
def src42(t: Tables) -> DataFrame:
    """Three snapshots of each supplier: the first reason against it, and how many there are."""
    return _candidates(t).select("s_suppkey", "kind", F.coalesce(F.get("c.errors", F.lit(0))["code"], F.lit("")).alias("reason"), F.size("c.errors").alias("errors"))


@query(
    "src41_chosen_snapshot",
    f"""WITH {_SNAPSHOTS}, r AS (SELECT s_suppkey, coalesce(string_agg(kind || ':' || reason, ',' ORDER BY kind) FILTER (reason <> ''), '') AS reasons FROM c GROUP BY s_suppkey),
    g AS (SELECT s_suppkey, max(c) FILTER (kind = 'server' AND reason = '') AS s, coalesce(max(c) FILTER (kind = 'runtime' AND reason = ''), max(c) FILTER (kind = 'static' AND reason = '')) AS f FROM c GROUP BY s_suppkey),
    d AS (SELECT *, coalesce(s, f) AS x, CASE WHEN s IS NULL OR f IS NULL THEN '' WHEN s.run_id <> f.run_id THEN 'run_id' WHEN s.day <> f.day THEN 'generated_at' ELSE '' END AS divergence FROM g JOIN r USING (s_suppkey))
    SELECT s_suppkey, x.kind AS origin, CASE WHEN x IS NULL THEN 'unavailable' WHEN x.stale THEN 'stale' WHEN x.weak OR x.kind <> 'server' OR (divergence <> '' AND f.day > s.day) THEN 'degraded' WHEN x.some THEN 'ready' ELSE 'empty' END AS status, divergence, x.run_id AS run_id, reasons FROM d""",
)
def src41(t: Tables) -> DataFrame:
    found = validation.chosen_snapshot(_candidates(t), ["s_suppkey"], "kind", "c")
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "set19_lifecycle",
    """WITH d AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
    SELECT k AS o_orderkey, k % 8 > 0 AS applies, CASE WHEN k % 8 = 0 THEN '' ELSE concat_ws(',', CASE WHEN k % 7 = 0 THEN 'publicationLifecycle.sourceHealth:invalid_health' END, CASE WHEN k % 5 = 0 THEN 'publicationLifecycle.activeKeys[1].sourceId:source_id' END,
        CASE WHEN k % 3 = 0 THEN 'publicationLifecycle.activeKeys[1].lotId:lot_id' END, CASE WHEN k % 7 > 0 AND k % 11 = 0 THEN 'publicationLifecycle.sourceHealth:source_status' END) END AS errors,
      CASE WHEN k % 8 > 0 THEN CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 2 ELSE 1 END ELSE 1 + (k % 5 = 0 OR k % 3 = 0)::INTEGER END AS keys, CASE WHEN k % 7 = 0 THEN '' ELSE 'a:' || CASE WHEN k % 11 = 0 THEN 'odd' ELSE 'success' END || ':' || (c % 2 = 0)::VARCHAR || ',b:partial:false' END AS health,
      CASE WHEN c % 3 = 0 THEN 0 ELSE 1 END AS images FROM d""",
)
def set19(t: Tables) -> DataFrame:
    """Lifecycle payloads of orders: key sets, health maps and images, with every error."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    either = lambda when, yes, no: F.when(when, yes).otherwise(no)
    text = _text(
        '{"publicationLifecycle":{"version":', either(k % 8 == 0, "2", "1"), ',"activeKeys":[{"sourceId":" A ","lotId":5},{"sourceId":"', either(k % 5 == 0, "a b", "a"), '","lotId":"', either(k % 3 == 0, " ", "5"), '"}],"sourceHealth":',
        either(k % 7 == 0, "[]", _text('{"A":{"status":"', either(k % 11 == 0, "odd", "Success"), '","inventoryAuthoritative":', either(c % 2 == 0, "true", '"yes"'), '},"b":"partial"}')),
        '},"activeMatchMetadata":[{"sourceId":"a","lotId":"5","imageUrl":"', either(c % 3 == 0, "/relative.png", "https://i.example/1.png"), '"},{"sourceId":"a","lotId":"6"}]}',
    )
    x = _variant(t.orders, "o_orderkey", text).select("o_orderkey", validation.lifecycle_payload(F.col("doc")).alias("l"), F.size(validation.match_images(F.col("doc"))).alias("images"))
    join = lambda xs, f: F.array_join(F.transform(xs, f), ",")
    health = join("l.health", lambda h: F.concat_ws(":", h["source_id"], h["status"], h["authoritative"].cast("string")))
    return x.select("o_orderkey", F.col("l.applies").alias("applies"), join("l.errors", lambda e: F.concat_ws(":", e["path"], e["code"])).alias("errors"), F.size("l.keys").alias("keys"), health.alias("health"), "images")


# Publications ------------------------------------------------------------------------------------------------------

_ATTEMPTS = """
t AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 41 > 0 THEN 'r' || event_id % 7 END AS run, sha256('{"runId":"r' || event_id % 7 || '","value":' || (event_id // 100 % 3) || '}') AS digest,
  CASE WHEN event_id % 29 = 0 THEN ts + INTERVAL 10 MINUTE ELSE date_trunc('day', ts) - INTERVAL 1 DAY * (event_id % 3) END AS generated, event_id % 31 = 0 AS wrong FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN run IS NULL THEN 'invalid' WHEN wrong THEN 'hash_mismatch' WHEN event_id % 29 = 0 THEN 'ahead_of_time' ELSE '' END AS bad FROM t),
steps AS (
  SELECT user_id, 0 AS n, NULL::BIGINT AS event_id, '' AS state, NULL::TIMESTAMP AS cur_at, NULL::VARCHAR AS cur_run, NULL::VARCHAR AS cur_hash, MAP {}::MAP(VARCHAR, VARCHAR) AS settled FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, event_id, state, CASE WHEN state = 'accepted' THEN generated ELSE cur_at END, CASE WHEN state = 'accepted' THEN run ELSE cur_run END, CASE WHEN state = 'accepted' THEN digest ELSE cur_hash END,
    CASE WHEN state = 'accepted' THEN map_concat(settled, MAP {run: digest}) ELSE settled END
  FROM (SELECT o.*, s.cur_at, s.cur_run, s.cur_hash, s.settled, CASE WHEN bad <> '' THEN bad WHEN coalesce(settled[run], digest) <> digest THEN 'run_conflict' WHEN cur_run = run AND cur_hash = digest THEN 'idempotent' WHEN generated < cur_at THEN 'older'
      WHEN generated = cur_at AND digest <> cur_hash THEN 'same_time_conflict' ELSE 'accepted' END AS state FROM steps s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))
"""


def _attempts(t: Tables) -> DataFrame:
    e = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    text = _text('{ "value" : ', F.floor(e / 100) % 3, ', "runId": "r', e % 7, '" }')
    generated = F.when(e % 29 == 0, ts + F.expr("INTERVAL 10 MINUTES")).otherwise(F.date_trunc("day", ts) - F.make_dt_interval(days=(e % 3).cast("int")))
    return t.events.select("event_id", "user_id", ts.alias("ts"), F.when(e % 41 > 0, _text("r", e % 7)).alias("run"), publication.content_hash(text).alias("digest"), generated.alias("generated"), F.when(e % 31 == 0, "0" * 64).alias("expected"))


def _states(t: Tables) -> DataFrame:
    return publication.published(_attempts(t), ["user_id"], "run", "digest", "generated", "ts", ["event_id"], "expected")


@query("snk15_publications", f"WITH RECURSIVE {_ATTEMPTS} SELECT event_id, state, cur_run AS current_run FROM steps WHERE n > 0")
def snk15(t: Tables) -> DataFrame:
    """Events as attempts to publish; a user is a series."""
    return _states(t).select("event_id", "state", "current_run")


@query("snk16_receipts", f"WITH RECURSIVE {_ATTEMPTS} SELECT user_id, run, min(digest) AS digest, count(*) AS publications FROM steps JOIN o USING (user_id, n) WHERE state IN ('accepted', 'idempotent') GROUP BY user_id, run")
def snk16(t: Tables) -> DataFrame:
    return publication.receipts(_states(t), ["user_id"], "run", "digest", "ts").select("user_id", "run", "digest", "publications")


@query(
    "str14_publication_state",
    f"""WITH RECURSIVE {_ATTEMPTS}, p AS (SELECT user_id, n, state, run, digest, ts FROM steps JOIN o USING (user_id, n) WHERE n > 0),
    c AS (SELECT user_id, run AS crun, digest AS cdigest, ts AS cts FROM p WHERE state = 'accepted' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1),
    r AS (SELECT user_id, run, min(digest) AS rdigest, min(ts) AS rts FROM p WHERE state IN ('accepted', 'idempotent') GROUP BY user_id, run)
    SELECT event_id, CASE WHEN crun = run AND cdigest = digest THEN 'current' WHEN rdigest = digest AND cts > rts THEN 'superseded' ELSE 'missing' END AS publication, CASE WHEN NOT coalesce(crun = run AND cdigest = digest, false) AND rdigest = digest AND cts > rts THEN crun END AS superseded_by
    FROM o LEFT JOIN c USING (user_id) LEFT JOIN r USING (user_id, run)""",
)
def str14(t: Tables) -> DataFrame:
    """For every attempt, whether what it sent is shown, was, or never was."""
    states = _states(t)
    current = publication.current_publications(states, ["user_id"], "ts", ["event_id"])
    told = publication.publication_state(_attempts(t), publication.receipts(states, ["user_id"], "run", "digest", "ts"), current, ["user_id"], "run", "digest", "ts")
    return told.select("event_id", "publication", "superseded_by")
