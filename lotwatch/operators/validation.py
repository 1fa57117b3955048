"""Validation of JSON documents by tables of rules: every error of a document, with its path and a typed reason.

A document is a VARIANT. A rule looks at one path; rules for the items of a list are applied to each of them, and their
paths carry the item's place. A table compiles to one expression that gives an array of (path, code, message) in the
order of the rules, empty for a sound document. Text that isn't JSON at all is one error of the whole document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions.folding import let

ERRORS = "array<struct<path: string, code: string, message: string>>"
Test = Callable[[Column], Column]


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, VOID for JSON's null, or a scalar's type; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant") if path else v


def text(v: Column) -> Column:
    """A scalar as trimmed text; null where there is nothing, JSON's null, a list or an object."""
    return F.trim(F.when(~kind(v).isin("OBJECT", "ARRAY", "VOID"), F.try_variant_get(v, "$", "string")))


def is_true(v: Column) -> Column:
    """JSON's true; a text that says so isn't."""
    return F.coalesce((kind(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def items(v: Column) -> Column:
    """A list's items, none for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def given(v: Column) -> Column:
    """Is there a value that counts: not missing, null, false, zero or the empty text?"""
    return F.coalesce(kind(v).isin("OBJECT", "ARRAY") | ~F.coalesce(text(v), F.lit("")).isin("", "0", "false"), F.lit(False))


# Tests, true where the value is sound ------------------------------------------------------------------------------


def required(v: Column) -> Column:
    return F.coalesce(text(v) != "", F.lit(False)) | F.coalesce(kind(v).isin("OBJECT", "ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v) == "ARRAY", F.lit(False))


def of_objects(v: Column) -> Column:
    return is_list(v) & F.forall(items(v), is_object)


def missing_or(test: Test) -> Test:
    return lambda v: v.isNull() | test(v)


def null_or(test: Test) -> Test:
    return lambda v: v.isNull() | F.coalesce(kind(v) == "VOID", F.lit(False)) | test(v)


def one_of(*values: str, lower: bool = False) -> Test:
    return lambda v: F.coalesce((F.lower(text(v)) if lower else text(v)).isin(*values), F.lit(False))


def unless_given(test: Test) -> Test:
    return lambda v: ~given(v) | test(v)


def number(value: int) -> Test:
    return lambda v: F.coalesce(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (F.try_variant_get(v, "$", "double") == value), F.lit(False))


def list_of(*values: str) -> Test:
    return lambda v: is_list(v) & F.forall(items(v), lambda x: F.coalesce((kind(x) == "STRING") & text(x).isin(*values), F.lit(False)))


def instant(v: Column) -> Column:
    """The time that a text names, with its zone or UTC; null for none."""
    t = text(v)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))


@dataclass(frozen=True)
class Rule:
    path: str
    code: str
    message: str
    sound: Test


@dataclass(frozen=True)
class Each:
    """Rules for each item of the list at a path."""

    path: str
    rules: Sequence[Rule] = field(default=())


def _errors(v: Column, rules: Sequence[Rule], prefix: Column) -> Column:
    own = [F.when(~r.sound(at(v, r.path)), F.struct(F.concat(prefix, F.lit(r.path)).alias("path"), F.lit(r.code).alias("code"), F.lit(r.message).alias("message"))) for r in rules]
    return F.filter(F.array(*own), lambda e: e.isNotNull()).cast(ERRORS)


def errors(document: Column, rules: Sequence[Rule | Each], whole: tuple[str, str] = ("invalid_shape", "not an object")) -> Column:
    """All errors of a VARIANT document, in the order of the rules; one alone if it is no object."""

    def found(v: Column) -> Column:
        parts, flat = [], []
        for r in rules:
            if isinstance(r, Rule):
                flat.append(r)
                continue
            if flat:
                parts.append(_errors(v, flat, F.lit("")))
            each = F.transform(items(at(v, r.path)), lambda x, i: _errors(x, r.rules, F.concat(F.lit(f"{r.path}["), i.cast("string"), F.lit("]."))))  # noqa: B023
            parts.append(F.flatten(each).cast(ERRORS))
            flat = []
        return F.concat(*parts, _errors(v, flat, F.lit(""))) if flat else F.concat(*parts)

    alone = F.array(F.struct(F.lit("").alias("path"), F.lit(whole[0]).alias("code"), F.lit(whole[1]).alias("message"))).cast(ERRORS)
    return F.when(is_object(document), let(document, found)).otherwise(alone)


# Snapshots ---------------------------------------------------------------------------------------------------------

# States of a scan and of its publication, older names of them, and the age at which a snapshot is stale.
SCAN_STATES, SYNC_STATES = ("success", "partial", "failed"), ("current", "stale")
OLD_STATES = {"partial_failure": "partial", "failure": "failed"}
STALE_SECONDS = 36 * 3600


def scan_status(v: Column) -> Column:
    reported = F.lower(F.coalesce(F.nullif(text(at(v, "scanStatus")), F.lit("")), text(at(v, "status")), F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OLD_STATES.items() for x in kv]), reported), reported)


def run_id(v: Column) -> Column:
    return F.coalesce(F.nullif(text(at(v, "runId")), F.lit("")), text(at(v, "sync.runId")), F.lit(""))


def _same_run(v: Column) -> Column:
    own = F.coalesce(text(at(v, "sync.runId")), F.lit(""))
    return (own == "") | (own == run_id(v))


def _same_time(v: Column) -> Column:
    own = at(v, "sync.generatedAt")
    return (F.coalesce(text(own), F.lit("")) == "") | instant(own).eqNullSafe(instant(at(v, "generatedAt")))


def _available(v: Column) -> Column:
    return (F.coalesce(F.lower(text(at(v, "sync.status"))), F.lit("")) != "unavailable") & (scan_status(v) != "unavailable")


#: In this order: the first reason is the one that a reader is given.
SNAPSHOT = (
    Rule("matches", "invalid_matches", "Falta la lista de oportunidades.", is_list),
    Rule("matches", "invalid_match_item", "Una oportunidad tiene un formato inválido.", lambda v: ~is_list(v) | of_objects(v)),
    Rule("featured", "invalid_featured", "El destacado tiene un formato inválido.", null_or(is_object)),
    Rule("", "unavailable", "Todavía no hay un snapshot publicado.", _available),
    Rule("", "invalid_scan_status", "Falta el estado de la corrida.", lambda v: scan_status(v).isin(*SCAN_STATES, "unavailable")),
    Rule("generatedAt", "invalid_generated_at", "Falta una fecha de generación válida.", lambda v: instant(v).isNotNull()),
    Rule("", "invalid_run_id", "Falta el identificador de corrida.", lambda v: run_id(v) != ""),
    Rule("sync.status", "invalid_sync_status", "Estado de sincronización inválido.", lambda v: F.coalesce(F.lower(text(v)), F.lit("")).isin("", "unavailable", *SYNC_STATES)),
    Rule("", "run_id_mismatch", "El snapshot y su recibo no pertenecen a la misma corrida.", _same_run),
    Rule("", "generated_at_mismatch", "La fecha del snapshot no coincide con su recibo.", _same_time),
)


def snapshot_candidate(document: Column, now: Column, stale_seconds: int = STALE_SECONDS) -> Column:
    """Struct of a snapshot's errors and, where it is sound, what a choice between several looks at."""

    def read(v: Column) -> Column:
        status, sync = scan_status(v), F.coalesce(F.lower(text(at(v, "sync.status"))), F.lit(""))
        generated = instant(at(v, "generatedAt"))
        reported = F.try_variant_get(v, "$.sync.ageSeconds", "double")
        age = F.when(reported >= 0, reported).otherwise(F.greatest(F.lit(0.0), F.floor(F.unix_micros(now) / 1e6 - F.unix_micros(generated) / 1e6).cast("double")))
        some = given(at(v, "featured")) | (F.size(items(at(v, "matches"))) > 0)
        return F.struct(
            errors(v, SNAPSHOT).alias("errors"), status.alias("scan_status"), generated.alias("generated_at"), run_id(v).alias("run_id"),
            F.coalesce(F.nullif(text(at(v, "sync.snapshotHash")), F.lit("")), text(at(v, "snapshotHash")), F.lit("")).alias("snapshot_hash"),
            age.alias("age_seconds"), ((sync == "stale") | ((sync == "") & (age > stale_seconds))).alias("stale"),
            ((status == "partial") | (F.size(items(at(v, "issues"))) > 0)).alias("partial"), (status == "failed").alias("failed"), some.alias("has_items"),
        )

    return let(document, read)


def chosen_snapshot(candidates: DataFrame, keys: Sequence[str], kind_column: str, candidate: str) -> DataFrame:
    """For each key the snapshot to show: the server's if it is sound, else that of the run, else the one kept in files.

    keys, origin, status (ready, empty, degraded, stale, or unavailable without a sound one), divergence (how the server's
    differs from what would stand in for it: snapshot_hash, run_id, generated_at, or nothing), run_id and reasons (the first
    of each that isn't sound, as kind:code). A fallback, a partial or failed scan, or a newer fallback that differs is degraded.
    """
    c = F.col(candidate)
    sound = F.size(c["errors"]) == 0
    of = lambda name: F.max(F.when((F.col(kind_column) == name) & sound, F.struct(c["generated_at"], c["run_id"], c["snapshot_hash"], c["stale"], c["partial"], c["failed"], c["has_items"]))).alias(f"_{name}")
    refused = F.array_sort(F.collect_set(F.when(~sound, F.concat(F.col(kind_column), F.lit(":"), F.get(c["errors"], 0)["code"])))).alias("reasons")
    x = candidates.groupBy(*keys).agg(of("server"), of("runtime"), of("static"), refused)
    x = x.withColumn("_fallback", F.coalesce("_runtime", "_static")).withColumn("_chosen", F.coalesce("_server", "_fallback"))
    origin = F.when(F.col("_server").isNotNull(), "server").when(F.col("_runtime").isNotNull(), "runtime").when(F.col("_static").isNotNull(), "static")
    s, f = F.col("_server"), F.col("_fallback")
    hashed = (s["snapshot_hash"] != "") & (f["snapshot_hash"] != "")
    differs = F.when(hashed, F.when(s["snapshot_hash"] != f["snapshot_hash"], "snapshot_hash").otherwise("")).when(s["run_id"] != f["run_id"], "run_id").when(s["generated_at"] != f["generated_at"], "generated_at").otherwise("")
    x = x.withColumn("divergence", F.when(s.isNotNull() & f.isNotNull(), differs).otherwise("")).withColumn("origin", origin)
    d = F.col("_chosen")
    newer = F.coalesce((F.col("divergence") != "") & (f["generated_at"] > s["generated_at"]), F.lit(False))
    degraded = d["partial"] | d["failed"] | (F.col("origin") != "server") | newer
    status = F.when(d.isNull(), "unavailable").when(d["stale"], "stale").when(degraded, "degraded").when(d["has_items"], "ready").otherwise("empty")
    return x.select(*keys, "origin", status.alias("status"), "divergence", d["run_id"].alias("run_id"), "reasons")


# Manifests of imports ----------------------------------------------------------------------------------------------

# What an import's manifest may say.
OWNERSHIP = ("none", "physical", "digital", "both")
DIGITAL_ORIGINS = ("purchased", "ps_plus_claimed", "subscription", "free_to_play", "unknown")
CLASSIFICATIONS = ("pending", "inferred", "verified")
PHOTO_ROLES = ("principal", "frontal", "trasera", "etiqueta", "accesorios", "contenido", "estado_cosmetico")


def _must(path: str, message: str = "") -> Rule:
    return Rule(path, "required", message or f"{path} es obligatorio.", required)


def _may(path: str, *values: str) -> Rule:
    return Rule(path, "unknown_value", f"{path} no es válido.", unless_given(one_of(*values)))


MANIFEST = (
    Rule("schemaVersion", "schema_version", "schemaVersion debe ser 1.", number(1)), _must("importId", "El identificador de lote es obligatorio."), _must("consoleId"),
    *[Rule(c, "not_a_list", "Debe ser un array.", missing_or(is_list)) for c in ("games", "accessories", "photos")],
    Each("games", (
        _must("clientRef"), _must("title"), _may("ownershipType", *OWNERSHIP), _may("digitalOrigin", *DIGITAL_ORIGINS), _may("classificationStatus", *CLASSIFICATIONS),
        Rule("entitledPlatforms", "unknown_value", "entitledPlatforms sólo admite PS4 y PS5.", unless_given(list_of("PS4", "PS5"))),
    )),
    Each("accessories", (_must("clientRef"), _must("name"), _may("completeness", "complete", "incomplete", "unknown"))),
    Each("photos", (_must("clientRef"), _must("fileName"), Rule("entityType", "unknown_value", "entityType debe ser console, game o accessory.", one_of("console", "game", "accessory")), _must("entityId"), _may("role", *PHOTO_ROLES))),
)


# Lifecycle payloads ------------------------------------------------------------------------------------------------

HEALTH = ("success", "partial", "failed", "unknown")
LIFECYCLE_VERSION, MOST_KEYS = 1, 10_000


def _source(v: Column) -> Column:
    return F.coalesce(F.lower(text(v)), F.lit(""))


def _source_sound(v: Column) -> Column:
    s = _source(v)
    return (s != "") & (F.char_length(s) <= 64) & ~s.rlike(r"[^\p{L}\p{N}_-]")


def _lot_sound(v: Column) -> Column:
    t = F.coalesce(text(v), F.lit(""))
    return (t != "") & (F.char_length(t) <= 256)


def _health_entries(v: Column) -> Column:
    return F.map_entries(F.coalesce(F.try_variant_get(v, "$", "map<string, variant>"), F.create_map().cast("map<string, variant>")))


def health_status(v: Column) -> Column:
    """What a source reports: an object's status, or a bare text as older publishers wrote it."""
    return F.coalesce(F.lower(text(F.when(is_object(v), at(v, "status")).otherwise(v))), F.lit(""))


LIFECYCLE = (
    Rule("publicationLifecycle.activeKeys", "invalid_keys", "activeKeys must be a list of at most 10000", lambda v: is_list(v) & (F.size(items(v)) <= MOST_KEYS)),
    Rule("publicationLifecycle.sourceHealth", "invalid_health", "sourceHealth must be an object", is_object),
    Each("publicationLifecycle.activeKeys", (Rule("", "key_not_an_object", "a key must be an object", is_object), Rule("sourceId", "source_id", "sourceId is invalid", _source_sound), Rule("lotId", "lot_id", "lotId is required", _lot_sound))),
    Rule("publicationLifecycle.sourceHealth", "source_status", "a source's status is unknown", lambda v: F.forall(_health_entries(v), lambda e: health_status(e["value"]).isin(*HEALTH))),
)


def lifecycle_payload(document: Column) -> Column:
    """Struct of applies (a lifecycle of this version), errors, keys (array of source_id and lot_id, distinct) and health (map of source to status and authority).

    Older publishers' bare statuses never have authority over an inventory.
    """

    def read(v: Column) -> Column:
        own = at(v, "publicationLifecycle")
        applies = is_object(own) & number(LIFECYCLE_VERSION)(at(own, "version"))
        keys = F.transform(items(at(own, "activeKeys")), lambda k: F.struct(_source(at(k, "sourceId")).alias("source_id"), F.coalesce(text(at(k, "lotId")), F.lit("")).alias("lot_id")))
        health = F.transform(_health_entries(at(own, "sourceHealth")), lambda e: F.struct(
            F.lower(F.trim(e["key"])).alias("source_id"), health_status(e["value"]).alias("status"), (is_object(e["value"]) & is_true(at(e["value"], "inventoryAuthoritative"))).alias("authoritative"),
        ))
        return F.struct(applies.alias("applies"), F.when(applies, errors(v, LIFECYCLE)).otherwise(F.array().cast(ERRORS)).alias("errors"), F.array_distinct(keys).alias("keys"), health.alias("health"))

    return let(document, read)


def match_images(document: Column) -> Column:
    """The images of active matches: array of source_id, lot_id and image_url, of those with a public address; one bad address costs only itself."""
    from lotwatch.sources.listings import public_url

    entry = lambda m: F.struct(_source(at(m, "sourceId")).alias("source_id"), F.coalesce(text(at(m, "lotId")), F.lit("")).alias("lot_id"), F.substring(public_url(F.coalesce(F.nullif(text(at(m, "imageUrl")), F.lit("")), text(at(m, "image_url")))), 1, 2048).alias("image_url"))
    return F.filter(F.transform(items(at(document, "activeMatchMetadata")), entry), lambda m: m["image_url"] != "")
