"""Publication of snapshots by compare-and-set, folded over attempts in the order of their arrival.

A series holds one current publication. An attempt is accepted, repeats the current one, or is refused: for a hash that
isn't its content's, a time ahead of its arrival, a run that was published with other content, an older time than the
current one's, or the current one's time with other content. Whether an attempt is refused depends on those before it
in its series, so a series is one sorted run of rows: Spark deals series over tasks and sorts them with spilling, and
the fold keeps only the current publication and, of runs that came with different contents, the one that counts. Rows
flow through in Arrow batches; no series is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.folding import let

#: Seconds that an attempt's time may be ahead of its arrival.
AHEAD = 300
ACCEPTED, IDEMPOTENT = "accepted", "idempotent"
REFUSED = ("invalid", "hash_mismatch", "ahead_of_time", "run_conflict", "older", "same_time_conflict")


def canonical(document: Column) -> Column:
    """A JSON text in its one form: members in the order of their names, no white space; null if it can't be read."""
    return F.to_json(F.try_parse_json(document))


def content_hash(document: Column) -> Column:
    """SHA-256 of a document's one form."""
    return F.sha2(canonical(document), 256)


def _states(batches, keys: Sequence[str]):
    """Each row's state, given the rows before it in its series; rows come sorted by series and arrival."""
    import pyarrow as pa

    series, current, settled = None, None, {}
    for batch in batches:
        states, currents = [], []
        columns = [batch[c].to_pylist() for c in ("_ok", "_run", "_hash", "_at", "_shared")]
        for key, ok, run, digest, at, shared in zip(zip(*(batch[k].to_pylist() for k in keys)), *columns):
            if key != series:
                series, current, settled = key, None, {}
            if ok != "":
                state = ok
            elif settled.get(run, digest) != digest:
                state = "run_conflict"
            elif current and (current[1], current[2]) == (run, digest):
                state = IDEMPOTENT
            elif current and at < current[0]:
                state = "older"
            elif current and at == current[0] and digest != current[2]:
                state = "same_time_conflict"
            else:
                state, current = ACCEPTED, (at, run, digest)
                if shared:
                    settled[run] = digest
            states.append(state)
            currents.append(current[1] if current else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string()), pa.array(currents, pa.string())], names=[*batch.schema.names, "state", "current_run"])


def published(attempts: DataFrame, series: Sequence[str], run: str, digest: str, generated: str, arrival: str, order: Sequence[str], expected: str | None = None) -> DataFrame:
    """Every attempt with its state and the run that is current after it.

    Attempts of a series count in order of arrival and then of `order`, which makes it total. Nulls of run, digest or
    generated are invalid. `expected`: a column with the hash that the sender computed, if any.
    """
    bad = F.when(F.col(run).isNull() | (F.trim(run) == "") | F.col(digest).isNull() | F.col(generated).isNull(), "invalid")
    if expected is not None:
        bad = bad.when(F.col(expected).isNotNull() & (F.lower(F.trim(expected)) != F.col(digest)), "hash_mismatch")
    ok = F.coalesce(bad.when(F.unix_micros(generated) > F.unix_micros(arrival) + AHEAD * 1_000_000, "ahead_of_time"), F.lit(""))
    # Only runs that come with different contents can conflict; the fold remembers no others.
    w = Window.partitionBy(*series, run)
    x = attempts.withColumns({"_ok": ok, "_run": F.col(run).cast("string"), "_hash": F.col(digest), "_at": F.unix_micros(generated), "_shared": F.min(digest).over(w) != F.max(digest).over(w)})
    x = x.repartition(*series).sortWithinPartitions(*series, arrival, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)
    return x.mapInArrow(lambda b: _states(b, series), f"{schema}, state string, current_run string").drop("_ok", "_run", "_hash", "_at", "_shared")


def current_publications(states: DataFrame, series: Sequence[str], arrival: str, order: Sequence[str]) -> DataFrame:
    """The publication that each series shows: its last accepted attempt."""
    w = Window.partitionBy(*series).orderBy(F.col(arrival).desc(), *[F.col(c).desc() for c in order])
    return states.filter(F.col("state") == ACCEPTED).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def receipts(states: DataFrame, series: Sequence[str], run: str, digest: str, arrival: str) -> DataFrame:
    """A row for each run that was ever published: its content, when it was first and last accepted or repeated, how often."""
    held = states.filter(F.col("state").isin(ACCEPTED, IDEMPOTENT))
    return held.groupBy(*series, run).agg(F.min(digest).alias(digest), F.min(arrival).alias("accepted_at"), F.max(arrival).alias("recorded_at"), F.count(F.lit(1)).alias("publications"))


def publication_state(requests: DataFrame, published_receipts: DataFrame, current: DataFrame, series: Sequence[str], run: str, digest: str, arrival: str) -> DataFrame:
    """Requests that were published, with `publication`: current, superseded (and by which run) or missing.

    A request is superseded if a receipt has its run and content and what is current was accepted after it.
    """
    now = current.select(*series, F.struct(F.col(run).alias("run"), F.col(digest).alias("digest"), F.col(arrival).alias("at")).alias("_c"))
    past = published_receipts.select(*series, run, F.col(digest).alias("_digest"), "accepted_at")
    x = requests.join(now, list(series), "left").join(past, [*series, run], "left")

    def told(c: Column) -> Column:
        is_current = F.coalesce((c["run"] == F.col(run)) & (c["digest"] == F.col(digest)), F.lit(False))
        was = F.coalesce((F.col("_digest") == F.col(digest)) & (c["at"] > F.col("accepted_at")), F.lit(False))
        return F.struct(F.when(is_current, "current").when(was, "superseded").otherwise("missing").alias("publication"), F.when(was & ~is_current, c["run"]).alias("superseded_by"))

    x = x.withColumn("_told", let(F.col("_c"), told))
    return x.select(*requests.columns, "_told.*")
