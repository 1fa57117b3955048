"""Registries of sources over runs: what a report proves, what stays known without proof, and rows of earlier runs judged by today's rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions import keywords as K
from lotwatch.functions.folding import let
from lotwatch.operators import match as M
from lotwatch.operators.rows import first_wins

RECEIPT_STATES = ("complete", "partial", "failed")


def whole_number(text: Column) -> Column:
    """A receipt's count: 0 for a blank one, null for what is no whole number."""
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(t == "", 0).otherwise(t.try_cast("long"))


def receipt_is_whole(group: Column, started: Column, finished: Column, status: Column, lots: Column, errors: Column) -> Column:
    """Has a receipt all that a proof needs: its group, both times, a known status, and counts that are none below 0?"""
    given = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""
    counted = F.coalesce((whole_number(lots) >= 0) & (whole_number(errors) >= 0), F.lit(False))
    return given(group) & given(started) & given(finished) & F.coalesce(F.lower(F.trim(status)).isin(*RECEIPT_STATES), F.lit(False)) & counted


def complete_groups(receipts: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Distinct groups with a whole receipt that is complete and without an error. receipts: by, group, started_at, finished_at, status, lots, errors."""
    whole = receipt_is_whole(F.col(group), F.col("started_at"), F.col("finished_at"), F.col("status"), F.col("lots"), F.col("errors"))
    return receipts.filter(whole & (F.lower(F.trim("status")) == "complete") & (whole_number(F.col("errors")) == 0)).select(*by, group).distinct()


def coverage(expected: DataFrame, receipts: DataFrame, steps: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """For each source: groups, complete, partial (those without proof), lots, and whether its inventory is authoritative.

    expected: by, group, the groups that discovery named; steps: by, discovery_proven, matches_status, matches_proven. A
    source has authority if discovery and matches do, matches succeeded or weren't needed, and exactly the groups that
    discovery named were asked, each with a complete receipt. Groups that only receipts name are unexpected: no authority.
    """
    asked = receipts.groupBy(*by, group).agg(F.sum(F.coalesce(whole_number(F.col("lots")), F.lit(0))).alias("_lots"))
    named = expected.select(*by, group).distinct().withColumn("_named", F.lit(True))
    proof = complete_groups(receipts, by, group).withColumn("_complete", F.lit(True))
    each = named.join(asked, [*by, group], "full").join(proof, [*by, group], "left")
    done, known = F.coalesce("_complete", F.lit(False)), F.coalesce("_named", F.lit(False))
    sums = each.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.count_if(done & known).alias("complete"), F.count_if(known & ~done).alias("partial"), F.count_if(~known).alias("unexpected"), F.sum(F.coalesce("_lots", F.lit(0))).alias("lots"))
    x = steps.join(sums, list(by), "left").fillna(0, ["groups", "complete", "partial", "unexpected", "lots"])
    proven = F.coalesce("discovery_proven", F.lit(False)) & F.coalesce("matches_proven", F.lit(False)) & F.coalesce(F.col("matches_status").isin("success", "skipped"), F.lit(False))
    return x.select(*by, "groups", "complete", "partial", "unexpected", "lots", (proven & (F.col("partial") == 0) & (F.col("unexpected") == 0)).alias("authoritative"))


def coverage_total(covered: DataFrame) -> DataFrame:
    """One row over all sources: their sums, and authority if every one has it; no source has none."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("groups", "complete", "partial", "unexpected", "lots")]
    return covered.agg(F.count(F.lit(1)).alias("sources"), *sums, F.coalesce(F.bool_and("authoritative"), F.lit(False)).alias("authoritative"))


def reconciled_registry(previous: DataFrame, current: DataFrame, statuses: DataFrame, source: str, key: str, order: str, report_is_valid: bool = True) -> DataFrame:
    """Rows after a run over registered sources, with `origin`: current or previous.

    A source that reports success and authority is replaced by what it gave; others keep what they had beside it, the
    current row of a key winning. A valid report names all registered sources: what it leaves out was taken away and
    keeps only what the run gave. Without a valid report nothing is dropped. Of several rows of a key, and of several
    reports of a source, the last by `order` counts. Both sides have equal columns; keys aren't null.
    """
    values = [c for c in previous.columns if c not in (source, key)]
    last = lambda df, name: df.groupBy(source, key).agg(F.max_by(F.struct(*values), order).alias(name))
    sure = (F.lower(F.trim("status")) == "success") & F.coalesce("authoritative", F.lit(False))
    told = statuses.groupBy(source).agg(F.max_by(F.coalesce(sure, F.lit(False)), order).alias("_sure"))
    both = last(previous, "_p").join(last(current, "_c"), [source, key], "full").join(told, source, "left")
    dropped = F.when(F.col("_sure").isNull(), F.lit(report_is_valid)).otherwise(F.col("_sure"))
    kept = both.filter(F.col("_c").isNotNull() | ~dropped)
    row = F.coalesce("_c", "_p")
    return kept.select(source, key, *[row[v].alias(v) for v in values], F.when(F.col("_c").isNotNull(), "current").otherwise("previous").alias("origin"))


def rescored(rows: DataFrame, description: str, value: str, bids: str, terms: Sequence[str] = M.SEARCHED, rules: Sequence[M.Rule] = M.RULES, risks: Sequence[str] = K.RISK, merits: Sequence[str] = K.POSITIVE, **scores) -> DataFrame:
    """Cached rows by today's rules: hits, risk_flags, positive_flags and score anew; rows that no longer match are left out.

    Rows without a description stay as they are, with what they had in these columns. Distinct descriptions are read once.
    """
    text = F.trim(F.coalesce(F.col(description), F.lit("")))
    read = rows.select(text.alias("_text")).filter("_text <> ''").distinct()
    read = read.select("_text", M.keyword_hits(F.col("_text"), terms, rules).alias("_hits"), M.flags(F.col("_text"), risks).alias("_risks"), M.flags(F.col("_text"), merits).alias("_merits"))
    x = rows.withColumn("_text", text).join(read, "_text", "left")
    blank = F.col("_text") == ""
    score = M.match_score(F.col("_hits"), F.col("_risks"), F.col("_merits"), F.col(value), F.col(bids), **scores)
    listed = lambda c: F.array_join(c, ", ")
    new = {"matched_keywords": listed("_hits"), "risk_flags": listed("_risks"), "positive_flags": listed("_merits"), "score": score}
    kept = x.filter(blank | (F.size("_hits") > 0))
    return kept.withColumns({c: F.when(blank, F.col(c)).otherwise(v) for c, v in new.items()}).select(*rows.columns)


def cached_rows(rows: DataFrame, processed: DataFrame, pending: DataFrame, group: str, run: str, newest: str, exclude: Column | None = None) -> DataFrame:
    """Rows of earlier runs for pending groups: each group's from the newest run that processed it, and only from there.

    A run that processed a group and has no row of it proves that there is none. processed: run, newest (when), group.
    """
    seen = processed if exclude is None else processed.filter(~F.col(run).eqNullSafe(exclude))
    chosen = seen.join(pending.select(group).distinct(), group, "left_semi")
    w = Window.partitionBy(group).orderBy(F.col(newest).desc(), F.col(run).desc())
    chosen = chosen.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(group, run)
    return rows.join(chosen, [group, run], "left_semi")


def merged_with_cache(current: DataFrame, cached: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Current rows first, then cached ones whose keys they don't have."""
    both = current.withColumn("_age", F.lit(0)).unionByName(cached.withColumn("_age", F.lit(1)))
    return first_wins(both, keys, "_age", *order).drop("_age")


def latest_matchful(runs: DataFrame, run: str, newest: str, counts: Sequence[str], exclude: Column | None = None) -> DataFrame:
    """The newest run that has any match in these counts; one row, or none."""
    seen = runs if exclude is None else runs.filter(~F.col(run).eqNullSafe(exclude))
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0))
    return seen.filter(total > 0).orderBy(F.col(newest).desc(), F.col(run).desc()).limit(1)


def discovery_status(exit_code: Column, reported: Column, ids: Column) -> Column:
    """Struct of status and proven for a discovery: an exit of 0 alone proves nothing, the count in its log has to be that of the distinct ids."""
    found = F.size(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.trim(i) != "")))

    def told(n: Column) -> Column:
        equal = F.coalesce(reported == n, F.lit(False))
        status = F.when(F.coalesce(exit_code, F.lit(1)) != 0, "failed").when(equal, "success").otherwise("partial")
        return F.struct(status.alias("status"), (status == "success").alias("proven"))

    return let(found, told)
