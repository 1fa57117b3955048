"""Reconciling what was known with what a run saw. Only proven coverage may retire what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwatch.functions.text import fold_spaces


def reconcile(previous: DataFrame, current: DataFrame, receipts: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Rows after a run: `current` replaces `previous` in groups whose receipt is complete, and is merged elsewhere.

    receipts: (group, status). A group without one, or with one that is partial or failed, keeps the previous rows
    that the run didn't see. Adds `origin`: current or previous. Both sides have equal columns.
    """
    values = [c for c in previous.columns if c not in keys]
    p = previous.select(*keys, F.struct(*values).alias("_p"))
    c = current.select(*keys, F.struct(*values).alias("_c"))
    both = p.join(c, list(keys), "full").withColumn("_g", F.coalesce(F.col("_c"), F.col("_p"))[group] if group not in keys else F.col(group))
    proof = receipts.groupBy(F.col(group).alias("_g")).agg(F.bool_and(F.col("status") == "complete").alias("_complete"))
    both = both.join(proof, "_g", "left")
    keep = F.col("_c").isNotNull() | ~F.coalesce(F.col("_complete"), F.lit(False))
    row = F.coalesce("_c", "_p")
    return both.filter(keep).select(*keys, *[row[v].alias(v) for v in values], F.when(F.col("_c").isNotNull(), "current").otherwise("previous").alias("origin"))


def sets_equal(expected: DataFrame, received: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: missing, unexpected, and complete if there are none of either."""
    e, r = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), received.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = e.join(r, list(keys), "full")
    counts = both.agg(F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"))
    return counts.withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def expire_dismissals(dismissed: DataFrame, active: DataFrame, healthy: DataFrame, keys: Sequence[str], source: str, now: Column, hours: int = 48) -> DataFrame:
    """The state transition of dismissals, with `action`: clear, protect, start, wait or delete, and `missing_since`.

    An active lot clears its timer; a source that isn't healthy protects its lots; a missing lot of a healthy source
    starts the timer or, after so many hours, is deleted.
    """
    x = dismissed.join(active.select(*keys).distinct().withColumn("_a", F.lit(True)), list(keys), "left").join(healthy.select(source).distinct().withColumn("_h", F.lit(True)), source, "left")
    since = F.col("missing_since")
    action = (
        F.when(F.col("_a"), "clear").when(F.col("_h").isNull(), "protect").when(since.isNull(), "start")
        .when(F.unix_timestamp(now) - F.unix_timestamp(since) >= hours * 3600, "delete").otherwise("wait")
    )
    x = x.withColumn("action", action).drop("_a", "_h")
    return x.withColumn("missing_since", F.when(F.col("action").isin("clear", "protect"), None).when(F.col("action") == "start", now).otherwise(since))


def upsert_listings(known: DataFrame, seen: DataFrame, keys: Sequence[str], price: str, now: Column) -> DataFrame:
    """Known listings after a run: seen ones are inserted or overwritten.

    previous_price and price_changed_at move only if both prices are known and differ; first_seen_at stays.
    """
    values = [c for c in seen.columns if c not in keys]
    k = known.select(*keys, F.struct(*[c for c in known.columns if c not in keys]).alias("_k"))
    s = seen.select(*keys, F.struct(*values).alias("_s"))
    x = k.join(s, list(keys), "full")
    old, new = F.col(f"_k.{price}"), F.col(f"_s.{price}")
    moved = F.coalesce(old.isNotNull() & new.isNotNull() & (old != new), F.lit(False))
    fresh = F.col("_s").isNotNull()
    return x.select(
        *keys, *[F.when(fresh, F.col(f"_s.{v}")).otherwise(F.col(f"_k.{v}")).alias(v) for v in values],
        F.when(moved, old).otherwise(F.col("_k.previous_price")).alias("previous_price"), F.when(moved, now).otherwise(F.col("_k.price_changed_at")).alias("price_changed_at"),
        F.coalesce(F.col("_k.first_seen_at"), now).alias("first_seen_at"), F.when(fresh, now).otherwise(F.col("_k.last_seen_at")).alias("last_seen_at"),
    )


def deactivate(matches: DataFrame, matched: DataFrame, receipts: DataFrame, search: str, listing: str) -> DataFrame:
    """Matches of a search that a run didn't find become inactive if all its receipts prove the search was covered."""
    proof = receipts.groupBy(search).agg(F.bool_and("authoritative").alias("_proof"))
    found = matched.select(search, listing).distinct().withColumn("_found", F.lit(True))
    x = matches.join(found, [search, listing], "left").join(proof, search, "left")
    active = F.when(F.col("_found"), True).when(F.coalesce("_proof", F.lit(False)), False).otherwise(F.col("is_active"))
    return x.withColumn("is_active", active).drop("_found", "_proof")


def keep_if_empty(known: DataFrame, new: DataFrame, keys: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Upsert in which an empty new text doesn't overwrite a known one."""
    k = known.select(*keys, *[F.col(c).alias(f"_k_{c}") for c in text])
    return k.join(new, list(keys), "full").select(*keys, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_k_{c}"), F.lit("")).alias(c) for c in text])


def exclusive(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables after new rows of `second`: `first` loses the keys that `second` has."""
    return first.join(second.select(*keys), list(keys), "left_anti"), second


def purge_expired(listings: DataFrame, expires: str, now: Column) -> DataFrame:
    """Listings whose content may still be kept; an empty date means for ever."""
    return listings.filter(F.col(expires).isNull() | (F.col(expires) >= now))


def newest_kept(df: DataFrame, n: int, newest: Column, key: str, protected: DataFrame | None = None) -> DataFrame:
    """Retention: the n newest rows, and those that are protected."""
    keep = df.orderBy(newest.desc(), F.col(key).desc()).limit(n).select(key)
    if protected is not None:
        keep = keep.unionByName(protected.select(key)).distinct()
    return df.join(keep, key, "left_semi")


def grams(text: Column, n: int) -> Column:
    """The substrings of n characters; a shorter text itself."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))


def phrase_hits(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(_source, _want, _at): the least position of a text of the source that contains the phrase, both folded.

    A text that contains a phrase has each three letters in a row of it (or the whole of a shorter phrase): candidates
    are the texts that have those of the phrase that fewest texts of the source have. Of a text's pieces only those that
    some phrase of its source has are dealt out.
    """
    sizes = F.concat(F.array(F.lit("")), *[grams(F.col("_text"), n) for n in (1, 2, 3)])
    pieces = wanted.withColumn("_gram", F.explode(F.array_distinct(grams(F.col("_want"), 3))))
    dealt = texts.withColumn("_gram", F.explode(F.array_distinct(sizes))).join(pieces.select("_source", "_gram").distinct(), ["_source", "_gram"], "left_semi")
    counts = dealt.groupBy("_source", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = pieces.join(counts, ["_source", "_gram"], "left").groupBy("_source", "_want").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_least"))
    keyed = rarest.select("_source", "_want", F.col("_least._gram").alias("_gram"))
    return keyed.join(dealt, ["_source", "_gram"]).filter(F.contains("_text", "_want")).groupBy("_source", "_want").agg(F.min("_at").alias("_at"))


def watch_hits(watched: DataFrame, rows: DataFrame, watch_key: str, source: str, lot: str, url: str, phrase: str, description: str, position: str) -> DataFrame:
    """The first row of the same source that each watched item matches: by lot, by url, or by its phrase in the text.

    Rows are first reduced to the least position of each key (lot, url, folded text) of a source, and phrases to the
    distinct ones, so an item meets one row per key, however many rows and items a source has. A phrase matches
    wherever the folded text contains it, within words too; a blank one matches nothing.
    """
    item = watched.select(*[F.col(c).alias(n) for c, n in ((watch_key, "_item"), (source, "_source"), (lot, "_lot"), (url, "_url"), (phrase, "_phrase"))])
    row = rows.select(*[F.col(c).alias(n) for c, n in ((source, "_source"), (lot, "_lot"), (url, "_url"), (description, "_text"), (position, "_at"))])
    texts = row.groupBy("_source", "_text").agg(F.min("_at").alias("_at"))
    texts = texts.select("_source", fold_spaces(F.col("_text")).alias("_text"), "_at").groupBy("_source", "_text").agg(F.min("_at").alias("_at"))
    phrases = item.filter(F.col("_phrase").rlike(r"(?U)[^\s\x1c-\x1f]")).select("_source", "_phrase").distinct().withColumn("_want", fold_spaces(F.col("_phrase")))
    by_phrase = phrases.join(phrase_hits(phrases.select("_source", "_want").distinct(), texts), ["_source", "_want"])
    hits = None
    for k, (key, how) in enumerate([("_lot", "lot"), ("_url", "url"), ("_phrase", "phrase")]):
        first = by_phrase.select("_source", "_phrase", "_at") if key == "_phrase" else row.groupBy("_source", key).agg(F.min("_at").alias("_at"))
        x = item.select("_item", "_source", key).join(first, ["_source", key]).select("_item", "_at", F.lit(k).alias("_k"), F.lit(how).alias("how"))
        hits = x if hits is None else hits.unionByName(x)
    best = hits.groupBy("_item").agg(F.min(F.struct("_at", "_k", "how")).alias("_hit"))
    return best.select(F.col("_item").alias(watch_key), F.col("_hit._at").alias(position), F.col("_hit.how").alias("how"))
