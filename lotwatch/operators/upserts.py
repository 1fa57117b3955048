"""Sinks as whole new tables: upserts whose columns keep, clear or follow, and rows that are replaced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(known: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str] = (), set_to: Mapping[str, Column] | None = None) -> DataFrame:
    """Known rows with new ones of the same keys in their places; `kept` columns stay as they were known.

    Both have the same columns. Columns of `set_to` get that value in every row that is new or overwritten.
    """
    values = [c for c in known.columns if c not in keys]
    k, n = known.select(*keys, F.struct(*values).alias("_k")), new.select(*keys, F.struct(*values).alias("_n"))
    both, written = k.join(n, list(keys), "full"), F.col("_n").isNotNull()

    def column(c: str) -> Column:
        fresh = (set_to or {}).get(c, F.col(f"_n.{c}"))
        fresh = F.when(F.col("_k").isNotNull(), F.col(f"_k.{c}")).otherwise(fresh) if c in kept else fresh
        return F.when(written, fresh).otherwise(F.col(f"_k.{c}")).alias(c)

    return both.select(*keys, *map(column, values))


def partial_update(known: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Preferences after changes: an absent field keeps its value, one that is given as null is cleared.

    changes: key, given (array of the fields' names) and the fields.
    """
    c = changes.select(key, F.col("given").alias("_given"), *[F.col(f).alias(f"_c_{f}") for f in fields])
    x = known.join(c, key, "left")
    return x.withColumns({f: F.when(F.array_contains("_given", f), F.col(f"_c_{f}")).otherwise(F.col(f)) for f in fields}).drop("_given", *[f"_c_{f}" for f in fields])


def replaced_or_appended(items: DataFrame, new: DataFrame, *matches: str) -> DataFrame:
    """A watch list with new items in place of those that share one of these keys with them; null and empty keys match none."""
    kept = items
    for m in matches:
        kept = kept.join(new.filter(F.col(m) != "").select(m), m, "left_anti").select(*items.columns)
    return kept.unionByName(new.select(*items.columns))
