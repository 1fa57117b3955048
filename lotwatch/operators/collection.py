"""Collection views: catalog patched by the user's edits, progress, inverted indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patched(base: DataFrame, edits: DataFrame, key: str, columns: Sequence[str], manual: DataFrame | None = None) -> DataFrame:
    """Base rows with what the edits say in place of each column that they fill; manual rows of new keys are added."""
    e = edits.select(key, *[F.col(c).alias(f"_e_{c}") for c in columns])
    out = base.join(e, key, "left").select(*[F.coalesce(f"_e_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
    if manual is None:
        return out
    return out.unionByName(manual.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def overridden(items: DataFrame, overrides: DataFrame, key: str, flags: Sequence[str], removed: str = "removed") -> DataFrame:
    """Items with the overrides' flags where these aren't null; items marked as removed are left out."""
    o = overrides.select(key, F.col(removed).alias("_removed"), *[F.col(f).alias(f"_o_{f}") for f in flags])
    out = items.join(o, key, "left").filter(~F.coalesce("_removed", F.lit(False)))
    return out.withColumns({f: F.coalesce(f"_o_{f}", f) for f in flags}).drop("_removed", *[f"_o_{f}" for f in flags])


def replaced(originals: DataFrame, enriched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Originals with enriched rows of the same key in their places, and the enriched ones of new keys."""
    values = [c for c in originals.columns if c not in keys]
    o, e = originals.select(*keys, F.struct(*values).alias("_o")), enriched.select(*keys, F.struct(*values).alias("_e"))
    row = F.coalesce("_e", "_o")
    return o.join(e, list(keys), "full").select(*keys, *[row[v].alias(v) for v in values])


def changed_only(base: DataFrame, current: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The current rows that differ from the base in one of these columns, or that it doesn't have."""
    b = base.select(key, F.struct(*columns).alias("_b"))
    return current.join(b, key, "left").filter(~F.struct(*columns).eqNullSafe(F.col("_b"))).drop("_b")


def merged_preserving(existing: DataFrame, candidate: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Existing rows with their gaps filled from candidates, and the conflicts: key, field, kept, offered."""
    c = candidate.select(key, *[F.col(x).alias(f"_c_{x}") for x in columns])
    both = existing.join(c, key, "left")
    filled = both.select(*[F.coalesce(x, f"_c_{x}").alias(x) if x in columns else F.col(x) for x in existing.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).cast("string").alias("kept"), F.col(f"_c_{x}").cast("string").alias("offered")) for x in columns])).alias("p")
    conflicts = both.select(key, pairs).select(key, "p.*").filter("kept IS NOT NULL AND offered IS NOT NULL AND kept <> offered")
    return filled, conflicts


def progress(df: DataFrame, keys: Sequence[str], owned: Column, counted: Column) -> DataFrame:
    """Per key: counted pieces, owned ones and the percentage, null where nothing counts."""
    out = df.groupBy(*keys).agg(F.count_if(counted).alias("total"), F.count_if(counted & owned).alias("owned"))
    return out.withColumn("percent", F.round(100 * F.try_divide("owned", "total"), 0).cast("int"))


def inverted_index(df: DataFrame, key: str, terms: Column, term: str = "term") -> DataFrame:
    """Per term the number of keys that hold it and the least of them; a key counts once per term."""
    x = df.select(key, F.explode(F.array_distinct(terms)).alias(term))
    return x.groupBy(term).agg(F.count(F.lit(1)).alias("keys"), F.min(key).alias("first_key"))
