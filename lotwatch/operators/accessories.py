"""Accessories of consoles: what a catalog lists, what is kept of each, and old free-text entries, reconciled one to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.folding import normalize
from lotwatch.operators.reconcile import grams
from lotwatch.operators.titles import containments

#: Where entries that nothing listed stand, and how far apart.
ADOPTED_ORDER, ADOPTED_STEP = 900, 10


def alias_keys(accessory_id: Column, name: Column, aliases: dict[str, Sequence[str]] | None = None) -> Column:
    """The keys that an accessory goes by: its id, its normalised name, and all of each alias group that one of them is in."""
    own = F.filter(F.array(F.lower(F.trim(F.coalesce(accessory_id, F.lit("")))), normalize(name)), lambda k: k != "")
    groups = [F.when(F.arrays_overlap(own, F.array(*map(F.lit, (g, *names)))), F.array(*map(F.lit, (g, *names)))).otherwise(F.array().cast("array<string>")) for g, names in (aliases or {}).items()]
    return F.array_distinct(F.concat(own, *groups))


def _within(longer: DataFrame, shorter: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows of keys where a text of `longer` holds one of `shorter`: by, _long, _long_key; by, _short, _short_key.

    A text that holds another has all its three-letter pieces; pairs are reached through the rarest of these.
    """
    texts = longer.withColumn("_pieces", F.concat(grams(F.col("_long"), 1), grams(F.col("_long"), 2), grams(F.col("_long"), 3)))
    needles = shorter.withColumn("_needed", F.array_distinct(grams(F.col("_short"), 3)))
    return containments(texts, "_pieces", needles, "_needed", by).filter(F.contains("_long", "_short")).select(*by, *keys)


def legacy_matches(base: DataFrame, legacy: DataFrame, by: Sequence[str], base_key: str, base_name: str, base_order: str, entry: str, entry_order: str) -> DataFrame:
    """The old entry that each listed accessory takes: by, base_key, entry_order.

    In the order of the list each accessory takes the first entry not taken yet whose text holds its name or its id, or is
    held by its name. Orders are unique in a group. Candidate pairs of a group flow through one task in that order; it
    keeps which entries are taken, nothing else. Blank names and entries match nothing.
    """
    names = base.select(*by, base_key, F.col(base_order).alias("_b"), normalize(F.col(base_name)).alias("_name"), normalize(F.col(base_key).cast("string")).alias("_id"))
    entries = legacy.select(*by, F.col(entry_order).alias("_e"), normalize(F.col(entry)).alias("_entry")).filter("_entry <> ''")
    own = names.filter("_name <> ''")
    needles = names.select(*by, "_b", base_key, F.explode(F.array_distinct(F.filter(F.array("_name", "_id"), lambda x: x != ""))).alias("_short"))
    pair = [base_key, "_b", "_e"]
    first = _within(entries.withColumnRenamed("_entry", "_long"), needles, by, pair)
    # An accessory without a name is held by no entry, but its id may be.
    second = _within(own.select(*by, base_key, "_b", F.col("_name").alias("_long")), entries.withColumnRenamed("_entry", "_short"), by, pair)
    pairs = first.unionByName(second).distinct().repartition(*by).sortWithinPartitions(*by, "_b", "_e")

    def walk(batches):
        import pyarrow as pa

        group, taken, done = None, set(), None
        for batch in batches:
            keep = []
            for key, b, e in zip(zip(*(batch[c].to_pylist() for c in by)), batch["_b"].to_pylist(), batch["_e"].to_pylist()):
                if key != group:
                    group, taken, done = key, set(), None
                fits = b != done and e not in taken
                if fits:
                    taken.add(e)
                    done = b
                keep.append(fits)
            yield batch.filter(pa.array(keep, pa.bool_()))

    matched = pairs.mapInArrow(walk, pairs.schema)
    return matched.select(*by, base_key, F.col("_e").alias(entry_order))


def quantity(entry: Column) -> Column:
    """The first number of an entry, 1 at least."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_extract(entry, r"(\d{1,9})", 1).try_cast("int"), F.lit(1)))


def _last(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias(name))


def reconciled(base: DataFrame, current: DataFrame, legacy: DataFrame, by: Sequence[str], aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Every accessory of each group: listed ones with what is kept of them, hand-made ones, and entries that nothing took.

    base: by, id, name, image, place; current: by, id, name, image, owned, quantity, notes, source (manual or catalog),
    place; legacy: by, entry, place. A listed accessory takes what is kept under its id, else under its name (the last of
    several), else the first kept one from the catalog that shares an alias, else an old entry, which makes it owned in
    the entry's number. Gives by, id, name, image, owned, quantity, notes, found_by (id, name, alias, legacy, or null),
    origin (catalog, manual, legacy) and place, which is unique in a group.
    """
    # Compressed files look small enough to be sent to all, and many times their size would go through the driver.
    merged_with = lambda df: df.hint("merge")
    fields = ["id", "name", "image", "owned", "quantity", "notes", "source"]
    kept = current.withColumn("_name", normalize(F.col("name"))).withColumn("_source", F.coalesce("source", F.lit("catalog")))
    by_id = _last(kept.filter("id IS NOT NULL AND id <> ''"), [*by, "id"], "place", fields, "_by_id")
    by_name = _last(kept.filter("_name <> ''"), [*by, "_name"], "place", fields, "_by_name")
    listed = base.select(*by, "id", "name", "image", "place").withColumn("_name", normalize(F.col("name")))
    keyed = lambda df: df.withColumn("_alias", F.explode(alias_keys(F.col("id"), F.col("name"), aliases)))
    firsts = keyed(kept.filter("_source <> 'manual'")).groupBy(*by, "_alias").agg(F.min_by(F.struct("place", *fields), "place").alias("_kept"))
    by_alias = keyed(listed.select(*by, F.col("place").alias("_place"), "id", "name")).join(merged_with(firsts), [*by, "_alias"]).groupBy(*by, "_place").agg(F.min_by("_kept", "_kept.place").alias("_by_alias")).withColumnRenamed("_place", "place")
    x = listed.join(merged_with(by_id), [*by, "id"], "left").join(merged_with(by_name), [*by, "_name"], "left").join(merged_with(by_alias), [*by, "place"], "left")
    k = F.coalesce("_by_id", "_by_name", F.when(F.col("_by_alias").isNotNull(), F.struct(*[F.col(f"_by_alias.{f}").alias(f) for f in fields])))
    x = x.withColumn("_k", k).withColumn("found_by", F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_alias").isNotNull(), "alias"))
    old = legacy.select(*by, "entry", F.col("place").alias("_entry_place"))
    taken = legacy_matches(x.filter("_k IS NULL").select(*by, "id", "name", "place"), old, by, "id", "name", "place", "entry", "_entry_place").join(merged_with(old), [*by, "_entry_place"])
    x = x.join(merged_with(taken.select(*by, "id", "entry", F.lit(True).alias("_taken"))), [*by, "id"], "left")
    manual = F.col("_k.source") == "manual"
    own_image, kept_image = F.nullif(F.col("image"), F.lit("")), F.nullif(F.col("_k.image"), F.lit(""))
    merged = x.select(
        *by, F.coalesce("_k.id", "id").alias("id"), F.coalesce("_k.name", "name").alias("name"), F.coalesce(F.when(F.coalesce(manual, F.lit(False)), F.coalesce(kept_image, own_image)).otherwise(F.coalesce(own_image, kept_image)), F.lit("")).alias("image"),
        F.when(F.col("_k").isNotNull(), F.coalesce("_k.owned", F.lit(False))).otherwise(F.coalesce("_taken", F.lit(False))).alias("owned"),
        F.coalesce("_k.quantity", F.when(F.col("_taken"), quantity(F.col("entry"))), F.lit(0)).alias("quantity"), F.coalesce("_k.notes", F.lit("")).alias("notes"),
        F.coalesce("found_by", F.when(F.col("_taken"), "legacy")).alias("found_by"), F.lit("catalog").alias("origin"), F.col("place").cast("long").alias("place"), F.lit(0).alias("_part"),
    )
    # Hand-made ones, but for those that are listed by id or name.
    mine = kept.filter("_source = 'manual'").join(merged_with(listed.select(*by, "id").distinct()), [*by, "id"], "left_anti").join(merged_with(listed.filter("_name <> ''").select(*by, "_name").distinct()), [*by, "_name"], "left_anti")
    extras = mine.select(*by, "id", "name", F.coalesce("image", F.lit("")).alias("image"), F.coalesce("owned", F.lit(False)).alias("owned"), F.coalesce("quantity", F.lit(0)).alias("quantity"), F.coalesce("notes", F.lit("")).alias("notes"), F.lit(None).cast("string").alias("found_by"), F.lit("manual").alias("origin"), F.col("place").cast("long").alias("place"), F.lit(1).alias("_part"))
    left = old.join(merged_with(taken.select(*by, "_entry_place")), [*by, "_entry_place"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_entry_place"))
    slug = F.replace(normalize(F.col("entry")), F.lit(" "), F.lit("-"))
    adopted = left.withColumn("_nth", nth).select(
        *by, F.concat(F.lit("legacy-"), F.coalesce(F.nullif(slug, F.lit("")), F.concat(F.lit("item-"), F.col("_nth").cast("string")))).alias("id"), F.col("entry").alias("name"), F.lit("").alias("image"), F.lit(True).alias("owned"),
        quantity(F.col("entry")).alias("quantity"), F.lit("").alias("notes"), F.lit(None).cast("string").alias("found_by"), F.lit("legacy").alias("origin"), (F.lit(ADOPTED_ORDER) + ADOPTED_STEP * (F.col("_nth") - 1)).cast("long").alias("place"), F.lit(2).alias("_part"),
    )
    every = merged.unionByName(extras).unionByName(adopted)
    w = Window.partitionBy(*by).orderBy(F.col("owned").desc(), "_part", "place", "id")
    return every.withColumn("place", F.row_number().over(w)).drop("_part")
