"""Benchmarks, valuations and verdict gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwatch.functions.money import cents

# Preference of evidence (less is better), age at which it is stale, samples that a median needs.
SOURCE_RANK = {"ebay-sold": 0, "pricecharting": 1, "retail": 2, "manual": 3, "peer-listings": 4, "editorial": 5, "lot-ceiling": 6}
STALE_DAYS, PEERS, LOW_SAMPLES = 180, 4, 5


def peer_median(df: DataFrame, keys: Sequence[str], price: Column, least: int = PEERS) -> DataFrame:
    """Median of the positive prices of each group with enough of them: benchmark and samples."""
    return df.filter(price > 0).groupBy(*keys).agg(cents(F.median(price)).alias("benchmark"), F.count(price).alias("samples")).filter(F.col("samples") >= least)


def low_quartile(df: DataFrame, keys: Sequence[str], price: Column, least: int = LOW_SAMPLES) -> DataFrame:
    """The price at place n // 4 of each group's sorted prices, not interpolated; groups with enough samples.

    By row_number, so that a large group is sorted with spilling and never gathered into one array.
    """
    x = df.filter(price.isNotNull()).select(*keys, price.alias("_p"))
    sized = x.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return sized.filter((F.col("_n") >= least) & (F.col("_rn") == F.floor(F.col("_n") / 4) + 1)).select(*keys, F.col("_p").alias("low"), F.col("_n").alias("samples"))


def lot_valuation(pieces: DataFrame, keys: Sequence[str], value: Column, factor: Column, useful: Column, cost: str) -> DataFrame:
    """Per lot: pieces, priced ones, their value, the useful ones' value, cost per useful piece, and discount."""
    worth = value * factor
    out = pieces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pieces"), F.count(value).alias("priced"), cents(F.sum(worth)).alias("lot_value"), F.count_if(useful).alias("useful"),
        cents(F.sum(F.when(useful, worth))).alias("useful_value"), F.max(cost).alias("cost"),
    )
    return out.withColumn("cost_per_useful", cents(F.try_divide("cost", "useful"))).withColumn("discount", cents(1 - F.try_divide(F.col("cost"), F.col("lot_value")), 4))


def pick_benchmark(references: DataFrame, keys: Sequence[str], today: Column, tie: str) -> DataFrame:
    """Each key's best reference: independent first, then fresh, then by source, then by confidence."""
    ranks = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    stale = F.coalesce(F.datediff(today, F.col("observed_at")) > STALE_DAYS, F.lit(True))
    w = Window.partitionBy(*keys).orderBy(F.col("independent").desc(), stale, F.coalesce(F.element_at(ranks, F.col("source")), F.lit(99)), F.col("confidence").desc(), tie)
    return references.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
