"""Readers of CSV and JSON documents, and typed decoding of JSON columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """These columns of CSV files with a header, all as text; ones that the header lacks are null, no file is no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return found.select(*[F.col(f"`{c}`") if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns])


def has_column(spark: SparkSession, path: str, column: str) -> bool:
    """Does the files' header name this column? Only headers are read."""
    return exists(spark, path) and column in spark.read.option("header", True).csv(path).columns


#: Between the documents of a JSON text sequence (RFC 7464); no JSON text holds it.
RECORD = "\x1e"


def scan_json(spark: SparkSession, path: str, schema: str, sequence: bool = False) -> DataFrame:
    """A document per file, or files of many with RECORD between them; one that can't be read, or is of another shape, is no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    text = (spark.read.option("lineSep", RECORD) if sequence else spark.read.option("wholetext", True)).text(path)
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d")).filter(F.trim("value").startswith("{") & (F.size(F.json_object_keys("value")) > 0)).select("d.*")


def json_field(text: Column, kind: StructType | ArrayType, fallback: Column) -> Column:
    """A JSON column's value, or the fallback where it is missing, corrupt, or an array in place of an object or vice versa."""
    opens = "[" if isinstance(kind, ArrayType) else "{"
    whole = F.try_parse_json(text).isNotNull() & F.trim(text).startswith(opens)
    return F.when(whole, F.from_json(text, kind)).otherwise(fallback)


def canonical_json(entries: Column) -> Column:
    """A map as compact JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def stable_array(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def merged_maps(persisted: Column, legacy: Column) -> Column:
    """Both maps' entries; what is persisted wins."""
    return F.map_concat(F.map_filter(legacy, lambda k, _: ~F.map_contains_key(persisted, k)), persisted)


def catalog_games(catalog: DataFrame) -> DataFrame:
    """(console, game, title, place): the games of a catalog by console, in their order. catalog: byConsole map<string, struct<juegosCatalogo>>."""
    each = catalog.select(F.explode("byConsole").alias("console", "c"))
    games = each.select("console", F.posexplode("c.juegosCatalogo").alias("place", "g"))
    return games.select("console", F.col("g.id").alias("game"), F.col("g.title").alias("title"), "place")
