"""Mixing sources to target weights: Efraimidis-Spirakis sampling, DataFrame functions only.

Every document gets the exponential key -ln(u) / w, u uniform by a hash of its id and w its quality weight.
Within a source the documents are taken in ascending key order until the source's token budget is met, which is
weighted sampling without replacement. Complete epochs come first: a target of 1.4 times the source's size takes
every document once and draws 0.4 of the source by key.

Prefix sums don't run over a whole source in one task: keys fall into `buckets` ranges per source, the ranges'
sums are accumulated, and only inside a range are rows sorted. A source with a third of all rows is so dealt over
as many groups as any other.

Edge cases: null text has size 0; size 0 takes 0 words; a null source is a source of its own, ordered last; null
ids hash like any value; repeated rows are separate rows that share a key, in an order that changes no result;
an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwatch.llm.common import materialize, pipeline_stage, table, with_row, word_count

#: Weights of the sources in code point order, repeating; the least weight of a document.
CYCLE = (3.0, 1.0, 2.0)
LEAST_WEIGHT = 0.25


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight, in [0.25, 1]: 1 for a mean word length of 3 to 10 characters, less the further off."""
    mean = F.char_length(text) / F.greatest(size, F.lit(1))
    off = F.when(mean < 4, 4 - mean).when(mean > 11, (mean - 11) / 4).otherwise(0.0)
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1 - off / 4), F.lit(LEAST_WEIGHT))


def targets(sources: DataFrame, share: float, most: float, cycle: tuple[float, ...]) -> DataFrame:
    """(no_source, name, source_size) to targets: w * level, at most `most` * source_size each, summing to share * all.

    Resharing an excess by weight until nothing is above its cap ends at one water level. Sources are walked in
    the order in which they hit their caps; the level is found from running sums. One row per source.
    """
    by_name = Window.orderBy("no_source", "name")
    by_ratio = Window.orderBy("ratio", "no_source", "name")
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x) for x in cycle]), (F.pmod(F.col("pos") - 1, F.lit(len(cycle))) + 1).cast("int"))
    x = (
        sources.withColumn("pos", F.row_number().over(by_name))
        .withColumn("w", w)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("wanted", share * F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("capped_before")) / F.col("w_left"))
    )
    # The first source, in ratio order, whose ratio is at or above its level fixes the level of all from there on.
    x = x.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    return x.select("no_source", "name", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("final"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[float, ...] = CYCLE, seed: int = 7, buckets: int = 1024, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words), copies (whole documents).

    With `row`, a column that numbers the rows, the number too; it orders repeated rows.

    The document at the end of a budget is taken in part, so a source's words are its target but for less than one
    word; `copies` counts that document as a whole one if at least half of it was taken.
    """
    size = word_count(F.col("text"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / F.lit(float(2**53))
    number = [F.col(row).alias("row")] if row else []
    rows = docs.select("doc_id", *number, F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), size.alias("size"), quality_weight(F.col("text"), size).alias("weight"))
    rows = rows.withColumn("key", -F.log(u) / F.col("weight"))
    # A fixed monotone map of keys to ranges. With the least weight no range gets more than 1 / LEAST_WEIGHT even shares,
    # whatever the weights; with a larger one light documents would crowd the last range.
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-LEAST_WEIGHT * F.col("key"))) * buckets).cast("int"))
    rows = materialize(rows.drop("weight"), "mix")
    ranges = rows.groupBy("no_source", "name", "bucket").agg(F.sum("size").alias("range_size"))
    per_source = targets(ranges.groupBy("no_source", "name").agg(F.sum("range_size").alias("source_size")), share, most, cycle)
    before = Window.partitionBy("no_source", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0))).join(per_source, ["no_source", "name"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ranges = ranges.withColumn("epochs", whole).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    inside = Window.partitionBy("no_source", "name", "bucket").orderBy("key", "doc_id", "size", *["row"] * len(number)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(ranges, ["no_source", "name", "bucket"]).withColumn("sum_before", F.col("range_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("sum_before")))
    drawn = F.when(F.col("size") > 0, (2 * part >= F.col("size"))).otherwise(F.col("sum_before") < F.col("budget"))
    return out.select(
        "doc_id", "size", F.when(~F.col("no_source"), F.col("name")).alias("source"), "source_size", F.col("target").cast("double").alias("target"),
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), (F.col("epochs") + drawn.cast("long")).cast("int").alias("copies"), *["row"] * len(number),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@pipeline_stage
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, whole, in the columns of documents."""
    rows, row = with_row(docs, "mix-rows")
    copies = mix(rows, row=row).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").alias("_copies"))
    joined = rows.join(copies, row)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
