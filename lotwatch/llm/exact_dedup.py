"""Exact deduplication by stateful streaming, DataFrame and SQL functions only.

Arrivals (digest, stable id, content locator) stream through an aggregation keyed by digest. Its state lives on
disk (RocksDB, checkpointed in the shared folder), has no watermark and so never expires: a copy that comes years
later still meets its digest. State per digest: the largest id, its locator, the count. State follows the number
of distinct texts, in small fixed-size rows, never the texts themselves. Copies are combined before the shuffle,
so that one text with a third of all rows is a few rows per task.

Hits (digests seen more than once) are checked on full bytes: their rows' texts, and no others', are grouped by digest
and text, combined map-side to one row per task and text. A digest with one text is confirmed. A digest with several (a
collision) has its documents grouped by the text itself. Up to FEW_HITS hits are broadcast, so that texts that were met
once never move; more are joined in a shuffle that deals each digest's rows over SALTS tasks.

Edge cases: a null text is the empty text; texts are equal when identical after lower-casing A-Z; a null id is
below all others; repeated rows count as copies and all of them but none other carry their own id as keep_id;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import ascii_lower, fresh_path, materialize, pipeline_stage, table, with_row

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Changelogs in place of whole snapshots per batch, and no preallocated log files: state on disk follows its rows.
#: All of an executor's stores share one bound on their memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


#: Digests that were hit are broadcast up to this many, which are counted first: about 150 bytes each.
FEW_HITS, SALTS = 200_000, 16


def normal_text() -> Column:
    return ascii_lower(F.coalesce(F.col("text"), F.lit("")))


def keyed_state(arrivals: DataFrame, checkpoint: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream the arrivals' files into the state at `checkpoint`; digest, keep_id, locator, group_size of all so far.

    `arrivals` is a table of (digest, doc_id, locator). Run again over a folder with more files, with the same
    checkpoint, it takes up only the new files.
    """
    spark = arrivals.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        folder = arrivals.inputFiles()
        if not folder:
            return arrivals.select("digest", F.col("doc_id").alias("keep_id"), "locator", F.lit(1).cast("long").alias("group_size"))
        folder = folder[0].rpartition("/")[0]
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(checkpoint)
    keep, n = (F.col("value")[f] for f in kept.schema["value"].dataType.names)
    return kept.select(F.col("key.digest").alias("digest"), keep["doc_id"].alias("keep_id"), keep["locator"].alias("locator"), n.alias("group_size"))


def dedup(docs: DataFrame, digest=lambda text: F.sha2(text, 256), row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, the row's locator and the kept row's, for every row of docs.

    `digest` is a parameter so that tests can provoke collisions. Locators are column `row`, where it is given; else
    they name no row beyond this call, and rows of collisions have none.
    """
    spark = docs.sparkSession
    text = normal_text()
    # monotonically_increasing_id is (partition, row): where in the input the content lies.
    locator = (F.col(row) if row else F.monotonically_increasing_id()).alias("locator")
    located = docs.select("doc_id", digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"), locator)
    arrivals = materialize(located, "arrivals")
    state = keyed_state(arrivals.select("digest", "doc_id", "locator"), fresh_path(spark, "dedup-state"))
    # Only digests that were hit need their state again; all other rows stand for themselves.
    hits = materialize(state.filter("group_size > 1").select("digest", F.struct("keep_id", F.col("locator").alias("keep_locator"), "group_size").alias("hit")), "dedup-hits")
    few = hits.count() <= FEW_HITS

    def met(rows: DataFrame, how: str) -> DataFrame:
        """Rows joined with the hits: these broadcast if they are few, else a hot digest's rows dealt over SALTS tasks."""
        if few:
            return rows.join(F.broadcast(hits), "digest", how)
        salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], how).drop("salt")

    suspects = met(docs.select("doc_id", digest(text).alias("digest"), text.alias("content")), "left_semi")
    contents = suspects.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    contents = materialize(contents.select("digest", F.lit(True).alias("collided")), "collisions")
    found = met(arrivals, "left")
    own = F.struct(F.col("doc_id").alias("keep_id"), F.col("locator").alias("keep_locator"), F.lit(1).cast("long").alias("group_size"))
    out = found.withColumn("hit", F.coalesce("hit", own)).select("digest", "doc_id", "hit.keep_id", "hit.group_size", F.col("doc_id").eqNullSafe(F.col("hit.keep_id")).alias("kept"), "text_sha256", "locator", "hit.keep_locator")
    if contents.isEmpty():
        return out.drop("digest")
    out = out.join(contents, "digest", "left_anti").drop("digest")
    split = docs.select("doc_id", digest(text).alias("digest"), text.alias("content"), (F.col(row) if row else F.lit(None).cast("long")).alias("locator")).join(contents, "digest", "left_semi")
    groups = split.groupBy("content").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    rest = split.join(groups, "content").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("keep.doc_id")).alias("kept"), F.sha2("content", 256).alias("text_sha256"), "locator", F.col("keep.locator").alias("keep_locator"))
    return out.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("locator", "keep_locator")


@pipeline_stage
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, one row of each group of equal texts, in the columns of documents."""
    rows, row = with_row(docs, "dedup-rows")
    kept = dedup(rows, row=row).filter("locator = keep_locator").select(F.col("locator").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
