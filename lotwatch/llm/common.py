"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset (tests) a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="lotwatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders made within a stage of the pipeline, until the next stage takes them away; whether one is being planned.
_stage_paths: list[str] = []
_in_stage = False


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _in_stage:
        _stage_paths.append(path)
    return path


#: Bytes of an Arrow batch that goes to Python: batches of rows with texts or sets stay small, however long these are.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 2_000_000) -> None:
    """Let no Arrow batch of this session hold more than so many bytes, or one row; a smaller bound that is set stays."""
    if int(spark.conf.get(BATCH_BYTES).rstrip("bB")) > most:
        spark.conf.set(BATCH_BYTES, str(most))


def pipeline_stage(f):
    """A stage (spark, docs, sf_dir) whose predecessor's tables go first: its rows are written by now, as the pipeline has it.

    Tables that `docs` still reads stay.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _in_stage
        bounded_batches(spark)
        read = docs.inputFiles() if _stage_paths else []
        for path in [p for p in _stage_paths if not any(f"{p.rpartition('/')[2]}/" in x for x in read)]:
            delete_path(spark, path)
            _stage_paths.remove(path)
        _in_stage = True
        try:
            return f(spark, docs, sf_dir)
        finally:
            _in_stage = False

    return run


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read that."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written as a table so that numbers stay, with a number of their own each; and that column's name."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of plans that nothing refers to any more, as after materialize()."""
    gc.collect()
    spark._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more, by Hadoop's file system, wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes; pure ASCII texts take the byte-wise path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drop_table(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def slices(batch, column: str, most: int):
    """An Arrow batch in parts of consecutive rows with at most so many bytes in a text column, or one row each."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(upto):
        before = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


#: What this worker keeps from task to task, by the module that made it; see kept() and let_go().
_kept: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What a module keeps in this worker, until a task of another module runs in it."""
    return _kept.setdefault(module, {})


def let_go(but: str) -> None:
    """Drop what modules other than this one keep: workers are the same for all jobs of a session, and executors small."""
    for module, things in _kept.items():
        if module != but:
            things.clear()


def tidied(run):
    """A function of Arrow batches for mapInArrow that gives its memory back when a task ends: workers live on and idle.

    What other modules keep goes before it begins.
    """
    owner = run.__module__

    @functools.wraps(run)
    def whole(batches):
        import ctypes

        import pyarrow as pa

        let_go(owner)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole
