"""Small helpers shared by the operators of this subpackage."""

# A plain explode makes the optimizer test that its array is not empty below the projections that build it, and so build it
# twice; the operators use explode_outer where the array is costly.

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side of a join is broadcast only up to this many rows of a few fixed-width columns; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays. For texts of ASCII alone, lower() is that and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def count_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, a temporary one if driver and executors are one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not re.fullmatch(r"local(\[[^\]-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (configured or tempfile.mkdtemp(prefix="quirefold-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most so many rows to and from Python for what runs inside; texts of a batch are in memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows keep the limit; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def keep_where(docs: DataFrame, kept: DataFrame, rows: int | None = None, anti: bool = False) -> DataFrame:
    """Rows of docs whose doc_id is (or, with anti, is not) in kept.doc_id; columns of docs stay as they are, whatever their names."""
    ids = kept.select(F.col("doc_id").alias("__kept_id")).distinct()
    if rows is not None:
        ids = bounded_broadcast(ids, rows)
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__row_id"))
    how = "left_anti" if anti else "left_semi"
    return packed.join(ids, F.col("__row_id").eqNullSafe(F.col("__kept_id")), how).select("__row.*")
