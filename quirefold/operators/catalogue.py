"""Small fixed tables that rows are looked up in: error codes, and catalogues by key, alias and role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


def is_recoverable(code: Column) -> Column:
    """whether work goes on after an error of this code."""
    return F.coalesce(code.isin(*V.RECOVERABLE), F.lit(False))


def with_messages(rows: DataFrame, code: str = "code", unknown: str | None = None) -> DataFrame:
    """rows with the message and recoverable of their error code; an unknown code has the message `unknown`. The table of codes is fixed and broadcast."""
    table = rows.sparkSession.createDataFrame(list(V.ERRORS.items()), "_code string, message string")
    joined = rows.join(F.broadcast(table), F.col(code) == F.col("_code"), "left").drop("_code")
    return joined.withColumn("message", F.coalesce("message", F.lit(unknown).cast("string"))).withColumn("recoverable", is_recoverable(F.col(code)))


def lookup(rows: DataFrame, catalogue: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Rows joined with the catalogue's entry whose id, or else alias, is their key; of several the first by `order`.

    catalogue: (id, alias, `order`, ...); both columns may be null. Rows without an entry have nulls.
    """
    entry = F.struct(*catalogue.columns)
    names = F.array(F.struct(F.lit(0).alias("by"), F.col("id").cast("string").alias("name")), F.struct(F.lit(1).alias("by"), F.col("alias").cast("string").alias("name")))
    named = catalogue.select(entry.alias("entry"), F.col(order).alias("_order"), F.explode(names).alias("_n")).where("_n.name IS NOT NULL")
    first = Window.partitionBy("_n.name").orderBy("_n.by", "_order")
    named = named.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(F.col("_n.name").alias("_name"), "entry")
    return rows.join(named, F.col(key) == F.col("_name"), "left").drop("_name")


def of_role(catalogue: DataFrame, role: str, order: str = "ord") -> DataFrame:
    """The entries of a role, numbered from 0 by `order`."""
    rows = catalogue.where(F.col("role") == role)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(order)) - 1)
