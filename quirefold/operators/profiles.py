"""Density profiles: rows (keys..., pos, dark) of a page's projection, and what is found on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def projection(pixels: DataFrame, keys: list[str], axis: str = "y", weight: str | None = None) -> DataFrame:
    """A page's dark pixels (keys..., x, y), or their weights, by row (axis y) or by column (axis x), as a profile."""
    return pixels.groupBy(*keys, F.col(axis).alias("pos")).agg((F.sum(weight) if weight else F.count("*")).alias("dark"))


def bands(profile: DataFrame, keys: list[str], min_density: float, min_size: int, merge_gap: int) -> DataFrame:
    """Runs of at least min_density and min_size, joined over gaps of at most merge_gap; ends are inclusive. Positions that the profile lacks are empty."""
    w = Window.partitionBy(*keys).orderBy("pos")
    marked = profile.withColumn("_on", F.col("dark") >= min_density)
    goes_on = F.lag("_on").over(w) & (F.col("pos") == F.lag("pos").over(w) + 1)
    runs = marked.withColumn("_run", F.sum((F.col("_on") & ~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    runs = runs.groupBy(*keys, "_run").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).where(F.col("end") - F.col("start") + 1 >= min_size)
    v = Window.partitionBy(*keys).orderBy("start")
    apart = F.coalesce((F.col("start") - F.lag("end").over(v) > merge_gap).cast("int"), F.lit(0))
    chained = runs.withColumn("_apart", apart).withColumn("band", F.sum("_apart").over(v.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return chained.groupBy(*keys, "band").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def splits(profile: DataFrame, keys: list[str], empty: float, min_gap: int, min_rows: int = 5) -> DataFrame:
    """Segments between gaps of at least min_gap rows under `empty`; segments of fewer than min_rows go, and a page of one segment stays whole."""
    w = Window.partitionBy(*keys).orderBy("pos")
    marked = profile.withColumn("_gap", F.col("dark") < empty)
    marked = marked.withColumn("_run", F.sum((F.col("_gap") != F.coalesce(F.lag("_gap").over(w), ~F.col("_gap"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_long", F.col("_gap") & (F.count("*").over(Window.partitionBy(*keys, "_run")) >= min_gap))
    marked = marked.withColumn("_segment", F.sum(F.col("_long").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.where("NOT _long").groupBy(*keys, "_segment").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).where(F.col("end") - F.col("start") + 1 >= min_rows)
    v = Window.partitionBy(*keys)
    parts = parts.withColumn("segment", F.row_number().over(v.orderBy("start")) - 1).withColumn("_n", F.count("*").over(v)).where("_n > 1").drop("_n", "_segment")
    whole = profile.groupBy(*keys).agg(F.min("pos").alias("start"), F.max("pos").alias("end")).join(parts.select(*keys).distinct(), keys, "left_anti").withColumn("segment", F.lit(0))
    return parts.select(*keys, "segment", "start", "end").unionByName(whole.select(*keys, "segment", "start", "end"))


def rising_edges(profile: DataFrame, keys: list[str], on: Column, from_start: bool = True) -> DataFrame:
    """Positions where a profile becomes on; from_start counts a profile that begins on."""
    w = Window.partitionBy(*keys).orderBy("pos")
    marked = profile.withColumn("_on", on)
    return marked.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(not from_start))).where("_on AND NOT _was").select(*keys, "pos")


def long_runs(profile: DataFrame, keys: list[str], on: Column, least: int) -> DataFrame:
    """An opening by a line of `least` pixels keeps the runs that are at least as long."""
    w = Window.partitionBy(*keys).orderBy("pos")
    marked = profile.withColumn("_on", on).withColumn("_run", F.col("pos") - F.sum(F.col("_on").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("_on").groupBy(*keys, "_run").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).where(F.col("end") - F.col("start") + 1 >= least).drop("_run")


def otsu(values: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """The threshold of the greatest variance between classes, the lowest on a tie."""
    counts = values.groupBy(*keys, F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    all_bins = values.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counts = all_bins.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    page = Window.partitionBy(*keys)
    below = page.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(*keys, "bin", F.sum("n").over(below).alias("w0"), F.sum(F.col("bin") * F.col("n")).over(below).alias("s0"), F.sum("n").over(page).alias("w"), F.sum(F.col("bin") * F.col("n")).over(page).alias("s"))
    w1 = F.col("w") - F.col("w0")
    apart = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    counts = counts.withColumn("between", F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * apart * apart))
    return counts.where("between IS NOT NULL").groupBy(*keys).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold"))


def brightest(profile: DataFrame, keys: list[str], size: int, within: float = 0.15) -> DataFrame:
    """The row with the least ink near the middle, the first on a tie."""
    near = profile.where(F.col("pos").between(int(size * (0.5 - within)), int(size * (0.5 + within)) - 1))
    return near.groupBy(*keys).agg(F.min_by("pos", F.struct("dark", "pos")).alias("split"))


def text_regions(pixels: DataFrame, keys: list[str], min_density: float, min_size: int, merge_gap: int) -> DataFrame:
    """Bands of rows, and in each the bands of columns, of pixels (x, y, dark)."""
    rows = bands(projection(pixels, keys, "y", "dark"), keys, min_density, min_size, merge_gap)
    inside = pixels.join(rows, keys).where(F.col("y").between(F.col("start"), F.col("end"))).groupBy(*keys, "band", F.col("x").alias("pos")).agg(F.sum("dark").alias("dark"))
    columns = bands(inside.withColumnRenamed("band", "row_band"), [*keys, "row_band"], min_density, min_size, merge_gap)
    tops = rows.select(*keys, F.col("band").alias("row_band"), F.col("start").alias("y_min"), F.col("end").alias("y_max"))
    return columns.join(tops, [*keys, "row_band"]).select(*keys, "row_band", "band", F.col("start").alias("x_min"), "y_min", F.col("end").alias("x_max"), "y_max")
