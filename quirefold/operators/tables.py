"""Rebuilding tables from blocks and line grids; boxes on the 0 to 999 grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlaps
from ..functions.text import strip
from .layout import table_rows

TABLE_TYPES = ("table_header", "table_cell", "table_row")


def split_by_regions(blocks: DataFrame, regions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks that overlap any region of their page, and the others; regions (keys..., x1, y1, x2, y2)."""
    r = regions.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    meets = overlaps([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    condition = meets
    for s in same:
        condition = condition & s
    return blocks.join(r, condition, "left_semi"), blocks.join(r, condition, "left_anti")


def uncovered(words: DataFrame, regions: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Words (x, y, x2, y2, conf >= 30, 5 pixels wide and high) of which no region covers `share` of the area."""
    r = regions.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in ("x", "y", "x2", "y2")])
    w = F.least("x2", "_x2") - F.greatest("x", "_x")
    h = F.least("y2", "_y2") - F.greatest("y", "_y")
    covered = (w > 0) & (h > 0) & (w * h >= share * (F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y")))
    for k in keys:
        covered = covered & (F.col(k) == F.col(f"_{k}"))
    kept = words.where("conf >= 30 AND x2 - x >= 5 AND y2 - y >= 5 AND trim(text) != ''")
    return kept.join(r, covered, "left_anti")


def table_cells(blocks: DataFrame, boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """The column whose boundaries hold a block's middle; of several blocks in a slot the first with text. boundaries: (keys..., i, pos)."""
    w = Window.partitionBy(*keys).orderBy("i")
    columns = boundaries.select(*keys, "i", "pos", F.lead("pos").over(w).alias("until")).where("until IS NOT NULL")
    placed = blocks.withColumn("_mid", F.floor((F.col("x1") + F.col("x2")) / 2)).join(columns, keys).where("_mid >= pos AND _mid < until")
    first = Window.partitionBy(*keys, "row_id", "i").orderBy(F.col("text").rlike(r"(?U)^\s*$"), "ord")
    return placed.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*keys, "row_id", F.col("i").alias("col_id"), "text")


def row_text(boxes: DataFrame, keys: list[str], keep_empty: bool = False) -> DataFrame:
    """Texts of a row by x1, joined by tabs."""
    kept = boxes if keep_empty else boxes.where(~F.col("text").rlike(r"(?U)^\s*$"))
    items = F.array_sort(F.collect_list(F.struct("x1", "ord", F.trim("text").alias("text"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(items, lambda i: i["text"]), "\t").alias("text"))


def first_grid(regions: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys..., tolerance, boundaries) from the first region of each page: how far apart rows are, and its vertical lines on the 0 to 999 grid.

    regions: (keys..., region, h_positions, v_positions) in pixels. The tolerance is half the median gap of the horizontal
    lines, and null without a gap.
    """
    first = regions.groupBy(*keys).agg(F.min_by(F.struct("h_positions", "v_positions"), "region").alias("_r")).select(*keys, "_r.*")
    gaps = F.filter(F.zip_with("h_positions", F.slice("h_positions", 2, 1 << 30), lambda a, b: b - a), lambda g: g > 0)
    sorted_gaps = F.array_sort(gaps)
    n = F.size(sorted_gaps)
    median = (F.get(sorted_gaps, ((n - 1) / 2).cast("int")) + F.get(sorted_gaps, (n / 2).cast("int"))) / 2
    tolerance = F.greatest(F.floor(median / F.lit(float(height)) * 999 / 2), F.lit(1)) if height > 0 else F.lit(None)
    return first.select(*keys, tolerance.cast("long").alias("tolerance"), (F.transform("v_positions", lambda p: F.floor(p / F.lit(float(width)) * 999)) if width > 0 else F.array().cast("array<long>")).alias("boundaries"))


def on_grid(regions: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Regions (keys..., x, y, width, height) in pixels as boxes (keys..., x1, y1, x2, y2) from 0 to 999."""
    at = lambda c, size: F.floor(c / F.lit(float(size)) * 999)
    return regions.select(*keys, at(F.col("x"), width).alias("x1"), at(F.col("y"), height).alias("y1"), at(F.col("x") + F.col("width"), width).alias("x2"), at(F.col("y") + F.col("height"), height).alias("y2"))


def cell_texts(items: Column, boundaries: Column) -> Column:
    """K06 in a row: for each pair of boundaries the first non-blank text whose middle lies between them, or an empty one. items: array of (mid, text) in order."""
    stripped = F.transform(items, lambda i: F.struct(i["mid"].alias("mid"), strip(i["text"]).alias("text")))
    slots = F.sequence(F.lit(0), F.size(boundaries) - 2)
    inside = lambda k: F.filter(stripped, lambda i: (i["mid"] >= F.get(boundaries, k)) & (i["mid"] < F.get(boundaries, k + 1)) & (i["text"] != ""))
    return F.transform(slots, lambda k: F.coalesce(F.get(inside(k), F.lit(0))["text"], F.lit("")))


def rebuild(blocks: DataFrame, regions: DataFrame, keys: list[str], tolerance: int = 15, grid: DataFrame | None = None) -> DataFrame:
    """Blocks of table regions become rows of the type table_row (tab-joined text, hull), after the other blocks.

    grid (first_grid) gives pages a tolerance of their own, and cells (K06) where there are two boundaries or more; a row
    without them has its texts by x1, empty ones too.
    """
    inside, outside = split_by_regions(blocks, regions, keys)
    if grid is None:
        inside = inside.withColumns({"_tolerance": F.lit(tolerance).cast("long"), "_boundaries": F.array().cast("array<long>")})
    else:
        own = grid.select(*keys, F.col("tolerance").alias("_tolerance"), F.col("boundaries").alias("_boundaries"))
        inside = inside.join(own, keys, "left").withColumn("_tolerance", F.coalesce("_tolerance", F.lit(tolerance).cast("long")))
    centre = F.floor((F.col("y1") + F.col("y2")) / 2)
    rows = table_rows(inside, keys, F.col("_tolerance"))
    item = F.struct(centre.alias("centre"), "ord", F.floor((F.col("x1") + F.col("x2")) / 2).alias("mid"), "x1", F.coalesce("text", F.lit("")).alias("text"))
    made = rows.groupBy(*keys, "row_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.first("_boundaries").alias("_b"), F.array_sort(F.collect_list(item)).alias("_items"))
    by_x = F.transform(F.array_sort(F.transform("_items", lambda i, k: F.struct(i["x1"].alias("x1"), k.alias("k"), i["text"].alias("text")))), lambda i: strip(i["text"]))
    texts = F.when(F.size("_b") >= 2, cell_texts(F.col("_items"), F.col("_b"))).otherwise(by_x)
    made = made.select(*keys, F.lit("table_row").alias("block_type"), "x1", "y1", "x2", "y2", F.array_join(texts, "\t").alias("text"), F.lit(1).alias("part"))
    return outside.select(*keys, "block_type", "x1", "y1", "x2", "y2", "text", F.lit(0).alias("part")).unionByName(made)
