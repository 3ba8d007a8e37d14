"""Placing text lines on page positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Part of a font's size above the baseline.
ASCENT = 0.766


def best_positions(positions: DataFrame, keys: list[str], n_lines: str = "n_lines", factor: float = 1.5) -> DataFrame:
    """Where positions are over factor times the lines (two or more), the largest ones, in their order, sampled to the number of lines.

    positions: (keys..., ord, x, y, x2, y2, n_lines). The result is numbered from 0 in pos.
    """
    page = Window.partitionBy(*keys)
    rows = positions.withColumn("_n", F.count("*").over(page)).withColumn("_area", (F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y")))
    rows = rows.withColumn("_rank", F.row_number().over(page.orderBy(F.desc("_area"), "ord")))
    plenty = (F.col("_n") > factor * F.col(n_lines)) & (F.col(n_lines) >= 2)
    kept = rows.where(~plenty | (F.col("_rank") <= F.least(F.floor(factor * F.col(n_lines)), F.col("_n"))))
    kept = kept.withColumn("_i", F.row_number().over(page.orderBy("ord")) - 1).withColumn("_c", F.count("*").over(page)).withColumn("_plenty", plenty)
    # position i of the sample is the kept one number floor(i * c / n): of the kept ones those that some i falls on
    i = F.ceil(F.col("_i") * F.col(n_lines) / F.col("_c"))
    taken = ~F.col("_plenty") | ((F.floor(i * F.col("_c") / F.col(n_lines)) == F.col("_i")) & (i < F.col(n_lines)))
    kept = kept.where(taken)
    return kept.withColumn("pos", F.row_number().over(page.orderBy("ord")) - 1).drop("_n", "_area", "_rank", "_i", "_c", "_plenty")


def map_lines(lines: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Line i of n goes to position floor(i * m / n) of m; lines (keys..., i, line), positions (keys..., pos, ...)."""
    n = lines.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = positions.groupBy(*keys).agg(F.count("*").alias("_m"))
    numbered = lines.join(n, keys).join(m, keys).withColumn("pos", F.least(F.floor(F.col("i") * F.col("_m") / F.col("_n")), F.col("_m") - 1).cast("int")).drop("_n", "_m")
    return numbered.join(positions.withColumn("pos", F.col("pos").cast("int")), [*keys, "pos"])


def direct(lines: DataFrame, positions: DataFrame, keys: list[str], sx: float, sy: float, height: float) -> DataFrame:
    """Mapped lines in points from the bottom left."""
    placed = map_lines(lines, positions, keys)
    return placed.select(*keys, "i", "line", (F.col("x") * sx).alias("x"), (height - F.col("y2") * sy).alias("y"), ((F.col("x2") - F.col("x")) * sx).alias("width"), ((F.col("y2") - F.col("y")) * sy).alias("height"))


def quotas(positions: DataFrame, keys: list[str], n_lines: str = "n_lines") -> DataFrame:
    """How many lines each position takes, by its share of all heights: one at least while every later position can have one, the rest to the last.

    Adds first (the first line's number) and quota.
    """
    page = Window.partitionBy(*keys)
    rows = positions.withColumn("_h", (F.col("y2") - F.col("y")).cast("double")).withColumn("_m", F.count("*").over(page)).withColumn("_all", F.sum("_h").over(page))
    rows = rows.withColumn("_wish", F.greatest(F.bround(F.when(F.col("_all") > 0, F.col("_h") / F.col("_all")).otherwise(0.0) * F.col(n_lines), 0).cast("int"), F.lit(1)))
    items = F.array_sort(F.collect_list(F.struct("pos", "_wish")))
    pages = rows.groupBy(*keys).agg(items.alias("_items"), F.first("_m").cast("int").alias("_m"), F.first(n_lines).cast("int").alias("_n"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a, item):
        after = F.col("_m") - F.size(a["out"]) - 1
        left = F.col("_n") - a["used"]
        take = F.when(after == 0, F.greatest(left, F.lit(0))).otherwise(F.greatest(F.least(item["_wish"], left - after), F.lit(0)))
        return F.struct((a["used"] + take).alias("used"), F.array_append(a["out"], take).alias("out"))

    given = pages.select(*keys, F.explode(F.arrays_zip(F.col("_items").alias("item"), F.aggregate("_items", start, step, lambda a: a["out"]).alias("quota"))).alias("_z")).select(*keys, F.col("_z.item.pos").alias("pos"), F.col("_z.quota").alias("quota"))
    w = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return positions.join(given, [*keys, "pos"]).withColumn("first", F.coalesce(F.sum("quota").over(w), F.lit(0)).cast("int"))


def distributed(lines: DataFrame, positions: DataFrame, keys: list[str], sx: float, sy: float, height: float, downward: bool = False) -> DataFrame:
    """Several lines in a position, as slices from its bottom upward (downward: in reading order)."""
    n = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"))
    given = quotas(positions.join(n, keys), keys).where("quota > 0")
    slots = given.select(*keys, "x", "y", "x2", "y2", "quota", "first", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("k")).withColumn("i", F.col("first") + F.col("k"))
    slot_height = (F.col("y2") - F.col("y")) * sy / F.col("quota")
    place = F.col("quota") - 1 - F.col("k") if downward else F.col("k")
    placed = lines.withColumn("i", F.col("i").cast("int")).join(slots, [*keys, "i"])
    return placed.select(*keys, "i", "line", (F.col("x") * sx).alias("x"), (height - F.col("y2") * sy + place * slot_height).alias("y"), ((F.col("x2") - F.col("x")) * sx).alias("width"), slot_height.alias("height"))


def fallback(lines: DataFrame, keys: list[str], img_w: float, img_h: float, sx: float, sy: float) -> DataFrame:
    """Lines evenly from 8 to 92 per cent of the height, with margins of 5 per cent."""
    page = Window.partitionBy(*keys)
    spacing = F.lit(img_h * 0.84) / F.count("*").over(page)
    h = F.least(F.lit(0.8) * spacing, F.lit(80.0))
    top = F.lit(img_h * 0.08) + F.col("i") * spacing
    return lines.select(*keys, "i", "line", F.lit(img_w * 0.05 * sx).alias("x"), (F.lit(img_h * sy) - (top + h) * sy).alias("y"), F.lit(img_w * 0.9 * sx).alias("width"), (h * sy).alias("height"))


def place(lines: DataFrame, positions: DataFrame, keys: list[str], img_w: float, img_h: float, sx: float, sy: float) -> DataFrame:
    """Direct where lines are at most 1.5 times the positions, distributed beyond, evenly spaced without positions; with mode."""
    n = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"))
    m = positions.groupBy(*keys).agg(F.count("*").alias("_m"))
    modes = n.join(m, keys, "left").select(*keys, F.when(F.col("_m").isNull(), "fallback").when(F.col("n_lines") <= F.lit(1.5) * F.col("_m"), "direct").otherwise("distributed").alias("mode"))
    of = lambda df, mode: df.join(modes.where(F.col("mode") == mode).select(*keys), keys, "left_semi")
    numbered = positions.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1)
    plenty = best_positions(of(positions, "direct").join(n, keys), keys)
    out = direct(of(lines, "direct"), plenty, keys, sx, sy, img_h * sy).withColumn("mode", F.lit("direct"))
    out = out.unionByName(distributed(of(lines, "distributed"), of(numbered, "distributed"), keys, sx, sy, img_h * sy).withColumn("mode", F.lit("distributed")))
    return out.unionByName(fallback(of(lines, "fallback"), keys, img_w, img_h, sx, sy).withColumn("mode", F.lit("fallback")))


def flow(lines: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Lines down the page at no more than 20 points each, down to the bottom margin."""
    page = Window.partitionBy(*keys)
    step = F.least(F.lit(height * 0.9) / F.count("*").over(page), F.lit(20.0))
    rows = lines.select(*keys, "i", "line", F.lit(width * 0.05).alias("x"), (F.lit(height * 0.95) - (F.col("i") + 1) * step).alias("y"), F.least(step * F.lit(0.8), F.lit(14.0)).alias("font"))
    return rows.where(F.col("y") >= height * 0.05)


def baselines(placed: DataFrame) -> DataFrame:
    """Font size and a centred baseline; lines under the page go."""
    from ..functions.geometry import font_size

    rows = placed.withColumn("font", font_size(F.col("height"))).withColumn("baseline", F.col("y") + (F.col("height") - F.col("font")) / 2)
    return rows.where("baseline >= 0")


def width_table(widths: DataFrame) -> DataFrame:
    """Glyph widths (code, width; in thousandths of the font's size) as one row with an array by code point.

    There are no more code points than Unicode has, which bounds the array. Glyphs that the font lacks have the width of code -1,
    or 1000.
    """
    default = F.coalesce(F.max(F.when(F.col("code") == -1, F.col("width").cast("double"))), F.lit(1000.0))
    table = widths.where("code >= -1 AND code < 1114112").agg(default.alias("default"), F.max(F.greatest("code", F.lit(0))).alias("most"), F.array_sort(F.collect_list(F.struct(F.col("code").cast("int").alias("code"), F.col("width").cast("double").alias("width")))).alias("entries"))
    # runs of absent codes are filled as the array grows
    start = F.array().cast("array<double>")

    def add(a: Column, e: Column) -> Column:
        gap = F.array_repeat(F.col("default"), F.greatest(e["code"] - F.size(a), F.lit(0)))
        return F.when(e["code"] < F.size(a), a).otherwise(F.concat(a, gap, F.array(e["width"])))

    return table.select("default", F.aggregate("entries", start, add).alias("glyphs"))


def text_width(text: Column, glyphs: Column, default: Column) -> Column:
    """A line's width in thousandths of the font's size."""
    return F.aggregate(F.split(text, ""), F.lit(0.0), lambda a, c: a + F.when(c == "", F.lit(0.0)).otherwise(F.coalesce(F.get(glyphs, F.ascii(c)), default)))


def fitted(rows: DataFrame, table: DataFrame, lines: str = "_lines", font: str = "font", width: str = "width") -> DataFrame:
    """Rows with their font scaled down so that the longest of their lines (an array) fits into their width."""
    from ..functions.geometry import fitted_font

    longest = F.coalesce(F.array_max(F.transform(lines, lambda s: text_width(s, F.col("glyphs"), F.col("default")))), F.lit(0.0)) * F.col(font) / 1000
    size = F.when(F.col(width) > 0, fitted_font(F.col(font), longest, F.col(width))).otherwise(F.col(font))
    return rows.crossJoin(table).withColumn(font, size).drop("glyphs", "default")


def block_lines(blocks: DataFrame, keys: list[str], width: float, height: float, widths: DataFrame | None = None) -> DataFrame:
    """A block's non-blank lines in equal slots of its box (0 to 1, from the top); none after the first under the page.

    With widths, a table of glyph widths, each has a font from 3 to 48 that fits (M13) and a baseline.
    """
    from ..functions.text import strip

    lines = F.filter(F.transform(F.split("text", "\n", -1), strip), lambda s: s != "")
    rows = blocks.select(*keys, "x", "y", "x2", "y2", lines.alias("_lines")).where(F.size("_lines") > 0)
    rows = rows.withColumns({"width": (F.col("x2") - F.col("x")) * width, "_slot": (F.col("y2") - F.col("y")) * height / F.size("_lines")})
    font = []
    if widths is not None:
        rows = fitted(rows.withColumn("font", F.greatest(F.least(F.col("_slot"), F.lit(48.0)), F.lit(3.0))), F.broadcast(width_table(widths)))
        font = ["font"]
    rows = rows.select(*keys, "x", "y", "width", "_slot", *font, F.posexplode("_lines").alias("i", "line"))
    bottom = F.lit(height) * (1 - F.col("y")) - (F.col("i") + 1) * F.col("_slot")
    placed = rows.select(*keys, "i", "line", (F.col("x") * width).alias("x"), bottom.alias("y"), "width", F.col("_slot").alias("height"), *font)
    low = "y"
    if font:
        placed, low = placed.withColumn("baseline", F.col("y") + F.col("height") / 2 - F.col("font") * F.lit(ASCENT - 0.5)), "baseline"
    return placed.withColumn("_low", F.min(low).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where("_low >= 0").drop("_low")
