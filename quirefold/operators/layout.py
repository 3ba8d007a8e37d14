"""Grouping of boxes into rows, cells, lines, blocks and bands.

Inputs have page keys, integer or double boxes and an ordinal `ord` that settles ties. Where a decision needs only the row
before, windows serve. Where it depends on what a group has become (a running mean, a box that grows), the boxes of a page are
folded in order as one sorted array: a page is the largest group that is ever in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = (Window.unboundedPreceding, Window.currentRow)


def _folded(df: DataFrame, keys: list[str], order: list[Column], start: Column, step) -> DataFrame:
    """Rows of df with `state`, what step has made of them in order; state is a struct whose field out is appended for each row."""
    rest = [c for c in df.columns if c not in keys]
    items = F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))))
    pages = df.groupBy(*keys).agg(items.alias("_items"))
    out = F.aggregate("_items", start, step, lambda a: a["out"])
    return pages.select(*keys, F.explode(F.arrays_zip(F.col("_items").alias("item"), out.alias("group"))).alias("_z")).select(*keys, "_z.item._row.*", F.col("_z.group").alias("_group"))


def running_rows(df: DataFrame, keys: list[str], factor: float = 0.6, least_ratio: float | None = None, name: str = "row_id") -> DataFrame:
    """G01 (factor 0.5, least_ratio 0.33), G03 (0.6), G05 (0.6), G06 (0.7): rows by the running mean of centres and heights.

    Boxes (x, y, h, ord) go by (y, x, ord). A box joins the current row if its centre is within factor times the row's mean
    height of the row's mean centre and, with least_ratio, if the heights are alike enough.
    """
    start = F.struct(F.lit(-1).alias("rid"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sc"), F.lit(0.0).alias("sh"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, item: Column) -> Column:
        h = item["_row"]["h"].cast("double")
        cy = item["_row"]["y"].cast("double") + h / 2.0
        n = F.greatest(a["n"], F.lit(1.0))
        mean_h = a["sh"] / n
        joins = (a["rid"] >= 0) & (F.abs(cy - a["sc"] / n) <= F.lit(factor) * mean_h)
        if least_ratio is not None:
            joins = joins & (F.least(mean_h, h) / F.greatest(mean_h, h, F.lit(1.0)) > least_ratio)
        rid = F.when(joins, a["rid"]).otherwise(a["rid"] + 1)
        return F.struct(
            rid.alias("rid"),
            F.when(joins, a["n"] + 1.0).otherwise(F.lit(1.0)).alias("n"),
            F.when(joins, a["sc"] + cy).otherwise(cy).alias("sc"),
            F.when(joins, a["sh"] + h).otherwise(h).alias("sh"),
            F.array_append(a["out"], rid).alias("out"),
        )

    return _folded(df, keys, [F.col("y"), F.col("x"), F.col("ord")], start, step).withColumnRenamed("_group", name)


def split_by_gap(df: DataFrame, keys: list[str], threshold: Column, name: str = "cell_id") -> DataFrame:
    """Within keys, by (x, ord), a new group after a gap x - previous x2 over the threshold."""
    w = Window.partitionBy(*keys).orderBy("x", "ord")
    parted = df.withColumn("_new", F.coalesce((F.col("x") - F.lag("x2").over(w) > threshold).cast("int"), F.lit(0)))
    return parted.withColumn(name, F.sum("_new").over(w.rowsBetween(*UNBOUNDED)).cast("int")).drop("_new")


def hull(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The box around each group's boxes (x, y, x2, y2)."""
    return df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), *more)


def page_hull(first: DataFrame, second: DataFrame, keys: list[str], least: int = 2, *more: Column) -> DataFrame:
    """The box around the longer of a page's two lists of boxes, the first where they are as long; pages whose lists are both shorter than `least` go. n: boxes of that list."""
    rows = [hull(df, keys, F.count("*").alias("n"), *more).withColumn("_list", F.lit(i)) for i, df in enumerate((first, second))]
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "_list")
    found = rows[0].unionByName(rows[1]).where(F.col("n") >= least)
    return found.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_list")


def reading_order(boxes: DataFrame, keys: list[str], *by: Column | str, name: str = "reading") -> DataFrame:
    """Boxes numbered from 1 in reading order: by (y, x) or what is given, then by ord."""
    return boxes.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*(by or ("y", "x")), "ord")))


def joined_text(order: list[str], separator: str = " ", name: str = "text") -> Column:
    """The non-blank texts of a group in order."""
    items = F.array_sort(F.collect_list(F.when(~F.col("text").rlike(r"(?U)^\s*$"), F.struct(*order, F.col("text").alias("_text")))))
    return F.array_join(F.transform(items, lambda i: i["_text"]), separator).alias(name)


def word_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of words by (block, paragraph, line); lines without text go."""
    lines = hull(words, [*keys, "block_num", "par_num", "line_num"], joined_text(["ord"]))
    return lines.where("text != ''")


def region_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of confidence 10 or more in running rows, one box for each."""
    kept = words.where("conf >= 10 AND trim(text) != ''")
    return hull(running_rows(kept, keys), [*keys, "row_id"], F.lit(0.8).alias("confidence"))


def cells(words: DataFrame, keys: list[str], img_w: int) -> DataFrame:
    """Text cells: running rows split at wide gaps."""
    rows = running_rows(words, keys)
    w = Window.partitionBy(*keys, "row_id")
    rows = rows.withColumn("_mean", F.avg("h").over(w))
    parts = split_by_gap(rows, [*keys, "row_id"], F.greatest(F.lit(1.2) * F.col("_mean"), F.lit(0.03 * img_w)))
    return hull(parts, [*keys, "row_id", "cell_id"], joined_text(["x", "ord"]))


def regions(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of like heights, split at gaps over 1.5 mean heights; with the mean angle and confidence (A02) where boxes have them."""
    rows = running_rows(boxes, keys, 0.5, 0.33)
    rows = rows.withColumn("_mean", F.avg("h").over(Window.partitionBy(*keys, "row_id")))
    parts = split_by_gap(rows, [*keys, "row_id"], F.lit(1.5) * F.col("_mean"))
    means = [F.avg(c).alias(c) for c in ("angle", "confidence") if c in boxes.columns]
    return hull(parts, [*keys, "row_id", "cell_id"], F.count("*").alias("n"), *means)


def upper_median(c: str) -> Column:
    """The middle value, the higher of two."""
    values = F.array_sort(F.collect_list(c))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def sized_blocks(words: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of words, split by size and by gaps over 1.5 of the page's upper median height."""
    medians = words.groupBy(*keys).agg(upper_median("h").alias("mid"))
    sized = words.join(medians, keys)
    sized = sized.withColumn("size", F.when(F.col("h") > F.lit(1.4) * F.col("mid"), "large").when(F.col("h") < F.lit(0.7) * F.col("mid"), "small").otherwise("medium"))
    parts = split_by_gap(running_rows(sized, keys), [*keys, "row_id", "size"], F.lit(1.5) * F.col("mid"))
    return hull(parts, [*keys, "row_id", "size", "cell_id"], F.floor(F.avg("h")).alias("char_height"), joined_text(["x", "ord"]))


def sentence_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (x, y, x2, y2, h, size, ord) of a row and size joined while the gap is at most 3 heights of the group's first; small ones stay alone."""
    rows = running_rows(blocks, keys, 0.7)
    start = F.struct(F.lit(-1).alias("gid"), F.lit(0.0).alias("reach"), F.lit(0.0).alias("first"), F.lit("").alias("place"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, item: Column) -> Column:
        r = item["_row"]
        place = F.concat(r["row_id"].cast("string"), F.lit(" "), r["size"])
        joins = (a["gid"] >= 0) & (a["place"] == place) & (r["size"] != "small") & (r["x"].cast("double") - a["reach"] <= F.lit(3.0) * a["first"])
        gid = F.when(joins, a["gid"]).otherwise(a["gid"] + 1)
        return F.struct(gid.alias("gid"), r["x2"].cast("double").alias("reach"), F.when(joins, a["first"]).otherwise(r["h"].cast("double")).alias("first"), place.alias("place"), F.array_append(a["out"], gid).alias("out"))

    grouped = _folded(rows, keys, [F.col("row_id"), F.col("size"), F.col("x"), F.col("ord")], start, step).withColumnRenamed("_group", "group_id")
    return hull(grouped, [*keys, "group_id", "row_id", "size"], F.floor(F.avg("h")).alias("char_height"), F.count("*").alias("n"))


def gap_tolerance(lines: DataFrame, keys: list[str], height: int) -> DataFrame:
    """Half the median gap between grid lines (pos) on the 0 to 999 grid, 1 at least; 15 without gaps."""
    w = Window.partitionBy(*keys).orderBy("pos")
    gaps = lines.withColumn("gap", F.lead("pos").over(w) - F.col("pos"))
    middle = F.median(F.when(F.col("gap") > 0, F.col("gap")))
    tolerance = F.when(middle.isNotNull(), F.greatest(F.floor(middle / F.lit(float(height)) * 999 / 2), F.lit(1))) if height > 0 else F.lit(None)
    return gaps.groupBy(*keys).agg(F.coalesce(tolerance, F.lit(15)).cast("long").alias("tolerance"))


def table_rows(boxes: DataFrame, keys: list[str], tolerance: Column | int = 15) -> DataFrame:
    """A new row when the integer centre is farther from the previous box's than the tolerance."""
    centre = F.floor((F.col("y1") + F.col("y2")) / 2)
    w = Window.partitionBy(*keys).orderBy("_c", "ord")
    rows = boxes.withColumn("_c", centre)
    new = F.coalesce((F.abs(F.col("_c") - F.lag("_c").over(w)) > tolerance).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("row_id", F.sum("_new").over(w.rowsBetween(*UNBOUNDED)).cast("int")).drop("_new", "_c")


def reading_rows(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """By (y, x, ord), the same row while the centre is within half the box's own height of the previous one."""
    w = Window.partitionBy(*keys).orderBy("y", "x", "ord")
    rows = boxes.withColumn("_c", F.col("y") + F.col("h") / 2.0)
    new = F.coalesce((F.abs(F.col("_c") - F.lag("_c").over(w)) > F.lit(0.5) * F.col("h")).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("row_id", F.sum("_new").over(w.rowsBetween(*UNBOUNDED)).cast("int")).drop("_new", "_c")


def page_text(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of a reading row joined by tabs, rows by line breaks."""
    rows = reading_rows(boxes, keys).groupBy(*keys, "row_id").agg(joined_text(["x", "ord"], "\t"))
    lines = F.array_sort(F.collect_list(F.struct("row_id", "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda r: r["text"]), "\n").alias("text"))


def drop_contained(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """By (y, x, ord), without boxes that lie inside the last box kept."""
    box = "struct<x:double,y:double,x2:double,y2:double>"
    start = F.struct(F.lit(None).cast(box).alias("last"), F.array().cast("array<boolean>").alias("out"))

    def step(a: Column, item: Column) -> Column:
        r = item["_row"]
        own = F.struct(*[r[c].cast("double").alias(c) for c in ("x", "y", "x2", "y2")])
        last = a["last"]
        inside = last.isNotNull() & (r["x"] >= last["x"]) & (r["y"] >= last["y"]) & (r["x2"] <= last["x2"]) & (r["y2"] <= last["y2"])
        inside = F.coalesce(inside, F.lit(False))
        return F.struct(F.when(inside, last).otherwise(own).alias("last"), F.array_append(a["out"], ~inside).alias("out"))

    return _folded(boxes, keys, [F.col("y"), F.col("x"), F.col("ord")], start, step).where("_group").drop("_group")


def merge_close(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """By centre, a box within 0.35 heights and 0.3 heights of the grown box before it grows that box; the first one's text stays."""
    start = F.struct(F.lit(-1).alias("gid"), *[F.lit(0.0).alias(c) for c in ("x", "y", "x2", "y2")], F.array().cast("array<int>").alias("out"))

    def step(a: Column, item: Column) -> Column:
        b = {c: item["_row"][c].cast("double") for c in ("x", "y", "x2", "y2")}
        h = F.greatest(b["y2"] - b["y"], a["y2"] - a["y"])
        joins = (a["gid"] >= 0) & (F.abs((b["y"] + b["y2"]) / 2 - (a["y"] + a["y2"]) / 2) <= F.lit(0.35) * h) & (b["x"] < a["x2"] + F.lit(0.3) * h)
        gid = F.when(joins, a["gid"]).otherwise(a["gid"] + 1)
        grown = [F.when(joins, f(a[c], b[c])).otherwise(b[c]).alias(c) for c, f in (("x", F.least), ("y", F.least), ("x2", F.greatest), ("y2", F.greatest))]
        return F.struct(gid.alias("gid"), *grown, F.array_append(a["out"], gid).alias("out"))

    centre = [(F.col("y") + F.col("y2")) / 2.0, (F.col("x") + F.col("x2")) / 2.0, F.col("ord")]
    grouped = _folded(boxes, keys, centre, start, step).withColumnRenamed("_group", "group_id")
    place = F.struct(*[c.alias(f"_p{i}") for i, c in enumerate(centre)])
    return hull(grouped, [*keys, "group_id"], F.min_by("text", place).alias("text"), F.count("*").alias("n"))


def merge_paragraphs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """By (y, x, ord), blocks of one size (not small) with 0.7 of the smaller width in common and a gap of at most 1.5 heights grow together."""
    start = F.struct(F.lit(-1).alias("gid"), *[F.lit(0.0).alias(c) for c in ("x", "y", "x2", "y2", "h")], F.lit("").alias("size"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, item: Column) -> Column:
        r = item["_row"]
        b = {c: r[c].cast("double") for c in ("x", "y", "x2", "y2", "h")}
        common = F.least(a["x2"], b["x2"]) - F.greatest(a["x"], b["x"])
        joins = (a["gid"] >= 0) & (a["size"] == r["size"]) & (r["size"] != "small") & (common >= F.lit(0.7) * F.least(a["x2"] - a["x"], b["x2"] - b["x"])) & (b["y"] - a["y2"] <= F.lit(1.5) * a["h"])
        gid = F.when(joins, a["gid"]).otherwise(a["gid"] + 1)
        grown = [F.when(joins, f(a[c], b[c])).otherwise(b[c]).alias(c) for c, f in (("x", F.least), ("y", F.least), ("x2", F.greatest), ("y2", F.greatest))]
        return F.struct(gid.alias("gid"), *grown, F.when(joins, a["h"]).otherwise(b["h"]).alias("h"), r["size"].alias("size"), F.array_append(a["out"], gid).alias("out"))

    grouped = _folded(blocks, keys, [F.col("y"), F.col("x"), F.col("ord")], start, step).withColumnRenamed("_group", "group_id")
    return hull(grouped, [*keys, "group_id", "size"], joined_text(["y", "x", "ord"], "\n"), F.count("*").alias("n"))


def match_lines(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Each line of the second set widens the first line of the list whose centre is within half the larger height, or is appended.

    Lines (x, y, x2, y2, ord); lines of the first set come first, in their order, and appended ones can be widened in turn.
    """
    box = "struct<x:double,y:double,x2:double,y2:double>"
    as_box = lambda r: F.struct(*[r[c].cast("double").alias(c) for c in ("x", "y", "x2", "y2")])
    listed = lambda df, name: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("x", "y", "x2", "y2").alias("box")))), lambda i: as_box(i["box"])).alias(name))
    both = listed(first, "a").join(listed(second, "b"), keys, "full")
    none = F.array().cast(f"array<{box}>")

    def step(lines: Column, b: Column) -> Column:
        near = lambda a: F.abs((a["y"] + a["y2"]) / 2 - (b["y"] + b["y2"]) / 2) < F.lit(0.5) * F.greatest(a["y2"] - a["y"], b["y2"] - b["y"])
        at = F.array_min(F.filter(F.transform(lines, lambda a, i: F.when(near(a), i)), lambda i: i.isNotNull()))
        widened = F.transform(lines, lambda a, i: F.when(i == at, F.struct(F.least(a["x"], b["x"]).alias("x"), a["y"].alias("y"), F.greatest(a["x2"], b["x2"]).alias("x2"), a["y2"].alias("y2"))).otherwise(a))
        return F.when(at.isNull(), F.array_append(lines, b)).otherwise(widened)

    lines = F.aggregate(F.coalesce("b", none), F.coalesce("a", none), step)
    return both.select(*keys, F.posexplode(lines).alias("ord", "box")).select(*keys, "ord", "box.*")


def combine_lines(first: DataFrame, second: DataFrame, keys: list[str], img_w: int, img_h: int) -> DataFrame:
    """Lines of both detectors of a text's size, matched, merged where close, without contained ones."""
    from ..functions.geometry import is_text_size

    fits = lambda df: df.where(is_text_size(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"), F.lit(img_w), F.lit(img_h)))
    matched = match_lines(fits(first), fits(second), keys).withColumn("text", F.lit(""))
    merged = merge_close(matched, keys).withColumnRenamed("group_id", "ord")
    return drop_contained(merged, keys)


def explode_lines(blocks: DataFrame, least_height: float = 0.02) -> DataFrame:
    """Blocks of several non-blank lines and enough height become equal slices; others stay whole. Boxes are from 0 to 1."""
    lines = F.filter(F.split("text", "\n"), lambda s: ~s.rlike(r"(?U)^\s*$"))
    many = (F.size(lines) >= 2) & (F.col("y2") - F.col("y") >= least_height)
    rows = blocks.withColumn("_lines", F.when(many, lines).otherwise(F.array("text")))
    n = F.size("_lines")
    step = (F.col("y2") - F.col("y")) / n
    rest = [c for c in blocks.columns if c not in ("text", "y", "y2")]
    return rows.select(*rest, "y", step.alias("_step"), F.posexplode("_lines").alias("line", "text")).select(*rest, "line", "text", (F.col("y") + F.col("line") * F.col("_step")).alias("y"), (F.col("y") + (F.col("line") + 1) * F.col("_step")).alias("y2")).drop("_step")


def repeated_line_start(lines: DataFrame, keys: list[str]) -> DataFrame:
    """G14 over a table of lines (i, line): the first line that equals the two before it, and the offset of the first of the three."""
    w = Window.partitionBy(*keys).orderBy("i")
    rows = lines.select(
        *keys,
        "i",
        ((F.col("line") == F.lag("line", 1).over(w)) & (F.col("line") == F.lag("line", 2).over(w)) & ~F.col("line").rlike(r"(?U)^\s*$")).alias("_same"),
        F.sum(F.char_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -3)).alias("_before"),
    )
    return rows.where("_same").groupBy(*keys).agg(F.min("i").alias("line"), F.min_by(F.coalesce("_before", F.lit(0)), "i").alias("offset"))
