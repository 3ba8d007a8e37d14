"""Pages put together from what was scanned and recognised on them: word scans, regions, joins, rollups and placement of blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geometry import to_points
from ..streaming.jobs import FRESH
from . import layout
from .placement import fitted, width_table
from .tables import TABLE_TYPES, row_text

#: Page segmentation modes in the order in which scans are tried.
WORD_MODES, LINE_MODES = (6, 11, 3), (6, 11)


def _first_enough(rows: DataFrame, keys: list[str], modes: tuple[int, ...], enough: int) -> DataFrame:
    """The rows of each page's first mode (column psm) that gave enough of them, or of the last mode where none did."""
    rank = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("psm").cast("int"))
    counts = rows.where(rank > 0).groupBy(*keys, "psm").agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.coalesce(F.min_by("psm", F.when(F.col("_n") >= enough, rank)), F.lit(modes[-1])).cast("int").alias("psm"))
    return rows.withColumn("psm", F.col("psm").cast("int")).join(best, [*keys, "psm"])


def word_scan(words: DataFrame, keys: list[str], smallest: int = 5, modes: tuple[int, ...] = WORD_MODES, enough: int = 5) -> DataFrame:
    """S05 (smallest 5), S06 (smallest 3): words (keys..., psm, conf, text, w, h) of confidence 10 or more that aren't blank or tiny, of the mode that counts."""
    kept = words.where((F.col("conf") >= 10) & ~T.is_blank(F.col("text")) & (F.col("w") >= smallest) & (F.col("h") >= smallest))
    return _first_enough(kept, keys, modes, enough)


def line_scan(words: DataFrame, keys: list[str], modes: tuple[int, ...] = LINE_MODES, enough: int = 3) -> DataFrame:
    """Lines (A01) of words of confidence 10 or more, of the first mode with enough lines, or of the last one."""
    return _first_enough(layout.word_lines(words.where("conf >= 10"), [*keys, "psm"]), keys, modes, enough)


def polygon_boxes(polygons: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """Polygons (points: array of x and y) with the upright box around them (x, y, x2, y2, whole pixels) and their angle.

    The angle is that of the smallest rectangle around the points, over -45 and up to 45 degrees. Such a rectangle has a side
    along one of the hull's edges, so the directions from point to point are all that need trying. Of equal rectangles the
    least turned counts; without two different points the angle is 0. Other columns stay.
    """
    ps = F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    extent = lambda values: T.once(values, lambda v: F.array_max(v) - F.array_min(v))

    def rectangle(d: Column) -> Column:
        along, across = F.transform("_p", lambda p: p["x"] * d["c"] + p["y"] * d["s"]), F.transform("_p", lambda p: p["y"] * d["c"] - p["x"] * d["s"])
        upright = T.once(F.degrees(F.atan2(d["s"], d["c"])), lambda t: t - F.round(t / 90) * 90)
        turned = T.once(upright, lambda t: F.round(F.when(t <= F.lit(-45 + 1e-9), t + 90).otherwise(t), 6))
        area = F.round(extent(along) * extent(across), 6)
        return T.once(turned, lambda t: F.struct(area.alias("area"), F.abs(t).alias("turned"), t.alias("angle")))

    def direction(p: Column, q: Column) -> Column:
        length = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        return T.once(length, lambda n: F.struct(((q["x"] - p["x"]) / n).alias("c"), ((q["y"] - p["y"]) / n).alias("s")))

    differ = lambda p, q: (p["x"] != q["x"]) | (p["y"] != q["y"])
    directions = F.flatten(F.transform("_p", lambda p, i: F.transform(F.filter("_p", lambda q, j: (j > i) & differ(p, q)), lambda q: direction(p, q))))
    best = F.array_min(F.transform(directions, rectangle))
    side = lambda f, c: f(F.transform("_p", lambda p: p[c])).cast("long")
    rest = [c for c in polygons.columns if c not in (*keys, points)]
    boxes = [side(F.array_min, "x").alias("x"), side(F.array_min, "y").alias("y"), side(F.array_max, "x").alias("x2"), side(F.array_max, "y").alias("y2")]
    # a polygon takes much more time than bytes, so polygons are dealt evenly over the tasks, however few files they come from
    return polygons.where(F.size(points) > 0).repartition(*keys).withColumn("_p", ps).select(*keys, *rest, *boxes, F.coalesce(best["angle"], F.lit(0.0)).alias("angle"))


def detected_regions(boxes: DataFrame, keys: list[str], img_w: int, img_h: int, words: DataFrame | None = None) -> DataFrame:
    """A detector's boxes (keys..., x, y, x2, y2) that aren't tiny, padded by a tenth of their height, within the image.

    Adds nx, ny, nx2, ny2 (0 to 1), confidence, reading (from 1, by y and x), and angle where boxes have one (polygon_boxes).
    Pages of words without any box get running rows (S09) in their place, of angle 0.
    """
    w, h = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    pad = F.greatest(F.floor(h * F.lit(0.1)), F.lit(2))
    sides = [F.greatest(F.col("x") - pad, F.lit(0)), F.greatest(F.col("y") - pad, F.lit(0)), F.least(F.col("x2") + pad, F.lit(img_w)), F.least(F.col("y2") + pad, F.lit(img_h))]
    names = ("x", "y", "x2", "y2")
    kept = boxes.where((w >= F.lit(0.005 * img_w)) & (h >= F.lit(0.003 * img_h)))
    out = kept.select(*keys, *[s.cast("long").alias(n) for n, s in zip(names, sides, strict=True)], F.lit(1.0).alias("confidence"), *([F.col("angle")] if "angle" in boxes.columns else []))
    if words is not None:
        # a page whose boxes are all tiny had a detection, and stays without regions
        rows = layout.region_rows(words.join(boxes.select(*keys).distinct(), keys, "left_anti"), keys)
        out = out.unionByName(rows.select(*keys, *[F.col(n).cast("long").alias(n) for n in names], "confidence", *([F.lit(0.0).alias("angle")] if "angle" in boxes.columns else [])))
    share = {f"n{n}": F.least(F.greatest(F.col(n) / F.lit(float(img_w if n[0] == "x" else img_h)), F.lit(0.0)), F.lit(1.0)) for n in names}
    return out.withColumns(share).withColumn("reading", F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x", "x2", "y2")))


def cached_positions(pages: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with line_positions, an array of (x, y, x2, y2, text) by (y, x); null where a page has no line."""
    item = F.struct("y", "x", "x2", "y2", "text")
    per_page = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    shown = F.transform("_l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["x2"].alias("x2"), p["y2"].alias("y2"), p["text"].alias("text")))
    return pages.join(per_page.select(*keys, shown.alias("line_positions")), keys, "left")


def is_table_block(block_type: Column) -> Column:
    """F15."""
    return block_type.isin(*TABLE_TYPES)


def full_text(blocks: DataFrame, keys: list[str], order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The non-empty texts of a page's blocks in order, one a line."""
    items = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(*order, F.col("text").alias("_text")))))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(items, lambda i: i["_text"]), "\n").alias("text"))


def page_rollup(detected: DataFrame, sentences: DataFrame, recognised: DataFrame, keys: list[str]) -> DataFrame:
    """A page's numbers of detected, sentence and recognised blocks, and its merged text (A15; empty without blocks)."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    pages = count(detected, "n_detected").join(count(sentences, "n_sentences"), keys, "full").join(count(recognised, "n_recognised"), keys, "full")
    pages = pages.join(layout.page_text(recognised, keys), keys, "left")
    return pages.select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_detected", "n_sentences", "n_recognised")], F.coalesce("text", F.lit("")).alias("text"))


def route_table_pages(pages: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys..., has_table, text) with text and by_blocks: blocks (A16) count on pages with a table that have any; the page's own text counts on the others."""
    of_blocks = full_text(blocks, keys).withColumnRenamed("text", "_block_text")
    rows = pages.join(of_blocks, keys, "left").withColumn("by_blocks", F.col("has_table") & F.col("_block_text").isNotNull())
    return rows.withColumn("text", F.when(F.col("by_blocks"), F.col("_block_text")).otherwise(F.coalesce("text", F.lit("")))).drop("_block_text")


def join_pages(pages: DataFrame, texts: DataFrame, blocks: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every page with its text (empty where it has none), block_results and line_positions (null where it has none)."""
    rows = pages.join(texts.select(*keys, "text"), keys, "left").join(blocks.select(*keys, "block_results"), keys, "left").join(lines.select(*keys, "line_positions"), keys, "left")
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def collection_stats(pages: DataFrame, keys: list[str]) -> DataFrame:
    """A10: of each document (keys), its pages, those with block results and those with cached lines."""
    return pages.groupBy(*keys).agg(F.count("*").alias("n_pages"), F.count_if(F.size("block_results") > 0).alias("n_blocks"), F.count_if(F.size("line_positions") > 0).alias("n_cached"))


def skip_failed(pages: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every page of pages with text and error; a page that failed (results.error) or has no result has an empty text."""
    rows = pages.join(results.select(*keys, "text", "error", F.lit(True).alias("_seen")), keys, "left")
    error = F.when(F.col("_seen").isNull(), F.lit("no result")).otherwise(F.col("error"))
    return rows.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).otherwise("")).drop("_seen")


def shown_as(c: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """The caller's label of a status or code, or the default."""
    out = F.lit(None).cast("string") if default is None else default
    for key, label in labels.items():
        out = F.when(c == key, label).otherwise(out)
    return out


def refined(c: Column, corrector: Callable[[Column], Column], template: str) -> Column:
    """A text that is worth it (F05) in chunks (X10), each put into the prompt (X12), corrected and read back (X08), joined by line breaks; overlaps stay."""
    parts = F.transform(T.chunks(c), lambda p: T.parse_refined(F.coalesce(corrector(T.prompt(p, template)), p), p))
    return F.when(T.should_refine(c), T.once(parts, lambda ps: F.when(F.size(ps) > 0, F.array_join(ps, "\n")).otherwise(c))).otherwise(c)


def place_blocks(blocks: DataFrame, keys: list[str], width: float, height: float, ascent: float = 0.766, clean: Callable[[Column], Column] = T.clean_text, widths: DataFrame | None = None) -> DataFrame:
    """Blocks on the 0 to 999 grid (keys..., ord, block_type, x1, y1, x2, y2, text) as lines with font and baseline in points.

    A block's cleaned lines share its height. Table blocks (F15) go by rows (G07): the row's text (X15), cleaned, on the row's
    hull. Lines under the page go. part is 0 for blocks, whose number is ord, and 1 for rows, whose number is the row's. With
    widths, a table of glyph widths, fonts are fitted to the box's width (M13).
    """
    glyphs = None if widths is None else F.broadcast(width_table(widths))

    def placed(rows: DataFrame, part: int, number: str, whole: bool) -> DataFrame:
        rows = rows.withColumn("_clean", clean(F.col("text")))
        lines = F.array("_clean") if whole else F.filter(F.transform(F.split("_clean", "\n", -1), T.strip), lambda s: s != "")
        x, y, w, h = to_points(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(width), F.lit(height))
        rows = rows.where("_clean != ''").select(*keys, F.lit(part).alias("part"), F.col(number).cast("long").alias("number"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("_h"), lines.alias("_lines"))
        slot = F.col("_h") / F.greatest(F.size("_lines"), F.lit(1))
        rows = rows.withColumn("_slot", slot).withColumn("font", F.greatest(F.least(F.col("_slot"), F.lit(48.0)), F.lit(3.0)))
        if glyphs is not None:
            rows = fitted(rows, glyphs)
        rows = rows.select("*", F.posexplode("_lines").alias("i", "line"))
        baseline = F.col("y") + F.col("_h") - (F.col("i") + 0.5) * F.col("_slot") - F.col("font") * F.lit(ascent - 0.5)
        return rows.withColumn("baseline", baseline).where("baseline >= 0").select(*keys, "part", "number", "i", "line", "x", "width", "font", "baseline")

    table = layout.table_rows(blocks.where(is_table_block(F.col("block_type"))), keys)
    hulls = table.groupBy(*keys, "row_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    rows = hulls.join(row_text(table, [*keys, "row_id"]), [*keys, "row_id"])
    normal = blocks.where(~F.coalesce(is_table_block(F.col("block_type")), F.lit(False)))
    return placed(normal, 0, "ord", False).unionByName(placed(rows, 1, "row_id", True))


def without_text(placed: DataFrame, text: str = "line") -> DataFrame:
    """Placement alone."""
    return placed.drop(text)


def job_pace(events: DataFrame, fresh: tuple[str, ...] = FRESH) -> DataFrame:
    """Progress events (job_id, seq, ts, current, total, and status if there is one) with seconds_per_page, remaining seconds and pages_per_minute.

    The clock of a job starts at its first event, and again at each event whose status is one of fresh and not that of the
    event before. 0 before the first page is done or without elapsed time.
    """
    rows = events.withColumn("_phase", F.lit(0))
    if "status" in events.columns:
        job, status = Window.partitionBy("job_id").orderBy("seq"), F.coalesce("status", F.lit(""))
        rows = events.withColumn("_new", (status.isin(*fresh) & (F.lag(status).over(job) != status)).cast("int"))
        rows = rows.withColumn("_phase", F.sum(F.coalesce("_new", F.lit(0))).over(job)).drop("_new")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = rows.withColumn("elapsed", (micros(F.col("ts")) - micros(F.min("ts").over(Window.partitionBy("job_id", "_phase")))) / F.lit(1e6)).drop("_phase")
    rows = rows.withColumn("seconds_per_page", F.when(F.col("current") > 0, F.col("elapsed") / F.col("current")).otherwise(0.0))
    left = F.col("total") - F.col("current")
    return rows.withColumn("remaining", F.when((left > 0) & (F.col("seconds_per_page") > 0), left * F.col("seconds_per_page")).otherwise(0.0)).withColumn(
        "pages_per_minute", F.when((F.col("total") > 0) & (F.col("elapsed") > 0), F.col("total") / F.col("elapsed") * 60).otherwise(0.0)
    )
