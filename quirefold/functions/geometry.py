"""Boxes, pages and progress arithmetic, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 999


def to_points(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """(x, y, width, height) in points from the bottom left, of a box on the 0 to 999 grid."""
    return [x1 / GRID * width, height - y2 / GRID * height, (x2 - x1) / GRID * width, (y2 - y1) / GRID * height]


def clamp(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """Inside the grid, one unit wide and high at least where there is room."""
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(GRID))
    a, b, c, d = inside(x1), inside(y1), inside(x2), inside(y2)
    return [a, b, F.when(c <= a, F.least(a + 1, F.lit(GRID))).otherwise(c), F.when(d <= b, F.least(b + 1, F.lit(GRID))).otherwise(d)]


def remap_half(x1: Column, y1: Column, x2: Column, y2: Column, half: Column, split: Column) -> list[Column]:
    """A box of the upper or lower half of a page on the grid of the whole page."""
    low = F.when(half == 0, 0).otherwise(split)
    high = F.when(half == 0, split).otherwise(GRID)
    at = lambda y: F.floor(low + y * (high - low) / GRID)
    a, b, c, d = clamp(x1, at(y1), x2, at(y2))
    return [a, b, c, F.greatest(d, F.least(b + 1, F.lit(GRID)))]


def to_grid(pixel: Column, size: Column) -> Column:
    """M04."""
    return F.floor(pixel / size * GRID)


def padded(x: Column, y: Column, x2: Column, y2: Column, pad: Column, width: Column, height: Column) -> list[Column]:
    """Grown on all sides, inside the image."""
    return [F.greatest(x - pad, F.lit(0)), F.greatest(y - pad, F.lit(0)), F.least(x2 + pad, width), F.least(y2 + pad, height)]


def crop_pad(height: Column, part: float, least: int) -> Column:
    return F.greatest(F.floor(height * F.lit(part)), F.lit(least))


def resized(width: Column, height: Column, most: int) -> list[Column]:
    """M06."""
    longest = F.greatest(width, height)
    fit = lambda c: F.when(longest > most, F.floor(c * (F.lit(float(most)) / longest))).otherwise(c)
    return [fit(width), fit(height)]


def upright(angle: Column) -> Column:
    """Angles under -45 turn by 90; a page turns if the result is 2 degrees or more off."""
    return F.when(angle < -45, angle + 90).otherwise(angle)


def turned_size(width: Column, height: Column, angle: Column) -> list[Column]:
    s, c = F.abs(F.sin(F.radians(angle))), F.abs(F.cos(F.radians(angle)))
    return [F.floor(height * s + width * c), F.floor(height * c + width * s)]


def max_workers(ram: Column, model: Column) -> Column:
    """Workers that fit beside 6 GB, from 1 to 4."""
    return F.when((model <= 0) | (ram - 6 <= 0), 1).otherwise(F.greatest(F.least(F.floor((ram - 6) / model), F.lit(4)), F.lit(1)))


def percent(done: Column, total: Column, digits: int = 2) -> Column:
    """M09."""
    return F.when(total > 0, F.round(done / total * 100, digits)).otherwise(0.0)


def model_progress(current: Column, total: Column, original: Column) -> list[Column]:
    """(number of models, model, page in the model) from counts that run over all models."""
    models = F.ceil(total / original)
    index = F.least(F.greatest(F.ceil(current / original), F.lit(1)), models)
    return [models, index, current - (index - 1) * original]


def memory_level(mb: Column) -> Column:
    """M12."""
    return F.when(mb >= 8000, "fatal").when(mb >= 5000, "danger").when(mb >= 4000, "warn").otherwise("ok")


def font_size(height: Column) -> Column:
    """0.85 of a line's height, from 6 to 20."""
    return F.least(F.greatest(height * F.lit(0.85), F.lit(6.0)), F.lit(20.0))


def fitted_font(size: Column, text_width: Column, width: Column) -> Column:
    """Scaled down to a width, not under 3."""
    return F.when(text_width > width, F.greatest(size * width / text_width, F.lit(3.0))).otherwise(size)


def overlaps(a: list[Column], b: list[Column]) -> Column:
    """boxes (x1, y1, x2, y2) overlap unless strictly apart."""
    return ~((a[2] < b[0]) | (b[2] < a[0]) | (a[3] < b[1]) | (b[3] < a[1]))


def is_word(conf: Column, w: Column, h: Column, text: Column, least_conf: int = 30, least: int = 5) -> Column:
    """a scanned word that is sure enough, not tiny and not blank."""
    return (conf >= least_conf) & (w >= least) & (h >= least) & ~text.rlike(r"(?U)^\s*$")


def is_noise(w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """F10."""
    return (w < F.lit(0.008) * img_w) | (h < F.lit(0.004) * img_h) | (h / F.greatest(w, F.lit(1)) > 10)


def is_large_enough(w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """F11."""
    return (w >= F.lit(0.01) * img_w) & (h >= F.lit(0.003) * img_h)


def is_text_size(w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """F12."""
    return (h >= F.greatest(F.floor(img_h * F.lit(0.003)), F.lit(8))) & (h <= F.floor(img_h * F.lit(0.06))) & (w >= F.floor(img_w * F.lit(0.015)))


def is_region_size(w: Column, h: Column, img_w: Column, img_h: Column) -> Column:
    """five per cent of the page, not too flat or tall."""
    return (w * h >= F.lit(0.05) * img_w * img_h) & (w / h >= F.lit(0.3)) & (w / h <= 3)


def is_grid(h_lines: Column, v_lines: Column, rows: int = 1, cols: int = 1) -> Column:
    """lines around each of so many rows and columns."""
    return (h_lines >= rows + 1) & (v_lines >= cols + 1)


def route(blocks: Column, text: Column, lines: Column) -> Column:
    """how a page is placed."""
    has_text = F.coalesce(text, F.lit("")) != ""
    return F.when(blocks, "blocks").when(has_text & lines, "cached").when(has_text, "positioned").otherwise("image")
