"""Dealing pages to workers, chunks and volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def worker_of(page: Column, pages: Column, workers: int, chunk: int) -> Column:
    """Contiguous equal ranges, the rest to the last worker; fewer workers where chunks don't suffice."""
    n = F.when(pages < chunk * workers, F.greatest(F.floor(pages / chunk), F.lit(1))).otherwise(workers)
    n = F.least(n, pages)
    return F.least(F.floor(page / F.floor(pages / n)), n - 1)


def chunk_of(page: Column, size: int) -> Column:
    """P05."""
    return F.floor(page / size)


def simple_ranges(pages: Column, parts: Column) -> Column:
    """Sizes that differ by one at most, larger ones first; empty ones left out. An array of (part, start, end), ends inclusive."""
    size, more = F.floor(pages / parts), pages % parts
    ranges = F.transform(
        F.sequence(F.lit(0).cast("long"), parts - 1),
        lambda i: F.struct(i.alias("part"), (i * size + F.least(i, more)).alias("start"), ((i + 1) * size + F.least(i + 1, more) - 1).alias("end")),
    )
    return F.filter(ranges, lambda r: r["end"] >= r["start"])


def aligned_ranges(pages: Column, parts: Column, chunk: int) -> Column:
    """Volumes of whole chunks, further chunks to the first volumes, what is left to the last; simple ranges where a volume has no chunk."""
    base = F.floor(F.floor(pages / parts) / chunk) * chunk
    rest = pages - base * parts
    extra = F.floor(rest / chunk)
    start = lambda i: i * base + F.least(i, extra) * chunk
    ranges = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: F.struct(i.alias("part"), start(i).alias("start"), (F.when(i == parts - 1, pages).otherwise(start(i + 1)) - 1).alias("end")))
    return F.when(base == 0, simple_ranges(pages, parts)).otherwise(ranges)


def split_error(pages: Column, parts: Column) -> Column:
    """E060 for a number of parts that doesn't fit."""
    return F.when((parts <= 0) | (parts > pages), "E060")
