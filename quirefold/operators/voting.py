"""Voting among correction candidates, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import classify, strip

SOURCES = ("unanimous", "majority", "specialist", "dictionary")


def align_versions(original: DataFrame, versions: DataFrame, keys: list[str], models: int = 3) -> DataFrame:
    """One row a page with v0, v1, ...; a missing version is the original. versions: (keys..., model_idx, text)."""
    wide = versions.groupBy(*keys).agg(*[F.max(F.when(F.col("model_idx") == m, F.col("text"))).alias(f"v{m}") for m in range(models)])
    joined = original.join(wide, keys, "left")
    return joined.select(*keys, F.col("text").alias("original"), *[F.coalesce(f"v{m}", "text").alias(f"v{m}") for m in range(models)])


def zip_lines(pages: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Lines of several texts side by side, padded with empty ones: (keys..., i, columns...)."""
    arrays = [F.split(c, "\n", -1).alias(c) for c in columns]
    zipped = pages.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("i", "z"))
    return zipped.select(*keys, "i", *[F.coalesce(f"z.{c}", F.lit("")).alias(c) for c in columns])


def vote(original: Column, a: Column, b: Column, c: Column, content: Column, hits: tuple[Column, Column, Column] | None = None) -> Column:
    """Struct (line, source): blank, unanimous, dictionary (one candidate alone has the most hits), majority, specialist."""
    x, y, z = strip(a), strip(b), strip(c)
    said = lambda line, source: F.struct(line.alias("line"), F.lit(source).alias("source"))
    out = F.when((x == "") & (y == "") & (z == ""), said(original, "unanimous")).when((x == y) & (y == z), said(a, "unanimous"))
    if hits is not None:
        p, q, r = hits
        top = F.greatest(p, q, r)
        alone = ((p == top).cast("int") + (q == top).cast("int") + (r == top).cast("int")) == 1
        out = out.when((top > 0) & alone & (p == top), said(a, "dictionary")).when((top > 0) & alone & (q == top), said(b, "dictionary")).when((top > 0) & alone, said(c, "dictionary"))
    out = out.when((x == y) | (x == z), said(a, "majority")).when(y == z, said(b, "majority"))
    return out.when(content == "english", said(a, "specialist")).when(content.isin("korean", "mixed"), said(b, "specialist")).otherwise(said(c, "specialist"))


def vote_lines(pages: DataFrame, keys: list[str], terms: DataFrame | None = None) -> DataFrame:
    """Lines (keys..., i, line, source, content) of pages (keys..., original, v0, v1, v2)."""
    from .lexicon import term_hits

    lines = zip_lines(pages.withColumn("content", classify(F.col("original"))), [*keys, "content"], ["original", "v0", "v1", "v2"])
    hits = None
    if terms is not None:
        candidates = ("v0", "v1", "v2")
        # where all candidates agree no dictionary is asked
        open_lines = lines.where(~((strip(F.col("v0")) == strip(F.col("v1"))) & (strip(F.col("v1")) == strip(F.col("v2")))))
        long = open_lines.select(*keys, "i", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), strip(F.col(v)).alias("line")) for v in candidates])).alias("c")).select(*keys, "i", "c.*")
        counted = long.join(term_hits(long.select("line").distinct(), ["line"], terms), "line")
        wide = counted.groupBy(*keys, "i").agg(*[F.max(F.when(F.col("v") == v, F.col("hits"))).alias(f"_h{v}") for v in candidates])
        lines = lines.join(wide, [*keys, "i"], "left")
        hits = tuple(F.coalesce(f"_h{v}", F.lit(0)) for v in candidates)
    voted = vote(F.col("original"), F.col("v0"), F.col("v1"), F.col("v2"), F.col("content"), hits)
    return lines.select(*keys, "i", "content", voted.alias("_v")).select(*keys, "i", "content", "_v.line", "_v.source")


def vote_pages(pages: DataFrame, keys: list[str], terms: DataFrame | None = None) -> DataFrame:
    """(keys..., text, source, content): lines joined, and the source of most lines, ties in a fixed order."""
    lines = vote_lines(pages, keys, terms)
    counts = [F.sum((F.col("source") == s).cast("int")).alias(f"_n_{s}") for s in SOURCES]
    joined = lines.groupBy(*keys).agg(F.first("content").alias("content"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"), *counts)
    top = F.greatest(*[F.col(f"_n_{s}") for s in SOURCES])
    source = F.coalesce(*[F.when(F.col(f"_n_{s}") == top, F.lit(s)) for s in SOURCES])
    return joined.select(*keys, "text", source.alias("source"), "content")


def vote_stats(voted: DataFrame) -> DataFrame:
    """A09."""
    return voted.groupBy("source").agg(F.count("*").alias("pages"))


def ensemble(pages: DataFrame, keys: list[str], correctors, terms: DataFrame | None = None) -> DataFrame:
    """Three correctors, Column functions or one of (DataFrame, keys) each, work on the original text; then the vote. Blank pages stay."""
    from ..functions.text import is_blank

    versions = pages.select(*keys, F.col("text").alias("original"), *[F.when(is_blank(F.col("text")), F.col("text")).otherwise(F.coalesce(f(F.col("text")), F.col("text"))).alias(f"v{m}") for m, f in enumerate(correctors)])
    return vote_pages(versions, keys, terms)


def cascade(c: Column, correctors) -> Column:
    """Each corrector works on what the one before has made; a null keeps its input."""
    for f in correctors:
        c = F.coalesce(f(c), c)
    return c


def accept_lines(original: Column, corrected: Column) -> Column:
    """Corrected lines where the line counts match and the line is a valid correction, else the originals."""
    from ..functions.text import is_valid_correction

    a, b = F.split(original, "\n", -1), F.split(corrected, "\n", -1)
    chosen = F.zip_with(a, b, lambda x, y: F.when(is_valid_correction(y, x), strip(y)).otherwise(x))
    return F.when(F.size(a) == F.size(b), F.array_join(chosen, "\n")).otherwise(original)


def correct_text(c: Column, corrector, least: int = 3, most: int = 500) -> Column:
    """One text of `least` characters or more, corrected from its first `most`; null answers and invalid ones (F08) keep the text."""
    from ..functions.text import is_valid_correction

    own = strip(c)
    answer = corrector(F.substring(own, 1, most))
    return F.when((F.char_length(own) >= least) & F.coalesce(is_valid_correction(answer, own), F.lit(False)), strip(answer)).otherwise(c)


def correct_texts(texts: Column, corrector, least: int = 3, most: int = 500) -> Column:
    """An array of texts that share a row, corrected in one answer for all of `least` characters or more.

    They are joined by line breaks. If that is longer than `most`, or the answer has another number of lines, each is corrected
    alone; otherwise each line that is a valid correction takes its text's place. Without an answer all texts stay.
    """
    from ..functions.text import is_valid_correction, once

    worth = lambda t: F.char_length(strip(t)) >= least
    alone = lambda ts: F.transform(ts, lambda t: correct_text(t, corrector, least, most))

    def with_answer(answer: Column) -> Column:
        lines = F.split(strip(answer), "\n", -1)
        place = F.aggregate(texts, F.array().cast("array<int>"), lambda a, t: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + worth(t).cast("int")))
        valid = lambda line, t: (line != "") & F.coalesce(is_valid_correction(line, strip(t)), F.lit(False))
        line_of = lambda k: strip(F.get(lines, k - 1))
        taken = F.zip_with(texts, place, lambda t, k: F.when(worth(t) & valid(line_of(k), t), line_of(k)).otherwise(t))
        return F.when(answer.isNull(), texts).when(F.size(lines) != F.size(F.filter(texts, worth)), alone(texts)).otherwise(taken)

    batch = F.array_join(F.filter(texts, worth), "\n")
    answered = once(corrector(batch), with_answer)
    return F.when(F.size(F.filter(texts, worth)) == 0, texts).when(F.char_length(batch) > most, alone(texts)).otherwise(answered)


def correct_blocks(blocks: DataFrame, keys: list[str], corrector, order: str = "ord", least: int = 3, most: int = 500) -> DataFrame:
    """Blocks (keys..., ord, text) with the texts of each key, such as a page's row, corrected together; other columns stay."""
    rest = [c for c in blocks.columns if c not in (*keys, order, "text")]
    rows = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.coalesce("text", F.lit("")).alias("_t"), F.struct(order, *rest).alias("_row")))).alias("_items"))
    rows = rows.withColumn("_new", correct_texts(F.transform("_items", lambda i: i["_t"]), corrector, least, most))
    out = rows.select(*keys, F.explode(F.arrays_zip(F.col("_items").alias("item"), F.col("_new").alias("text"))).alias("_z"))
    return out.select(*keys, "_z.item._row.*", F.col("_z.text").alias("text"))
