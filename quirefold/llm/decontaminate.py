"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every window of `width` item words is known by its fingerprint: the minimum hash of the k-grams inside it. Documents are
winnowed the same way, so a shared span of `width` words always shares a fingerprint. Neighbouring document windows with one
minimum form a run; only runs whose fingerprint the benchmark has are kept, and each is extended word by word: all of its
windows are compared with the benchmark's windows as text. Items of fewer words than a window are one window of their own
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, cut, lower_az

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, GRAM = 10, 4


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shifted(column: str, by: int) -> Column:
    return F.slice(column, by + 1, F.greatest(F.size(column) - by, F.lit(0)))


def _over_windows(df: DataFrame, column: str, length: int, join) -> DataFrame:
    """Replace each element of an array by what join makes of the `length` elements from it on (of fewer at the end).

    Windows of one size are joined from two of the next smaller sizes, which may overlap where length is no power of two.
    """
    have = 1
    while have < length:
        step = min(have, length - have)
        df = df.withColumn(column, F.zip_with(column, _shifted(column, step), join))
        have += step
    return df


def _with_minima(df: DataFrame, width: int, gram: int) -> DataFrame:
    """From words: n_words and minima, the fingerprint of the window that starts at each word."""
    df = df.withColumn("n_words", F.size("words")).withColumn("minima", F.transform("words", lambda w: F.xxhash64(w)))
    df = _over_windows(df, "minima", gram, lambda a, b: F.xxhash64(a, b))
    df = _over_windows(df, "minima", width - gram + 1, lambda a, b: F.least(a, b))
    return df.withColumn("minima", F.slice("minima", 1, F.greatest(F.col("n_words") - width + 1, F.lit(0))))


def _short_prints(length: int) -> Column:
    return F.transform(F.slice("words", 1, F.greatest(F.col("n_words") - length + 1, F.lit(0))), lambda w, i: F.xxhash64(F.lit(length), F.slice("words", i + 1, length)))


def _short_runs(length: int) -> Column:
    """A run of one window for each word of a document at which a window of that length starts."""
    return F.transform(
        F.slice("words", 1, F.greatest(F.col("n_words") - length + 1, F.lit(0))),
        lambda w, i: F.struct(
            F.xxhash64(F.lit(length), F.slice("words", i + 1, length)).alias("fingerprint"),
            (i + 1).alias("start"),
            F.lit(length).alias("length"),
            F.slice("words", i + 1, length).alias("context"),
        ),
    )


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(item_id, window, fingerprint, length) of every window of every item; items without words have none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    full = _with_minima(items, width, gram).select(
        "item_id",
        F.posexplode("minima").alias("at", "fingerprint"),
        "words",
    ).select("item_id", F.array_join(F.slice("words", F.col("at") + 1, width), " ").alias("window"), "fingerprint", F.lit(width).alias("length"))
    n = F.size("words")
    short = items.where((n > 0) & (n < width)).select(
        "item_id",
        F.array_join("words", " ").alias("window"),
        F.xxhash64(n, F.col("words")).alias("fingerprint"),
        n.alias("length"),
    )
    return full.unionByName(short).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (hit ranges of word numbers from 1: start, length), items (ids as sorted strings).

    A word is hit if it is inside any occurrence of a window. Null or empty texts have no words and no hits. Repeated rows
    (same doc_id and text) give one row; rows of one doc_id with different texts give one row each; a null doc_id is kept.
    Items without words match nothing; an item with a null id hits words but isn't listed. Other columns are ignored. The
    benchmark's windows are broadcast if they are at most broadcast_rows, and joined by shuffle beyond.
    """
    windows = cut(benchmark_windows(benchmark, width, gram))
    by_length = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # width rows at most
    total = sum(by_length.values())
    prints = bounded_broadcast(windows.select("fingerprint").distinct(), total, broadcast_rows)

    # first which documents share a fingerprint with the benchmark: of these alone are runs made and extended
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    lengths = sorted(x for x in by_length if x < width)
    marks = F.concat(F.array(F.lit(None).cast("bigint")), F.array_distinct("minima"), *[F.array_distinct(_short_prints(x)) for x in lengths])
    marked = (
        _with_minima(texts, width, gram)
        .select("doc_id", "text_hash", "n_words", F.explode_outer(marks).alias("fingerprint"))
        .join(prints.withColumn("known", F.lit(True)), "fingerprint", "left")
        .where(F.col("fingerprint").isNull() | F.col("known"))
    )
    base = cut(marked.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("known")))
    candidates = base.where("known").select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"))
    candidates = bounded_broadcast(candidates, candidates.count(), broadcast_rows)
    rows = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    rows = _with_minima(rows, width, gram)
    rows = rows.withColumn(
        "starts",
        F.filter(
            F.transform("minima", lambda m, i: F.when((i == 0) | (m != F.get("minima", i - 1)), i)),
            lambda i: i.isNotNull(),
        ),
    )
    size = F.size("minima")
    runs = F.transform(
        "starts",
        lambda s, j: F.struct(
            F.get("minima", s).alias("fingerprint"),
            (s + 1).alias("start"),
            F.lit(width).alias("length"),
            F.slice("words", s + 1, F.coalesce(F.get("starts", j + 1), size) - s + width - 1).alias("context"),
        ),
    )
    every = F.concat(runs, *[_short_runs(x) for x in lengths])
    found = rows.select("doc_id", "text_hash", F.explode_outer(every).alias("run")).select("doc_id", "text_hash", "run.*").join(prints, "fingerprint", "left_semi")
    tried = found.select(
        "doc_id",
        "text_hash",
        "length",
        F.explode_outer(
            F.transform(
                F.slice("context", 1, F.size("context") - F.col("length") + 1),
                lambda w, i: F.struct((F.col("start") + i).alias("start"), F.array_join(F.slice("context", i + 1, F.col("length")), " ").alias("window")),
            )
        ).alias("at"),
    ).select("doc_id", "text_hash", "length", "at.*")
    known = bounded_broadcast(windows.select("window", F.col("length").alias("of_length"), "item_id"), total, broadcast_rows)
    hits = tried.join(known, (tried["window"] == known["window"]) & (tried["length"] == known["of_length"]))
    hits = hits.groupBy(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("windows"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    per_doc = base.join(hits, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    per_doc = per_doc.withColumn("windows", F.coalesce("windows", F.array().cast("array<struct<start:int,length:int>>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    spans = F.aggregate(
        "windows",
        F.array().cast("array<struct<start:int,length:int>>"),
        lambda done, w: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["start"] + F.element_at(done, -1)["length"] >= w["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        (F.greatest(F.element_at(done, -1)["start"] + F.element_at(done, -1)["length"], w["start"] + w["length"]) - F.element_at(done, -1)["start"]).alias("length"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(w["start"].alias("start"), w["length"].alias("length"))))),
    )
    return (
        per_doc.withColumn("spans", spans)
        .withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda a, s: a + s["length"]))
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "spans", "items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without the documents that hold a benchmark window; all columns stay."""
    from .common import keep_where

    hit = contamination(docs, benchmark, **parameters).where("n_hit > 0").select("doc_id")
    return keep_where(docs, hit, anti=True)
