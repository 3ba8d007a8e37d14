"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source whose target is r times its words takes floor(r) certain copies of each document. The rest is a fixed-size sample:
documents are ranked by random odds over inclusion odds, and taken in that order until the source's words reach the target. A
document of its source's mean size has the odds of the share that is wanted; longer ones have less in proportion to their size,
shorter ones more, up to SPREAD times, so that many documents rather than a few long ones fill the rest.
The cut in that order is found by two rounds of histograms, so no task sees a whole source; only the documents inside one
histogram cell of one cell are ever ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, count_words, cut

WEIGHTS, MOST_COPIES, CELLS, SPREAD = (5, 2, 1), 3, 4096, 8.0


def _uniform(doc_id: Column, salt: str) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 digest of the salt and the id; it is the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """Per source of sizes (source, size): source_size, documents and target.

    Sources in order of their code points, null last, have the weights in turn and share all words. A target stops at
    most_copies times the source's words, and what is over is shared again by weight. One row per source is ordered in one
    task; these rows are sums, of which there are as many as sources.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * most_copies)
    filling = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # the sources that stop are the first ones in the order of most / weight: the level that the others share is the first one under the next stop
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.coalesce(F.sum("most").over(filling), F.lit(0.0)).alias("stopped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))).alias("sharing"),
    )
    level = (F.col("total") - F.col("stopped")) / F.col("sharing")
    rows = rows.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("most"), level)).over(everything))
    return rows.select("source", "source_size", "documents", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_copies: int = MOST_COPIES, salt: str = "mix", cells: int = CELLS) -> DataFrame:
    """Per row of docs: doc_id, source, size (words), source_size, target (both of its source), copies and taken (words).

    copies is 0 to most_copies. A source takes the documents of the smallest rank while the words that they add stay within
    half a document of the target; documents without words are taken as often as certain. Ranks depend on the id, the size and
    the source's mean size, ties go by id; repeated rows count as rows of their own, and a null id ranks as an empty one. A null or empty text has size 0,
    null sources form one source. An empty table gives an empty result.
    """
    rows = cut(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")))
    targets = cut(source_targets(rows, weights, most_copies).withColumnRenamed("source", "of"))
    targets = bounded_broadcast(targets, targets.count())
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("certain", F.least(F.floor(ratio), F.lit(most_copies)).cast("long"))
    rows = rows.withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))
    share = F.greatest(F.least(ratio - F.col("certain"), F.lit(1 - 1e-12)), F.lit(1e-12))
    u = _uniform(F.col("doc_id"), salt)
    mean = F.col("source_size") / F.col("documents")
    relative = F.when(F.col("size") == 0, F.lit(SPREAD)).otherwise(F.greatest(F.least(mean / F.col("size"), F.lit(SPREAD)), F.lit(1 / SPREAD)))
    rows = rows.withColumn("odds", share / (1 - share)).withColumn("rank", (u / (1 - u)) / (F.col("odds") * relative))
    # cells that go with the rank: within a source the odds of the share are one number, and the rest lies about 1
    x = F.col("rank") * F.col("odds")
    rows = rows.withColumn("spot", x / (1 + x))
    rows = cut(rows.withColumn("cell", F.floor(F.col("spot") * cells).cast("int")).withColumn("finer", F.floor(F.col("spot") * cells * cells).cast("long") % cells))
    by_source = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    first = first.withColumn("before", F.coalesce(F.sum("words").over(by_source), F.lit(0)))
    # state: 1 the whole cell is in, 0 the whole cell is out, null the cut is inside
    state = lambda: F.when(F.col("before") + F.col("words") <= F.col("wanted"), 1).when(F.col("before") >= F.col("wanted"), 0)
    first = first.select(F.col("source").alias("s1"), F.col("cell").alias("c1"), F.col("before").alias("before1"), state().alias("state1"))
    rows = rows.join(first, F.col("source").eqNullSafe(F.col("s1")) & (F.col("cell") == F.col("c1"))).drop("s1", "c1")
    open_rows = rows.where("state1 IS NULL")
    inner = Window.partitionBy("source", "cell").orderBy("finer").rowsBetween(Window.unboundedPreceding, -1)
    second = open_rows.groupBy("source", "cell", "finer").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("before1").alias("before1"))
    second = second.withColumn("before", F.col("before1") + F.coalesce(F.sum("words").over(inner), F.lit(0)))
    second = second.select(F.col("source").alias("s2"), F.col("cell").alias("c2"), F.col("finer").alias("f2"), F.col("before").alias("before2"), state().alias("state2"))
    open_rows = open_rows.join(second, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("c2")) & (F.col("finer") == F.col("f2"))).drop("s2", "c2", "f2")
    last = Window.partitionBy("source", "cell", "finer").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = open_rows.where("state2 IS NULL").withColumn("before3", F.col("before2") + F.coalesce(F.sum("size").over(last), F.lit(0)))
    inside = inside.withColumn("extra", (F.col("before3") + F.col("size") / 2.0 <= F.col("wanted")).cast("int"))
    columns = ["doc_id", "source", "size", "source_size", "target", "certain"]
    done = (
        rows.where("state1 IS NOT NULL").select(*columns, F.col("state1").alias("extra"))
        .unionByName(open_rows.where("state2 IS NOT NULL").select(*columns, F.col("state2").alias("extra")))
        .unionByName(inside.select(*columns, "extra"))
    )
    copies = F.least(F.col("certain") + F.col("extra"), F.lit(most_copies))
    return done.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """docs, each row as often as the mix takes it; all columns stay.

    Documents without words, which no mix of words can weigh, stay once. Rows of one id, source and size are alike to the mix;
    where the cut falls among them, those of the smallest text hashes are taken.
    """
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(1))
    plan = mix(docs, **parameters).groupBy(F.col("doc_id").alias("__i"), F.col("source").alias("__s"), F.col("size").alias("__n"))
    plan = plan.agg(F.min(copies).cast("int").alias("__low"), F.max(copies).cast("int").alias("__high"), F.count("*").alias("__rows"), F.sum(copies).alias("__all"))
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), count_words(F.col("text")).alias("__size"), F.xxhash64("text").alias("__hash"))
    same = F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n"))
    planned = cut(plan.where("__high > 0"))
    even, uneven = planned.where("__low = __high"), planned.where("__low != __high")
    out = packed.join(even, same).select("__row", F.col("__low").alias("__copies"))
    if not uneven.isEmpty():
        place = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy("__hash"))
        # so many rows have the higher number of copies
        higher = (F.col("__all") - F.col("__low") * F.col("__rows")) / (F.col("__high") - F.col("__low"))
        parts = packed.join(uneven, same).withColumn("__place", place)
        out = out.unionByName(parts.select("__row", F.when(F.col("__place") <= higher, F.col("__high")).otherwise(F.col("__low")).alias("__copies")).where("__copies > 0"))
    return out.select(F.explode(F.array_repeat("__row", F.col("__copies"))).alias("__row")).select("__row.*")
