"""Sharding by a k-d tree over text metadata, with DataFrame functions only.

The unit is a distinct text, so copies share a shard. Texts that weigh more than a small part of a shard with all their copies
are placed first, each in the lightest shard. The others are split again and again at a weighted quantile (the median, but
for what the placed texts have used) along the widest metadata dimension, until each leaf is a shard. Quantiles come from
histograms that all tasks fill: one over the dimension, and one over a hash for the texts of the histogram bin that the cut
falls into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS, BINS = 16, 1024
#: A text with all its copies is placed by itself if it weighs more than this part of a shard.
HEAVY = 1 / 64
BLOCKS = 256


def _dimensions(text: Column) -> dict[str, Column]:
    """Metadata of a text, each from 0 to about 1."""
    size = F.octet_length(text)
    return {
        "d_size": F.log2(size + 1.0) / 32,
        "d_wide": (size - F.length(text)) / F.greatest(size, F.lit(1)).cast("double"),
        "d_lines": F.log2(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1.0) / 24,
        "d_first": F.least(F.ascii(text), F.lit(1023)) / 1024.0,
    }


def split_texts(groups: DataFrame, shards: int, bins: int = BINS, heavy: float = HEAVY) -> DataFrame:
    """(key1, key2, shard) for groups (key1, key2, bytes, d_*), with near equal sums of bytes in each shard.

    To the driver come only the heavy groups (fewer than shards / heavy), and for each node of the tree the ranges and the
    histogram bin of its cut.
    """
    names = sorted(c for c in groups.columns if c.startswith("d_"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    free = [total / shards] * shards
    big = groups.where(F.col("bytes") > heavy * total / shards).select("key1", "key2", "bytes").orderBy(F.desc("bytes"), "key1", "key2").collect()
    placed = []
    for g in big:
        s = max(range(shards), key=lambda i: (free[i], -i))
        free[s] -= g["bytes"]
        placed.append((g["key1"], g["key2"], s))
    free = [max(x, 0.0) for x in free]
    light = groups.where(F.col("bytes") <= heavy * total / shards).withColumn("spread", F.pmod(F.xxhash64("key1", "key2", F.lit(9)), F.lit(bins)))

    nodes = {0: (0, shards)}  # number: the shards below it, from and up to
    light = light.withColumn("node", F.lit(0))
    while any(b - a > 1 for a, b in nodes.values()):
        ranges = {r["node"]: r for r in light.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[F.min(n).alias(f"{n}_low") for n in names], *[F.max(n).alias(f"{n}_high") for n in names]).collect()}
        cuts, after = {}, {}
        for node, (a, b) in nodes.items():
            half = (a + b) // 2
            if b - a > 1:
                after[2 * node + 1], after[2 * node + 2] = (a, half), (half, b)
            else:
                after[2 * node + 1] = (a, b)
            if b - a > 1 and node in ranges:
                r = ranges[node]
                widest = max(names, key=lambda n, r=r: (r[f"{n}_high"] - r[f"{n}_low"], n))
                room = sum(free[a:b])
                part = sum(free[a:half]) / room if room else 0.5
                cuts[node] = (widest, r[f"{widest}_low"], r[f"{widest}_high"], part * r["bytes"])

        def choose(of, otherwise, cuts=cuts):
            return reduce(lambda c, n: c.when(F.col("node") == n, of(n)), list(cuts)[1:], F.when(F.col("node") == next(iter(cuts)), of(next(iter(cuts))))).otherwise(otherwise) if cuts else otherwise

        def bin_of(n, cuts=cuts):
            name, low, high, _ = cuts[n]
            return F.least(F.floor((F.col(name) - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1)).cast("long")

        light = light.withColumn("bin", choose(bin_of, F.lit(0)))

        def cut_of(rows: DataFrame, column: str, used: Column) -> dict[int, tuple[int, float]]:
            """Of each node the value of the column at which the running sum passes what is wanted, and the sum before it."""
            sums = rows.groupBy("node", column).agg(F.sum("bytes").alias("bytes"))
            w = Window.partitionBy("node").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
            sums = sums.withColumn("sum", F.sum("bytes").over(w)).withColumn("wanted", choose(lambda n: F.lit(float(cuts[n][3])), F.lit(-1.0)) - used)
            found = sums.where("sum >= wanted").groupBy("node").agg(F.min(F.struct(column, (F.col("sum") - F.col("bytes")).alias("before"))).alias("at"))
            return {r["node"]: (r["at"][0], float(r["at"][1])) for r in found.collect()}

        first = cut_of(light, "bin", F.lit(0.0)) if cuts else {}
        at = choose(lambda n: F.lit(int(first[n][0])) if n in first else F.lit(bins), F.lit(bins))
        inside = light.where(F.col("bin") == at)
        second = cut_of(inside, "spread", choose(lambda n: F.lit(first[n][1] if n in first else 0.0), F.lit(0.0))) if cuts else {}
        spread_at = choose(lambda n: F.lit(int(second[n][0])) if n in second else F.lit(bins), F.lit(bins))
        right = (F.col("bin") > at) | ((F.col("bin") == at) & (F.col("spread") > spread_at))
        light = cut(light.withColumn("node", (2 * F.col("node") + F.when(right, 2).otherwise(1)).cast("int")).drop("bin"))
        nodes = after
    shard = reduce(lambda c, n: c.when(F.col("node") == n, nodes[n][0]), list(nodes)[1:], F.when(F.col("node") == next(iter(nodes)), nodes[next(iter(nodes))][0]))
    assigned = light.select("key1", "key2", shard.cast("int").alias("shard"))
    if placed:
        assigned = assigned.unionByName(groups.sparkSession.createDataFrame(placed, "key1 long, key2 long, shard int"))
    return assigned


def shard(docs: DataFrame, shards: int = SHARDS, bins: int = BINS) -> DataFrame:
    """Per row of docs: doc_id, size (UTF-8 bytes + 1), text_crc32, shard (from 0) and slot (from 0 without gaps in each shard).

    The law is `bytes`: the shards' sums of size are near equal, and equal texts share a shard. A null text counts as an
    empty one. Repeated rows have slots of their own; an empty table gives an empty result. Slots go by blocks of ids, in
    each block by id, so no task orders a whole shard.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2"), *[c.alias(n) for n, c in _dimensions(text).items()])
    rows = cut(rows)
    dims = sorted(c for c in rows.columns if c.startswith("d_"))
    groups = cut(rows.groupBy("key1", "key2").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(d) for d in dims]))
    rows = rows.join(split_texts(groups, shards, bins), ["key1", "key2"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "key1"), F.lit(BLOCKS)))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_first(), "key1", "key2")
    rows = rows.join(F.broadcast(counts), ["shard", "block"])  # shards * BLOCKS rows at most
    slot = F.row_number().over(own) - 1 + F.col("before")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
