"""Exact n-gram Jaccard join by PartEnum signatures, and the classes that its links form.

Sets are dealt into size bands. In a band whose largest set has u shingles, linked sets differ in at most
d = floor(2u(100-p)/(100+p)) shingles. The feature domain is partitioned into n1 = floor(d/2) + 1 + spare parts, each of these
into two, and of the two every subset of one is enumerated: each subset's shingles give one signature. A shingle that differs
spoils one signature, so linked sets of a band have all others in common; how many can differ follows from the size of either
set alone (`promised`). (Three subparts and subsets of two make half as many signatures again.) A set that can be linked to one
of the next band signs there as well. Signatures without shingles tell nothing, and sets that have nothing in common share
them: they are left out of a set that has fewer of them than are promised.

Sets with a common signature are candidates. They are not listed as pairs:

1. Each set is compared with one hub, the set with the most company among those that share its signatures. Groups of near
   copies collapse there, one comparison a set.
2. Of the signatures whose sets are still apart, the shingles are counted: those that only one set has can't be common.
   That, the sizes, and a sketch of each set (for each of SKETCH_BITS places whether an odd number of shingles fall there) bound
   how much two sets differ from below. Only pairs of separate classes that keep these bounds leave the join on the signature,
   and a pair leaves it where none of the signatures just before is common to both, so once or a few times.
3. Every pair that is left is verified on its whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pair_blocks
from .common import arrow_rows, bounded_broadcast, cut, free_shuffles, keep_where
from .components import connected_components
from .shingles import mix, shingle_sets

K, PERCENT = 4, 85
#: Ratio of a band's largest set to its smallest; buckets by which the shingles of a set are counted.
WIDEN, BUCKETS = 1.4, 32
#: Texts of an Arrow batch where whole rows of a corpus are deduplicated.
ARROW_ROWS = 1024
#: Places of a set's sketch, and signatures of a set that are looked back at to tell that a pair has met before.
SKETCH_BITS, BEFORE = 1024, 8
#: Subparts of a part, of which all but one make a signature.
SUBPARTS = 2
#: Upper bits of a hash that are exchanged, and bits for the need of a set beside a signature. Hashes that agree in these bits are
#: taken for equal, which adds candidates and weakens bounds, but loses no link.
HASH_BITS, NEED_BITS = 44, 4

_KEYS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_shingles", "key1", "key2")])
_SHARED = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "need", "signature", "n", "least")])
_COUNTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.ArrayType(T.LongType()))])
_ALONE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("alone", T.IntegerType()), T.StructField("by_bucket", T.ArrayType(T.IntegerType()))])
_PAIRS = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b")])


@lru_cache(maxsize=None)
def bands(most: int) -> tuple[int, ...]:
    """Smallest sizes of the bands, up to the first beyond most."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * WIDEN)))
    return tuple(out)


def plan_of(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, n1, spare) of the bands in which a set of n shingles signs: its own, and the next where a linked set can lie in it."""
    starts = bands(2 * n + 2)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    out = []
    for band in (own, own + 1) if n else ():
        if band == own or 100 * n >= percent * starts[band]:
            largest = starts[band + 1] - 1
            differ = 2 * largest * (100 - percent) // (100 + percent)
            spare = 1 + differ // 32
            # sets that can't differ are equal, and equal sets are one
            if differ:
                out.append((band, differ // 2 + 1 + spare, spare))
    return out


def promised(n: int, band: int, n1: int, spare: int, percent: int) -> int:
    """Signatures in a band, of SUBPARTS * n1, that a set of n shingles and any linked one have in common at least, without shingles or with."""
    largest = min(bands(2 * n + 2)[band + 1] - 1, 100 * n // percent)
    differ = (100 - percent) * (n + largest) // (100 + percent)
    return max(1 + spare, SUBPARTS * n1 - (SUBPARTS - 1) * differ)


def signatures(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The signatures of a set, and how many of them it shares with every linked set at least."""
    n, out, need = len(shingles), [], []
    place, value = mix(shingles, 11), mix(shingles, 12)
    for band, n1, spare in plan_of(n, percent):
        cell = (place % np.uint64(SUBPARTS * n1)).astype(np.int64)
        sums, counts = np.zeros(SUBPARTS * n1, np.uint64), np.bincount(cell, minlength=SUBPARTS * n1)
        with np.errstate(over="ignore"):
            np.add.at(sums, cell, value)
            sums, counts = sums.reshape(n1, SUBPARTS), counts.reshape(n1, SUBPARTS)
            # the subset without subpart j is the part less that subpart
            sums = (sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums).ravel()
            held = (counts.sum(axis=1, keepdims=True) - counts).ravel() > 0
            found = mix(sums + mix(np.arange(SUBPARTS * n1, dtype=np.uint64), band), 77)
        empty, common = SUBPARTS * n1 - int(held.sum()), promised(n, band, n1, spare, percent)
        if empty < common:
            found = found[held]
        # one that keeps its empty signatures shares them with others that do so alone
        need.append(common - empty if empty < common else 1)
        out.append(found)
    return (np.concatenate(out), min(need)) if out else (shingles[:0], 1)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that few texts at once are Python strings."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _keys(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = shingle_sets(batch.column(1).to_pylist(), k)
        n, one, two = zip(*[(len(s), np.sum(mix(s, 3), dtype=np.uint64), np.sum(mix(s, 4), dtype=np.uint64)) for s in sets], strict=True)
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]], names=_KEYS.names)


def _upper(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - HASH_BITS)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], k: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of pairs (signature and need, doc_id)."""

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in _slices(batches):
            lists, need = zip(*[signatures(s, percent) for s in shingle_sets(batch.column(1).to_pylist(), k)], strict=True)
            n = [len(x) for x in lists]
            # a need that is named too small loses nothing
            least = np.minimum(np.array(need, np.int64), 2**NEED_BITS - 1)
            yield _upper(np.concatenate(lists)) << NEED_BITS | np.repeat(least, n), np.repeat(batch.column(0).to_numpy(), n)

    return pair_blocks.by_range(found(), buckets, HASH_BITS + NEED_BITS)


def _shared(table: pa.Table) -> pa.Table:
    """Of the blocks of a bucket, the rows of signatures that several have."""
    x, doc = pair_blocks.pairs(table)
    order = np.argsort(x)
    x, doc = x[order], doc[order]
    signature, need = x >> NEED_BITS, x & (2**NEED_BITS - 1)
    first = np.flatnonzero(np.r_[True, signature[1:] != signature[:-1]])
    n = np.diff(np.r_[first, len(x)])
    # in order of x the first of a signature has the least need
    n, least = np.repeat(n, n), np.repeat(need[first], n)
    keep = n > 1
    return pa.table([c[keep] for c in (doc, need, signature, n, least)], names=_SHARED.names)


def _shingled(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of pairs (shingle, doc_id); two of a shingle are enough to tell that it isn't alone."""

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in _slices(batches):
            lists = list(shingle_sets(batch.column(1).to_pylist(), k))
            yield _upper(np.concatenate(lists)), np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists])

    return pair_blocks.by_range(found(), buckets, HASH_BITS, most=2)


def _only_once(table: pa.Table, buckets: int) -> pa.Table:
    """Of the blocks of a bucket of shingles, blocks of pairs (doc_id, bucket of 0 to BUCKETS - 1) for the shingles that come once; dealt by document."""
    x, doc = pair_blocks.pairs(table)
    order = np.argsort(x)
    x, doc = x[order], doc[order]
    new = np.r_[True, x[1:] != x[:-1]]
    once = new & np.r_[new[1:], True]
    x, doc = x[once], doc[once]
    to = (mix(doc.view(np.uint64), 21) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, to))
    return pa.Table.from_batches([pair_blocks.blocks(to[order], doc[order], x[order] & (BUCKETS - 1))])


def _alone(table: pa.Table) -> pa.Table:
    """Of the blocks of a bucket of documents, how many shingles come once, in all and by bucket."""
    doc, bucket = pair_blocks.pairs(table)
    docs, at = np.unique(doc, return_inverse=True)
    counts = np.bincount(at * BUCKETS + bucket, minlength=len(docs) * BUCKETS).reshape(-1, BUCKETS)
    return pa.table([pa.array(docs), pa.array(counts.sum(axis=1).astype(np.int32)), _rows(counts)], names=_ALONE.names)


def _rows(counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BUCKETS), pa.array(counts.astype(np.int32).ravel()))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A bit for each place: whether an odd number of shingles fall there. Two sets differ in as many shingles as bits at least."""
    odd = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        both = [(np.bincount(_upper(s) & (BUCKETS - 1), minlength=BUCKETS), sketch(s)) for s in shingle_sets(batch.column(1).to_pylist(), k)]
        counts, sketches = (np.array(x) for x in zip(*both, strict=True))
        words = np.arange(len(sketches) + 1, dtype=np.int32) * (SKETCH_BITS // 64)
        yield pa.record_batch([batch.column(0), _rows(counts), pa.ListArray.from_arrays(pa.array(words), pa.array(sketches.ravel()))], names=_COUNTED.names)


def _linked(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    last, s = None, np.zeros(0, np.uint64)
    for batch in _slices(batches):
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if x != last:
                last, s = x, next(shingle_sets([x], k))
            t = next(shingle_sets([y], k))
            if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and len(s):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
        mask = pa.array(keep)
        yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=_PAIRS.names)


def shared_signatures(nodes: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """Rows (doc_id, need, company, signatures): the signatures that several rows have, for documents with enough of them for a link.

    Texts are signed once. All signatures are exchanged, in blocks of a few bytes each, by ranges of their hashes; only those that
    several rows have become rows. company is how many other rows the signatures have in all. A task has all holders of a
    signature at once, at some 30 bytes each.
    """
    dealt = nodes.select("doc_id", "text").mapInArrow(partial(_signed, k=k, percent=percent, buckets=buckets), pair_blocks.BLOCKS)
    shared = dealt.groupBy("bucket").applyInArrow(_shared, _SHARED)
    # a pair shares as many as the lesser need of its two sets
    by_doc = shared.groupBy("doc_id", "need").agg(F.count("*").alias("own"), F.min("least").alias("least"), F.sum(F.col("n") - 1).alias("company"), F.collect_list("signature").alias("signatures"))
    return cut(by_doc.where("own >= least").drop("own", "least"))


def hubs(docs: DataFrame, **limit) -> DataFrame:
    """One pair (a, b) for each document: with the hub of most of its signatures. A signature's hub is its document with the most company."""
    rows = docs.select("doc_id", "company", F.explode("signatures").alias("signature"))
    best = F.max(F.struct("company", (-F.col("doc_id")).alias("minus"))).alias("best")
    named = rows.groupBy("signature").agg(best, F.count("*").alias("n")).where("n > 1")
    named = cut(named.select("signature", (-F.col("best.minus")).alias("hub"), F.col("best.company").alias("weight")))
    stars = rows.join(bounded_broadcast(named, named.count(), **limit), "signature").where("doc_id != hub").groupBy("doc_id", "hub").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    chosen = stars.groupBy("doc_id").agg(F.max_by("hub", F.struct("n", "weight", -F.col("hub"))).alias("hub"))
    return chosen.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"))


def _still_apart(docs: DataFrame, component: DataFrame, **limit) -> DataFrame:
    """Rows (signature, doc_id, need, component, members) of the signatures that several components have."""
    component = component.select(F.col("node").alias("doc_id"), "component")
    docs = docs.join(bounded_broadcast(component, component.count(), **limit), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = docs.select("doc_id", "need", "component", F.explode("signatures").alias("signature"))
    groups = cut(rows.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low != high").select("signature", "members"))
    rows = rows.join(bounded_broadcast(groups, groups.count(), **limit), "signature")
    # a link to another component shows in as many of these signatures as the document needs
    enough = cut(rows.groupBy("doc_id").agg(F.count("*").alias("own"), F.min("need").alias("need")).where("own >= need").select("doc_id"))
    return rows.join(bounded_broadcast(enough, enough.count(), **limit), "doc_id")


def _bounds(rows: DataFrame, texts: DataFrame, k: int, buckets: int, **limit) -> DataFrame:
    """(doc_id, alone, counts, sketch): how many shingles no other document of rows has, the others by bucket, and the sketch of all.

    Only documents of rows are counted, so the bound holds between these. Shingles are exchanged in blocks, and those that come
    once go back to their documents in blocks.
    """
    ids = cut(rows.select("doc_id").distinct())
    # hashed once for the shingles and once for the counts: kept, the shingles would need more room than the texts
    texts = texts.join(bounded_broadcast(ids, ids.count(), **limit), "doc_id", "left_semi").select("doc_id", "text")

    def only_once(table: pa.Table) -> pa.Table:
        return _only_once(table, buckets)

    once = texts.mapInArrow(partial(_shingled, k=k, buckets=buckets), pair_blocks.BLOCKS).groupBy("bucket").applyInArrow(only_once, pair_blocks.BLOCKS)
    alone = once.groupBy("bucket").applyInArrow(_alone, _ALONE)
    counted = texts.mapInArrow(partial(_counted, k=k), _COUNTED)
    left = F.coalesce(F.zip_with("counts", "by_bucket", lambda c, x: c - x), F.col("counts"))
    return counted.join(alone, "doc_id", "left").select("doc_id", F.coalesce("alone", F.lit(0)).alias("alone"), left.alias("counts"), "sketch")


def _pairs_left(apart: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of separate components that have a signature in common and that the bounds of facts allow to link; some come again."""
    facts = facts.select("doc_id", "alone", "size", "sketch")
    # one document alone that holds more shingles of its own than a link allows has none
    hopeless = 100 * F.col("alone") > (100 - percent) * F.col("size")
    apart = apart.join(facts.drop("sketch"), "doc_id", "left").where((F.col("members") == 2) | F.coalesce(~hopeless, F.lit(True)))
    by_doc = apart.groupBy("doc_id", "component").agg(F.sort_array(F.collect_set("signature")).alias("signatures"))
    met = F.transform("signatures", lambda x, i: F.struct(x.alias("signature"), F.slice("signatures", F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE))).alias("before")))
    rows = cut(by_doc.join(facts, "doc_id", "left")).withColumn("met", F.explode_outer(met)).select("met.*", "doc_id", "component", "alone", "size", "sketch")

    def side(s: str) -> DataFrame:
        return rows.select("signature", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns[1:]])

    total = F.col("size_a") + F.col("size_b")
    apart_by = lambda differ: F.coalesce((100 + percent) * differ <= (100 - percent) * total, F.lit(True))
    bits = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    # unknown where a document has several texts or no crowded signature: then there is no bound
    near: Column = apart_by(F.col("alone_a") + F.col("alone_b")) & apart_by(F.abs(F.col("size_a") - F.col("size_b"))) & apart_by(bits)
    joined = side("a").join(side("b"), "signature").where(F.expr("doc_id_a < doc_id_b AND component_a != component_b") & near & ~F.arrays_overlap("before_a", "before_b"))
    return joined.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))


def similarity_classes(docs: DataFrame, k: int = K, percent: int = PERCENT, broadcast_rows: int | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Two documents link when 100 * |intersection| >= percent * |union| of their k-word shingle sets. Words are runs without
    ASCII white space after lower-casing A-Z; a text of fewer words than k is one shingle. A text without words, or null, has
    an empty set, links with nothing and is its own component. A document with a null doc_id links with nothing and has a
    null component. Repeated rows of one doc_id are one node, also with different texts; each row is returned, and is its own
    component where its text is empty. Shingles are compared by 64-bit hashes.
    """
    limit = {} if broadcast_rows is None else {"limit": broadcast_rows}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = cut(texts.mapInArrow(partial(_keys, k=k), _KEYS))
    some = keys.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = cut(some.groupBy("key1", "key2").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles")))
    nodes = texts.join(bounded_broadcast(sets.select(F.col("first_id").alias("doc_id")).distinct(), sets.count(), **limit), "doc_id", "left_semi")
    sizes = some.groupBy("doc_id").agg(F.max("n_shingles").alias("size"), (F.min("key1") != F.max("key1")).alias("several"))

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. Of the texts only those of a pair are moved: each b once to where its a is."""
        pairs = cut(pairs)
        n = pairs.count()
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(bounded_broadcast(pairs, n, **limit), "b")
        firsts = bounded_broadcast(pairs.select("a").distinct(), n, **limit)
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(firsts, "a", "left_semi")
        return cut(right.join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(partial(_linked, k=k, percent=percent), _PAIRS).distinct())

    shingles = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = pair_blocks.buckets_for(shingles)
    shared = shared_signatures(nodes, k, percent, buckets).where(F.size("signatures") >= F.col("need"))
    free_shuffles(docs.sparkSession)
    links = verify(hubs(shared, **limit))
    free_shuffles(docs.sparkSession)
    several = cut(sizes.where("several").select("doc_id"))
    if not several.isEmpty():
        # the sets of one document are one node
        own = some.join(several, "doc_id", "left_semi").join(sets.drop("n_shingles"), ["key1", "key2"]).select("doc_id", "first_id")
        own = own.join(own.groupBy("doc_id").agg(F.min("first_id").alias("a")), "doc_id").where("a != first_id")
        links = cut(links.unionByName(own.select("a", F.col("first_id").alias("b"))))
    component = connected_components(links)
    apart = cut(_still_apart(shared, component, **limit))
    free_shuffles(docs.sparkSession)
    crowded = apart.where("members > 2")
    facts = cut(_bounds(crowded, texts, k, buckets, **limit).join(sizes.where("NOT several").select("doc_id", "size"), "doc_id"))
    free_shuffles(docs.sparkSession)
    more = verify(_pairs_left(apart, facts, percent).distinct())
    if not more.isEmpty():
        links = cut(links.unionByName(more).distinct())
        component = connected_components(links)

    found = sets.join(component, sets["first_id"] == component["node"], "left").select("key1", "key2", F.coalesce("component", "first_id").alias("component"))
    with_ids = keys.join(found, ["key1", "key2"], "left")
    of_id = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return with_ids.select("doc_id", "n_shingles", of_id.alias("component_id"))


def keep_one_of_each_class(docs: DataFrame, **parameters) -> DataFrame:
    """docs with the document of the smallest doc_id of each class; all columns stay, and documents without an id stay.

    Repeated rows of a kept doc_id collapse to one of them.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        classes = cut(similarity_classes(docs, **parameters))
    gone = cut(classes.where("doc_id != component_id").select("doc_id").distinct())
    kept = keep_where(docs, gone, gone.count(), anti=True)
    repeated = cut(classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    packed = keep_where(kept, repeated).select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"))
    single = packed.groupBy("__id").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*")
    return keep_where(kept, repeated, anti=True).unionByName(single)
