"""Convolutional text classifier for toxicity: hashed word embeddings, several filter widths, max pooling, trained in numpy.

A word's vector is the sum of the hashed vectors of the word and of its first four and five bytes. Filters of width 1, 2 and 3
slide over the word vectors of the whole text; each filter's maximum feeds a logistic unit. The model is fitted in one
task to a bounded sample of labelled rows. All other labelled rows outside the held-out fold are scored on the executors; histograms of
these scores calibrate the model and set a rejection threshold for each language. Scoring runs over Arrow batches on the executors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, free_shuffles

#: The classifier is fitted to at most this many labelled rows of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 5000
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 18, 16, 8, (1, 2, 3), (4, 5)
CUT = 0.7
PIECE_BYTES = 1 << 20
#: Cells of the score histograms: CELLS to a unit of the logit, within -SPAN to SPAN.
CELLS, SPAN = 256, 64
LOGITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text_hash", T.LongType()), T.StructField("z", T.DoubleType())])
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

_BYTE = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_PAD = BUCKETS  # one more row of the embedding, always zero


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pieces of the texts: bucket numbers (words, 1 + prefixes), each text followed by padding, and where each text begins."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = 0
    while first < len(raw):
        last, total = first, 0
        while last < len(raw) and (last == first or total + len(raw[last]) <= PIECE_BYTES):
            total += len(raw[last])
            last += 1
        part = raw[first:last]
        data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        letter = _LETTER[data]
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        starts = np.flatnonzero(begins)
        ends = np.cumsum([len(t) + 1 for t in part])
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        columns = []
        if len(starts):
            at = np.arange(len(data)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
            at[~letter] = 0
            with np.errstate(over="ignore"):
                powers = np.multiply.accumulate(np.full(int(at.max()) + 1, 0xD6E8FEB86659FD93, np.uint64))
                values = np.where(letter, _BYTE[data] * powers[at], np.uint64(0))
                for k, most in enumerate((None, *PREFIXES)):
                    sums = np.add.reduceat(values if most is None else np.where(at < most, values, np.uint64(0)), starts)
                    columns.append((((sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)) >> np.uint64(46)).astype(np.int32))
        pad = max(WIDTHS) - 1
        where = np.arange(len(starts)) + np.repeat(np.arange(len(part)) * pad, counts)
        buckets = np.full((len(starts) + pad * len(part), 1 + len(PREFIXES)), _PAD, np.int32)
        for k, c in enumerate(columns):
            buckets[where, k] = c
        yield buckets, np.concatenate([[0], np.cumsum(counts + pad)[:-1]]).astype(np.int64)
        first = last


def _start(rng: np.random.Generator) -> np.ndarray:
    """The embedding before training; drawn in blocks, so that the doubles of all rows are never there at once."""
    e = np.empty((BUCKETS + 1, DIM), np.float32)
    for first in range(0, len(e), 1 << 14):
        e[first : first + (1 << 14)] = rng.normal(0, 0.05, e[first : first + (1 << 14)].shape)
    return e


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Where given, the rows of the embedding that training saw; the others are as drawn from seed, but for their first dimension, 0.
    seen: np.ndarray | None = None
    seed: int = 5

    def __getstate__(self) -> dict:
        """The embedding, most of the model, travels in half precision, and only the rows that training saw; what is scored anywhere has gone that way once."""
        state = dict(self.__dict__)
        if "embedding" in state:
            e = state.pop("embedding")
            state["rows"] = (e if self.seen is None else e[self.seen]).astype(np.float16)
        return state

    def __getattr__(self, name: str):
        """A model that has travelled builds its embedding when it first scores, which the driver's copy never does."""
        if name != "embedding" or "rows" not in self.__dict__:
            raise AttributeError(name)
        rows = self.__dict__.pop("rows")
        if self.seen is None:
            self.embedding = rows.astype(np.float32)
        else:
            e = _start(np.random.default_rng(self.seed))
            e[:, 0] = 0
            for first in range(0, len(e), 1 << 14):
                e[first : first + (1 << 14)] = e[first : first + (1 << 14)].astype(np.float16)
            e[self.seen] = rows
            self.embedding = e
        return self.embedding

    def pooled(self, buckets: np.ndarray, begins: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each text's maximum of each filter, and (if asked) at which word."""
        x = self.embedding[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            x += self.embedding[buckets[:, k]]
        pools, places = [], []
        for w, f in self.filters.items():
            y = x @ f[0]
            for j in range(1, w):
                y[:-j] += x[j:] @ f[j]
            for j in range(1, w):  # windows that would run into the next text
                y[np.r_[begins[1:], len(x)] - j] = -np.inf
            pools.append(np.maximum.reduceat(y, begins, axis=0))
            if where:
                ends = np.r_[begins[1:], len(x)]
                places.append(np.stack([y[a:b].argmax(0) + a for a, b in zip(begins, ends, strict=True)]))
        return np.concatenate(pools, 1), np.concatenate(places, 1) if where else None

    def logits(self, buckets: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(buckets, begins)[0] + self.bias, 0) @ self.out + self.offset

    def raw(self, texts: list[str | None]) -> np.ndarray:
        found = [self.logits(*f) for f in features(texts)]
        return np.concatenate(found).astype(np.float64) if found else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.raw(texts)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))


def _one_by_one(texts: list[str]) -> list[np.ndarray]:
    out = []
    for buckets, begins in features(texts):
        out += np.split(buckets, begins[1:])
    return out


def fit(texts: list[str], labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Model:
    """Train on texts with labels 0 and 1; the embedding's first dimension starts as the bucket's smoothed log odds."""
    rng = np.random.default_rng(seed)
    docs = _one_by_one(texts)
    labels = np.asarray(labels, np.float64)
    seen = np.zeros((2, BUCKETS + 1))
    for d, y in zip(docs, labels, strict=True):
        seen[int(y), np.unique(d)] += 1
    n = [max(1, (labels == y).sum()) for y in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds *= seen.sum(0) / (seen.sum(0) + 5)
    e = _start(rng)
    e[:, 0] = np.clip(odds, -4, 4) / 4
    e[_PAD] = 0
    filters = {w: rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][0, 0] = np.abs(filters[w][0, 0]) + 0.5
    total = FILTERS * len(WIDTHS)
    m = Model(e, filters, np.zeros(total, np.float32), np.full(total, 0.1, np.float32), -1.0, seen=np.flatnonzero(seen.any(0)).astype(np.int32), seed=seed)
    squares = {"e": np.zeros(BUCKETS + 1, np.float32), "f": {w: np.full_like(f, 1e-3) for w, f in filters.items()}, "b": np.full(total, 1e-3, np.float32), "o": np.full(total, 1e-3, np.float32), "c": 1e-3}
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for first in range(0, len(order), batch):
            ids = order[first : first + batch]
            begins = np.concatenate([[0], np.cumsum([len(docs[i]) for i in ids])[:-1]]).astype(np.int64)
            buckets = np.concatenate([docs[i] for i in ids])
            pooled, places = m.pooled(buckets, begins, where=True)
            hidden = np.maximum(pooled + m.bias, 0)
            z = hidden @ m.out + m.offset
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[ids]) / len(ids)).astype(np.float32)
            to_hidden = error[:, None] * m.out * (hidden > 0)
            grad_out = hidden.T @ error + 1e-4 * m.out
            grad_bias, grad_offset = to_hidden.sum(0), float(error.sum())
            for n_w, w in enumerate(WIDTHS):
                g = to_hidden[:, n_w * FILTERS : (n_w + 1) * FILTERS]
                at = places[:, n_w * FILTERS : (n_w + 1) * FILTERS]
                grad_f = np.zeros_like(m.filters[w])
                for j in range(w):
                    row = np.minimum(at + j, len(buckets) - 1)
                    words = buckets[row]  # texts, filters, features
                    x = m.embedding[words].sum(2)
                    grad_f[j] = np.einsum("tfd,tf->df", x, g)
                    to_x = g[..., None] * m.filters[w][j].T[None]
                    live = np.abs(g) > 0
                    for k in range(words.shape[2]):
                        b, v = words[..., k][live], to_x[live]
                        squares["e"][b] += (v * v).mean(1)
                        np.subtract.at(m.embedding, b, rate * v / (np.sqrt(squares["e"][b])[:, None] + 1e-3))
                squares["f"][w] += grad_f**2
                m.filters[w] -= rate * grad_f / np.sqrt(squares["f"][w])
            m.embedding[_PAD] = 0
            squares["b"] += grad_bias**2
            squares["o"] += grad_out**2
            squares["c"] += grad_offset**2
            m.bias -= rate * grad_bias / np.sqrt(squares["b"])
            m.out -= rate * grad_out / np.sqrt(squares["o"])
            m.offset -= rate * grad_offset / np.sqrt(squares["c"])
    return m


def _scale(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Platt's scale for weighted logits."""
    a, b = 1.0, 0.0
    pos, neg = (weights * labels).sum(), (weights * (1 - labels)).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, h = weights * (p - target), weights * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def calibrate(model: Model, scored: DataFrame, counts: dict[int, int], precision: float = 0.95) -> None:
    """Scale the scores (Platt) on scored rows that weren't trained on (lang, toxic, z), and set each language's rejection threshold: the least score at or above which the weighted precision holds, at least 0.3; 0.7 for languages with under 20 toxic rows.

    Only histograms of the logits come to the driver. counts: all rows of each label, which those of scored stand for.
    """
    z = F.round(F.least(F.greatest("z", F.lit(-float(SPAN))), F.lit(float(SPAN))) * 1e6).cast("long")
    cells = scored.select("lang", "toxic", z.alias("z")).withColumn("cell", F.floor(F.col("z") * CELLS / 1e6)).groupBy("lang", "toxic", "cell")
    cells = cut(cells.agg(F.count("*").alias("n"), F.sum("z").alias("sum"), F.min("z").alias("low")))
    whole = cells.groupBy("toxic", "cell").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).orderBy("cell", "toxic").collect()
    if not whole:
        return
    labels, n = np.array([float(r["toxic"]) for r in whole]), np.array([float(r["n"]) for r in whole])
    weight = {y: counts.get(y, 0) / max(1.0, n[labels == y].sum()) for y in (0, 1)}
    model.scale = _scale(np.array([r["sum"] / r["n"] / 1e6 for r in whole]), labels, n * np.where(labels == 1, weight[1], weight[0]))
    enough = cells.where("lang IS NOT NULL AND toxic = 1").groupBy("lang").agg(F.sum("n").alias("toxic_rows")).where("toxic_rows >= 20").select("lang")
    rows = cells.join(enough, "lang", "left_semi").groupBy("lang", "cell").agg(F.min("low").alias("low"), *[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    own: dict[str, list] = {}
    for r in rows.orderBy("lang", F.desc("cell")).collect():
        own.setdefault(r["lang"], []).append((r["low"] / 1e6, r["n0"] * weight[0], r["n1"] * weight[1]))
    for lang, found in own.items():
        low, clean, toxic = np.array(found).T
        p = 1 / (1 + np.exp(-np.clip(model.scale[0] * low + model.scale[1], -40, 40)))
        good = np.cumsum(toxic) / np.maximum(np.cumsum(clean + toxic), 1e-12) >= precision
        model.thresholds[lang] = float(max(0.3, min(p[good].min() if good.any() else CUT, CUT)))


def in_fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of three quarters of a sample (doc_id, text, toxic) and their ids; nothing where a label has no rows."""
    found = list(batches)
    if not found:
        return
    rows = pa.Table.from_batches(found).sort_by("doc_id")
    ids, texts, y = rows["doc_id"].to_numpy(), rows["text"].to_pylist(), rows["toxic"].to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return
    used = np.flatnonzero(np.arange(len(y)) % 4 != 3)
    model = fit([texts[i] for i in used], y[used])
    yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary()), pa.array([ids[used].tolist()], pa.list_(pa.int64()))], names=["model", "fitted"])


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model | None:
    """Fit on labelled rows whose fold isn't 1: three quarters of a sample (of each label the rows of the smallest id hashes, as many as the parameters say at most); calibrate on all others. None if one of the labels has no rows."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(in_fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, sample_toxic), (0, sample_clean))]
    picked = picks[0].unionByName(picks[1]).select(F.col("doc_id").alias("picked_id"), "toxic")
    own = docs.select("doc_id", "text", "lang").where("text IS NOT NULL")
    rows = own.join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic"))
    # one task holds the sample, whose rows the parameters bound; the driver gets the model and the ids
    done = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic")).repartition(1).mapInArrow(_fit_sample, "model binary, fitted array<long>").collect()
    if not done:
        return None
    model = pickle.loads(done[0]["model"])
    fitted = docs.sparkSession.createDataFrame([(d,) for d in done[0]["fitted"]], "doc_id long")
    del done
    free_shuffles(docs.sparkSession)
    others = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).join(F.broadcast(fitted), "doc_id", "left_anti")
    calibrate(model, _scored(docs, others, sum(counts.values()), model), counts)
    free_shuffles(docs.sparkSession)
    return model


def _scored(docs: DataFrame, labelled: DataFrame, n: int, model: Model, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """lang, toxic and logit z of labelled (doc_id, toxic) documents, one row an id. Texts don't move: with too many ids to broadcast, all texts outside the held-out fold are scored and the logits are joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.where("text IS NOT NULL").where(in_fold(F.col("doc_id")) != 1)
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("text_hash"), "text")
    if n <= broadcast_rows:
        own = own.join(F.broadcast(labelled.select("doc_id")), "doc_id", "left_semi")

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:3], pa.array(shared.value.raw(batch.column(3).to_pylist()))], names=LOGITS.names)

    # of repeated ids one row counts
    best = own.mapInArrow(logits, LOGITS).join(labelled, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text_hash", "lang", "z")).alias("row"))
    return best.select("row.lang", "toxic", "row.z")


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(model.value.score(batch.column(1).to_pylist()))], names=SCORES.names)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs, from its whole text alone; null counts as empty. Without a model the score is 0.

    Repeated rows are scored each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of BUCKETS * DIM half floats at most
    return rows.mapInArrow(partial(_score, model=shared), SCORES)


def reject_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """docs without the rows whose score reaches the threshold of their language (0.7 for languages without one); all columns stay."""
    model = train(docs, labels, **parameters)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"), F.col("lang").alias("__lang"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([shared.value.thresholds.get(x, CUT) for x in batch.column(2).to_pylist()])
            yield batch.filter(pa.array(shared.value.score(batch.column(1).to_pylist()) < least))

    return packed.mapInArrow(keep, packed.schema).select("__row.*")
