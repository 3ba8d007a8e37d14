"""The pipeline's stages in sequence, and the classifier against loops."""

import pickle
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import toxicity

# --- classifier


def _features(texts):
    return list(toxicity.features(texts))


def test_convolution_and_pooling_against_loops():
    r = np.random.default_rng(2)
    texts = ["one two three", "", "x", None, "a b c d e f g h", "Ünï, wörd! one two", "two " * 30]
    e = r.normal(0, 1, (toxicity.BUCKETS + 1, toxicity.DIM))
    e[toxicity._PAD] = 0
    filters = {w: r.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS}
    total = toxicity.FILTERS * len(toxicity.WIDTHS)
    m = toxicity.Model(e, filters, r.normal(0, 1, total), r.normal(0, 1, total), 0.3, (1.4, -0.2))
    scores = m.score(texts)
    at = 0
    for buckets, begins in _features(texts):
        pools, places = m.pooled(buckets, begins, where=True)
        for n, first in enumerate(begins):
            last = begins[n + 1] if n + 1 < len(begins) else len(buckets)
            words = [sum(e[b] for b in buckets[i]) for i in range(first, last)]
            pooled, k = [], 0
            for w, f in filters.items():
                for g in range(toxicity.FILTERS):
                    found = [sum(float(words[i + j] @ f[j, :, g]) for j in range(w)) for i in range(len(words) - w + 1)]
                    pooled.append(max(found, default=-np.inf))  # a text without words has fewer places than the widest filter
                    assert not found or abs(pools[n, k] - max(found)) < 1e-9 and places[n, k] - first == int(np.argmax(found))
                    k += 1
            z = sum(max(p + b, 0) * o for p, b, o in zip(pooled, m.bias, m.out, strict=True)) + m.offset
            assert abs(scores[at] - 1 / (1 + np.exp(-(1.4 * z - 0.2)))) < 1e-9
            at += 1
    assert at == len(texts) and scores[1] == scores[3]


def test_a_step_follows_the_gradient():
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 12))) for _ in range(24)]
    labels = np.array([i % 3 == 0 for i in range(24)], float)
    rate = 2e-5  # so small that embeddings, which move first, hardly do
    before, after = (toxicity.fit(texts, labels, epochs=1, batch=64, rate=x, seed=4) for x in (0.0, rate))

    def loss(m):
        z = m.raw(texts)
        return float(np.mean(np.logaddexp(0, z) - labels * z) + 0.5e-4 * (m.out.astype(float) ** 2).sum())

    wide = lambda m: toxicity.Model(m.embedding.astype(float), {w: f.astype(float) for w, f in m.filters.items()}, m.bias.astype(float), m.out.astype(float), float(m.offset))

    def numeric(get, index):
        """The slope of the loss, or 0 at a kink of it, where a maximum changes or a unit begins to act."""
        out = []
        for d in (1e-5, 0.0, -1e-5):
            m = wide(before)
            get(m)[index] += d
            out.append(loss(m))
        up, down = (out[0] - out[1]) / 1e-5, (out[1] - out[2]) / 1e-5
        return (up + down) / 2 if abs(up - down) < 0.01 * abs(up) else 0.0

    def of_step(old, new):
        """The gradient whose first step of the adaptive rate this is."""
        moved = (float(old) - float(new)) / rate
        return np.sign(moved) * np.sqrt(1e-3) * abs(moved) / np.sqrt(max(1 - moved**2, 1e-9))

    checked = 0
    for get in (lambda m: m.bias, lambda m: m.out, *[lambda m, w=w: m.filters[w] for w in toxicity.WIDTHS]):
        old, new = get(before), get(after)
        for index in np.ndindex(old.shape):
            want = numeric(get, index)
            if 2e-3 < abs(want) < 0.05 and abs(old[index]) < 0.3:  # larger parameters have too few digits for such a step
                assert abs(of_step(old[index], new[index]) - want) < 0.1 * abs(want) + 1e-4
                checked += 1
    assert checked > 30
    assert loss(after) < loss(before)


def test_model_travels_with_what_training_saw():
    """Before, every copy, the driver's too, held and sent all rows of the embedding."""
    r = random.Random(3)
    texts = [" ".join([f"w{r.randrange(300)}" for _ in range(20)] + ["vile"] * (i % 2)) for i in range(200)]
    model = toxicity.fit(texts, np.arange(200) % 2, epochs=1)
    sent = pickle.dumps(model)
    assert len(sent) < toxicity.BUCKETS * toxicity.DIM * 2 / 20
    there = pickle.loads(sent)
    assert pickle.dumps(there) == sent and "embedding" not in there.__dict__  # a copy that scores nothing builds no table
    assert np.array_equal(there.embedding, model.embedding.astype(np.float16).astype(np.float32))
    whole = toxicity.Model(model.embedding, model.filters, model.bias, model.out, model.offset)  # nothing known of training
    more = [*texts, "words never seen", "", None]
    assert np.array_equal(pickle.loads(pickle.dumps(whole)).score(more), there.score(more))


# --- pipeline


def test_stages_in_sequence(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    clean = {i: " ".join(word() for _ in range(40)) for i in range(60)}
    item = " ".join(word() for _ in range(14))
    rows = [(i, t, "en", r.choice(["a", "b", None]), 1, i % 2, "x") for i, t in clean.items()]
    rows += [(100 + i, clean[i] + " more", "en", "a", None, 0, "y") for i in range(5)]  # near copies of 0 to 4
    rows += [(200, clean[9] + " " + item + " end", "de", "a", 1, 1, None), (201, None, None, None, None, None, None), (202, "", "en", "b", 0, 1, "z"), (None, " ".join(word() for _ in range(30)), "en", "b", 0, 1, "z")]
    rows += [rows[7], rows[8], rows[8]]  # repeated rows
    rows += [(300 + i, " ".join([word() for _ in range(20)] + ["vile" + r.choice("abc")]), "en", "b", 1, 0, "t") for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, shard string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    labels = [(i, 1, 0) for i in range(60)] + [(300 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: {x.doc_id for x in df.select("doc_id").distinct().collect()}
    every, kept = set(clean) | {100, 101, 102, 103, 104, 200, 201, 202, None}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = ids(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        if name == "toxicity":
            assert kept[name] - set(range(300, 340)) == every and len(kept[name] & set(range(300, 340))) < 8
        if name == "near_duplicates":
            assert kept[name] & every == every - {100, 101, 102, 103, 104} and docs.where("doc_id IN (7, 8)").count() == 2
        if name == "decontamination":
            assert kept[name] & every == every - {100, 101, 102, 103, 104, 200}
    sharded = docs.collect()
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    assert len(sharded) == mixed.count() and {x.shard for x in sharded} <= set(range(16))
    assert sorted(x.slot for x in sharded if x.shard == 0) == list(range(sum(x.shard == 0 for x in sharded)))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0, name
    assert spark.read.parquet(str(tmp_path / "mixing")).where(F.col("doc_id") == 201).count() == 1
