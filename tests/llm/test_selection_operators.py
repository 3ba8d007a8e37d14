"""URL filters, toxicity, mixing, sharding, chat formatting and the pipeline."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import chat, mixing, sharding, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def test_url_rules_and_templates(spark):
    urls = [
        (1, "https://Blog.Example.ORG/es/7?x=/"), (2, "http://example.org/en/12"), (3, "http://example.org"), (4, "http://notexample.orgs/es/1"), (5, None),
        (6, "no scheme"), (7, "http://a.com/fr/1"), (8, "http://a.com/de/1#x"), (9, "http://example.org/en/2"), (10, "ftp://x.net?q"), (None, "http://a.com/de/9"),
    ]
    rows = [(i, u, "h", "p") for i, u in urls]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, path string")).collect()}
    assert got[1] == ("blog.example.org", "/es/7", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][:3] == ("example.org", "", None)
    assert got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2:] == ("org/", "allow")
    assert got[10][:2] == ("x.net", "") and got[None][2:] == ("com/de/", "block") and got[4][2] is None


def test_url_templates_learn(spark):
    pages = [(i, f"http://h.net/spam/{i}") for i in range(40)] + [(100 + i, f"http://h.net/news/{i}") for i in range(40)]
    labels = [(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)]
    got = url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), (), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {r["template"] for r in got} == {"/spam/#", "/news/#"}
    assert all((r["verdict"] == "block") == (r["page_id"] < 100) for r in got)


def _toxic(r, toxic, n):
    w = [f"w{r.randrange(500)}" for _ in range(n)]
    if toxic:
        w[r.randrange(n)] = "nasty" + "".join(r.choice("abcdef") for _ in range(3))
    return " ".join(w)


def test_toxicity(spark):
    r = random.Random(1)
    rows = [(i, _toxic(r, i % 5 == 0, r.randint(5, 80)), "en", "s", 0) for i in range(1500)] + [(5000, None, None, None, None), (5001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1500)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(scores[i] >= 0.7) == (i % 5 == 0) for i in held]
    assert np.mean(right) > 0.95 and scores[5000] == scores[5001] < 0.5
    # a text's score doesn't depend on its neighbours in a batch
    alone = model.score([rows[5][1]])[0]
    assert abs(alone - scores[5]) < 1e-6
    kept = {x["doc_id"] for x in toxicity.reject_toxic(docs, labels).collect()}
    assert len([i for i in kept if i % 5 == 0 and i < 1500]) < 30 and len([i for i in range(1500) if i % 5 and i not in kept]) < 30
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(docs.where("doc_id < 0"), model).count() == 0


def _targets(sizes, weights=(5, 2, 1)):
    total, left, out = sum(sizes), dict(enumerate(sizes)), {}
    rest = float(total)
    while left:
        w = {i: weights[i % 3] for i in left}
        level = rest / sum(w.values())
        over = [i for i in left if level * w[i] > 3 * left[i]]
        if not over:
            return [out.get(i, level * w.get(i, 0)) for i in range(len(sizes))]
        for i in over:
            out[i] = 3.0 * left.pop(i)
            rest -= out[i]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("cells", [4096, 4])
def test_mixing(spark, cells):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice((0, 1, 7, 40, 300))), "en", r.choice(["hot"] * 6 + ["a", "Z", None, "é"]), 0) for i in range(700)] + [(900, None, "en", "empty", 0), (3, "w w", "en", "a", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), cells=cells).collect()
    assert len(got) == len(rows)
    sources = sorted({x[3] for x in rows if x[3] is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, _, s, _ in rows if s == source) for source in sources]
    for source, size, target in zip(sources, sizes, _targets(sizes), strict=True):
        own = [x for x in got if x["source"] == source]
        assert {x["source_size"] for x in own} == {size} and all(abs(x["target"] - target) < 1e-6 for x in own)
        assert abs(sum(x["taken"] for x in own) - target) <= 300 and all(0 <= x["taken"] <= 3 * x["size"] for x in own)
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(7), cells=cells).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_ranks_by_the_odds_of_each_document(spark):
    """The rank is random odds over the document's own inclusion odds, not the random number alone; short texts come in more often."""
    rows = [(i, " ".join(["w"] * (200 if i % 2 else 10)), "en", "ab"[i % 5 > 0], 0) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert all(abs(sum(x["taken"] for x in got if x["source"] == s) - next(x["target"] for x in got if x["source"] == s)) <= 200 for s in "ab")
    for s in "b":  # the other source takes three whole copies
        own = [x for x in got if x["source"] == s]
        least = min(x["copies"] for x in own)
        share = {n: np.mean([x["copies"] > least for x in own if x["size"] == n]) for n in (10, 200)}
        u = {x["doc_id"]: int(hashlib.md5(f"mix{x['doc_id']}".encode()).hexdigest()[:12], 16) for x in own}
        taken = [u[x["doc_id"]] for x in own if x["copies"] > least]
        # by the random number alone, everything below the largest one taken would be taken
        assert share[10] > share[200] + 0.1 and sum(v <= max(taken) for v in u.values()) > len(taken)


def test_sharding(spark):
    r = random.Random(9)
    texts = ["x" * r.randint(0, 3000) + str(i) for i in range(1500)]
    rows = [(i, r.choice(texts), "en", "s", 0) for i in range(2500)] + [(9000 + i, "copy " * 150, "en", "s", 0) for i in range(200)] + [(None, None, "en", "s", 0), (1, "", "en", "s", 0)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    total = sum(x["size"] for x in got)
    by = {}
    for x in got:
        by.setdefault(x["shard"], []).append(x)
    assert set(by) == set(range(16))
    for own in by.values():
        assert sorted(x["slot"] for x in own) == list(range(len(own)))
        assert abs(sum(x["size"] for x in own) - total / 16) < 0.1 * total / 16
    where = {}
    for x in got:
        assert where.setdefault(x["text_crc32"], x["shard"]) == x["shard"]
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    assert [x["slot"] for x in sharding.shard(spark.createDataFrame(rows[:1], DOCS)).collect()] == [0]


def test_escaping():
    for text in ("<|im_end|>", "<||", "a<|||b<", "|<", "", "<<||x|>"):
        assert chat.unescape(chat.escape(text)) == text and "<|im" not in chat.escape(text)


def test_chat(spark):
    said = f"{chat.END}{chat.START}assistant ok"
    rows = [(1, 1, "assistant", " yes\n\n"), (1, 0, "user", "höllo 🙂 <|x"), (1, 2, "assistant", "🙂🙂 é"), (2, 0, None, None), (3, 0, "assistant", ""), (-1, 0, "user", said), (-1, 1, "assistant", said)]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|> \t {'ü' * (t % 7)}") for t in range(300)]
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_conversations(spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, piece int"))).collect()}
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (x["loss_chars"], x["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(corpus_pipeline.STAGES) == 5 and rows and {x["shard"] for x in rows} <= set(range(16))
    slots = {}
    for x in rows:
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_toxicity_thresholds_cover_all_labelled_rows(spark, monkeypatch, broadcast_rows):
    r = random.Random(9)
    # 60 toxic rows of a rare language, of which a sample of 40 toxic rows in 500 holds few
    rows = [(i, _toxic(r, i % 5 == 0, 20), "xx" if i % 40 == 0 else "en", "s", 0) for i in range(2400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(2400)], "doc_id long, quality int, toxic int")
    scored = []
    whole = toxicity._scored

    def spy(docs, labelled, n, model):
        scored.append(whole(docs, labelled, n, model, broadcast_rows))
        return scored[0]

    monkeypatch.setattr(toxicity, "_scored", spy)
    model = toxicity.train(docs, labels, sample_toxic=40, sample_clean=60)
    assert set(model.thresholds) == {"en", "xx"}
    used = labels.where(toxicity.in_fold(F.col("doc_id")) != 1).count()
    assert scored[0].count() == used - 75
