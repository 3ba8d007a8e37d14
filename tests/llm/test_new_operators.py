"""Centroid clustering, packing and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quirefold.llm import ball_tree, conversation_repair, packing

# --- clustering -------------------------------------------------------------------------------------------------------------


def _lloyd(rows, k=16, rounds=3):
    kept = [(i, [max(min(int(np.floor(np.float64(x) * 64)), 1 << 27), -(1 << 27)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    z = [v for _, v in sorted(kept, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(z))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        z = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(z)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, j, d in found:
        by[j] += d
    return sorted(((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, z[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def _clustered(spark, rows, extra="", tree=ball_tree.TREE):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)
    return sorted((tuple(r) for r in ball_tree.with_inertia(*ball_tree.cluster(df, tree=tree)).collect()), key=str)


def test_clustering_against_plain_rounds(spark):
    r = np.random.default_rng(5)
    centers = r.normal(0, 2, (9, 64))
    rows = [(int(i), [float(x) for x in np.float32(centers[i % 9] + r.normal(0, 0.05 + (i % 3), 64))]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # one very common vector
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]  # repeated ids, a null id
    rows += [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 63 + [None]), (6, [0.5] * 63 + [float("nan")]), (7, [0.5] * 63 + [float("inf")]), (8, [1e30] + [0.0] * 63), (9, [-1e30] + [1e20] * 63)]
    assert _clustered(spark, rows, tree=128) == _lloyd(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 40])
def test_clustering_of_few_or_equal_vectors(spark, n):
    rows = [(i, [0.25 * (i % 2)] * 64, "x", 1.0) for i in range(n)]
    assert _clustered(spark, rows, ", cluster string, distance double") == _lloyd([x[:2] for x in rows])


def test_balls_go_whole_and_hold_their_vectors():
    r = np.random.default_rng(1)
    points = (np.repeat(r.integers(-500, 500, (8, 64)), 200, axis=0) + r.integers(-2, 3, (1600, 64))).astype(np.int32)
    order, balls = ball_tree.build(points)
    names = ("first", "past", "left", "right", "radius", "sums")
    b = dict(zip(names, map(np.array, zip(*balls, strict=True)), strict=True))
    inside = points[order]
    for first, past, radius, total in zip(b["first"], b["past"], b["radius"], b["sums"], strict=True):
        assert (inside[first:past].sum(axis=0) == total).all()
        assert np.sqrt(((inside[first:past] - total / (past - first)) ** 2).sum(axis=1)).max() <= radius + 1e-9
    whole, rows, nearest = ball_tree.descend(inside, b, points[::200].astype(np.int64))
    assert sum(b["past"][x] - b["first"][x] for x, _ in whole) + len(rows) == len(points)
    assert len(whole) > 0 and len(rows) < len(points)


# --- packing ----------------------------------------------------------------------------------------------------------------


def _fewest(items, room):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, free):
        if len(free) >= best[0] and i < len(items) or len(free) > best[0]:
            return
        if i == len(items):
            best[0] = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= items[i]}.values():
            free[k] -= items[i]
            go(i + 1, free)
            free[k] += items[i]
        go(i + 1, [*free, room - items[i]])

    go(0, [])
    return best[0]


def _plain_best_fit(items, room):
    free = []
    for x in sorted(items, reverse=True):
        fit = min((f for f in free if f >= x), default=None)
        if fit is not None:
            free.remove(fit)
        free.append((room if fit is None else fit) - x)
    return len(free)


def test_reduction_keeps_the_optimum_and_best_fit_is_plain():
    r, fixed_triples, fixed_all = random.Random(3), 0, 0
    for _ in range(1500):
        room = r.choice([10, 20, 31, 50])
        low = r.choice([1, 2, room // 4, room // 3 + 1])
        items = [r.randint(low, room - 1) for _ in range(r.randint(1, 9))]
        counts = Counter(items)
        fixed, left = packing.reduce_instance(dict(counts), room)
        used = Counter()
        for sizes, times in fixed:
            assert sum(sizes) <= room
            used.update({s: times * n for s, n in Counter(sizes).items()})
            fixed_triples += len(sizes) == 3
            fixed_all += times
        assert used + Counter(left) == counts
        assert sum(t for _, t in fixed) + _fewest(list(Counter(left).elements()), room) == _fewest(items, room)
        patterns = packing.best_fit(dict(counts), room)
        assert sum(t for _, t in patterns) == _plain_best_fit(items, room)
        assert all(sum(s * n for s, n in p) <= room for p, _ in patterns)
    assert fixed_triples > 50 and fixed_all > 3000


WORDS = ["Don't", "stop.", "É", "é", "x́", "日本語", "a,b;", "<|endoftext|>", "12,5", "’s", "ﬁ", "Σας", "...", "word" * 9, "İx", "m'll!", "ŉ"]


def _packed(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    found = packing.pieces(docs, keep_ids=True, chars=3000)  # long texts come in parts
    found = found.cache()
    packed = packing.pack(found).collect()
    return found, packed


def _check(packed, rows, most):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(packing.TOKENIZER), []
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, want)) == sorted(str(tuple(x)[:5]) for x in packed)
    places = defaultdict(list)
    for x in packed:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= most(sum(x["length"] for x in packed))


def test_packing(spark):
    r = random.Random(4)
    text = lambda n: r.choice(["", " ", "\n"]) + "".join(r.choice(WORDS) + r.choice([" ", "\n", "\t", "  ", "　", "\x0b"]) for _ in range(n))
    rows = [(i, text(r.choice([1, 5, 30, 200, 900]))) for i in range(120)] + [(500, None), (501, ""), (502, text(9000)), (None, "a b"), (None, None), (7, "same text"), (7, "same text")]
    rows += [(600 + i, "one very common text") for i in range(300)]
    found, packed = _packed(spark, rows)
    _check(packed, rows, lambda tokens: -(-tokens // 2048) + 1)
    distinct = [x for x in packed if x["doc_id"] == 502]
    whole = packing.sequences(spark.createDataFrame(packed), found.where("doc_id >= 500")).where("size(ids) > 0").collect()
    by_sequence = {x["sequence_id"]: x["ids"] for x in whole}
    full = next(x for x in distinct if x["length"] == 2048)
    assert zlib.crc32(np.array(by_sequence[full["sequence_id"]], "<u4").tobytes()) == full["ids_crc32"]


def test_packing_of_nothing_and_with_other_columns(spark):
    assert _packed(spark, [])[1] == []
    rows = [(1, "a", "x", 3), (2, None, None, None)]
    _check(_packed(spark, rows, "doc_id long, text string, length string, part int")[1], [x[:2] for x in rows], lambda tokens: 1)


def test_words_equal_whole_texts_for_other_tokenizers():
    source = open("/opt/tokenizers/byte_bpe_50k.json", encoding="utf-8").read()
    words = packing.Words(source)
    texts = ["a b, c.", "", "x  y\n"]
    ids, ends = words.encode(pa.array(texts))
    assert not words.by_words
    assert [list(x) for x in np.split(ids, ends[:-1])] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# --- conversation repair ----------------------------------------------------------------------------------------------------

_PREFIX = re.compile(r"s?(ua)*u?")


def _cheapest(initials, faults):
    """The least (cost, audit) by search over whole edit sequences, and the turns kept."""
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        if i < 0:
            return cost, audit, turns
        if i == len(initials) and re.fullmatch(r"(s?(ua)+)?", roles):
            heapq.heappush(heap, (cost, audit, -1, roles, turns))
        nexts = [(2, "I", i, x, (-1, x)) for x in "ua"]
        if i < len(initials):
            extra = int(faults[i] == 1)
            nexts.append((3, "D", i + 1, "", None))
            if faults[i] < 2:
                nexts += [(extra, "K", i + 1, initials[i], (i, ""))] + [(2 + extra, "R", i + 1, x, (i, x)) for x in "ua"]
        for c, e, j, x, turn in nexts:
            if turn is not None and (len(x) != 1 or not _PREFIX.fullmatch(roles + x)):
                continue
            heapq.heappush(heap, (cost + c, audit + e, j, roles + x, turns if turn is None else (*turns, turn)))


def _plain_report(rows, ids):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv in set(ids):
        turns = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64]))
        faults, seen = [], set()
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append(2 if not body else 3 if (role, text) in seen else int(body[-1] not in ".!?"))
            seen.add((role, text))
        initials = [r[1][:1] for r in turns]
        cost, audit, kept = _cheapest(initials, faults)
        lines = [f"{ {'u': 'user', 'a': 'assistant'}[x] if x else turns[i][1]}:{turns[i][2] if i >= 0 else ''}" for i, x in kept]
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def _reported(spark, rows, schema="conv_id long, turn long, role string, text string", parts=3, block=conversation_repair.ROWS):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return sorted((tuple(r) for r in conversation_repair.report(conversation_repair.damage(df), df, block).collect()), key=str)


TEXTS = ["Yes.", "No!", "Why? ", "cut off", "", " \n", "Yes. No", "x.\t", None, "Ünï 日本。"]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_repair_against_search(spark, block):
    r = random.Random(block)
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(r.randint(1, 6)):
            rows.append((conv, None if r.random() < 0.06 else turn + r.randrange(2), r.choice(ROLES), r.choice(TEXTS)))
    rows += [rows[3], rows[3], rows[40]]
    assert _reported(spark, rows, block=block) == _plain_report(rows, [x[0] for x in rows])


def test_blocks_lead_into_each_other():
    """A long run of turns in blocks of any size gives what one block gives."""
    r = random.Random(7)
    for _ in range(200):
        n = r.randint(1, 30)
        initials, faults, counts = [r.choice("usaxua") for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)], [r.choice([1, 1, 3]) for _ in range(n)]
        whole = conversation_repair.walk(initials, counts, faults, conversation_repair.AT_END, 0, True)
        cuts = sorted(r.sample(range(1, n), min(n - 1, r.randint(0, 4)))) if n > 1 else []
        spans = list(zip([0, *cuts], [*cuts, n], strict=True))
        rows = [(1, 0, b, initials[i:j], counts[i:j], faults[i:j]) for b, (i, j) in enumerate(spans)]
        names = ["conv_id", "part", "block", "initials", "counts", "faults"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        matrices = next(conversation_repair._matrices([conversation_repair._rows(rows, names, types)]))
        togo = {b: (tuple(v), last) for _, _, b, v, last in zip(*[c.to_pylist() for c in next(conversation_repair._backward([matrices.take(pa.array(range(len(rows))[::-1]))])).columns], strict=True)}
        state, audit, cost, kept = 0, "", 0, []
        for (_, _, b, *block), (i, _) in zip(rows, spans, strict=True):
            a, turns, c, state = conversation_repair.walk(*block, togo[b][0], state, togo[b][1])
            audit, cost, kept = audit + a, cost + c, kept + [(k + i if k >= 0 else k, x) for k, x in turns]
        assert (audit, cost, kept) == (whole[0], whole[2], whole[1])


def test_one_long_conversation_in_blocks(spark):
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "No", f"Text {t}.", f"Cut {t}"])) for t in range(3000)] + [(1, 5000, "user", "Same.")] * 2500
    (conv, gaps, blank, repeats, truncated, illegal, cost, audit, digest) = _reported(spark, rows, parts=5, block=100)[0]
    damaged = []
    for _, t, role, text in rows:
        kind = zlib.crc32(f"1:{t}".encode()) % 20
        damaged += [(t, "user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text))] * {0: 0, 3: 2}.get(kind, 1)
    damaged.sort()
    seen, faults = set(), []
    for _, role, text in damaged:
        faults.append(2 if not text else 3 if (role, text) in seen else int(text[-1] not in ".!?"))
        seen.add((role, text))
    a, kept, c, _ = conversation_repair.walk([x[1][0] for x in damaged], [1] * len(damaged), faults, conversation_repair.AT_END, 0, True)
    lines = [f"{conversation_repair.ROLES[x] if x else damaged[i][1]}:{damaged[i][2] if i >= 0 else ''}" for i, x in kept]
    assert (blank, repeats, truncated, cost, audit) == (faults.count(2), faults.count(3), faults.count(1), c, a)
    assert digest == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_of_nothing_and_with_other_columns(spark):
    assert _reported(spark, []) == []
    rows = [(4, 1, "user", "Hi.", 1, "x"), (4, 2, "assistant", "Ho.", None, None), (None, None, None, None, None, None)]
    assert _reported(spark, rows, "conv_id long, turn long, role string, text string, n int, fault string") == _plain_report([x[:4] for x in rows], [x[0] for x in rows])


# --- mixing of repeated ids, and sharding by a plain tree --------------------------------------------------------------------


@pytest.mark.parametrize("same_text", [False, True])
def test_mixed_documents_follow_the_mix(spark, same_text):
    from pyspark.sql import functions as F

    from quirefold.llm import mixing

    r = random.Random(11)
    rows = []
    for i in range(2000):
        n = 20 if same_text else r.choice([0, 1, 3, 8, 20, 60])
        rows.append((None if i % 50 == 0 else i // 2 if not same_text else i // 700, " ".join(["w"] * n) if n or i % 3 else None, r.choice(["a", "b", "c", None]), i, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, size string")
    taken = mixing.mix(docs)
    words = lambda df, c: {x["source"]: x["n"] for x in df.groupBy("source").agg(F.sum(c).alias("n")).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert words(mixed, mixing.count_words(F.col("text"))) == words(taken, F.col("taken"))
    assert mixed.where("text IS NULL OR text = ''").count() == docs.where("text IS NULL OR text = ''").count()
